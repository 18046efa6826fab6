"""Text functions over names made of the parts' numbers and sizes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.functions import text
from pharos.operators import reports
from pharos.runtime import table

EXTENSIONS = (".png", ".JPG", ".pdf", ".svg", ".x")
COLOURS = ("#000000", "#ffffff", "#777777", "#808080", "grey")


def _pick(values: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image paths, content types, patterns and titles of file names."""
    path = F.concat(F.lit("out/img_"), F.col("p_partkey"), _pick(EXTENSIONS))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select(
        "p_partkey", text.is_image_path(F.col("path")).alias("is_image"), text.content_type(F.col("path")).alias("content_type"), text.glob_match(F.col("path"), "OUT/*_?1.p*").alias("matches"), text.title_words(F.col("path")).alias("title")
    )


def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from field names, captions, addresses and longer texts."""
    part = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return part.select(
        "p_partkey", text.humanised(F.concat(F.lit("unit_price-"), n)).alias("label"), text.figure_number(F.concat(F.lit("see FIGURE "), n, F.lit(".2 here"))).alias("figure"),
        text.domain(F.concat(F.lit("https://www.shop"), n, F.lit(".test/x"))).alias("domain"), text.common_prefix(F.array(F.concat(F.lit("Item "), k, F.lit(" red")), F.concat(F.lit("Item "), k, F.lit(" blue")))).alias("prefix"),
        text.first_words(F.concat_ws(" ", F.col("p_name"), F.col("p_type"))).alias("first_words"),
    )


def measure_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark colours and shares of repairs in percent."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", text.is_dark(_pick(COLOURS)).alias("is_dark"), reports.percent_remediated(F.col("p_size") % 7, F.col("p_size") % 5).cast("int").alias("percent"))


def failed_types_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of repairs over all runs, from the totals of each, with the union of failed types."""
    details = table(spark, sf_dir, "remediation_detail").select("detail_id", "run_id", "remediation_status", F.lower(F.trim("type")).alias("type")).distinct()
    by_run = reports.remediation_totals(details, "run_id")
    return reports.merged_totals(by_run)


QUERIES = {f.__name__: f for f in (path_functions, label_functions, measure_functions, failed_types_of_files)}
ORACLE = {
    "path_functions": """
WITH f AS (SELECT p_partkey, p_partkey % 5 AS k, 'out/img_' || p_partkey || ['.png', '.JPG', '.pdf', '.svg', '.x'][p_partkey % 5 + 1] AS path FROM part)
SELECT p_partkey, k IN (0, 1) AS is_image, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS content_type,
  regexp_full_match(path, 'out/.*_.1[.]p.*') AS matches, 'Img ' || p_partkey AS title FROM f""",
    "label_functions": r"""
WITH w AS (SELECT *, string_split_regex(trim(p_name || ' ' || p_type), '\s+') AS ws FROM part)
SELECT p_partkey, 'Unit Price ' || p_size AS label, p_size || '.2' AS figure, 'shop' || p_size || '.test' AS domain, 'Item ' || p_partkey AS prefix, array_to_string(ws[1:5], ' ') || CASE WHEN len(ws) > 5 THEN '...' ELSE '' END AS first_words FROM w""",
    "measure_functions": """
SELECT p_partkey, p_partkey % 5 IN (0, 2) AS is_dark, CAST(CASE WHEN p_size % 5 > 0 THEN trunc(100.0 * (p_size % 7) / (p_size % 5)) ELSE 0 END AS INT) AS percent FROM part""",
    "failed_types_of_files": """
WITH d AS (SELECT DISTINCT detail_id, run_id, remediation_status AS status, lower(trim(type)) AS type FROM remediation_detail)
SELECT CAST(count(*) FILTER (status IN ('remediated', 'failed')) AS BIGINT) AS processed, CAST(count(*) FILTER (status = 'remediated') AS BIGINT) AS remediated, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
  CAST(count(*) FILTER (status IS NULL OR status NOT IN ('remediated', 'failed')) AS BIGINT) AS skipped, (SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT DISTINCT type FROM d WHERE status = 'failed' AND type <> '')) AS failed_types FROM d""",
}
