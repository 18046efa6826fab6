"""Roll-ups over the table of issues, remediation results and model calls, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("needs_remediation", "remediated", "auto_remediated", "compliant")
LEVELS = ("critical", "major", "minor", "info")


def _counts(column: str, values: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(v) for v in values]


def audit_summary(issues: DataFrame) -> DataFrame:
    """One row: issues in all, by known status and by known severity; severities count compliant rows too."""
    return issues.agg(F.count("*").alias("total_issues"), *_counts("remediation_status", STATUSES), *_counts("severity", LEVELS))


def by_page(issues: DataFrame) -> DataFrame:
    """Counts by document and page with the issues of the page in order; issues without a page number are a group of their own in each document."""
    page = F.col("location.page_number").alias("page_number")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("issue_seq", "id", "type"))), lambda x: x.id)
    return issues.groupBy("doc_id", page).agg(F.count("*").alias("total"), *_counts("remediation_status", STATUSES), listed.alias("issues"))


def by_status(issues: DataFrame) -> DataFrame:
    return issues.groupBy("remediation_status").agg(F.count("*").alias("total"))


def status_class(status: Column, kind: Column) -> Column:
    """remediated, compliant or non_compliant; a type named compliant counts as such whatever its status."""
    return F.when(status.isin("remediated", "auto_remediated"), "remediated").when((status == "compliant") | kind.startswith("compliant"), "compliant").otherwise("non_compliant")


def unified_counts(issues: DataFrame) -> DataFrame:
    """Counts by severity and by type, each in all and by class, in one pass over grouping sets."""
    rows = issues.select("type", "severity", status_class(F.col("remediation_status"), F.col("type")).alias("class"))
    sets = rows.groupingSets([["severity"], ["type"]], "severity", "type").agg(
        F.grouping("severity").alias("g"), F.count("*").alias("identified"), *[F.count_if(F.col("class") == c).alias(c) for c in ("remediated", "compliant", "non_compliant")]
    )
    return sets.select(F.when(F.col("g") == 0, "severity").otherwise("type").alias("family"), F.when(F.col("g") == 0, F.col("severity")).otherwise(F.col("type")).alias("key"), "identified", "remediated", "compliant", "non_compliant")


def first_by_id(rows: DataFrame) -> DataFrame:
    """Issues told in several sources once each: the one of the first source (`src`), then of the first place (`pos`), by id.

    Without an id, type, severity and selector (or element) stand for it; rows that only refer to another (`ref`) are left out.
    """
    made = F.concat_ws("-", F.coalesce("type", F.lit("unknown")), F.coalesce("severity", F.lit("unknown")), F.coalesce("selector", "element", F.lit("")))
    keyed = rows.where(F.col("ref").isNull()).withColumn("id", F.coalesce(F.nullif("id", F.lit("")), made))
    return keyed.withColumn("rank", F.row_number().over(W.partitionBy("report", "id").orderBy("src", "pos"))).where("rank = 1").drop("rank")


def remediation_totals(details: DataFrame, *keys: str) -> DataFrame:
    """Processed, remediated, failed and skipped issues with the set of failed types, by `keys`; processed isn't their sum, skipped count apart."""
    s = F.col("remediation_status")
    return details.groupBy(*keys).agg(
        F.count_if(s.isin("remediated", "failed")).alias("processed"), F.count_if(s == "remediated").alias("remediated"), F.count_if(s == "failed").alias("failed"),
        F.count_if(~s.isin("remediated", "failed") | s.isNull()).alias("skipped"), F.array_join(F.sort_array(F.collect_set(F.when(s == "failed", F.col("type")))), ",").alias("failed_types"),
    )


def merged_totals(files: DataFrame, *keys: str) -> DataFrame:
    """Totals over files: sums, and the union of the sets of failed types. Types are told apart before they are gathered, so that the list has one entry for each type."""
    sums = files.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("processed", "remediated", "failed", "skipped")])
    types = files.select(*keys, F.explode(F.split("failed_types", ",")).alias("t")).where("t <> ''").distinct()
    union = types.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("t")), ",").alias("failed_types"))
    if not keys:
        return merged_totals(files.withColumn("_all", F.lit(1)), "_all").drop("_all")
    return sums.join(union, list(keys), "left").fillna("", ["failed_types"])


def clamped(summary: DataFrame) -> DataFrame:
    """No more remediated than processed issues where any were processed."""
    return summary.withColumn("remediated", F.when(F.col("processed") > 0, F.least("remediated", "processed")).otherwise(F.col("remediated")))


def percent_remediated(done: Column, total: Column) -> Column:
    return F.when(total > 0, (100 * done / total).cast("int")).otherwise(0)


def delta(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Counts before and after by key; a key may be missing on either side."""
    b, a = before.groupBy(*keys).agg(F.count("*").alias("before")), after.groupBy(*keys).agg(F.count("*").alias("after"))
    return b.join(a, list(keys), "full").fillna(0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by model, by purpose and in all."""
    sets = calls.groupingSets([["model_id"], ["purpose"], []], "model_id", "purpose").agg(
        F.grouping_id().alias("g"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    return sets.select(F.when(F.col("g") == 1, "model").when(F.col("g") == 2, "purpose").otherwise("all").alias("by"), F.coalesce("model_id", "purpose", F.lit("")).alias("key"), "calls", "input_tokens", "output_tokens")


def write_report(issues: DataFrame, path: str, kind: str = "json") -> None:
    """Issues as json, csv, text or html files; an unknown kind is json. Parents are dropped from contexts, and csv cells can't start a formula."""
    flat = issues.drop("nodes")
    if "context" in flat.columns:
        flat = flat.withColumn("context", F.col("context").dropFields("parent"))
    safe = lambda c: F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
    if kind == "csv":
        cols = [safe(F.col(f.name).cast("string")).alias(f.name) if f.dataType.simpleString() == "string" else F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("struct", "map", "array")) else F.col(f.name) for f in flat.schema]
        flat.select(*cols).write.mode("overwrite").csv(path, header=True)
    elif kind == "text":
        flat.select(F.concat_ws("\n", F.concat("id", F.lit(". "), "type"), F.concat(F.lit("Severity: "), "severity"), F.concat(F.lit("Message: "), "description"), F.repeat(F.lit("-"), 80)).alias("value")).write.mode("overwrite").text(path)
    elif kind in ("html", "unified"):
        rows = unified_counts(issues).where("family = 'type'").orderBy("key")
        cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in ("key", "identified", "remediated", "compliant", "non_compliant")], F.lit("</tr>"))
        rows.select(cells.alias("value")).coalesce(1).write.mode("overwrite").text(path)  # one row per issue type
    else:
        flat.write.mode("overwrite").json(path)
