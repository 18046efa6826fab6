"""Queries of the text, layout, job, log and usage operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.functions import text as X
from pharos.operators import layout, pipeline, reports
from pharos.runtime import cut, table
from pharos.streaming import streams


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("ts", "event_type", F.concat(F.lit("File: user_"), "user_id", F.lit(".pdf, Status: "), "event_type", F.lit(" "), "event_id").alias("message"))


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    logs = _logs(spark, d)
    return pipeline.latest_status(*[logs.where(F.pmod(F.hash("event_type"), F.lit(4)) == i).select("ts", "message") for i in range(4)])


def log_filter(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.log_filter(_logs(spark, d), "user_[0-9]*7\\.pdf, Status: p").select("message")


def latest_status_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stream over the folder's event file, run to its end; the same SQL holds as for the batch form."""
    import uuid

    from pharos.runtime import checkpoint_dir

    stream = streams.file_stream(spark, d, _events(spark, d).schema, glob="events*.parquet")
    logs = stream.select("ts", F.concat(F.lit("File: user_"), "user_id", F.lit(".pdf, Status: "), "event_type", F.lit(" "), "event_id").alias("message"))
    name = f"latest_{uuid.uuid4().hex}"
    return streams.run_once(streams.latest_status(logs), name, f"{checkpoint_dir(spark)}/{name}")


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("user_id").alias("job_id"), "ts", "event_id", F.element_at(F.array(*map(F.lit, ("html", "audit", "remediate", "package"))), (F.col("event_id") % 4 + 1).cast("int")).alias("stage"), F.col("event_type").alias("status"))


def job_state(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.job_state(_job_events(spark, d)).drop("history")


def job_history(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.job_state(_job_events(spark, d)).select("job_id", "history")


def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    files = o.select(F.col("o_custkey").alias("job"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), *[(F.col("o_orderkey") % m).alias(c) for c, m in (("critical", 3), ("major", 5), ("minor", 7))])
    return pipeline.batch_rollup(files, "job")


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    calls = e.select((F.col("user_id") % 3).cast("string").alias("model_id"), F.col("event_type").alias("purpose"), X.token_estimate(F.col("props")).alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"))
    return reports.usage(calls)


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    keys = X.chunk_keys(F.col("file_key"), F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(keys).alias("n", "chunk")).select("doc_id", "n", "chunk", X.merged_key(F.col("chunk")).alias("merged"))


def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    keys = docs.select(F.col("file_key").alias("key")).distinct()
    done = docs.where(F.col("source") == "guideline").select(X.base_name(F.col("file_key")).alias("name"))
    return pipeline.upload_gate(keys, done).select("key", "name")


def object_events(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"Records":[{"eventSource":"'), F.when(F.col("doc_id") % 3 == 0, "other").otherwise("aws:s3"), F.lit('","s3":{"bucket":{"name":"b"},"object":{"key":"in/'), F.col("doc_id"), F.lit('+a%20b.pdf"}}}]}')))
    return pipeline.object_events(docs.select(body.alias("body")))


def issue_file_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    files = part.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("out/"), F.col("p_size"), F.lit("/page-"), F.col("p_partkey"), F.lit(".html")).alias("path"))
    k = F.col("p_partkey")
    issues = part.select(
        k.alias("issue_id"),
        F.when(k % 4 == 0, F.concat(F.lit("out/"), F.col("p_size"), F.lit("/page-"), k, F.lit(".html"))).when(k % 4 == 1, F.concat(F.lit("/tmp/x/page-"), k, F.lit(".html"))).alias("file_path"),
        F.lit(None).cast("string").alias("file_name"), F.when(k % 4 == 2, k.cast("int")).alias("page_number"),
    )
    return pipeline.issue_files(issues, files)


def file_order(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    files = part.select(F.col("p_brand").alias("folder"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/Page_"), "p_partkey", F.lit(".HTML"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a/page"), "p_partkey", F.lit(".html"))).otherwise(F.concat(F.lit("a/x"), "p_partkey", F.lit(".html"))).alias("path"))
    return pipeline.ordered_files(files).select("folder", "path", "page_key", "place")


def dominant_language(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.dominant(table(spark, d, "documents").where(F.col("source").isNotNull()), "source", "lang")


def image_only(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.image_only(table(spark, d, "image_data").select(F.col("file_key").alias("doc_id"), F.col("next").alias("text")))


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    names = table(spark, d, "part").select(F.col("p_brand").alias("folder"), "p_partkey", F.concat(F.lit("fig"), F.col("p_partkey"), F.lit("part"), F.col("p_size"), F.lit(".png")).alias("name"))
    return names.select("name", F.row_number().over(W.partitionBy("folder").orderBy(X.natural_key(F.col("name")))).alias("place"))


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem")
    doc, n = F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint")
    side = {"x": (F.col("l_partkey") % 40), "y": (F.col("l_suppkey") % 30), "width": F.lit(50).cast("bigint"), "height": (n % 9)}
    figures = rows.select(doc, n.alias("figure_no"), *[c.alias(k) for k, c in side.items()])
    elements = rows.select(doc, n.alias("element_no"), *[(c + (7 if k == "x" else 0)).alias(k) for k, c in side.items()])
    return figures, elements


def bbox_join(spark: SparkSession, d: str) -> DataFrame:
    return layout.box_candidates(*_boxes(spark, d))


def bbox_assignment(spark: SparkSession, d: str) -> DataFrame:
    return layout.assigned_boxes(layout.box_candidates(*_boxes(spark, d)))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("bigint")
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), (n % 2).alias("page"), n.alias("element_no"), F.when(n % 3 != 0, F.concat(F.lit("t"), n)).alias("text"),
        F.when(n % 3 == 0, F.concat(F.when(n % 2 == 0, "figures/").otherwise("tables/"), F.lit("i"), n, F.lit(".png"))).alias("image"), (F.col("l_partkey") % 5).cast("double").alias("top"), F.col("l_quantity").alias("left"),
    )


def figure_context(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    figures = e.where((F.col("element_no") % 3 == 0)).select("doc_id", "page", F.col("element_no").alias("figure_no"), "element_no")
    return layout.narratives(e.select("doc_id", "page", "element_no", "text", "image"), figures)


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_elements(spark, d)).select("doc_id", "element_no", "place", "before", "after")


def neighbour_elements(spark: SparkSession, d: str) -> DataFrame:
    return layout.neighbours(_elements(spark, d)).select("doc_id", "element_no", "near")


def position_info(spark: SparkSession, d: str) -> DataFrame:
    return layout.position_info(_elements(spark, d), F.col("image").isNotNull()).select("doc_id", "element_no", "index", "total", "flagged_before", "flagged_after")


def caption_asof(spark: SparkSession, d: str) -> DataFrame:
    return layout.captions_after(_elements(spark, d), F.col("image").isNotNull(), F.col("element_no") % 2 == 1)


def dedup_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    blocks = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("block_no", "text")).withColumn("tag", F.lit("p"))
    return layout.in_page_duplicates(blocks).groupBy("doc_id").agg(F.count("*").alias("removed"))


def title_context(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    context = X.title_context(F.split("text", "\n\n"))
    return docs.select("doc_id", X.word_count(F.get(F.split("text", "\n\n"), F.lit(0))).alias("words"), F.length(context).alias("chars"))


def filename_sanitise(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("p_brand"), F.lit("  #1 &"), F.col("p_name"), F.lit("__?.pdf "))
    return table(spark, d, "part").select("p_partkey", X.safe_file_name(name).alias("name"))


def stage_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("in/"), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, ".pdf").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", X.stage_key(key, "audit").alias("own"), X.stage_key(key, "audit", "json").alias("json"))


def alt_cleaner(spark: SparkSession, d: str) -> DataFrame:
    alt = F.concat(F.lit('"'), F.element_at(F.array(F.lit("Image of "), F.lit("photo  OF "), F.lit("a ")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lower("p_name"), F.lit('.."'))
    return table(spark, d, "part").select("p_partkey", X.clean_alt(alt).alias("alt"))


def header_ids(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" x"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.header_id(text, F.col("p_size")).alias("header_id"), X.normal_header(text).alias("normal"))


def remediation_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.remediation_totals(table(spark, d, "remediation_detail").dropDuplicates(["detail_id"]), "severity")


def unified_issue_set(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_issue").dropDuplicates(["issue_key"])
    rows = a.select(F.col("run_id").alias("report"), F.when(F.col("issue_key") % 4 != 0, F.col("id")).alias("id"), "type", "severity", "selector", F.lit(None).cast("string").alias("element"), F.when(F.col("issue_key") % 10 == 0, "#/issues/0").alias("ref"), (F.col("issue_key") % 3).alias("src"), F.col("issue_key").alias("pos"))
    return reports.first_by_id(rows).groupBy("report").agg(F.count("*").alias("issues"), F.sum("pos").alias("pos"))


def audit_delta(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "audit_issue").dropDuplicates(["issue_key"]).where(F.col("type").isNotNull())
    return reports.delta(a.where(F.col("run_id") % 2 == 0), a.where(F.col("run_id") % 2 == 1), "type")


QUERIES = {
    f.__name__: f
    for f in (
        latest_status, log_filter, latest_status_stream, job_state, job_history, batch_rollup, usage_rollup, token_estimate, chunk_plan, upload_gate, object_events, issue_file_match, file_order,
        dominant_language, image_only, natural_sort, bbox_join, bbox_assignment, figure_context, reading_order, neighbour_elements, position_info, caption_asof, dedup_blocks, title_context,
        filename_sanitise, stage_keys, alt_cleaner, header_ids, remediation_totals, unified_issue_set, audit_delta,
    )
}

_LATEST = "SELECT 'user_' || user_id || '.pdf' AS file, arg_max(event_type || ' ' || event_id, (ts, event_type || ' ' || event_id)) AS status FROM events GROUP BY user_id"
_JOBS = "WITH e AS (SELECT user_id AS job_id, ts, event_id, ['html', 'audit', 'remediate', 'package'][event_id % 4 + 1] AS stage, event_type AS status FROM events)"
_EL = """WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, CAST(l_linenumber AS BIGINT) AS element_no, CASE WHEN l_linenumber % 3 <> 0 THEN 't' || l_linenumber END AS text,
  CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'figures/' ELSE 'tables/' END || 'i' || l_linenumber || '.png' END AS image, CAST(l_partkey % 5 AS DOUBLE) AS top, l_quantity AS "left" FROM lineitem)"""
_BOX = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS no, l_partkey % 40 AS x, l_suppkey % 30 AS y, l_linenumber % 9 AS h FROM lineitem"
ORACLE = {
    "latest_status": _LATEST,
    "latest_status_stream": _LATEST,
    "log_filter": "SELECT message FROM (SELECT 'File: user_' || user_id || '.pdf, Status: ' || event_type || ' ' || event_id AS message FROM events) WHERE regexp_matches(message, 'user_[0-9]*7\\.pdf, Status: p')",
    "job_state": f"{_JOBS} SELECT job_id, arg_max(stage, (ts, event_id)) AS stage, arg_max(status, (ts, event_id)) AS status, count(*) AS updates FROM e GROUP BY job_id",
    "job_history": f"{_JOBS} SELECT job_id, string_agg(stage || ':' || status, '>' ORDER BY ts, event_id) AS history FROM e GROUP BY job_id",
    "batch_rollup": "SELECT o_custkey AS job, count(*) AS processed, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(sum(o_orderkey % 3) AS BIGINT) AS critical, CAST(sum(o_orderkey % 5) AS BIGINT) AS major, CAST(sum(o_orderkey % 7) AS BIGINT) AS minor FROM orders GROUP BY o_custkey",
    "usage_rollup": """
WITH c AS (SELECT CAST(user_id % 3 AS VARCHAR) AS m, event_type AS p, CASE WHEN coalesce(length(props), 0) = 0 THEN 0 ELSE greatest(1, length(props) // 4) END AS i, event_id % 50 AS o FROM events)
SELECT CASE grouping(m) * 2 + grouping(p) WHEN 1 THEN 'model' WHEN 2 THEN 'purpose' ELSE 'all' END AS "by", coalesce(m, p, '') AS key, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens
FROM c GROUP BY GROUPING SETS ((m), (p), ())""",
    "token_estimate": "SELECT doc_id, CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents",
    "chunk_plan": """
WITH k AS (SELECT doc_id, regexp_replace(regexp_extract(file_key, '[^/]*$'), '\\.[^.]*$', '') AS name, unnest(range(CAST(ceil(n_chars / 200.0) AS BIGINT))) AS n FROM documents WHERE n_chars > 0 AND file_key IS NOT NULL)
SELECT doc_id, CAST(n AS INT) AS n, 'temp/' || name || '/' || name || '_chunk_' || (n + 1) || '.pdf' AS chunk, 'temp/' || name || '/' || name || '.pdf' AS merged FROM k""",
    "upload_gate": """
SELECT DISTINCT file_key AS key, substr(file_key, 9) AS name FROM documents WHERE starts_with(file_key, 'uploads/') AND lower(file_key) LIKE '%.pdf' AND substr(file_key, 9) NOT LIKE '%/%'
AND file_key NOT IN (SELECT file_key FROM documents WHERE source = 'guideline' AND file_key IS NOT NULL)""",
    "object_events": "SELECT 'b' AS bucket, 'in/' || doc_id || ' a b.pdf' AS key FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0",
    "issue_file_match": "SELECT p_partkey AS issue_id, CASE WHEN p_partkey % 4 = 3 THEN (SELECT arg_min(p_partkey, 'out/' || p_size || '/page-' || p_partkey || '.html') FROM part) ELSE p_partkey END AS file_id FROM part",
    "file_order": """
WITH f AS (SELECT p_brand AS folder, CASE p_partkey % 3 WHEN 0 THEN 'a/Page_' || p_partkey || '.HTML' WHEN 1 THEN 'a/page' || p_partkey || '.html' ELSE 'a/x' || p_partkey || '.html' END AS path, CASE WHEN p_partkey % 3 = 2 THEN 999 ELSE CAST(p_partkey AS INT) END AS page_key FROM part)
SELECT folder, path, page_key, CAST(row_number() OVER (PARTITION BY folder ORDER BY page_key, path) AS INT) AS place FROM f""",
    "dominant_language": "WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL) SELECT source, lang FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1",
    "image_only": "SELECT file_key AS doc_id, NOT bool_or(trim(coalesce(\"next\", ''), ' ') <> '') AS image_only FROM image_data GROUP BY file_key",
    "natural_sort": "SELECT 'fig' || p_partkey || 'part' || p_size || '.png' AS name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_size) AS INT) AS place FROM part",
    "bbox_join": f"WITH b AS ({_BOX}) SELECT f.doc_id, f.no AS figure_no, e.no AS element_no FROM b f JOIN b e ON f.doc_id = e.doc_id AND abs(f.x - e.x - 7) <= 7 AND abs(f.y - e.y) <= 7 AND abs(f.h - e.h) <= 7",
    "figure_context": f"""{_EL} SELECT f.doc_id, f.element_no AS figure_no, nullif(string_agg(CASE WHEN e.text IS NOT NULL THEN e.text WHEN e.image LIKE '%tables%' THEN NULL WHEN e.element_no = f.element_no THEN '<IMAGE INTERESTED>' || regexp_extract(e.image, '[^/]*$') || '</IMAGE INTERESTED>'
  ELSE '<OTHER IMAGE>' || regexp_extract(e.image, '[^/]*$') || '</OTHER IMAGE>' END, ' ' ORDER BY e.element_no), '') AS context FROM e f JOIN e ON e.doc_id = f.doc_id AND e.page = f.page WHERE f.element_no % 3 = 0 GROUP BY ALL""",
    "reading_order": f"{_EL} SELECT doc_id, element_no, CAST(row_number() OVER w AS INT) AS place, lag(element_no) OVER w AS before, lead(element_no) OVER w AS after FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page, top, \"left\", element_no)",
    "neighbour_elements": f"{_EL} SELECT doc_id, element_no, (SELECT string_agg(x, ',') FROM (SELECT unnest(l) AS x)) AS near FROM (SELECT doc_id, element_no, list(element_no) OVER (PARTITION BY doc_id, page ORDER BY element_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM e)",
    "position_info": f"{_EL} SELECT doc_id, element_no, row_number() OVER w - 1 AS index, count(*) OVER (PARTITION BY doc_id) AS total, CAST(sum(CASE WHEN image IS NULL THEN 0 ELSE 1 END) OVER w - CASE WHEN image IS NULL THEN 0 ELSE 1 END AS BIGINT) AS flagged_before, CAST(sum(CASE WHEN image IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) - sum(CASE WHEN image IS NULL THEN 0 ELSE 1 END) OVER w AS BIGINT) AS flagged_after FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY element_no)",
    "caption_asof": f"{_EL} SELECT f.doc_id, f.element_no, (SELECT min(c.element_no) FROM e c WHERE c.doc_id = f.doc_id AND c.element_no > f.element_no AND c.element_no % 2 = 1) AS caption_no FROM e f WHERE f.image IS NOT NULL",
    "dedup_blocks": "WITH b AS (SELECT doc_id, trim(unnest(string_split(text, '. ')), ' ') AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, t, count(*) - 1 AS extra FROM b WHERE t <> '' GROUP BY ALL) SELECT doc_id, CAST(sum(extra) AS BIGINT) AS removed FROM n GROUP BY doc_id HAVING sum(extra) > 0",
    "title_context": r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ps, len(list_filter(regexp_split_to_array(coalesce(ps[1], ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM p)
SELECT doc_id, CAST(words AS INT) AS words, CAST(length(CASE WHEN words >= 50 OR len(ps) <= 1 THEN ps[1] ELSE trim(ps[1] || chr(10) || chr(10) || coalesce(ps[2], '') || chr(10) || chr(10) || coalesce(ps[3], ''), ' ') END) AS INT) AS chars FROM w""",
    "filename_sanitise": r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(replace(p_brand || '  #1 &' || p_name || '__?.pdf ', ' ', '_'), '__+', '_', 'g'), '[#%&{}\\<>*?/$!''"":@+`|=]', '_', 'g'), '_'), ''), 'document') AS name FROM part",
    "stage_keys": "SELECT s_suppkey, 'audit/' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN '.pdf' ELSE '.html' END AS own, 'audit/' || s_name || '.json' AS json FROM supplier",
    "alt_cleaner": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'A ' || lower(p_name) ELSE upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) END AS alt FROM part",
    "header_ids": r"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'th-' || p_size WHEN 1 THEN 'th-header-' || p_size ELSE 'th-' || left(regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '-', 'g'), 20) END AS header_id,
CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_size || ' x' ELSE trim(regexp_replace(regexp_replace(lower(p_name), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) END AS normal FROM part""",
    "remediation_totals": """
WITH r AS (SELECT DISTINCT detail_id, severity, type, remediation_status AS s FROM remediation_detail)
SELECT severity, count(*) FILTER (s IN ('remediated', 'failed')) AS processed, count(*) FILTER (s = 'remediated') AS remediated, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s IS NULL OR s NOT IN ('remediated', 'failed')) AS skipped,
coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (s = 'failed'), '') AS failed_types FROM r GROUP BY severity""",
    "unified_issue_set": """
WITH a AS (SELECT DISTINCT issue_key, run_id, id, type, severity, selector FROM audit_issue),
k AS (SELECT run_id, issue_key, issue_key % 3 AS src, coalesce(nullif(CASE WHEN issue_key % 4 <> 0 THEN id END, ''), coalesce(type, 'unknown') || '-' || coalesce(severity, 'unknown') || '-' || coalesce(selector, '')) AS i FROM a WHERE issue_key % 10 <> 0),
f AS (SELECT run_id, i, arg_min(issue_key, (src, issue_key)) AS pos FROM k GROUP BY ALL)
SELECT run_id AS report, count(*) AS issues, CAST(sum(pos) AS BIGINT) AS pos FROM f GROUP BY run_id""",
    "audit_delta": """
WITH a AS (SELECT DISTINCT issue_key, run_id, type FROM audit_issue WHERE type IS NOT NULL)
SELECT type, count(*) FILTER (run_id % 2 = 0) AS before, count(*) FILTER (run_id % 2 = 1) AS after, count(*) FILTER (run_id % 2 = 1) - count(*) FILTER (run_id % 2 = 0) AS change FROM a GROUP BY type""",
}
