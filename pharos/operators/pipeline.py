"""Jobs, logs, usage and files around an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pharos.functions.text import base_name, log_fields

EVENTS = "struct<Records: array<struct<eventSource: string, s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>>"


def latest_status(*logs: DataFrame) -> DataFrame:
    """(file, status) of the last message of each file over all log groups (ts, message); other messages are ignored."""
    rows = logs[0]
    for x in logs[1:]:
        rows = rows.unionByName(x)
    told = rows.select("ts", log_fields(F.col("message")).alias("f")).select("ts", "f.*").where(F.col("file") != "")
    return told.groupBy("file").agg(F.max_by("status", F.struct("ts", "status")).alias("status"))


def log_filter(logs: DataFrame, pattern: str = ".*") -> DataFrame:
    return logs.where(F.col("message").rlike(pattern))


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, stage, status, updates, history) from events (job_id, ts, event_id, stage, status); history in order of time."""
    entry = F.struct("ts", "event_id", "stage", "status")
    told = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.concat(e.stage, F.lit(":"), e.status)), ">")
    last = F.max(entry)
    return events.groupBy("job_id").agg(last.alias("l"), F.count("*").alias("updates"), told.alias("history")).select("job_id", "l.stage", "l.status", "updates", "history")


def batch_rollup(files: DataFrame, job: str) -> DataFrame:
    """Files processed, succeeded and failed of each job, their issues, and the merged counts by severity."""
    n = lambda s: F.count_if(F.col("status") == s)
    return files.groupBy(job).agg(F.count("*").alias("processed"), n("completed").alias("succeeded"), n("failed").alias("failed"), *[F.sum(c).alias(c) for c in ("critical", "major", "minor")])


def upload_gate(keys: DataFrame, done: DataFrame, prefix: str = "uploads/") -> DataFrame:
    """Keys (key) to process: under the prefix, a PDF, not nested deeper, and without an output of their name in `done` (name)."""
    name = F.substring("key", len(prefix) + 1, 100_000)
    ok = F.col("key").startswith(prefix) & F.lower("key").endswith(".pdf") & ~name.contains("/")
    return keys.where(ok).withColumn("name", name).join(done.select("name").distinct(), "name", "left_anti")


def object_events(payloads: DataFrame) -> DataFrame:
    """(bucket, key) of the records of storage events that have both; a body that is no such event gives none."""
    records = payloads.select(F.explode(F.from_json("body", "Records array<struct<eventSource: string, s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>")["Records"]).alias("r"))
    rows = records.where(F.col("r.eventSource") == "aws:s3").select(F.col("r.s3.bucket.name").alias("bucket"), F.coalesce(F.try_url_decode(F.replace("r.s3.object.key", F.lit("+"), F.lit(" "))), F.col("r.s3.object.key")).alias("key"))
    return rows.where((F.col("bucket") != "") & (F.col("key") != ""))


def issue_files(issues: DataFrame, files: DataFrame) -> DataFrame:
    """(issue_id, file_id): files an issue belongs to, by path, else file name, else page number, else the first file if it has none of them.

    A cascade of equi joins, each for what the ones before left over; an issue may go to several files of one name.
    """
    first = files.agg(F.min_by("file_id", F.struct("path", "file_id")).alias("file_id"))
    by_path = issues.join(files.select("file_id", "path"), issues["file_path"] == files["path"]).select("issue_id", "file_id")
    left = issues.join(by_path, "issue_id", "left_anti")
    named = files.select("file_id", base_name(F.col("path")).alias("name"))
    by_name = left.withColumn("name", F.coalesce(F.nullif(base_name(F.coalesce("file_path", F.lit(""))), F.lit("")), "file_name")).join(named, "name").select("issue_id", "file_id")
    left = left.join(by_name, "issue_id", "left_anti")
    numbered = files.select("file_id", F.regexp_extract(base_name(F.col("path")), r"(?i)page[_-]?(\d+)\.html$", 1).try_cast("int").alias("page_number"))
    by_page = left.join(numbered, "page_number").select("issue_id", "file_id")
    left = left.join(by_page, "issue_id", "left_anti").where(F.col("file_path").isNull() & F.col("file_name").isNull() & F.col("page_number").isNull())
    rest = left.select("issue_id", F.lit(1).alias("k")).join(F.broadcast(first.withColumn("k", F.lit(1))), "k").select("issue_id", "file_id")
    return by_path.unionByName(by_name).unionByName(by_page).unionByName(rest)


def ordered_files(files: DataFrame) -> DataFrame:
    """Files by the page number in their name, those without one last (999), then by path."""
    n = F.coalesce(F.regexp_extract(base_name(F.col("path")), r"(?i)page[_-]?(\d+)\.html$", 1).try_cast("int"), F.lit(999))
    return files.withColumn("page_key", n).withColumn("place", F.row_number().over(W.partitionBy("folder").orderBy("page_key", "path")))


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key; of equally common ones the first in order."""
    return rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def image_only(pages: DataFrame) -> DataFrame:
    """(doc_id, image_only): whether no page of a document has any text."""
    return pages.groupBy("doc_id").agg((~F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "")).alias("image_only"))
