"""Streaming forms of the job and log operators; on the same input they give what the batch forms give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pharos.functions.text import log_fields


def file_stream(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", glob: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as they come, filtered by name, so many at a time."""
    return spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)


def once_by_key(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, whatever is delivered again."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_status(stream: DataFrame) -> DataFrame:
    """The last status of each file so far, for update or complete mode."""
    told = stream.select("ts", log_fields(F.col("message")).alias("f")).select("ts", "f.*").where(F.col("file") != "")
    return told.groupBy("file").agg(F.max(F.struct("ts", "status")).alias("l")).select("file", F.col("l.status").alias("status"))


def chunk_fan_out(stream: DataFrame, keys: str = "chunks") -> DataFrame:
    """One row for each chunk of each document."""
    return stream.withColumn("chunk", F.explode(keys)).drop(keys)


def job_state(stream: DataFrame) -> DataFrame:
    """Current stage and status of each job and its number of updates; only the last entry is kept as state, not the history."""
    return stream.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "stage", "status")).alias("l"), F.count("*").alias("updates")).select("job_id", "l.stage", "l.status", "updates")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the result as a table in memory; for results of a few rows per key."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
