"""Session helpers shared by all operators: checkpoints, parallelism, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that `bounded_broadcast` sends to every executor.
BROADCAST_ROWS = 200_000
#: Largest size in bytes, as JSON, of what it sends.
BROADCAST_BYTES = 64 << 20
#: Parts a key is split into by `salted_join`.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A folder that the context has, or that ``spark.checkpoint.dir`` names, is used as it is. Only where
    neither is set, as in local tests, a temporary folder is made.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pharos-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a compressed table into the checkpoint folder and go on from there: computed once, and safe when executors are lost.

    `DataFrame.checkpoint` runs the last stage twice and writes rows as they are in memory; of a table, each reader takes
    the columns it needs. Partitions aren't kept, see `cut_in_place`. Like checkpoints, the table stays until the folder is emptied.
    """
    to = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def cut_in_place(df: DataFrame) -> DataFrame:
    """Like `cut`, by a checkpoint, for where the next step relies on which rows share a partition."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """Number of partitions `df` would be read in, from the plan alone."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy Python stage enough tasks.

    Input that arrives in fewer partitions than the cluster has cores is dealt out anew; large input,
    which has more partitions than that, stays where it is and isn't shuffled.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if partitions(df) >= want else df.repartition(want, *keys)


def arrow_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound Arrow batches by bytes: single texts may be very long, and a batch must fit into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bounded_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """`small` marked for broadcast if it has at most `limit` rows and `size` bytes, else unmarked; and which of both."""
    told = small.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    fits = told["n"] <= limit and (told["bytes"] or 0) <= size
    return (F.broadcast(small), True) if fits else (small, False)


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], by: str, salts: int = SALTS) -> DataFrame:
    """Inner join in which a key of very many rows of `large` is spread over `salts` tasks by the column `by`; `small` is repeated as often."""
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(many, [*keys, "_salt"]).drop("_salt")


def one_row(df: DataFrame, key: str) -> DataFrame:
    """One row for each `key`: the least of those delivered more than once.

    Only keys are shuffled to find what came again, and only what came again is compared as a whole; all other rows, with
    their texts, stay where they are. Rows without a key can't be told apart and are left out.
    """
    keyed = df.where(F.col(key).isNotNull())
    again, _ = bounded_broadcast(cut(keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)))
    rest = [c for c in df.columns if c != key]
    least = keyed.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return keyed.join(again, key, "left_anti").unionByName(least)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python stages can import it whatever their path."""
    sc = spark.sparkContext
    if getattr(sc, "_pharos_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="pharos-")) / "pharos.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._pharos_shipped = True
