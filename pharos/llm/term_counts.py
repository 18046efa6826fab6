"""Frequency of every distinct value or term over a whole collection.

The operator works in five steps, none of which brings terms to the driver:

1. values: the distinct values of each field as they are written, by one map-side combined aggregation, are brought into
   one form and taken apart into words; from here on nothing is done row by row that can be done value by value;
2. dictionary: the distinct terms, dealt out by range and numbered without gaps in term order;
3. encoding: rows get the integers of their values by a broadcast of checked size or a join in which a value of very many
   rows is salted, and then the integers of the words in them;
4. blocks: occurrences are combined by term and record, and every task adds them into count arrays of `BLOCK` identifiers,
   one for occurrences and one for records, and passes on what isn't zero in them;
5. sum: the arrays are summed by range of identifiers, and lined up with the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pharos.runtime import BROADCAST_ROWS, bounded_broadcast, cut, salted_join

#: Identifiers a count array covers, and blocks a task holds before it passes them on.
BLOCK, HELD_BLOCKS = 1024, 2000

#: White space of any kind: the Unicode property and the four information separators.
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: Read as a hyphen inside a value: white space, underscores, dashes of any kind, minus, soft hyphen, hyphen bullet.
JOINT = r"[\p{IsWhite_Space}\x1c-\x1f_\p{Pd}\u2212\u00ad\u2043]"


def normal_value(c: Column) -> Column:
    """A value without white space around it, in lower case, with `-` for each blank, underscore or dash; empty is NULL."""
    trimmed = F.regexp_replace(c.cast("string"), f"^{BLANK}+|{BLANK}+$", "")
    return F.nullif(F.regexp_replace(F.lower(trimmed), JOINT, "-"), F.lit(""))


def distinct_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field_name, raw, value): the values of `fields` as written and in their one form; null and empty ones are left out."""
    told = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("raw")) for c in fields])
    raws = df.select(F.explode(told).alias("t")).select("t.*").where(F.col("raw").isNotNull()).distinct()
    return raws.withColumn("value", normal_value(F.col("raw"))).where(F.col("value").isNotNull())


def global_dictionary(terms: DataFrame) -> DataFrame:
    """(field_name, unit, term, term_id): the distinct terms, numbered from 0 without gaps in their order.

    Terms are dealt out by range and written once; each part then needs only the number of terms in the
    parts before it, which is one small row per part.
    """
    keys = ["field_name", "unit", "term"]
    parts = cut(terms.select(*keys).distinct().repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(*keys)) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(before), "part").select(*keys, (F.col("inside") + F.col("before")).cast("bigint").alias("term_id"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds (term_id, occurrences, has_record) rows into count arrays by block; of each array, what isn't zero is passed on."""
    held: dict[int, np.ndarray] = {}

    def out() -> pd.DataFrame:
        some = {b: np.flatnonzero(a.any(axis=0)) for b, a in held.items()}
        return pd.DataFrame({"block": list(held), "at": list(some.values()), "occurrences": [held[b][0, i] for b, i in some.items()], "records": [held[b][1, i] for b, i in some.items()]})

    for pdf in batches:
        ids, n, has = (pdf[c].to_numpy(dtype=np.int64) for c in ("term_id", "occurrences", "has_record"))
        order = np.argsort(ids, kind="stable")
        ids, n, has = ids[order], n[order], has[order]
        block = ids // BLOCK
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(ids) else []
        for s, e in zip(starts, [*starts[1:], len(ids)]):
            a = held.setdefault(int(block[s]), np.zeros((2, BLOCK), np.int64))
            np.add.at(a[0], ids[s:e] % BLOCK, n[s:e])
            np.add.at(a[1], ids[s:e] % BLOCK, has[s:e])
            if len(held) > HELD_BLOCKS:
                yield out()
                held.clear()
    if held:
        yield out()


def _summed(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The dense arrays of one range of identifiers, from what the tasks passed on; read batch by batch."""
    total = np.zeros((2, BLOCK), np.int64)
    for pdf in batches:
        for at, occurrences, records in zip(pdf["at"], pdf["occurrences"], pdf["records"]):
            total[0, at] += occurrences
            total[1, at] += records
    some = np.flatnonzero(total[0])
    yield pd.DataFrame({"term_id": some + int(key[0]) * BLOCK, "occurrences": total[0, some], "records": total[1, some]})


def term_frequencies(
    df: DataFrame, record: str, values: list[str], words: list[str], key: str | None = None, min_records: int = 3, max_share: float = 0.5, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(field_name, unit, term, term_id, occurrences, records, mark) of every term of `df`.

    `record` names the record a term is counted in once. `key`, if given, names what a row may be delivered again under:
    the least of its rows counts; rows without a key can't be told apart and all count. `mark` is ``too_rare`` below
    `min_records` distinct records, ``too_common`` above `max_share` of all records, else NULL; a term that is both is too
    rare. Null and empty values don't count; a null record adds occurrences but is no record. An empty table gives no rows.
    """
    known = cut(distinct_values(df, values))
    split = F.explode(F.filter(F.split("value", "-"), lambda w: w != ""))
    worded = known.where(F.col("field_name").isin(words)).select("field_name", "value").distinct().select("field_name", "value", split.alias("term"))
    whole = known.select("field_name", F.lit("value").alias("unit"), F.col("value").alias("term"))
    dictionary = cut(global_dictionary(whole.unionByName(worded.select("field_name", F.lit("word").alias("unit"), "term"))))
    ids = dictionary.where("unit = 'value'").select("field_name", F.col("term").alias("value"), F.col("term_id").alias("value_id"))
    codes = cut(known.join(ids, ["field_name", "value"]).select("field_name", "raw", "value_id"))
    # the words of each value, each as often as it is in it
    word_ids = dictionary.where("unit = 'word'").select("field_name", "term", "term_id")
    parts = worded.join(word_ids, ["field_name", "term"]).join(ids, ["field_name", "value"]).groupBy("value_id", "term_id").agg(F.count("*").alias("times"))

    rows = df.select(*([F.col(key).alias("_key")] if key else []), F.col(record).alias("record"), *[F.col(c).cast("string").alias(f"raw{i}") for i, c in enumerate(values)])
    small = bounded_broadcast(codes, broadcast_rows)[1]
    for i, c in enumerate(values):
        own = codes.where(F.col("field_name") == c).select(F.col("raw").alias(f"raw{i}"), F.col("value_id").alias(f"id{i}"))
        if small:
            rows = rows.join(F.broadcast(own), f"raw{i}", "left")
        else:  # rows without a known value stay beside those that meet it
            met = salted_join(rows, own, [f"raw{i}"], "record")
            rows = met.unionByName(rows.join(own, f"raw{i}", "left_anti").withColumn(f"id{i}", F.lit(None).cast("bigint")))
        rows = rows.drop(f"raw{i}")
    if key:  # only integers are shuffled to tell what came again
        told = F.struct("record", *[f"id{i}" for i in range(len(values))])
        once = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min(told).alias("r")).select("r.*")
        rows = once.unionByName(rows.where(F.col("_key").isNull()).drop("_key"))
    long = rows.select("record", F.explode(F.array(*[F.col(f"id{i}") for i in range(len(values))])).alias("value_id")).where(F.col("value_id").isNotNull())
    by_value = cut(long.groupBy("value_id", "record").agg(F.count("*").alias("n")))
    if bounded_broadcast(parts, broadcast_rows)[1]:
        in_words = by_value.join(F.broadcast(parts), "value_id")
    else:
        in_words = salted_join(by_value, parts, ["value_id"], "record")
    in_words = in_words.groupBy("term_id", "record").agg(F.sum(F.col("n") * F.col("times")).alias("occurrences"))
    coded = by_value.select(F.col("value_id").alias("term_id"), "record", F.col("n").alias("occurrences")).unionByName(in_words)
    coded = coded.select("term_id", "occurrences", F.col("record").isNotNull().cast("bigint").alias("has_record"))

    blocks = coded.mapInPandas(_blocks, "block bigint, at array<int>, occurrences array<bigint>, records array<bigint>")
    counts = blocks.groupBy("block").applyInPandas(_summed, "term_id bigint, occurrences bigint, records bigint")
    total = df.select(F.count_distinct(record).alias("n")).first()["n"]
    mark = F.when(F.col("records") < min_records, "too_rare").when(F.col("records") > max_share * total, "too_common")
    return dictionary.join(counts, "term_id").select("field_name", "unit", "term", "term_id", "occurrences", "records", mark.alias("mark"))


def issue_term_frequencies(issues: DataFrame) -> DataFrame:
    """Terms of `type` and `severity` of an issue table, counted by issue and by audit run; redelivered issues count once."""
    return term_frequencies(issues, "run_id", ["type", "severity"], ["type"], key="issue_key")
