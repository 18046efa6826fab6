"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer, counted once per record into a checkpoint. Sizes by source are small (one row per
source) and go to the driver, where one path leads from them to the mix:

1. exponents: a source's weight is its own share to a power, w = own^x. One power for all sources is found by bisection for
   an entropy or as far as repeats allow (`temperature_weights`); one power can't meet nine independent target shares, so
   each source's power is bisected to its own target (`target_exponents`);
2. caps: a weight that needs more repeats than a source may have is held at its cap, and the source falls short. What it
   can't give is reported as missing and isn't made up for by others beyond their target;
3. budgets in tokens, and their realisation as budgeted block permutations: each pass over a source, whole ones too, is a
   pseudo-random permutation of its records, cut into blocks by hash; whole blocks are taken while the budget lasts, and
   only within the block where it runs out are records counted one by one. `position` orders the whole mix. No source is
   ever gathered in one task.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pharos.runtime import arrow_batches, cut, spread

#: Vocabulary file of the tokenizer, a parameter like the folder it is in, which has no default.
TOKENIZER = "byte_bpe_50k.json"
#: Blocks a permutation of a source has.
BLOCKS = 4096
SEED = 17


def source_key(c: str):
    """Sources are compared trimmed and in lower case; null and blank are no source."""
    return F.nullif(F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", "")), F.lit(""))


def _tokens(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for pdf in batches:
            if pdf.empty:
                continue
            # equal texts are counted once a batch
            texts = {t: 0 for t in pdf["text"] if t}
            for t, e in zip(texts, tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)):
                texts[t] = len(e)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [texts[t] if t else 0 for t in pdf["text"]]})

    return f


def token_sizes(documents: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each document that has a source, in a checkpoint; a null text has no tokens, a document delivered again counts once."""
    arrow_batches(documents.sparkSession)
    source = documents.select("doc_id", source_key("source").alias("source"), "text").where(F.col("source").isNotNull() & F.col("doc_id").isNotNull())
    counted = spread(source).mapInPandas(_tokens(f"{folder}/{tokenizer}"), "doc_id bigint, source string, tokens bigint")
    # texts stay where they are; what came again is told from its counts
    return cut(counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.*"))


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect(ok: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The largest x in [low, high] that is `ok`, where `ok` holds up to some x; `low` if it holds nowhere."""
    if ok(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def _normal(x: dict[str, float]) -> dict[str, float]:
    total = sum(x.values())
    return {k: v / total for k, v in x.items()} if total > 0 else x


def tempered(sizes: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares proportional to the sources' own shares to the power `exponent`: 1 is as they are, 0 all alike."""
    own = _normal({k: float(v) for k, v in sizes.items() if v > 0})
    return _normal({k: v**exponent for k, v in own.items()})


def temperature_weights(sizes: dict[str, int], budget: int, repeats: dict[str, int], target_entropy: float | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, shares). The flattest mix whose entropy is at most the target's and in which no source is repeated too often."""

    def fits(flat: float) -> bool:
        w = tempered(sizes, 1 - flat)
        return all(w[k] * budget <= repeats.get(k, 1) * sizes[k] for k in w) and (target_entropy is None or entropy(w) <= target_entropy)

    flat = bisect(fits, 0.0, 1.0)
    return 1 - flat, tempered(sizes, 1 - flat)


#: Exponents are looked for between these; own shares of a thousandth to the power 40 are nothing.
LEAST_EXPONENT, MOST_EXPONENT = -40.0, 40.0


def target_exponents(own: dict[str, float], target: dict[str, float]) -> dict[str, float | None]:
    """The power of each source's own share that meets its target, by bisection; None where no power does.

    A source without documents, or the only one, has no power; neither has a target of nothing.
    """
    out: dict[str, float | None] = {}
    for k, t in target.items():
        p = own.get(k, 0.0)
        if not 0 < p < 1 or not 0 < t:
            out[k] = None
            continue
        # p^x falls as x grows: the largest x whose weight is still at least the target
        out[k] = bisect(lambda x, p=p, t=t: p**x >= t, LEAST_EXPONENT, MOST_EXPONENT, 100)
    return out


def mix_plan(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One row per source of the targets: its size, exponent, weight, cap, budget in tokens and whether it falls short.

    The total is the size of all documents that have a source, in the targets or not. A source without documents, or a
    null share or repeat (read as 0), has a budget of 0. A source is short if its weight, held at what its repeats give,
    is below its target.
    """
    own = {r["source"]: int(r["tokens"] or 0) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # one row per source
    rows = {r["source"]: r for r in targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull()).orderBy("source", "target_share", "max_repeats").collect()}
    total = sum(own.values())
    share = {k: max(0.0, float(r["target_share"] or 0)) for k, r in rows.items()}
    exponent = target_exponents(_normal({k: float(v) for k, v in own.items()}), share)
    plan = []
    for k in sorted(rows):
        repeats, size = max(0, int(rows[k]["max_repeats"] or 0)), own.get(k, 0)
        # a source that is everything has weight 1 at any power; one that is nothing has none
        wanted = (size / total) ** exponent[k] if exponent[k] is not None else min(1.0, share[k]) if size == total else 0.0
        most = repeats * size / total if total else 0.0
        weight = min(wanted, most)
        plan.append(
            {
                "source": k, "size": size, "target_share": share[k], "max_repeats": repeats, "total": total, "exponent": exponent[k], "weight": weight,
                "budget": int(round(weight * total)), "short": share[k] * total > 0 and weight < share[k] * (1 - 1e-9),
            }
        )
    return plan


def _frame(spark: SparkSession, plan: list[dict]) -> DataFrame:
    schema = "source string, size bigint, target_share double, max_repeats int, total bigint, exponent double, weight double, budget bigint, short boolean"
    return spark.createDataFrame(plan, schema)


def realised(sizes: DataFrame, plan: list[dict], seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """(source, doc_id, repeat, tokens, position) of the mix: each source's records up to its budget, `repeat` from 1.

    Each pass is a permutation of the source's records of its own, whole passes too; the last one takes records while the
    sum before them is below what is left of the budget, and stops before the record that would pass it by more than half
    of that record. `position` (from 0 to 1) is a record's place in the mix: a pass takes up as much of it as it is of the
    source's budget, its records in the order of its permutation, so that all sources run evenly through the mix.
    """
    spark = sizes.sparkSession
    passes = [(r["source"], r["budget"] // r["size"], r["budget"] % r["size"], r["budget"] / r["size"]) for r in plan if r["size"] > 0 and r["budget"] > 0]
    told = F.broadcast(spark.createDataFrame(passes, "source string, whole bigint, rest bigint, passes double"))  # one row per source
    rows = sizes.join(told, "source")
    order = F.xxhash64("doc_id", F.lit(seed), F.col("pass"))
    # the place of a record within its pass: the upper bits of its hash, as a share
    place = (F.pmod(F.shiftright("order", 11), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("place")
    whole = rows.where(F.col("whole") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("pass")).withColumn("order", order).select("*", place)
    last = rows.where(F.col("rest") > 0).withColumn("pass", F.col("whole")).withColumn("order", order).select("*", place).withColumn("block", F.floor(F.col("place") * blocks).cast("int"))
    # one row per source and block; the sums before each block are taken over those
    sums = last.groupBy("source", "block").agg(F.sum("tokens").alias("own"))
    sums = sums.withColumn("before", F.sum("own").over(W.partitionBy("source").orderBy("block")) - F.col("own"))
    last = last.join(sums, ["source", "block"]).where(F.col("before") < F.col("rest"))
    full = last.where(F.col("before") + F.col("own") <= F.col("rest"))
    edge = last.where(F.col("before") + F.col("own") > F.col("rest"))  # one block of each source
    run = F.sum("tokens").over(W.partitionBy("source", "block").orderBy("place", "doc_id"))
    edge = edge.withColumn("sum", F.col("before") + run).where(F.col("sum") - F.col("tokens") / 2 <= F.col("rest"))
    pick = lambda df: df.select("source", "doc_id", (F.col("pass") + 1).alias("repeat"), "tokens", F.least(F.lit(1.0), (F.col("pass") + F.col("place")) / F.col("passes")).alias("position"))
    return pick(whole).unionByName(pick(full)).unionByName(pick(edge))


def mix(documents: DataFrame, targets: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(records of the mix, shares reached).

    shares: (source, size, target_share, exponent, budget, tokens, records, share, short); share is of the tokens of the whole mix.
    """
    sizes = token_sizes(documents, folder, tokenizer)
    plan = mix_plan(sizes, targets)
    records = cut(realised(sizes, plan))
    got = records.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
    told = F.broadcast(_frame(documents.sparkSession, plan)).join(got, "source", "left").fillna(0, ["tokens", "records"])
    all_tokens = records.agg(F.sum("tokens").alias("n")).first()["n"] or 1
    return records, told.select("source", "size", "target_share", "exponent", "budget", "tokens", "records", (F.col("tokens") / all_tokens).alias("share"), "short")


def short_sources(documents: DataFrame, targets: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source) of the targets that can't reach their share."""
    plan = mix_plan(token_sizes(documents, folder, tokenizer), targets)
    return _frame(documents.sparkSession, plan).where("short").select("source")


def tempered_mix(documents: DataFrame, targets: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, size, exponent, share) of the temperature mix whose entropy is that of the target shares, as far as repeats allow."""
    plan = mix_plan(token_sizes(documents, folder, tokenizer), targets)
    sizes = {r["source"]: r["size"] for r in plan}
    repeats = {r["source"]: r["max_repeats"] for r in plan}
    goal = entropy(_normal({r["source"]: r["target_share"] for r in plan if r["target_share"] > 0}))
    exponent, w = temperature_weights(sizes, sum(sizes.values()), repeats, goal)
    return documents.sparkSession.createDataFrame([(k, sizes[k], exponent, w.get(k, 0.0)) for k in sorted(sizes)], "source string, size bigint, exponent double, share double")
