"""Layout elements of pages: figures matched by bounding boxes, narratives around figures, reading order and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 7
_SIDES = ("x", "y", "width", "height")


def box_candidates(figures: DataFrame, elements: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Pairs of figures and elements of one document whose boxes differ by at most the tolerance on every side.

    Both have doc_id, x, y, width, height (rounded) and a number, `figure_no` and `element_no`. The band is an equi join on
    document and grid cell: an element is in the cells of its left and lower edge and their neighbours, a figure in its own, so
    that no pairs but near ones are compared.
    """
    cell = lambda c: F.floor(F.col(c) / (tolerance + 1))
    near = lambda c: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(c) + d)
    f = figures.select("doc_id", "figure_no", *[F.col(c).alias(f"f_{c}") for c in _SIDES], cell("x").alias("cx"), cell("y").alias("cy"))
    e = elements.select("doc_id", "element_no", *_SIDES, F.explode(near("x")).alias("cx"), near("y").alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")
    close = [F.abs(F.col(c) - F.col(f"f_{c}")) <= tolerance for c in _SIDES]
    return f.join(e, ["doc_id", "cx", "cy"]).where(close[0] & close[1] & close[2] & close[3]).select("doc_id", "figure_no", "element_no")


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over pairs sorted by document, figure and element; what is kept is the taken elements of one document."""
    doc, figure, done, taken = None, None, False, set()
    for pdf in batches:
        rows = []
        for d, f, e in zip(pdf["doc_id"], pdf["figure_no"], pdf["element_no"]):
            if d != doc:
                doc, figure, taken = d, None, set()
            if f != figure:
                figure, done = f, False
            if not done and e not in taken:
                taken.add(e)
                done = True
                rows.append((d, f, e))
        yield pd.DataFrame(rows, columns=["doc_id", "figure_no", "element_no"])


def assigned_boxes(candidates: DataFrame) -> DataFrame:
    """Each figure's first candidate that no figure before it has taken. A document's near pairs are read in order, not gathered."""
    ordered = candidates.repartition("doc_id").sortWithinPartitions("doc_id", "figure_no", "element_no")
    return ordered.mapInPandas(_greedy, "doc_id bigint, figure_no bigint, element_no bigint")


def narratives(elements: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, figure_no, context): texts and image markers of a figure's page in order, its own image marked apart, tables left out.

    elements: doc_id, page, element_no, text, image; figures: doc_id, page, figure_no, element_no. A page without elements gives NULL.
    """
    rows = figures.select("doc_id", "page", "figure_no", F.col("element_no").alias("own")).join(elements, ["doc_id", "page"], "left")
    image = F.col("image").isNotNull() & ~F.lower("image").contains("tables")
    name = F.element_at(F.split("image", "/"), -1)
    marker = F.when(F.col("element_no") == F.col("own"), F.concat(F.lit("<IMAGE INTERESTED>"), name, F.lit("</IMAGE INTERESTED>"))).otherwise(F.concat(F.lit("<OTHER IMAGE>"), name, F.lit("</OTHER IMAGE>")))
    said = F.array_compact(F.array(F.nullif("text", F.lit("")), F.when(image, marker)))
    parts = rows.select("doc_id", "figure_no", F.struct("element_no", said.alias("said")).alias("s"))
    joined = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s.said)), " ")
    return parts.groupBy("doc_id", "figure_no").agg(F.nullif(joined, F.lit("")).alias("context"))


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements numbered by page, top and left, missing ones as 0, with the elements before and after."""
    w = W.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), F.coalesce("top", F.lit(0.0)), F.coalesce("left", F.lit(0.0)), "element_no")
    return elements.select("*", F.row_number().over(w).alias("place"), F.lag("element_no").over(w).alias("before"), F.lead("element_no").over(w).alias("after"))


def neighbours(elements: DataFrame, k: int = 2) -> DataFrame:
    """The elements up to k places before and after on the same page, in order."""
    w = W.partitionBy("doc_id", "page").orderBy("element_no").rowsBetween(-k, k)
    return elements.withColumn("near", F.array_join(F.transform(F.collect_list("element_no").over(w), lambda x: x.cast("string")), ","))


def position_info(elements: DataFrame, flagged: Column) -> DataFrame:
    """Index, total, and flagged elements before and after each, in order of place."""
    w = W.partitionBy("doc_id").orderBy("element_no")
    n = flagged.cast("bigint")
    upto = F.sum(n).over(w)
    whole = W.partitionBy("doc_id")
    return elements.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("index"), F.count("*").over(whole).alias("total"), (upto - n).alias("flagged_before"), (F.sum(n).over(whole) - upto).alias("flagged_after"))


def captions_after(elements: DataFrame, is_figure: Column, is_caption: Column) -> DataFrame:
    """(doc_id, element_no, caption_no): the first caption after each figure, as of reading order; NULL if none follows."""
    w = W.partitionBy("doc_id").orderBy("element_no").rangeBetween(1, W.unboundedFollowing)
    return elements.withColumn("caption_no", F.first(F.when(is_caption, F.col("element_no")), ignorenulls=True).over(w)).where(is_figure).select("doc_id", "element_no", "caption_no")


def bookmarks(elements: DataFrame) -> DataFrame:
    """(doc_id, title, page): headings of levels one to four with a text; pages count from one."""
    return elements.where(F.col("path").rlike("H[1-4]") & F.col("text").isNotNull()).select("doc_id", F.col("text").alias("title"), (F.col("page") + 1).alias("page"))


def in_page_duplicates(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_no, tag, text) that repeat an earlier one of their document: same tag and trimmed text, long texts by hash."""
    text = F.trim("text")
    sign = F.concat("tag", F.lit(":"), F.when(F.length(text) > 100, F.md5(text)).otherwise(text))
    ranked = blocks.withColumn("sign", sign).where(text != "").withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "sign").orderBy("block_no")))
    return ranked.where("copy > 1").select("doc_id", "block_no", "copy")

