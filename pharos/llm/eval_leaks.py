"""Evaluation texts leaking into training text.

The test items are the index, the training documents the queries. The index is inverted. Its terms are pairs of adjacent
words, which tell far more than words and of which a leaked run keeps most; each term's postings are in the order of items, cut into blocks with the largest BM25 contribution of each. Contributions are divided by the least score
that a leaked run of the item may have, so that one threshold, 1, holds for all items. A passage is looked up with
block-max WAND: cursors on the postings of its terms, a pivot from the terms' maxima, and jumps over blocks whose maxima
can't reach the threshold. All items above it are then aligned word by word with the document, and count as leaked if a run
of at least `RUN` of their words stands there with at most one word in ten changed, added or missing.

Every passage of every document is a query, none is capped; a passage with fewer adjacent pairs of item words than any
leaked run keeps can't hold one of any item, and isn't looked up. The items must be few enough to be sent to all executors
(`MOST_WORDS`, checked); more items are handled in slices of that size, one after the other.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.runtime import arrow_batches, cut, spread

#: Shortest run of item words that counts, and words per allowed edit.
RUN, PER_EDIT = 20, 10
#: Words of a passage and step between passages. The longest run that needn't hold a shorter one has 30 words and 3 edits,
#: so at most 33 words of a document, and lies in one passage wherever it begins.
PASSAGE, STEP = 72, 36
#: Postings of a term in a block.
BLOCK = 32
#: Share of the BM25 score of an item's weakest run of `RUN` words, edits taken off, from which an item is aligned; below 1 for rounding only.
THRESHOLD = 0.999
#: Adjacent pairs of item words that any leaked run keeps (each edit takes two), in so many words of a document.
PAIRS, PAIRS_IN = RUN - 1 - 2 * (RUN // PER_EDIT), 45
#: Item words that one slice of the index holds.
MOST_WORDS = 500_000

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words of a text without markup, entities, case and punctuation."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    return _WORD.findall(text.lower().replace("\u00ad", ""))


class Postings:
    """A term's items, contributions and blocks, with the largest contribution of each block and of all."""

    __slots__ = ("block_max", "items", "scores", "top")

    def __init__(self, items: list[int], scores: list[float]):
        self.items, self.scores = items, scores
        self.block_max = [max(scores[i : i + BLOCK]) for i in range(0, len(scores), BLOCK)]
        self.top = max(self.block_max)


class LeakIndex:
    """An inverted index of items with BM25 weights and block maxima."""

    def __init__(self, items: list[tuple[int, list[str]]], k1: float = 1.2, b: float = 0.3):
        self.ids = [i for i, _ in items]
        self.items = [w for _, w in items]
        n = max(1, len(items))
        mean = sum(map(len, self.items)) / n or 1.0
        terms = [list(zip(ws, ws[1:])) if len(ws) >= RUN else [] for ws in self.items]  # a shorter item can't leak
        counts = [Counter(ts) for ts in terms]
        df = Counter(w for own in counts for w in own)
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        held: dict[tuple[str, str], tuple[list[int], list[float]]] = {}
        for k, (ts, own) in enumerate(zip(terms, counts)):
            norm = k1 * (1 - b + b * len(ts) / mean)
            score = {w: idf[w] * tf * (k1 + 1) / (tf + norm) for w, tf in own.items()}
            least = self._threshold(ts, score)
            for w, x in score.items():
                at, scores = held.setdefault(w, ([], []))
                at.append(k)
                scores.append(x / least)
        self.postings = {w: Postings(at, scores) for w, (at, scores) in held.items()}
        self.pairs = [set(own) for own in counts]

    @staticmethod
    def _threshold(ts: list[tuple[str, str]], own: dict[tuple[str, str], float]) -> float:
        """The least score a leaked run of an item may have, times `THRESHOLD`: the best pairs may be the ones that edits took.

        A run that holds no shorter one has `RUN` words, or half as many more with one edit more.
        """
        least = math.inf
        for run in (RUN, RUN + PER_EDIT):
            lost = 2 * (run // PER_EDIT)
            for i in range(len(ts) - run + 2):
                kept = sorted({t: own[t] for t in ts[i : i + run - 1]}.values())
                least = min(least, sum(kept[: len(kept) - lost]))
        return max(THRESHOLD * least, 1e-12)

    def above(self, passage: list[tuple[str, str]]) -> list[int]:
        """Items whose score over the distinct pairs of a passage reaches their threshold (block-max WAND)."""
        cursors = [[p.items[0], 0, p] for w in dict.fromkeys(passage) if (p := self.postings.get(w)) is not None]
        out: list[int] = []
        while cursors:
            cursors.sort(key=_ITEM)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2].top
                if bound >= 1:
                    pivot = i
                    break
            if pivot < 0:
                break  # all the terms that are left can't reach the threshold
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, end = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
            for c in cursors[: pivot + 1]:
                p, at = c[2], bisect_left(c[2].items, item, c[1])
                if at < len(p.items):
                    block = at // BLOCK
                    bound += p.block_max[block]
                    last = min((block + 1) * BLOCK, len(p.items)) - 1
                    end = min(end, p.items[last] + 1)
            if bound >= 1:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    if c[0] < item:
                        c[1] = bisect_left(c[2].items, item, c[1])
                    if c[1] < len(c[2].items) and c[2].items[c[1]] == item:
                        score += c[2].scores[c[1]]
                        c[1] += 1
                if score >= 1:
                    out.append(item)
            else:  # nothing before the nearest end of these blocks, or the next term's item, can reach it
                end = max(end, item + 1)
                for c in cursors[: pivot + 1]:
                    c[1] = bisect_left(c[2].items, end, c[1])
            for c in cursors[: pivot + 1]:
                c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def candidates(self, doc: list[str]) -> list[int]:
        """Items that may leak into a document: of each passage that can hold a leaked run of any item, those above their threshold."""
        pairs = list(zip(doc, doc[1:]))
        total = [0, *accumulate(map(self.postings.__contains__, pairs))]
        if total[-1] < PAIRS:
            return []
        may: set[int] = set()
        for at in range(0, max(1, len(doc) - STEP), STEP):
            if total[min(at + PASSAGE - 1, len(pairs))] - total[at] >= PAIRS:
                may.update(self.above(pairs[at : at + PASSAGE - 1]))
        return sorted(may)


_ITEM = itemgetter(0)


def leaked_spans(item: list[str], doc: list[str], run: int = RUN, per_edit: int = PER_EDIT) -> list[tuple[int, int, int]]:
    """(first word, last word + 1 in the document, item words) of runs of the item with one edit at most in `per_edit` words.

    For each number of edits up to what the shortest splittable run allows, the longest run ending at each pair of words
    is extended by a match, a changed, a missing or an added word. A run of twice `run` words or more holds one of less
    that meets the condition too, so few edits need to be told apart.
    """
    n = len(doc)
    if n == 0 or len(item) < run:
        return []
    most = (2 * run - 1) // per_edit
    codes = {w: i for i, w in enumerate(set(item))}
    d = np.array([codes.get(w, -1) for w in doc])
    # best[e][j]: item words of the longest run with e edits ending before document word j, times `unit`, plus where it began
    unit, nothing = 1 << 32, -(1 << 60)
    begin = np.full((most + 1, n + 1), nothing, np.int64)
    begin[0] = np.arange(n + 1)
    need = np.array([max(run, e * per_edit) * unit for e in range(most + 1)])[:, None]
    best, shifted = begin.copy(), np.full_like(begin, nothing)
    hits: list[tuple[int, int, int]] = []
    for w in item:
        match = d == codes[w]
        shifted[:, 1:] = best[:, :-1] + unit
        new = begin.copy()
        new[:, 1:] = np.where(match, np.maximum(new[:, 1:], shifted[:, 1:]), new[:, 1:])
        np.maximum(new[1:], shifted[:-1], out=new[1:])  # changed
        np.maximum(new[1:], best[:-1] + unit, out=new[1:])  # missing
        for e in range(1, most + 1):  # added
            np.maximum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])
        if match.any():
            found = (new[:, 1:] >= need) & match
            if found.any():
                for e, j in zip(*np.nonzero(found)):
                    v = int(new[e, j + 1])
                    hits.append((v % unit, int(j) + 1, v // unit))
        best = new
    merged: list[tuple[int, int, int]] = []
    for s, t, k in sorted(hits):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(t, merged[-1][1]), max(k, merged[-1][2]))
        else:
            merged.append((s, t, k))
    return merged


def near_pairs(pairs: set[tuple[str, str]], doc: list[str]) -> list[tuple[int, int]]:
    """Stretches of the document in which enough of an item's adjacent words stand for a leaked run, with room around them."""
    hit = np.array([p in pairs for p in zip(doc, doc[1:])], np.int32)
    if hit.sum() < PAIRS:
        return []
    total = np.r_[0, np.cumsum(hit)]
    at = np.arange(len(hit))
    dense = np.flatnonzero(total[np.minimum(at + PAIRS_IN, len(hit))] - total[at] >= PAIRS)
    out: list[tuple[int, int]] = []
    for i in dense.tolist():
        s, t = max(0, i - 5), min(len(doc), i + PAIRS_IN + 5)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], t)
        else:
            out.append((s, t))
    return out


def _search(told) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, answers = told.value
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ws = words(text)
                for k in index.candidates(ws):
                    spans = [(s + a, s + b, n) for s, t in near_pairs(index.pairs[k], ws) for a, b, n in leaked_spans(index.items[k], ws[s:t])]
                    if spans:
                        answer = answers.get(index.ids[k]) or []
                        has = bool(answer) and any(ws[i : i + len(answer)] == answer for i in range(len(ws) - len(answer) + 1))
                        rows.append((doc_id, index.ids[k], [{"first": s, "last": t} for s, t, _ in spans], max(x[2] for x in spans), has))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "spans", "item_words", "has_answer"])

    return f


def _slices(items: DataFrame) -> Iterator[list]:
    """The items in slices whose words fit into one index."""
    held, size = [], 0
    for r in items.select("item_id", "text", "answer").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        held.append(r)
        size += len(words(r["text"])) + 1
        if size > MOST_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, spans, item_words, has_answer): every leaked item of every document.

    `spans` are the word positions of the leaked runs, `has_answer` tells whether the item's answer stands in the document
    too. Items shorter than a run can't leak; null texts have no words; redelivered items count once; documents without an
    id are left out. Without items or documents there are no rows.
    """
    spark: SparkSession = documents.sparkSession
    arrow_batches(spark)
    schema = "doc_id bigint, item_id bigint, spans array<struct<first int, last int>>, item_words int, has_answer boolean"
    source = spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))
    out = None
    for rows in _slices(items):
        once = {r["item_id"]: r for r in rows}
        index = LeakIndex([(k, words(r["text"])) for k, r in sorted(once.items())])
        told = spark.sparkContext.broadcast((index, {k: words(r["answer"] or "") for k, r in once.items()}))  # of a checked number of words
        part = source.mapInPandas(_search(told), schema)
        out = part if out is None else cut(out).unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out.dropDuplicates(["doc_id", "item_id"])
