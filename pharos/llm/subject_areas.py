"""Subject areas of documents by latent semantic analysis.

1. Terms: document frequencies over all documents. Every term of `LEAST` documents counts, however small the share of its
   language or subject; it is weighted by its inverse document frequency.
2. Embedding: truncated singular value decomposition of the document-term matrix by subspace iteration. A pass multiplies
   the rows where they are; what is summed across the cluster is one matrix of vocabulary x dimensions.
3. Seeds: sentences of hand-labelled documents, one centroid for each language and subject, and one for none of them.
4. Refinement: sentences of all documents go to the centroid of the largest cosine, those of labelled documents at first
   only to their own labels or none, and centroids are taken anew.
5. A document treats the subjects of at least `TREATED` of its sentences; sentences of test items are left aside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.llm.eval_leaks import _slices, words
from pharos.llm.languages import label_code
from pharos.runtime import arrow_batches, cut, one_row, spread

TREATED = 0.2
#: Least number of documents that a term must be in; one of fewer says nothing of others.
LEAST = 3
DIMENSIONS, SVD_STEPS = 64, 4
#: Refinements with labelled documents kept to their labels, and after that without.
HELD_STEPS, FREE_STEPS = 3, 2
#: Share of adjacent words that a sentence has in common with test items, from which it is one of theirs.
OF_ITEMS = 0.35
#: Most labelled documents that seed the centroids; a bound on the classifier's sample, taken by hash of the id.
MOST_LABELLED = 100_000
NONE = "none"

_TAG = re.compile(r"<[^<>]*>")
_ENDS = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def doc_sentences(text: str, items: set[tuple[str, str]]) -> list[list[str]]:
    """Words of each sentence in lower case, without markup; pieces of under three words go to the one before, sentences of test items are left out."""
    clean = html.unescape(_TAG.sub(" ", text))
    pieces: list[str] = []
    for p in _ENDS.split(clean):
        if not p or not p.strip():
            continue
        if pieces and len(_WORD.findall(p)) < 3:
            pieces[-1] += " " + p
        else:
            pieces.append(p)
    out = []
    for p in pieces:
        ws = words(p)
        if len(ws) > 1 and sum(map(items.__contains__, zip(ws, ws[1:]))) >= OF_ITEMS * (len(ws) - 1):
            continue
        own = [w.lower() for w in _WORD.findall(p)]
        if len(own) >= 3:
            out.append(own)
    return out


def _split(told) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = told.value
        for pdf in batches:
            if pdf.empty:
                continue
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "code": pdf["code"], "sentences": [[" ".join(s) for s in doc_sentences(t, items)] for t in pdf["text"]]})

    return f


class Space:
    """Term weights and, once found, the term vectors."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.vectors: np.ndarray | None = None

    def embed(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sentences, given as term ids one after the other and where each ends, among the latent dimensions, of length one; zero if without a term."""
        out = np.zeros((len(ends), self.vectors.shape[1]), np.float32)
        begins = np.r_[0, ends[:-1]].astype(np.int64)
        some = ends > begins
        if some.any():
            x = np.add.reduceat(self.vectors[ids] * self.idf[ids][:, None], begins[some], axis=0)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            out[some] = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return out


def vocabulary(texts: DataFrame) -> tuple[dict[str, int], Space]:
    """Terms by id and their weights over all documents; it grows with the distinct words of the corpus."""
    total = texts.count()
    ws = texts.select(F.explode(F.array_distinct(F.flatten(F.transform("sentences", lambda s: F.split(s, " "))))).alias("term"))
    rows = ws.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= LEAST).orderBy("term").collect()
    return {r["term"]: i for i, r in enumerate(rows)}, Space(np.log((1 + total) / (1 + np.array([r["df"] for r in rows], float))).astype(np.float32))


def encoded(texts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, code, labels, ids, ends): term ids of each document's sentences one after the other, and where each sentence ends; written once."""
    told = texts.sparkSession.sparkContext.broadcast(terms)

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = told.value
        for pdf in batches:
            if pdf.empty:
                continue
            ids, ends = [], []
            for own in pdf["sentences"]:
                flat: list[int] = []
                to: list[int] = []
                for sentence in own:
                    flat += [i for w in sentence.split(" ") if (i := terms.get(w)) is not None]
                    to.append(len(flat))
                ids.append(flat)
                ends.append(to)
            yield pdf.drop(columns="sentences").assign(ids=ids, ends=ends)

    return cut(texts.select("doc_id", "code", "labels", "sentences").mapInPandas(f, "doc_id bigint, code string, labels array<string>, ids array<int>, ends array<int>"))


#: Term ids that are looked at together.
CHUNK = 50_000


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in runs of documents of about `CHUNK` terms; a longer document is a run of its own."""
    if len(pdf):
        run = np.cumsum([len(x) for x in pdf["ids"]]) // CHUNK
        for _, part in pdf.groupby(run, sort=False):
            yield part


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of arrays given as (block, values) rows, blocks summed apart."""

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if pdf.empty:
                continue
            for v in pdf["values"]:
                total = np.array(v, np.float64) if total is None else total + v
        yield pd.DataFrame({"block": [key[0]], "values": [total]})

    out = np.zeros(int(np.prod(shape)))
    size = max(1, -(-len(out) // 64))
    for r in parts.groupBy("block").applyInPandas(add, "block int, values array<double>").toLocalIterator():
        v = np.array(r["values"])
        out[r["block"] * size : r["block"] * size + len(v)] = v
    return out.reshape(shape)


def _in_blocks(total: np.ndarray) -> pd.DataFrame:
    flat = total.ravel()
    size = max(1, -(-len(flat) // 64))
    return pd.DataFrame({"block": range(-(-len(flat) // size)), "values": [flat[i : i + size] for i in range(0, len(flat), size)]})


def decompose(texts: DataFrame, space: Space, dimensions: int = DIMENSIONS, steps: int = SVD_STEPS) -> Space:
    """Finds the leading right singular vectors of the weighted document-term matrix and gives them to `space`."""
    sc = texts.sparkSession.sparkContext
    n = len(space.idf)
    k = min(dimensions, n)
    if not k:
        space.vectors = np.zeros((0, 1), np.float32)
        return space
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((n, k)))[0]
    for _ in range(steps):
        told = sc.broadcast((space.idf, q.astype(np.float32)))

        def f(batches: Iterator[pd.DataFrame], told=told) -> Iterator[pd.DataFrame]:
            idf, q = told.value
            total = np.zeros(q.shape, np.float64)
            for pdf in batches:
                for part in _chunks(pdf):
                    # counts of (document, term), damped and weighted, each document of length one
                    doc = np.repeat(np.arange(len(part)), [len(x) for x in part["ids"]])
                    if not len(doc):
                        continue
                    pairs, count = np.unique(doc.astype(np.int64) * n + np.concatenate(part["ids"].to_numpy()), return_counts=True)
                    doc, term = np.divmod(pairs, n)
                    x = ((1 + np.log(count)) * idf[term]).astype(np.float32)
                    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    size = np.diff(np.r_[begins, len(doc)])
                    x /= np.repeat(np.maximum(np.sqrt(np.add.reduceat(x * x, begins)), 1e-12), size)
                    y = np.add.reduceat(x[:, None] * q[term], begins, axis=0)
                    order = np.argsort(term, kind="stable")
                    back = (x[:, None] * np.repeat(y, size, axis=0))[order]
                    at = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0])
                    total[term[order][at]] += np.add.reduceat(back, at, axis=0)
            yield _in_blocks(total)

        z = _summed(texts.select("ids").mapInPandas(f, "block int, values array<double>"), (n, k))
        q, r = np.linalg.qr(z)
        told.unpersist()
    space.vectors = q.astype(np.float32)
    return space


class Classifier:
    """Centroids by (language, class); class 0 is no subject."""

    def __init__(self, space: Space, subjects: list[str], codes: list[str]):
        self.space, self.subjects, self.codes = space, subjects, codes
        self.centroids = np.zeros((len(codes), len(subjects) + 1, space.vectors.shape[1]), np.float32)

    def classes(self, x: np.ndarray, codes: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(language, class) of each embedded sentence by the largest cosine; a sentence without a known term is of no subject.

        `codes`: the language of each sentence's document by its label, or -1. `allowed`: which classes each may have.
        """
        shape = self.centroids.shape
        cos = (x @ self.centroids.reshape(-1, shape[2]).T).reshape(len(x), shape[0], shape[1])
        cos[:, ~np.any(self.centroids, axis=2)] = -2
        if allowed is not None:
            cos = np.where(allowed[:, None, :], cos, -2)
        best = cos.max(axis=2).argmax(axis=1)
        # the document's label is a hint only: a sentence nearer to another language's centroids by far is in that language
        hinted = np.flatnonzero((codes >= 0) & (best == codes))
        cos[hinted, codes[hinted]] += 0.15
        lang, cls = np.divmod(cos.reshape(len(x), -1).argmax(axis=1), shape[1])
        cls[~np.any(x, axis=1)] = 0
        return lang, cls

    def sentences(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document by place, language of its label, embedding) of each sentence of some documents."""
        sizes = [len(x) for x in part["ids"]]
        offset = np.cumsum(sizes) - sizes
        ends = np.concatenate([np.asarray(e, np.int64) + o for e, o in zip(part["ends"], offset)] or [np.zeros(0, np.int64)])
        doc = np.repeat(np.arange(len(part)), [len(e) for e in part["ends"]])
        code = np.array([self.codes.index(c) if c in self.codes else -1 for c in part["code"]], np.int64)
        return doc, code[doc], self.space.embed(np.concatenate(part["ids"].to_numpy()).astype(np.int64), ends)


def _taught(told, first: bool, hold: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Classifier = told.value
        place = {s: i + 1 for i, s in enumerate(model.subjects)}
        total = np.zeros(model.centroids.shape, np.float64)
        for pdf in batches:
            for part in _chunks(pdf):
                doc, code, x = model.sentences(part)
                if not len(doc):
                    continue
                own = [None if labels is None else [place[s] for s in labels if s in place] for labels in part["labels"]]
                if first:  # in the language of the document's label; documents of several subjects weigh little, but some classes have no others
                    for d in np.unique(doc[code >= 0]):
                        if own[d] is not None:
                            for c in own[d] or [0]:
                                total[code[doc == d][0], c] += x[doc == d].sum(axis=0) / max(1, len(own[d])) ** 3
                    continue
                allowed = None
                if hold:
                    allowed = np.ones((len(part), len(place) + 1), bool)
                    for d, cs in enumerate(own):
                        if cs is not None:
                            allowed[d] = False
                            allowed[d, [0, *cs]] = True
                    allowed = allowed[doc]
                lang, cls = model.classes(x, code, allowed)
                keep = np.ones(len(doc), bool) if hold else np.array([labels is None or len(labels) > 0 for labels in part["labels"]])[doc]
                np.add.at(total, (lang[keep], cls[keep]), x[keep])
        yield _in_blocks(total)

    return f


def fit_subjects(texts: DataFrame, space: Space, subjects: list[str], codes: list[str]) -> Classifier:
    """Centroids from labelled documents, refined on all documents."""
    sc = texts.sparkSession.sparkContext
    model = Classifier(space, subjects, codes)
    labelled = cut(texts.where(F.col("labels").isNotNull()))
    for step in range(1 + HELD_STEPS + FREE_STEPS):
        rows = labelled if step <= HELD_STEPS else texts
        told = sc.broadcast(model)
        total = _summed(rows.select("code", "ids", "ends", "labels").mapInPandas(_taught(told, step == 0, step <= HELD_STEPS), "block int, values array<double>"), model.centroids.shape)
        told.unpersist()
        norm = np.linalg.norm(total, axis=2, keepdims=True)
        fresh = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0).astype(np.float32)
        fresh[norm[:, :, 0] == 0] = model.centroids[norm[:, :, 0] == 0]  # a class nothing went to stays where it was
        model.centroids = fresh
    return model


def _shares(told) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Classifier = told.value
        names = np.array([NONE, *model.subjects], object)
        for pdf in batches:
            for part in _chunks(pdf):
                doc, code, x = model.sentences(part)
                if not len(doc):
                    continue
                cls = model.classes(x, code)[1]
                of = np.bincount(doc, minlength=len(part))
                pair, n = np.unique(doc * len(names) + cls, return_counts=True)
                d, c = np.divmod(pair, len(names))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[d], "subject": names[c], "sentences": n, "of": of[d]})

    return f


def subject_shares(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, subject, sentences, of): sentences of each subject in each document; `none` for those of no subject.

    Documents with a null or empty text, or of test items alone, have no rows. Labels of unknown documents, null labels and
    labels outside the areas are ignored; a document labelled `none` treats no subject.
    """
    spark: SparkSession = documents.sparkSession
    arrow_batches(spark)
    pairs = {p for rows in _slices(items) for r in rows for ws in [words(r["text"])] for p in zip(ws, ws[1:])}
    subjects = sorted({r["subject"] for r in areas.select("subject").where(F.col("subject").isNotNull()).distinct().collect()})
    source = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", label_code(F.col("lang")).alias("code"), "text")
    source = one_row(source, "doc_id")
    told = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin([*subjects, NONE])).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    told = told.orderBy(F.xxhash64("doc_id")).limit(MOST_LABELLED).select("doc_id", F.filter("labels", lambda s: s != NONE).alias("labels"))
    texts = cut(spread(source).mapInPandas(_split(spark.sparkContext.broadcast(pairs)), "doc_id bigint, code string, sentences array<string>").join(F.broadcast(told), "doc_id", "left"))
    terms, space = vocabulary(texts)
    texts = encoded(texts, terms)
    space = decompose(texts, space)
    codes = sorted(r["code"] for r in texts.where(F.col("code").isNotNull()).select("code").distinct().collect()) or ["?"]
    model = fit_subjects(texts, space, subjects, codes)
    told = spark.sparkContext.broadcast(model)
    return texts.select("doc_id", "code", "ids", "ends").mapInPandas(_shares(told), "doc_id bigint, subject string, sentences int, of int")


def treated_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, subject) of the subjects that at least a fifth of a document's sentences treat."""
    shares = subject_shares(documents, labels, areas, items)
    return shares.where((F.col("subject") != NONE) & (F.col("sentences") >= TREATED * F.col("of"))).select("doc_id", "subject")
