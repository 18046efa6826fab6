"""Missing or wrong language labels, and texts in several languages.

The n-gram model of the languages is fitted on the texts themselves by expectation-maximisation: it begins with the
labels as delivered, right or wrong, and then takes each sentence for what the model before made of it. Its counts
have a fixed size (languages x buckets) and are the only thing that comes to the driver. Every text is then a mixture
of languages (see `languages.mixture`), cut into segments of sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharos.llm.languages import BUCKETS, CODES, LanguageModel, bucket_counts, label_code, segments, sentences, telling_words
from pharos.llm.scan_lines import JOIN
from pharos.llm.scan_noise import labelled
from pharos.runtime import cut

#: Passes after the first, which takes the labels as they are.
EM_STEPS = 2
#: A sentence counts for a language from this posterior probability.
SURE = 0.9


#: Words with a digit or sign among their letters: misread, so that their pieces tell no language.
_MISREAD = re.compile(r"\w*(?:[^\W\d_][\d@]|[\d@][^\W\d_])[\w@]*")


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        own = [sentences(t.replace(JOIN, "")) for t in pdf["body"]]
        yield pdf.drop(columns="body").assign(sentences=own, telling=[[" ".join(telling_words(_MISREAD.sub(" ", s))) for s in ss] for ss in own])


#: Distinct words of a language that a task holds before it turns them into n-gram counts.
HELD_WORDS = 300_000
#: Buckets whose counts are summed as one array.
RANGE = 4096


def _counts(codes: tuple[str, ...], model: LanguageModel | None, words_of: Callable[[str], list[str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(codes), BUCKETS), np.float64)
        held = [Counter() for _ in codes]
        for pdf in batches:
            if pdf.empty:
                continue
            if model is None:
                for code, own in zip(pdf["code"], pdf["sentences"]):
                    if code in codes:
                        for s in own:
                            held[codes.index(code)].update(words_of(s))
            else:
                texts = [(code, words_of(s)) for code, own in zip(pdf["code"], pdf["sentences"]) for s in own]
                if not texts:
                    continue
                x = model.all_scores([ws for _, ws in texts])
                x = np.exp(x - x.max(axis=1, keepdims=True))
                sure = x.max(axis=1) / x.sum(axis=1) >= SURE
                for (code, ws), best, ok in zip(texts, x.argmax(axis=1).tolist(), sure.tolist()):
                    if ok:
                        held[best].update(ws)
                    elif code in codes:  # else its words would be lost to all languages
                        held[codes.index(code)].update(ws)
            if max(map(len, held)) > HELD_WORDS:
                total += bucket_counts(held)
                held = [Counter() for _ in codes]
        parts = (total + bucket_counts(held)).reshape(-1, RANGE)
        some = np.flatnonzero(parts.any(axis=1))
        if len(some):
            yield pd.DataFrame({"part": some, "counts": list(parts[some])})

    return f


def _sum(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(RANGE)
    for pdf in batches:
        for c in pdf["counts"]:
            total += c
    yield pd.DataFrame({"part": [key[0]], "counts": [total]})


def fit_languages(texts: DataFrame, codes: tuple[str, ...] = CODES, steps: int = EM_STEPS, words_of: Callable[[str], list[str]] = telling_words) -> LanguageModel:
    """The language model of texts given as (code, sentences); `code` may be NULL or wrong. `words_of` gives a sentence's telling words."""
    model = None
    for _ in range(steps + 1):
        parts = texts.select("code", "sentences").mapInPandas(_counts(codes, model, words_of), "part int, counts array<double>")
        # languages x buckets numbers, summed by range of buckets: a fixed size for the driver, and many groups for the tasks
        rows = parts.groupBy("part").applyInPandas(_sum, "part int, counts array<double>").collect()
        counts = np.zeros((len(codes) * BUCKETS // RANGE, RANGE))
        for r in rows:
            counts[r["part"]] = r["counts"]
        model = LanguageModel(codes, counts.reshape(len(codes), BUCKETS))
    return model


def _segments(model: LanguageModel, with_text: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            rows = []
            x = model.all_scores([s.split() for own in pdf["telling"] for s in own])
            at = 0
            for image_id, field, code, telling, own in zip(pdf["image_id"], pdf["field_name"], pdf["code"], pdf["telling"], pdf["sentences"] if with_text else pdf["telling"]):
                n = len(telling)
                if n == 0:
                    continue
                found = segments(x[at : at + n])
                at += n
                for k, (lang, first, last, sure) in enumerate(found, 1):
                    rows.append((image_id, field, code, k, model.codes[lang], sure, len(found), " ".join(own[first : last + 1]) if with_text else None))
            yield pd.DataFrame(rows, columns=["image_id", "field_name", "label_code", "segment_no", "lang_code", "confidence", "segments", "text"])

    return f


def language_segments(images: DataFrame, with_text: bool = False) -> DataFrame:
    """(image_id, field_name, label_code, segment_no, lang_code, confidence, segments, text) of `current` and `context`.

    One row for each longest run of sentences in one language. Headers, page numbers and markers are taken out before, and
    divided words put together; misread words stay, as the other n-grams outweigh theirs. `text` is NULL unless asked for.
    A text without a full sentence, null or empty, has none; label_code is NULL where the label names no language.
    """
    texts = labelled(images).where(F.col("field_name").isin("current", "context")).select("image_id", "field_name", label_code(F.col("label")).alias("code"), "body")
    whole = "image_id bigint, field_name string, code string, sentences array<string>, telling array<string>"
    texts = cut(texts.mapInPandas(_sentences, whole))
    schema = "image_id bigint, field_name string, label_code string, segment_no bigint, lang_code string, confidence double, segments int, text string"
    model = fit_languages(texts.select("code", F.col("telling").alias("sentences")), words_of=str.split)
    return texts.select("image_id", "field_name", "code", "telling", *(["sentences"] if with_text else [])).mapInPandas(_segments(model, with_text), schema)


def wrong_labels(images: DataFrame) -> DataFrame:
    """(image_id, field_name, segment_no, lang_code) of texts whose label names no language or another, or that hold several."""
    found = language_segments(images)
    wrong = F.col("label_code").isNull() | (F.col("label_code") != F.col("lang_code")) | (F.col("segments") > 1)
    return found.where(wrong).select("image_id", "field_name", "segment_no", "lang_code")
