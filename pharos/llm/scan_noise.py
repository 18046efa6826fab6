"""Noise in text from scanned pages: divided words, misread characters, running headers, page numbers.

Order of work, all statistics over all rows:

1. lines are counted by publication; that a line comes back in its publication, or lines of its make-up do so
   elsewhere, is a feature of it;
2. the layout features of all lines of all texts refit the hidden Markov model of line roles;
3. the model labels the lines, and the texts are put together from those that are text;
4. words of the running text are counted, with their case and label; a word that a much commoner one turns into
   by confusions of characters is its misreading; a divided word keeps its hyphen if it is met so;
5. what was found is attached to the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pharos.llm.languages import label_code
from pharos.llm.scan_lines import _MARKER, HYPHENS, JOIN, PARAMETERS, LineModel, confusions, header_key, line_features, number_form, reassembled, shapes, skip_templates
from pharos.runtime import BROADCAST_ROWS, arrow_batches, bounded_broadcast, cut, one_row, salted_join, spread

FIELDS = ("prev", "current", "next", "context")
#: A misreading by one and by two confusions is at most this share of the right word's number; words of letters alone may be words of their own.
MOST_SHARE, MOST_SHARE_TWICE = 0.1, 0.01
#: Shares of prints of a make-up that agree within publications, from which it comes back partly and nearly always.
AGREE, AGREE_NEARLY = 0.5, 0.85
#: Share of the publications with a make-up in which it comes back, from which it is that of headers.
COMES_BACK = 0.3
#: Share of a publication's images with a line, from which it is a header though no other publication has one like it.
OWN_SHARE = 0.05
EM_STEPS = 3
#: Distinct lines or words that a task holds before it passes their counts on.
HELD = 300_000
#: What words are made of here; `@` is met in misread ones.
_TOKEN = re.compile(rf"[\w@]+(?:(?:['’{HYPHENS}]|{JOIN}[{HYPHENS}])[\w@]+)*")
#: A word with a capital that doesn't begin a sentence.
_INSIDE = re.compile(r"(?<![\sA-ZÀ-ÖØ-Þ.!?…:;()\[\]\"'«»“”„–—-]) ([^\W\d_a-zß-öø-ÿ][\w@]*)")
_IN_MARKS = re.compile(r"<[^<>]*>[^<>]*</[^<>]*>")


def _recurring_keys(text: str) -> set[str]:
    return {k for line in set(text.split("\n")) if (s := line.strip()) and not ("<" in s and _MARKER.match(s)) and number_form(s) in (0, 4) and (k := header_key(s))}


def _line_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts the images of each publication that each line is in, per task."""
    held: Counter = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame([(f, k, n) for (f, k), n in held.items()], columns=["file_key", "key", "n"])

    for pdf in batches:
        for f, *texts in zip(pdf["file_key"], *[pdf[c] for c in FIELDS]):
            keys: set[str] = set()
            for t in texts:
                if t:
                    keys |= _recurring_keys(t)
            held.update((f, k) for k in keys)
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _templates(known) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = known.value if known is not None else None
        for pdf in batches:
            rows = [(h, f, k, n) for f, k, n in zip(pdf["file_key"], pdf["key"], pdf["n"]) for t in skip_templates(k) for h in (_hash(t),) if have is None or h in have]
            yield pd.DataFrame(rows, columns=["template", "file_key", "key", "n"])

    return f


def recurring_lines(images: DataFrame) -> DataFrame:
    """(file_key, key, recurs): lines that come back in their publication, by place in the feature `recurs`.

    For every make-up (a line with one word left open) and publication, the prints are counted and those of its
    commonest line. A make-up is one that comes back if, over all publications with several prints, prints agree;
    section headings have one make-up but change within a publication. Only make-ups of lines that come back anywhere can
    be such, so only those are looked for among the others.
    """
    spark = images.sparkSession
    found = images.select("file_key", *FIELDS).mapInPandas(_line_counts, "file_key string, key string, n bigint")
    # the images of one publication and line are counted, not gathered: one row for each, however many images
    lines = cut(found.groupBy("file_key", "key").agg(F.sum("n").alias("n")))
    schema = "template bigint, file_key string, key string, n bigint"
    twice = lines.where("n > 1").mapInPandas(_templates(None), schema).select("template").distinct()
    small = twice.limit(BROADCAST_ROWS + 1).collect()  # hashes, of a checked number
    if len(small) <= BROADCAST_ROWS:
        by = lines.mapInPandas(_templates(spark.sparkContext.broadcast({r["template"] for r in small})), schema)
    else:
        by = lines.mapInPandas(_templates(None), schema).join(twice, "template", "left_semi")
    by = cut(by)
    prints = by.groupBy("template", "file_key").agg(F.sum("n").alias("prints"), F.max("n").alias("top"))
    made = prints.groupBy("template").agg(
        F.sum(F.when(F.col("prints") > 1, F.col("top") - 1)).alias("same"), F.sum(F.when(F.col("prints") > 1, F.col("prints") - 1)).alias("pairs"),
        F.sum((F.col("prints") > 1).cast("int")).alias("files"), F.count("*").alias("all_files"),
    )
    # a make-up that comes back in few of its publications may be a sentence that does so by chance
    headers = made.where((F.col("files") >= 2) & (F.col("same") >= AGREE * F.col("pairs")) & (F.col("files") >= COMES_BACK * F.col("all_files")))
    headers = headers.select("template", F.when(F.col("same") >= AGREE_NEARLY * F.col("pairs"), 3).otherwise(2).alias("recurs"))
    # the word left open tells the publications apart; one of several lines of a make-up in a publication must lead
    good = prints.join(headers, "template").select("template", "file_key", "prints", "recurs")
    share = by.join(good, ["template", "file_key"]).where(F.col("n") >= AGREE * F.col("prints"))
    # and a line on a fair part of its publication's pages comes back, whatever others are like
    size = images.groupBy("file_key").agg(F.count("*").alias("images"))
    alone = lines.where("n >= 3").join(size, "file_key").where(F.col("n") >= OWN_SHARE * F.col("images"))
    both = share.select("file_key", "key", "recurs").unionByName(alone.select("file_key", "key", F.lit(1).alias("recurs")))
    return both.groupBy("file_key", "key").agg(F.max("recurs").alias("recurs"))


def _all_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, f, k) for i, f, *texts in zip(pdf["image_id"], pdf["file_key"], *[pdf[c] for c in FIELDS]) for k in set().union(*[_recurring_keys(t) for t in texts if t])]
        yield pd.DataFrame(rows, columns=["image_id", "file_key", "key"])


def _features(known) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = known.value if known is not None else None
        none: dict[str, int] = {}
        for pdf in batches:
            own = pdf["recurs"] if back is None else [back.get(f, none) for f in pdf["file_key"]]
            rows = []
            for i, label, keys, *texts in zip(pdf["image_id"], pdf["label"], own, *[pdf[c] for c in FIELDS]):
                if back is None:
                    keys = {r["key"]: r["recurs"] for r in keys} if keys is not None else none
                rows += [(i, label, name, t, line_features(t, keys)[1]) for name, t in zip(FIELDS, texts) if t and t.strip()]
            yield pd.DataFrame(rows, columns=["image_id", "label", "field_name", "text", "codes"])

    return f


def described(images: DataFrame) -> DataFrame:
    """(image_id, label, field_name, text, codes): each text with the feature codes of its lines, written once."""
    spark = images.sparkSession
    source = images.select("image_id", F.coalesce("file_key", F.lit("")).alias("file_key"), F.col("lang").alias("label"), *FIELDS)
    source = spread(one_row(source, "image_id"))
    back = cut(recurring_lines(source))
    told, fits = bounded_broadcast(back)
    if fits:
        own: dict[str, dict[str, int]] = {}
        for r in back.toLocalIterator():  # of checked size
            own.setdefault(r["file_key"], {})[r["key"]] = r["recurs"]
        rows, known = source.withColumn("recurs", F.lit(None)), spark.sparkContext.broadcast(own)
    else:  # the lines of each image meet those that come back; a publication or line of very many images is salted
        met = salted_join(source.mapInPandas(_all_keys, "image_id bigint, file_key string, key string"), back, ["file_key", "key"], "image_id")
        met = met.groupBy("image_id").agg(F.collect_list(F.struct("key", "recurs")).alias("recurs"))
        rows, known = source.join(met, "image_id", "left"), None
    schema = "image_id bigint, label string, field_name string, text string, codes array<int>"
    return cut(rows.mapInPandas(_features(known), schema))


def _counts(model: LineModel):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(PARAMETERS)
        for pdf in batches:
            if len(pdf):
                total += model.expected(list(pdf["codes"]))
        yield pd.DataFrame({"at": np.arange(PARAMETERS), "x": total})

    return f


def fit_lines(texts: DataFrame) -> LineModel:
    """The line model of all texts; what comes to the driver is one number per parameter."""
    model = LineModel()
    for _ in range(EM_STEPS):
        rows = texts.select("codes").mapInPandas(_counts(model), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(PARAMETERS)
        for r in rows:
            counts[r["at"]] = r["x"]
        model = LineModel.refitted(counts)
    return model


def _label(model: LineModel):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            rows = [reassembled([r.strip() for r in t.split("\n")], p) for t, p in zip(pdf["text"], model.paths(list(pdf["codes"])))]
            yield pd.DataFrame(
                {
                    "image_id": pdf["image_id"], "label": pdf["label"], "field_name": pdf["field_name"], "body": [r[0] for r in rows],
                    "lines": [[{"noise": a, "item": b} for a, b in r[1]] for r in rows], "headings": [r[2] for r in rows],
                }
            )

    return f


def labelled(images: DataFrame) -> DataFrame:
    """(image_id, label, field_name, body, lines, headings) of each text, written once."""
    arrow_batches(images.sparkSession)
    texts = described(images)
    schema = "image_id bigint, label string, field_name string, body string, lines array<struct<noise string, item string>>, headings array<string>"
    return cut(texts.select("image_id", "label", "field_name", "text", "codes").mapInPandas(_label(fit_lines(texts)), schema))


def _plain(body: str) -> str:
    """A text without markers; an underscore is no letter."""
    return (_IN_MARKS.sub(" ", body) if "<" in body else body).replace("_", " ")


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts words as written by language, per task: undivided ones, those inside sentences, and divided ones as they stand."""

    def out() -> pd.DataFrame:
        return pd.DataFrame([(c, w, k, n) for (c, k), own in counts.items() for w, n in own.items()], columns=["code", "w", "kind", "n"])

    counts: dict[tuple[str, str], Counter] = {}
    for pdf in batches:
        for code, body in zip(pdf["code"], pdf["body"]):
            clean = _plain(body)
            if (code, "word") not in counts:
                counts[code, "word"], counts[code, "inside"] = Counter(), Counter()
            counts[code, "word"].update(_TOKEN.findall(clean))
            counts[code, "inside"].update(_INSIDE.findall(clean))
        if sum(map(len, counts.values())) > HELD:
            yield out()
            counts.clear()
    if counts:
        yield out()


def _shapes(c: str) -> Column:
    return F.pandas_udf(lambda w: w.map(shapes), "string")(c)


def _confusions(right: str, read: str) -> Column:
    def f(right: pd.Series, read: pd.Series) -> pd.Series:
        return pd.Series([confusions(a, b) for a, b in zip(right, read)], dtype="Int32")

    return F.pandas_udf(f, "int")(right, read)


def word_table(body: DataFrame, code: Column) -> DataFrame:
    """(code, w, kind, n): words as written, by language and kind (`word`; `inside` for those with a capital inside sentences), written once."""
    return cut(body.select(code.alias("code"), "body").mapInPandas(_word_counts, "code string, w string, kind string, n bigint").groupBy("code", "w", "kind").agg(F.sum("n").alias("n")))


def lexicon(body: DataFrame, told: DataFrame, code: Column) -> DataFrame:
    """(word, n, is_name) of the undivided words. A name is written with a capital inside sentences and spread over languages as texts are."""
    plain = told.where((F.col("kind") == "word") & ~F.col("w").contains(JOIN)).groupBy(F.lower("w").alias("word"), "code").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("w").rlike(r"^\p{Lu}"), F.col("n")).otherwise(0)).alias("capital")
    )
    inside = told.where((F.col("kind") == "inside") & F.col("w").rlike(r"^\p{Lu}")).groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("inside"))
    known = F.col("code") != ""
    by = plain.groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("capital").alias("capital"), F.max(F.when(known, F.struct("n", "code"))).alias("top"), F.sum(F.when(known, F.col("n"))).alias("labelled")
    ).select("word", "n", "capital", F.col("top.n").alias("most"), F.col("top.code").alias("code"), "labelled")
    share = body.select(code.alias("code")).where(known).groupBy("code").agg(F.count("*").alias("texts"))
    share = share.select("code", (F.col("texts") / F.sum("texts").over(W.partitionBy(F.lit(1)))).alias("share"))  # one row per language
    # a name's share in a language is about that of texts; a word's is halfway to one or above
    own = F.col("most") / F.col("labelled") - 0.4 / F.sqrt("labelled") >= (1 + F.coalesce("share", F.lit(0.0))) / 2 - 0.03
    named = (F.coalesce("inside", F.lit(0)) > 0) & (F.col("capital") > 0.9 * F.col("n")) & ~F.coalesce(own, F.lit(False))
    return by.join(F.broadcast(share), "code", "left").join(inside, "word", "left").select("word", "n", named.alias("is_name"))


def misreadings(words: DataFrame) -> DataFrame:
    """(read, item): misread words and the right ones.

    Every word of two letters or more that may be misread meets the words it shares its shapes with, and is aligned with
    each to count the confusions of characters, as many as there are; the right word is much commoner, no name and free
    of digits. Of several right words the one with the fewest confusions, then the commonest, is taken. Words of one
    letter are left out: a single digit is a number.
    """
    odd = F.col("read").rlike(r"\p{L}[0-9@ſ]|[0-9@ſ]\p{L}") & ~F.col("read").rlike(r"^[0-9]+\p{L}{1,2}$")
    right = words.where((F.col("n") >= 4) & ~F.col("is_name") & ~F.col("word").rlike(r"[0-9@ſ]") & (F.length("word") > 1)).select(F.col("word").alias("item"), "n", _shapes("word").alias("shapes"))
    most = right.agg(F.max("n").alias("n")).first()["n"] or 0  # a word above this share of the commonest can't be a misreading
    may = words.where((F.length("word") > 1) & F.col("word").rlike(r"\p{L}")).select(F.col("word").alias("read"), F.col("n").alias("few")).where(odd | (F.col("few") <= MOST_SHARE * most))
    tried = may.select("read", "few", odd.alias("odd"), _shapes("read").alias("shapes")).join(right, "shapes").where(F.col("read") != F.col("item"))
    pairs = tried.withColumn("steps", _confusions("item", "read")).where(F.col("steps").isNotNull()).where(F.when(F.col("odd"), F.col("few") < F.col("n")).otherwise(F.col("few") <= F.when(F.col("steps") < 2, MOST_SHARE).otherwise(MOST_SHARE_TWICE) * F.col("n")))
    best = pairs.groupBy("read").agg(F.max(F.struct((-F.col("steps")).alias("s"), "n", "item")).alias("b"))
    return best.select("read", "b.item")


def divided_words(tokens: DataFrame, words: DataFrame, misread: DataFrame) -> DataFrame:
    """(token, item) of the divided words `tokens` as they stand and as a whole. The hyphen stays if the word is met more often with it."""
    plain = lambda sep: F.regexp_replace("token", f"{JOIN}[{HYPHENS}]", sep)
    forms = tokens.select("token", F.explode(F.array(F.struct(plain("").alias("form"), F.lit(False).alias("own")), F.struct(plain("-").alias("form"), F.lit(True).alias("own")))).alias("f")).select("token", "f.*")
    known = words.select(F.col("word").alias("form"), F.col("n").alias("met"))
    right = misread.select(F.col("read").alias("form"), "item")
    told = forms.join(known, "form", "left").join(right, "form", "left").join(known.select(F.col("form").alias("item"), F.col("met").alias("right_met")), "item", "left")
    weight = F.coalesce("right_met", "met", F.lit(0))
    best = told.groupBy("token").agg(F.max(F.struct(weight.alias("met"), (~F.col("own")).alias("joined"), F.coalesce("item", "form").alias("item"))).alias("b"))
    return best.select("token", "b.item")


def repairs(body: DataFrame, code: Column) -> DataFrame:
    """(token, noise, item): what to put in place of a token, for all misread and divided words."""
    told = word_table(body, code)
    words = cut(lexicon(body, told, code))
    tokens = told.where((F.col("kind") == "word") & F.col("w").contains(JOIN)).select(F.lower("w").alias("token")).distinct()
    # divided words take part in the search with their joined form, so that a misread one is known as such
    joined = tokens.select(F.regexp_replace("token", f"{JOIN}[{HYPHENS}]", "").alias("word")).distinct().join(words, "word", "left_anti").select("word", F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("is_name"))
    misread = cut(misreadings(words.unionByName(joined)))
    divided = divided_words(tokens, words, misread)
    return misread.select(F.col("read").alias("token"), F.lit("misread").alias("noise"), "item").unionByName(divided.select("token", F.lit("hyphenation").alias("noise"), "item"))


def _tokens(body: str) -> set[str]:
    return set(_TOKEN.findall(_plain(body).lower()))


def _found(fixes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = fixes.value if fixes is not None else None
        for pdf in batches:
            rows = []
            for i, name, body in zip(pdf["image_id"], pdf["field_name"], pdf["body"]):
                own = _tokens(body)
                rows += [(i, name, t, *(known[t] if known else ("", ""))) for t in (own if known is None else own & known.keys())]
            yield pd.DataFrame(rows, columns=["image_id", "field_name", "token", "noise", "item"])

    return f


def found_words(body: DataFrame, fixes: DataFrame) -> DataFrame:
    """(image_id, field_name, token, noise, item) of each text. Repairs of a checked size go to the tasks; more meet the words in a salted join."""
    schema = "image_id bigint, field_name string, token string, noise string, item string"
    source = body.select("image_id", "field_name", "body")
    if bounded_broadcast(fixes)[1]:
        told = body.sparkSession.sparkContext.broadcast({r["token"]: (r["noise"], r["item"]) for r in fixes.toLocalIterator()})
        return source.mapInPandas(_found(told), schema)
    return salted_join(source.mapInPandas(_found(None), schema).drop("noise", "item"), fixes, ["token"], "image_id")


def _code() -> Column:
    return F.coalesce(label_code(F.col("label")), F.lit(""))


def scan_findings(images: DataFrame) -> DataFrame:
    """(image_id, field_name, noise, item): each kind of noise in each text; equal rows come once.

    Null, empty and blank texts have none; an image without an id can't be named and is left out; redelivered images
    count once. An empty table gives no rows.
    """
    body = labelled(images)
    lines = body.select("image_id", "field_name", F.explode("lines").alias("l")).select("image_id", "field_name", "l.noise", "l.item")
    words = found_words(body, cut(repairs(body, _code()))).select("image_id", "field_name", "noise", "item")
    return lines.unionByName(words).distinct()


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        out = []
        for body, fixes in zip(pdf["body"], pdf["fixes"]):
            own = {f["token"]: f["item"] for f in fixes} if fixes is not None else {}

            def put(m, own=own) -> str:
                item = own.get(m[0].lower())
                if item is None:
                    return m[0]
                return item.upper() if m[0].isupper() and len(m[0]) > 1 else item[:1].upper() + item[1:] if m[0][:1].isupper() else item

            out.append(_TOKEN.sub(put, body).replace(JOIN, "") if own else body.replace(JOIN, ""))
        yield pd.DataFrame({"image_id": pdf["image_id"], "label": pdf["label"], "field_name": pdf["field_name"], "text": out})


def repaired_texts(images: DataFrame) -> DataFrame:
    """(image_id, label, field_name, text): every text as continuous paragraphs, without headers and page numbers, words repaired."""
    body = labelled(images)
    fixes = found_words(body, cut(repairs(body, _code()))).groupBy("image_id", "field_name").agg(F.collect_set(F.struct("token", "item")).alias("fixes"))
    whole = body.select("image_id", "label", "field_name", "body").join(fixes, ["image_id", "field_name"], "left")
    return whole.mapInPandas(_repair, "image_id bigint, label string, field_name string, text string")
