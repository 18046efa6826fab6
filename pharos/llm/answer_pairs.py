"""Broken prompt and response pairs: empty, refused, copied, truncated answers and answers in another language.

A pass over the pairs takes prompt and answer apart (markup, attributes, what the answer says itself) and tells empty
answers, refusals, copies and broken markup. Truncation of texts whose markup is whole is told from all answers:

* the distinct texts are sorted across the cluster and each is compared with its successor, which starts with it if it is
  a shortened version of it; only the first text of each part crosses between parts;
* lengths at which unended texts pile up are limits, and shortened versions of such a length were cut;
* a last word that hardly ever ends a text, or is only the beginning of words, shows that a text breaks off; both are
  shares of its uses, so that they hold for tables of any size.

The language of prompt and answer comes from an n-gram model fitted on all documents, from their labels first and then from
what each sentence is found to be.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharos.llm.language_labels import fit_languages
from pharos.llm.languages import LanguageModel, label_code, marked_sentences, telling_words
from pharos.runtime import arrow_batches, bounded_broadcast, cut, cut_in_place, spread

#: Languages of the pairs.
PAIR_CODES = ("en", "de", "fr", "es")
#: Nats by which another language must lead.
LEAD = 4.0
#: A word met this often ends a text in less than this share of its uses: a text that ends with it breaks off.
MET, ENDS = 20, 0.02
#: A piece of a word ends an unended text in at least this share of its uses, and the words it begins are met this many times as often.
PIECE_ENDS, PIECE_BEGINS = 0.9, 5
#: Words a remark before a copy may have.
REMARK = 14

# How models decline in en, de, fr and es, and what stands for nothing.
REFUSALS = (
    r"\bI(?:'m| am)? (?:sorry|afraid)\b", r"\bI (?:can(?:'t|not| not)|could not|couldn't|won't|will not|am (?:not able|unable)|have to decline|must (?:decline|refuse)|decline|refuse)\b",
    r"\bI'm (?:not able|unable)\b", r"\bas an? (?:AI|assistant|language model|artificial)\b", r"\bnot something (?:that )?I (?:can|could|am able)\b", r"\bnot be appropriate for me\b",
    r"\bcan be (?:offered|given|provided) by this model\b", r"\bnot possible for me\b", r"\bagainst my (?:guidelines|policy|policies)\b",
    r"\btut mir leid\b", r"\b(?:ich|wir) (?:bin|sind) (?:leider )?nicht in der Lage\b", r"\bkann ich (?:leider |hier |dabei )*nicht\b", r"\bich kann (?:\w+ ){0,5}nicht\b", r"\bmuss ich (?:leider )?ablehnen\b",
    r"\bals (?:KI|Assistent|Sprachmodell)\b", r"\bleider (?:nicht möglich|ablehnen)\b",
    r"\bje suis désolée?\b", r"\bje ne (?:peux|suis) pas\b", r"\bil m['’]est impossible\b", r"\bje (?:dois|préfère) (?:décliner|refuser)\b", r"\ben tant qu['’](?:assistant|IA|intelligence)",
    r"\blo siento\b", r"\bno (?:me es|es) posible (?:atender|ayudar|describir|responder)", r"\bno puedo\b", r"\bdebo (?:rechazar|declinar)\b", r"\bcomo (?:asistente|IA|modelo)\b",
)
NOTHING = ("", "n/a", "na", "none", "null", "nil", "[]", "{}", "-", "--", "—", "...", "…", "undefined", "empty", "?", ".", '""', "''")

_REFUSED = re.compile("|".join(REFUSALS), re.I)
_FENCE = re.compile(r"^\s*```\w*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr"}
_TOKEN = re.compile(r"[^\W_]+")
_OPEN_END = re.compile(r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]|[,;:–—(\-])\s*$")
_CLOSED_END = re.compile(r"[.!?)\]\"'»”]\s*$")
#: What stands before a model's answer in a failure_reason; a reason that begins neither with it nor with markup is a technical failure.
_REPLY = re.compile(r"^\s*(?:model(?:'s)?\s+)?(?:reply|answer|response|output)\s*[:–—-]\s*", re.I)
_INSTRUCTION = re.compile(r"^[^:.!?\n]{3,60}:\s+")


@lru_cache(maxsize=256)
def tokens(text: str) -> list[str]:
    return _TOKEN.findall(html.unescape(text).lower())


@lru_cache(maxsize=64)  # a pair is looked at from several sides
def take_apart(content: str) -> tuple[list[str], bool, bool, bool]:
    """(texts of elements and alternative texts, markup broken, has markup, is a decorative image)."""
    fenced = _FENCE.match(content)
    content = fenced[1] if fenced else content
    parts, open_tags, at, broken, decorative = [], [], 0, content.count("```") % 2 == 1, False
    for m in _TAG.finditer(content):
        parts.append(content[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if m[1]:
            while open_tags and open_tags[-1] != name:
                open_tags.pop()
                broken = True
            if open_tags:
                open_tags.pop()
        elif name == "img":
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])}
            alt = attrs.get("alt")
            if alt is not None and not alt.strip():
                decorative = True
            parts.append(alt or "")
        elif name not in _VOID and not m[3].rstrip().endswith("/"):
            open_tags.append(name)
    rest = content[at:]
    broken |= bool(open_tags) or bool(re.search(r"<[A-Za-z/][^<>]*$|<$", rest)) or bool(re.search(r"<[A-Za-z][^<>]*$", content[content.rfind("<") :]) if "<" in content else False)
    if broken:  # what an unfinished tag says still belongs to the answer
        rest = re.sub(r"<[^<>]*?(?:alt\s*=\s*[\"']([^\"']*))?$", r" \1", rest)
    parts.append(rest)
    texts = [t for p in parts if (t := html.unescape(p).replace("​", "").replace("﻿", "").strip())]
    return texts, broken, bool(_TAG.search(content)) or "<" in content, decorative


def plain_prompt(prompt: str) -> str:
    """What a prompt says, without markup and the instruction before it."""
    texts, _, marked, _ = take_apart(prompt)
    return " ".join(texts) if marked else _INSTRUCTION.sub("", prompt, count=1)


def is_copy(prompt: str, answer: str) -> bool:
    """Whether the answer is the prompt or its text but for case, space, quoting, wrapping or a leading remark."""
    p, a = tokens(prompt), tokens(answer)
    if not p or not a:
        return False
    if p == a or (len(a) - len(p) <= REMARK and len(p) > 1 and _within(p, a)):
        return True
    own = take_apart(answer)[0]
    said = tokens(plain_prompt(prompt))
    whole = tokens(" ".join(own))
    if said and whole == said:
        return True
    texts = [tokens(t) for t in own]
    return len(said) >= 4 and any(len(t) - len(said) <= REMARK and _within(said, t, at_end=True) for t in [*texts, whole] if len(t) >= len(said)) and not _adds(prompt, own)


def _within(a: list[str], b: list[str], at_end: bool = False) -> bool:
    """Whether `a` stands in `b` in one piece, with little after it."""
    last = len(b) - len(a)
    return any(b[i : i + len(a)] == a for i in range(max(0, last - (0 if at_end else 3)), last + 1))


def _adds(prompt: str, own: list[str]) -> bool:
    """Whether an answer keeps the prompt's text where it was and says something of its own beside it."""
    had = {" ".join(tokens(t)) for t in take_apart(prompt)[0]}
    kept = [t for t in own if " ".join(tokens(t)) in had]
    new = [t for t in own if " ".join(tokens(t)) not in had]
    return bool(kept) and bool(new)


def own_text(prompt: str, answer: str) -> str:
    """The longest text of an answer that isn't in the prompt."""
    had = {" ".join(tokens(t)) for t in take_apart(prompt)[0]}
    new = [t for t in take_apart(answer)[0] if " ".join(tokens(t)) not in had and tokens(t)]
    return " ".join(max(new, key=len, default="").split())


def reply_in(reason: str) -> str | None:
    """The model's answer that a failure_reason tells; None if it tells a technical failure."""
    lead = _REPLY.match(reason)
    answer = reason[lead.end() :] if lead else reason
    return answer if lead or answer.lstrip().startswith("<") else None


def _judge(model: LanguageModel) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def language(text: str) -> tuple[str, float]:
        x = model.scores(telling_words(text))
        order = np.argsort(x)
        return model.codes[order[-1]], float(x[order[-1]] - x[order[-2]])

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            rows = []
            for detail_id, before, after, reason in zip(pdf["detail_id"], pdf["before_content"], pdf["after_content"], pdf["failure_reason"]):
                before, after, reason = before or "", after or "", (reason or "").strip()
                given = bool(after.strip())
                answer = after if given else reason
                texts, broken, marked, decorative = take_apart(answer)
                said = " ".join(texts).strip()
                nothing = said.lower() in NOTHING or not _TOKEN.search(said)
                own, defect, other = "", "", False
                if nothing and broken and given and marked:
                    defect = "truncated"
                elif nothing:
                    defect = "" if reason or (decorative and given) else "empty"
                elif _REFUSED.search(said):
                    defect = "refusal"
                elif is_copy(before, answer):
                    defect = "copy"
                elif given or (answer := reply_in(reason)):
                    if not given:
                        texts, broken, marked, decorative = take_apart(answer)
                    if is_copy(before, answer):
                        defect = "copy"
                    else:
                        own = own_text(before, answer)
                        if broken or _OPEN_END.search(own) or (not marked and not _CLOSED_END.search(own)):
                            defect = "truncated"
                        elif own and before.strip():
                            (p, ps), (a, as_) = language(plain_prompt(before)), language(own)
                            other = p != a and ps >= LEAD and as_ >= LEAD
                rows.append((detail_id, defect, own if not defect else "", other))
            yield pd.DataFrame(rows, columns=["detail_id", "defect", "own", "other"])

    return f


def _neighbours(first_of: dict[int, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Compares each text of a sorted part with its successor: whether it is cut inside a word, or at one, by it."""

    def compared(text: str, after: str) -> tuple[bool, bool]:
        if not after.startswith(text) or after == text:
            return False, False
        nxt = after[len(text)]
        inside = text[-1].isalnum() and nxt.isalnum()
        return inside, not inside and (nxt.isspace() or text[-1].isspace())

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part, rows = None, 0, []
        for pdf in batches:
            if pdf.empty:
                continue
            for p, t in zip(pdf["part"], pdf["own"]):
                part = p
                if held is not None:
                    rows.append((held, *compared(held, t)))
                held = t
            yield pd.DataFrame(rows, columns=["own", "in_word", "at_word"])
            rows = []
        if held is not None:
            after = next((first_of[p] for p in sorted(first_of) if p > part), "")
            yield pd.DataFrame([(held, *compared(held, after))], columns=["own", "in_word", "at_word"])

    return f


def shortened(texts: DataFrame) -> DataFrame:
    """(own, in_word, at_word) of distinct texts: whether the next text in order starts with it, cut in or at a word."""
    parts = cut_in_place(texts.repartitionByRange("own").sortWithinPartitions("own").withColumn("part", F.spark_partition_id()))
    first_of = {r["part"]: r["first"] for r in parts.groupBy("part").agg(F.min("own").alias("first")).collect()}  # one row per part
    return parts.sortWithinPartitions("part", "own").mapInPandas(_neighbours(first_of), "own string, in_word boolean, at_word boolean")


def _last(c: str) -> Column:
    return F.lower(F.regexp_extract(c, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))


def broken_off(own: DataFrame) -> DataFrame:
    """(own) of the texts that break off, from all texts `own` (one row per answer)."""
    texts = cut(own.groupBy("own").agg(F.count("*").alias("n")))
    words = texts.select("n", F.explode(F.regexp_extract_all(F.lower("own"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.sum("n").alias("met"))
    unended = ~F.rlike("own", F.lit(r"[.!?)\]\"'»”]\s*$"))
    ends = texts.select("n", _last("own").alias("word"), unended.alias("open")).groupBy("word").agg(F.sum("n").alias("ends"), F.sum(F.when(F.col("open"), F.col("n"))).alias("open_ends"))
    words = cut(words.join(ends, "word", "left").select("word", "met", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("open_ends", F.lit(0)).alias("open_ends")))
    lengths = texts.where(unended).groupBy(F.length("own").alias("length")).agg(F.sum("n").alias("n"))
    near = lengths.select("length", "n", F.explode(F.sequence(F.col("length") - 5, F.col("length") + 5)).alias("at"))
    limits = near.groupBy("at").agg(F.sum(F.when(F.col("length") == F.col("at"), F.col("n"))).alias("here"), F.sum("n").alias("around"))
    limits = limits.where((F.col("here") >= 10) & (F.col("here") > 3 * (F.col("around") - F.col("here")) / 10)).select(F.col("at").alias("length"), F.lit(True).alias("limit"))
    # a word that does hardly anything but end unended texts and begins much commoner ones is a piece of one, however often it is met; of one met hardly ever, no share can be told
    last = words.where(((F.col("met") <= 2) | (F.col("open_ends") >= PIECE_ENDS * F.col("met"))) & (F.length("word") >= 1) & F.col("word").rlike(r"^\p{L}+$"))
    longer = words.where((F.col("met") >= 3) & F.col("word").rlike(r"^\p{L}+$")).select("met", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.substring("word", F.lit(1), i))).alias("piece"))
    longer = longer.groupBy("piece").agg(F.sum("met").alias("begins"))
    pieces = last.join(longer, F.col("word") == F.col("piece")).where(F.col("begins") >= PIECE_BEGINS * F.when(F.col("met") <= 2, 1).otherwise(F.col("met"))).select("word", F.lit(True).alias("piece"))
    judged = texts.where(unended).select("own", _last("own").alias("word"), F.length("own").alias("length"))
    small, _ = bounded_broadcast(limits)
    judged = judged.join(shortened(texts.select("own")), "own", "left").join(words, "word", "left").join(pieces, "word", "left").join(small, "length", "left")
    never = (F.col("met") >= MET) & (F.col("ends") < ENDS * F.col("met"))
    hit = F.coalesce("in_word", F.lit(False)) | F.coalesce(never, F.lit(False)) | F.coalesce("piece", F.lit(False)) | (F.coalesce("at_word", F.lit(False)) & F.coalesce("limit", F.lit(False)))
    return judged.where(hit).select("own")


def _split_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        yield pd.DataFrame({"code": pdf["code"], "sentences": [[" ".join(ws) for ws in marked_sentences(t)] for t in pdf["text"]]})


def document_languages(documents: DataFrame, codes: tuple[str, ...] = PAIR_CODES) -> LanguageModel:
    """The language model of all documents.

    The first pass takes the labels as they are; the second takes each sentence, of documents without a label or with a
    wrong one too, for what the first made of it. Markup and entities count for no language.
    """
    source = documents.where(F.col("text").isNotNull()).select(label_code(F.col("lang")).alias("code"), "text")
    return fit_languages(cut(spread(source).mapInPandas(_split_documents, "code string, sentences array<string>")), codes, steps=1, words_of=str.split)


def broken_pairs(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(detail_id, defect) of each defective pair; at most one defect each, in the order empty, refusal, copy, truncated, other language.

    Pairs with another status than remediated or failed aren't answers; redelivered pairs count once; a pair without an id
    is left out. Null contents are read as empty ones.
    """
    arrow_batches(pairs.sparkSession)
    columns = ["before_content", "after_content", "failure_reason"]
    rows = pairs.where(F.col("remediation_status").isin("remediated", "failed") & F.col("detail_id").isNotNull()).select("detail_id", *columns)
    rows = rows.groupBy("detail_id").agg(F.min(F.struct(*columns)).alias("r")).select("detail_id", "r.*")
    judged = cut(spread(rows).mapInPandas(_judge(document_languages(documents)), "detail_id bigint, defect string, own string, other boolean"))
    off = broken_off(judged.where(F.col("own") != "").select("own")).withColumn("off", F.lit(True))
    whole = judged.join(off, "own", "left")
    defect = F.when(F.col("defect") != "", F.col("defect")).when(F.col("off"), "truncated").when(F.col("other"), "other_language")
    return whole.select("detail_id", defect.alias("defect")).where(F.col("defect").isNotNull())
