"""Language labels and character n-gram language models."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Usual ways of writing a language, by two-letter code (ISO 639-1, 639-2 and 639-3 codes, English and own names).
LABELS = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglese", "inglês", "engels"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "alemão", "duits"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francese", "francês", "frans"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "castilian", "spanisch", "espagnol", "spagnolo", "espanhol", "spaans"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien", "italiaans"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portoghese", "portugees"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "neerlandés", "olandese", "holandês", "flemish", "vlaams"),
}
CODES = tuple(LABELS)
_BY_LABEL = {w: c for c, ws in LABELS.items() for w in ws}


def label_code(c: Column) -> Column:
    """The two-letter code a label names, whatever its case, region or script; NULL if it names none of `CODES`."""
    word = F.regexp_extract(F.lower(F.trim(c)), r"^([\p{L}]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in _BY_LABEL.items() for x in pair])
    return F.try_element_at(table, word)


#: Buckets n-grams are hashed into; the model has a fixed size whatever the corpus.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def telling_words(text: str) -> list[str]:
    """The words a language is told from, in lower case.

    Words with a capital are left out if the text has two others: they are mostly names and, in the one language that
    writes nouns so, the other words suffice.
    """
    return _telling(_WORDS.findall(unicodedata.normalize("NFC", text)))


def _telling(words: list[str]) -> list[str]:
    plain = [w for w in words if w[:1].islower()]
    return plain if len(plain) >= 2 else [w.lower() for w in words]


@lru_cache(maxsize=100_000)
def word_ngrams(w: str) -> np.ndarray:
    """Buckets of the character n-grams of a word, its ends marked, and of the word itself."""
    w = f" {w} "
    out = [zlib.crc32(w[i : i + n].encode("utf-8")) for n in ORDERS for i in range(len(w) - n + 1)]
    return np.array([*out, zlib.crc32(b"w" + w.encode("utf-8"))], dtype=np.int64) % BUCKETS


class LanguageModel:
    """Log-likelihoods of n-grams by language, from counts of shape (languages, BUCKETS)."""

    def __init__(self, codes: tuple[str, ...], counts: np.ndarray, smooth: float = 0.1):
        self.codes = codes
        share = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS)
        self.log = np.log(share).astype(np.float32)

        self.known: dict[str, np.ndarray] = {}
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(codes)))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of words in each language. Overlapping n-grams tell the same, so the sum is divided by their orders."""
        if len(self.known) > 200_000:
            self.known.clear()
        total = np.zeros(len(self.codes))
        for w in words:
            x = self.known.get(w)
            if x is None:
                x = self.known[w] = self.log[:, word_ngrams(w)].sum(axis=1, dtype=np.float64) / (len(ORDERS) + 1)
            total += x
        return total

    def all_scores(self, texts: list[list[str]]) -> np.ndarray:
        """`scores` of many texts at once, one row each."""
        if len(self.at) > 200_000:
            self.at.clear()
        flat = [w for ws in texts for w in ws]
        new = list(set(flat).difference(self.at))
        if new:
            first = len(self.at)
            self.at.update(zip(new, range(first, first + len(new))))
            while len(self.rows) < len(self.at):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            grams = [word_ngrams(w) for w in new]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            self.rows[first : len(self.at)] = np.add.reduceat(self.log[:, np.concatenate(grams)].astype(np.float64), np.cumsum(sizes) - sizes, axis=1).T / (len(ORDERS) + 1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        some = sizes > 0
        out = np.zeros((len(texts), len(self.codes)))
        if flat:
            out[some] = np.add.reduceat(self.rows[np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))], (np.cumsum(sizes) - sizes)[some])
        return out


def bucket_counts(counts: list[Counter]) -> np.ndarray:
    """N-gram counts by language from word counts by language."""
    total = np.zeros((len(counts), BUCKETS), np.float64)
    for row, own in zip(total, counts):
        words = list(own)
        for a in range(0, len(words), 50_000):
            grams = [word_ngrams(w) for w in words[a : a + 50_000]]
            n = np.repeat([float(own[w]) for w in words[a : a + 50_000]], [len(g) for g in grams])
            row += np.bincount(np.concatenate(grams), weights=n, minlength=BUCKETS)
    return total


#: Nats a further language of a text must gain, and what a change of language between two sentences costs.
LANGUAGE_COST, CHANGE_COST = 6.0, 2.0
_MARK = re.compile(r"<[^<>]*>[^<>]*</[^<>]*>|<[^<>]*>")
_TAG = re.compile(r"<[^<>]*>")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+(?=[\"'„«“(¿¡]?[^\W_a-zà-ÿ])")
_FULL = re.compile(r"[.!?…][\"'»”)]*$")


def sentences(text: str) -> list[str]:
    """The full sentences of a text in reading order: three words or more, with an end. Markers and headings are none.

    A piece of fewer words, such as what follows an ordinal's full stop, goes to the piece before it.
    """
    out: list[str] = []
    for paragraph in re.split(r"\n\s*\n", _MARK.sub(" ", text)):
        pieces = [p for p in _SPLIT.split(" ".join(paragraph.split())) if p]
        own: list[str] = []
        for p in pieces:
            if own and len(_WORDS.findall(p)) < 3:
                own[-1] += " " + p
            else:
                own.append(p)
        out += [p for p in own if _FULL.search(p) and len(_WORDS.findall(p)) >= 3]
    return out


def marked_sentences(text: str) -> list[list[str]]:
    """The telling words of the sentences of a text with markup, tags and entities taken out.

    Unlike with `sentences`, what stands between tags is text, and headings and pieces without an end are too.
    """
    out: list[list[str]] = []
    clean = unicodedata.normalize("NFC", html.unescape(_TAG.sub(" ", text)))
    for paragraph in re.split(r"\n\s*\n", clean):
        for p in _SPLIT.split(" ".join(paragraph.split())):
            words = _WORDS.findall(p)
            if out and len(words) < 3:
                out[-1] += words
            elif words:
                out.append(words)
    return [_telling(ws) for ws in out]


def mixture(ll: np.ndarray, steps: int = 20) -> tuple[list[int], np.ndarray]:
    """(languages, proportions) of a text from its sentences' log-likelihoods by expectation-maximisation.

    A language is added while the likelihood of the mixture gains more than `LANGUAGE_COST`.
    """

    def fit(chosen: list[int]) -> tuple[float, np.ndarray]:
        x = ll[:, chosen]
        p = np.full(len(chosen), 1 / len(chosen))
        for _ in range(steps):
            z = x + np.log(p + 1e-9)
            post = np.exp(z - z.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            p = post.mean(axis=0)
        z = x + np.log(p + 1e-9)
        top = z.max(axis=1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1))).sum()), p

    chosen = [int(ll.sum(axis=0).argmax())]
    best, p = fit(chosen)
    while len(chosen) < ll.shape[1]:
        # only a language that is best for some sentence can gain anything
        rest = sorted(set(ll.argmax(axis=1).tolist()) - set(chosen))
        tried = [(fit([*chosen, k]), k) for k in rest]
        if not tried:
            break
        (gain, q), k = max(tried, key=lambda t: t[0][0])
        if gain - best <= LANGUAGE_COST:
            break
        chosen, best, p = [*chosen, k], gain, q
    return chosen, p


def segments(ll: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(language, first sentence, last sentence, confidence) of each longest run of sentences in one language.

    The run of languages is the most probable one under the text's mixture; confidence is the mean posterior
    probability of the language over its sentences.
    """
    one = int(ll.sum(axis=0).argmax())
    if (ll.argmax(axis=1) == one).all():  # no other language can gain anything
        return [(one, 0, len(ll) - 1, float((1 / np.exp(ll - ll[:, [one]]).sum(axis=1)).mean()))]
    chosen, p = mixture(ll)
    x = ll[:, chosen] + np.log(p + 1e-9)
    everything = np.exp(ll - ll.max(axis=1, keepdims=True))
    sure = everything[:, chosen] / everything.sum(axis=1, keepdims=True)
    n, k = x.shape
    v, back = x[0], []
    cost = CHANGE_COST * (1 - np.eye(k))
    for t in range(1, n):
        m = v[:, None] - cost
        back.append(m.argmax(axis=0))
        v = m.max(axis=0) + x[t]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out: list[list] = []
    for t, s in enumerate(path):
        if out and out[-1][0] == chosen[s]:
            out[-1][2] = t
            out[-1][3].append(float(sure[t, s]))
        else:
            out.append([chosen[s], t, t, [float(sure[t, s])]])
    return [(a, b, c, float(np.mean(d))) for a, b, c, d in out]
