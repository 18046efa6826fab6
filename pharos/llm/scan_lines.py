"""Lines of scanned pages: layout features, a hidden Markov model of line roles, reassembly into paragraphs.

A line is a header, a page number, a section heading, running text or a break (blank line, figure marker). Each line is
described by the layout features of `FEATURES`, none of which decides alone; `LineModel` is a hidden Markov model whose
emissions are products over the features. Its probabilities begin at the prior below and are refitted on all lines by
expectation-maximisation, most of each staying with the prior whatever the number of lines. The most probable roles of a
whole text decide. That a line comes back on other pages is one of the features; those statistics are taken over all rows
before (see `scan_noise`).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

STATES = ("header", "page_number", "heading", "body", "break")
HEADER, PAGE, HEADING, BODY, BREAK = range(5)

# Words before and between page numbers in en, de, fr, es, it, pt, nl; characters read for digits; hyphens
# that divide words; characters confused in recognition (right, read as).
PAGE_WORDS = ("page", "seite", "página", "pagina", "bladzijde", "p", "s", "b", "pg", "pag", "pág", "blz", "folio")
OF_WORDS = ("of", "von", "sur", "de", "di", "van", "da")
DIGITS = "0-9lIOo|"
HYPHENS = "\u00ac\u2010\u00ad\u2011-"
CONFUSED = (
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("g", "9"), ("a", "@"), ("z", "2"), ("b", "8"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"),
    ("f", "ſ"), ("t", "ſ"), ("s", "ſ"), ("h", "b"), ("b", "h"), ("i", "l"), ("l", "i"), ("m", "rn"), ("rn", "m"), ("n", "ri"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("w", "vv"), ("li", "h"), ("h", "li"),
)

_NUMBER = rf"(?:[{DIGITS}]+|(?=[ivxlc])(?:c{{0,3}}(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}})))"
_PAGE = re.compile(rf"^[\W_]*(?:(?P<word>[^\W\d_]+)(?:\s*\.\s*|\s+))?(?P<n>{_NUMBER})(?:\s*(?:/|(?P<of>[^\W\d_]{{2,4}}))\s*(?P<m>[{DIGITS}]+))?[\W_]*$")
_MARKER = re.compile(r"^\s*<[^<>\n]*>[^<>\n]*(?:</[^<>\n]*>)?\s*$")
_IN_SENTENCE = re.compile(r"\w[.,]\w|\w[.,;:!?]$")
_DECIMAL = re.compile(r"^[\W_]*\d+(?:[.,]\d+)+[\W_]*$")
_STOPS = tuple(".!?:;,…")

#: Characters that are confused, or pairs of them, and the one they are read as here; in this order.
_FOLD = tuple("0o 1i li 5s ſt ft 6b 8b hb 9g @a 2z ce".split()), (("rn", "m"), ("ri", "n"), ("ei", "d"), ("ii", "u"), ("vv", "w"))


def skeleton(word: str) -> str:
    """A form that a word and its misreadings share: characters that are confused are mapped to one."""
    word = word.lower()
    for seen, read in _FOLD[0]:
        word = word.replace(seen, read)
    for seen, read in _FOLD[1]:
        word = word.replace(seen, read)
    return word


_PAGE_SKELETONS = {skeleton(w) for w in PAGE_WORDS}
_OF_SKELETONS = {skeleton(w) for w in OF_WORDS}


def number_form(s: str) -> int:
    """How a stripped line is a number, by place in the feature `number`: not at all, bare, with marks around it, with a word or a total, or as part of a sentence (decimal, full stop)."""
    if s.count(" ") > 5:  # a word, a number, a word and a number, with marks set apart, are six at most
        return 0
    m = _PAGE.match(s)
    if not m or not m["n"]:
        return 4 if _DECIMAL.match(s) else 0
    if (m["word"] and skeleton(m["word"]) not in _PAGE_SKELETONS) or (m["of"] and skeleton(m["of"]) not in _OF_SKELETONS):
        return 0
    if _IN_SENTENCE.search(s):
        return 4
    return 3 if m["word"] or m["m"] else 1 if s.isalnum() else 2


_DIGITS = re.compile(r"\d")
#: Decoration around a line, and what is read for digits.
_MARKS = " \t\r\f\v\u00a0!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~§°·•†‡«»“”„‘’…–—―\u00ad"
_READ_DIGITS = "0123456789lIOo|"


def _bare(s: str) -> str:
    """A line without decoration and without a number at either end."""
    s = s.strip(_MARKS)
    i = s.find(" ")
    if i > 0 and not s[:i].strip(_READ_DIGITS):
        s = s[i:].lstrip(_MARKS)
    i = s.rfind(" ")
    if i > 0 and not s[i + 1 :].strip(_READ_DIGITS):
        s = s[:i].rstrip(_MARKS)
    return s


def header_key(s: str) -> str | None:
    """What two prints of one running header share: no page number, decoration, case or misreading. None if nothing is left of the line."""
    s = _bare(s)
    if _DIGITS.search(s):
        s = " ".join(["9" if _DIGITS.search(w) and not w.strip(_MARKS).strip(_READ_DIGITS) else w for w in s.split()])
    return " ".join(skeleton(s).split()) or None


_CLOSERS = "'\"»”)]"


def ends(s: str) -> bool:
    """Whether a sentence or a part of one ends with the line."""
    return s.rstrip(_CLOSERS)[-1:] in _STOPS


def skip_templates(key: str) -> list[str]:
    """The key with each of its words left open in turn; none for a single word."""
    words = key.split(" ")
    return [" ".join([*words[:i], "*", *words[i + 1 :]]) for i in range(len(words)) if words[i] not in "9·—-|–"] if len(words) > 1 else []


#: Layout features of a line and their values.
FEATURES = {
    "kind": ("marker", "blank", "text"),
    "number": ("none", "bare", "marked", "counted", "in_sentence"),
    "recurs": ("no", "own", "partly", "made"),  # not, often in its own publication alone, or in a make-up that comes back in several, partly or nearly always with one line in each
    "form": ("none", "title", "early", "full"),  # how it fills its line
    "place": ("only", "first", "last", "inside"),
    "flow": ("none", "broken", "between", "open"),  # whether the text around it goes on across it
    "begins": ("none", "lower", "upper", "digit", "mark"),
    "ends": ("stop", "hyphen", "open"),
    "digits": ("none", "some", "most"),
}
_SIZES = tuple(len(v) for v in FEATURES.values())
_STEPS = tuple(int(np.prod(_SIZES[i + 1 :], dtype=np.int64)) for i in range(len(_SIZES)))
CODES = int(np.prod(_SIZES))
_KIND, _NUMBER_AT, _RECURS, _FORM, _PLACE, _FLOW, _BEGINS, _ENDS_AT, _DIGITS_AT = _STEPS


def line_features(text: str, recurs: dict[str, int]) -> tuple[list[str], list[int]]:
    """(stripped lines, feature codes of each). `recurs`: places in the feature `recurs` by header key."""
    strips = [r.strip() for r in text.split("\n")]
    n = len(strips)
    kinds, numbers, back = [2] * n, [0] * n, [0] * n
    plain: list[int] = []  # lines of text that aren't numbers and don't come back
    for i, s in enumerate(strips):
        if not s:
            kinds[i] = 1
        elif "<" in s and _MARKER.match(s):
            kinds[i] = 0
        else:
            numbers[i] = form = number_form(s)
            if form in (0, 4):
                if recurs and (key := header_key(s)) is not None:
                    back[i] = recurs.get(key, 0)
                if not back[i]:
                    plain.append(i)
    width = max((len(strips[i]) for i in plain), default=0)
    shown = [i for i in range(n) if kinds[i] != 1]
    first, last = (shown[0], shown[-1]) if shown else (-1, -1)
    # the nearest plain line or marker after each line, the nearest plain one before it
    after: list[str] = [""] * n
    nxt = ""
    is_plain = [False] * n
    for i in plain:
        is_plain[i] = True
    for i in range(n - 1, -1, -1):
        after[i] = nxt
        if is_plain[i] or kinds[i] == 0:
            nxt = strips[i]
    codes = []
    before, closed = "", True
    for i, s in enumerate(strips):
        if kinds[i] == 1:
            codes.append(_KIND + 3 * _PLACE + 2 * _ENDS_AT)
            continue
        place = 0 if first == last else 1 if i == first else 2 if i == last else 3
        if kinds[i] == 0:
            codes.append(place * _PLACE + 2 * _ENDS_AT + 4 * _BEGINS)
            before = ""
            continue
        c, follows = s[0], after[i]
        begins = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4
        ended = ends(s)
        end = 0 if ended else 1 if s[-1] in HYPHENS else 2
        digits = sum(map(s.count, "0123456789")) if _DIGITS.search(s) else 0
        flow = 0
        fresh = not before or closed
        if before or follows:
            goes_on = follows[:1].islower() or follows[:1].isdigit()
            flow = 1 if not fresh and goes_on else 2 if fresh and not goes_on else 3
        form = 0
        if numbers[i] in (0, 4):
            early = not follows or follows[0] == "<" or len(s) + 3 + len(follows.split(None, 1)[0]) <= width
            form = 2 if early else 3
            if early and begins == 2 and end == 2 and fresh and (follows[:1].isupper()) and s.count(" ") < 8 and not _INNER.search(s):
                form = 1
        codes.append(
            2 * _KIND + numbers[i] * _NUMBER_AT + back[i] * _RECURS + form * _FORM + place * _PLACE + flow * _FLOW + begins * _BEGINS + end * _ENDS_AT
            + (0 if not digits else 2 if 2 * digits > len(s) else 1) * _DIGITS_AT
        )
        if is_plain[i]:
            before, closed = s, ended
    return strips, codes


_INNER = re.compile(r"[.!?:;,]\s")


def _rows(*rows: tuple[float, ...]) -> np.ndarray:
    a = np.array(rows, float)
    return a / a.sum(axis=1, keepdims=True)


#: The prior: rows are roles in the order of `STATES`.
START = _rows((8, 12, 8, 70, 2))
MOVE = _rows((1, 2, 3, 90, 4), (8, 1, 3, 84, 4), (1, 1, 1, 96, 1), (3, 6, 0.5, 82, 8.5), (2, 4, 2, 90, 2))
EMIT = {
    "kind": _rows((0.1, 0.1, 99.8), (0.1, 0.1, 99.8), (0.1, 0.1, 99.8), (0.1, 0.1, 99.8), (60, 39.9, 0.1)),
    "number": _rows((97, 0.5, 0.5, 1.5, 0.5), (1, 34, 31, 34, 0.01), (98, 0.5, 0.5, 0.5, 0.5), (98.7, 0.1, 0.1, 0.1, 1), (99, 0.2, 0.2, 0.2, 0.4)),
    "recurs": _rows((3, 36, 1, 60), (98, 0.5, 0.5, 1), (99, 0.3, 0.4, 0.3), (99, 0.3, 0.4, 0.3), (98.5, 0.5, 0.5, 0.5)),
    "form": _rows((1, 40, 50, 9), (97, 1, 1, 1), (0.3, 99.6, 0.1, 0.0001), (1, 0.3, 30, 68.7), (97, 1, 1, 1)),
    "place": _rows((3, 50, 3, 44), (3, 30, 20, 47), (2, 60, 1, 37), (15, 15, 15, 55), (2, 5, 5, 88)),
    "flow": _rows((3, 45, 29, 23), (3, 45, 29, 23), (2, 2, 90, 6), (8, 40, 17, 35), (90, 4, 3, 3)),
    "begins": _rows((1, 0.2, 75.8, 15, 8), (1, 10, 20, 45, 24), (1, 2, 90, 5, 2), (1, 55, 38, 4, 2), (40, 2, 2, 2, 54)),
    "ends": _rows((0.02, 0.02, 99.96), (2, 20, 78), (1, 1, 98), (40, 12, 48), (1, 1, 98)),
    "digits": _rows((45, 53, 2), (2, 8, 90), (90, 9, 1), (80, 19, 1), (97, 2, 1)),
}
#: Share of each refitted probability that stays with the prior.
KEPT = 0.85
#: What a role has more seldom than this in the prior it never learns to have.
RULED_OUT = 1e-3


class LineModel:
    """A hidden Markov model of line roles; all methods take many texts at once, as lists of feature codes."""

    def __init__(self, start: np.ndarray = START, move: np.ndarray = MOVE, emit: dict[str, np.ndarray] = EMIT):
        self.start, self.move, self.emit = start, move, emit
        table = np.zeros((1, len(STATES)))
        for name in FEATURES:  # in the order of the code's digits
            table = (table[:, None, :] + np.log(emit[name]).T[None, :, :]).reshape(-1, len(STATES))
        self.log_emit = table

    def _batches(self, codes: list[np.ndarray], most: int = 512):
        """(places, codes padded with -1) of sequences of like lengths."""
        order = sorted((i for i in range(len(codes)) if len(codes[i])), key=lambda i: len(codes[i]))
        for a in range(0, len(order), most):
            at = order[a : a + most]
            grid = np.full((len(at), len(codes[at[-1]])), -1, np.int64)
            for row, i in enumerate(at):
                grid[row, : len(codes[i])] = codes[i]
            yield at, grid

    def paths(self, codes: list[np.ndarray]) -> list[list[int]]:
        """The most probable roles of each text (Viterbi)."""
        out: list[list[int]] = [[] for _ in codes]
        a, start = np.log(self.move), np.log(self.start[0])
        for at, grid in self._batches(codes):
            n, length = grid.shape
            b = self.log_emit[grid]
            v = start + b[:, 0]
            back = np.zeros((length, n, len(STATES)), np.int8)
            for t in range(1, length):
                m = v[:, :, None] + a[None]
                back[t] = m.argmax(axis=1)
                on = grid[:, t] >= 0
                back[t][~on] = np.arange(len(STATES))
                v = np.where(on[:, None], m.max(axis=1) + b[:, t], v)
            state = v.argmax(axis=1)
            roles = np.zeros((n, length), np.int8)
            for t in range(length - 1, -1, -1):
                roles[:, t] = state
                state = back[t][np.arange(n), state]
            for row, i in enumerate(at):
                out[i] = roles[row, : len(codes[i])].tolist()
        return out

    def expected(self, codes: list[np.ndarray]) -> np.ndarray:
        """Expected counts of all texts, flat: start, transitions, emissions by feature (forward-backward with scaling)."""
        k = len(STATES)
        start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CODES, k))
        for _, grid in self._batches(codes):
            n, length = grid.shape
            on = grid >= 0
            e = np.where(on[:, :, None], np.exp(self.log_emit[grid]), 1.0)
            f, c = np.zeros((length, n, k)), np.ones((length, n))
            for t in range(length):
                x = (self.start[0] if t == 0 else f[t - 1] @ self.move) * e[:, t]
                c[t] = x.sum(axis=1)
                f[t] = x / c[t][:, None]
            g = np.ones((n, k))
            for t in range(length - 1, -1, -1):
                post = f[t] * g
                seen = on[:, t]
                np.add.at(emits, grid[seen, t], post[seen])
                if t == 0:
                    start += post.sum(axis=0)
                    break
                ahead = e[:, t] * g / c[t][:, None]
                moves += self.move * (f[t - 1][seen].T @ ahead[seen])
                g = np.where(seen[:, None], ahead @ self.move.T, 1.0)
        shaped = emits.reshape(*_SIZES, k)
        by_feature = [shaped.sum(axis=tuple(j for j in range(len(_SIZES)) if j != i)).T.ravel() for i in range(len(_SIZES))]
        return np.concatenate([start, moves.ravel(), *by_feature])

    @staticmethod
    def refitted(counts: np.ndarray) -> LineModel:
        """The model from expected counts, `KEPT` of each probability from the prior."""
        k = len(STATES)

        def mixed(x: np.ndarray, prior: np.ndarray) -> np.ndarray:
            x = np.where(prior < RULED_OUT, 0.0, x)
            total = x.sum(axis=1, keepdims=True)
            out = np.where(total > 0, KEPT * prior + (1 - KEPT) * x / np.where(total > 0, total, 1), prior)
            return np.where(prior < RULED_OUT, prior, out) / np.where(prior < RULED_OUT, prior, out).sum(axis=1, keepdims=True)

        start, moves, at, emit = mixed(counts[None, :k], START), mixed(counts[k : k + k * k].reshape(k, k), MOVE), k + k * k, {}
        for name, size in zip(FEATURES, _SIZES):
            emit[name] = mixed(counts[at : at + k * size].reshape(k, size), EMIT[name])
            at += k * size
        return LineModel(start, moves, emit)


#: Numbers that `LineModel.expected` returns.
PARAMETERS = len(STATES) * (1 + len(STATES) + sum(_SIZES))


#: Joins the halves of a divided word until it is known whether its hyphen is its own.
JOIN = "\x01"
_LAST = re.compile(rf"[\w'’@][{HYPHENS}]$")


def reassembled(strips: list[str], roles: list[int]) -> tuple[str, list[tuple[str, str]], list[str]]:
    """(running text, (noise, line) of headers and page numbers, section headings).

    Running text has a blank line where a break or heading stood, one space between lines, and `JOIN` with the
    hyphen read before it between the halves of a divided word.
    """
    parts: list[str] = []
    noise: list[tuple[str, str]] = []
    headings: list[str] = []
    divided = ""
    for s, role in zip(strips, roles):
        if role in (HEADER, PAGE) and s:
            noise.append((STATES[role], s))
            continue
        if not s or role == BREAK:
            if not divided and not s:
                parts.append("\n\n")
            continue
        if role == HEADING:
            headings.append(s)
            parts += ["\n\n", s, "\n\n"] if parts else [s, "\n\n"]
            continue
        if divided:
            if s[:1].isalpha() and s[:1].islower():
                parts.append(JOIN + divided)
            else:
                parts[-1] += divided
                parts.append(" ")
            divided = ""
        elif parts and not parts[-1].endswith("\n\n"):
            parts.append(" ")
        if s[-1] in HYPHENS and _LAST.search(s):
            divided = s[-1]
            s = s[:-1]
        parts.append(s)
    if divided:
        parts.append(divided)
    text = "".join(parts).strip()
    return text if text.isascii() else unicodedata.normalize("NFC", text), noise, headings


def originals(read: str, most: int = 2) -> list[tuple[str, int]]:
    """(word, confusions) of all words that `read` may come from by one to `most` of the confusions."""
    found: dict[str, int] = {read: 0}
    level = [read]
    for n in range(1, most + 1):
        nxt = []
        for w in level:
            for right, seen in CONFUSED:
                i = w.find(seen)
                while i >= 0:
                    v = w[:i] + right + w[i + len(seen) :]
                    if v not in found:
                        found[v] = n
                        nxt.append(v)
                    i = w.find(seen, i + 1)
        level = nxt
    return [(w, n) for w, n in found.items() if n]


#: Shapes that characters and pairs of them are made of: what is confused has one spelling in shapes.
_SHAPES = {
    "0": "o", "1": "i", "l": "i", "5": "s", "t": "s", "f": "s", "ſ": "s", "9": "g", "@": "a", "2": "z", "c": "e",
    "h": "ii", "b": "ii", "6": "ii", "8": "ii", "u": "ii", "n": "ri", "m": "rri", "d": "ei", "w": "vv",
}


def shapes(word: str) -> str:
    """A form that a word shares with all that comes of it by any number of confusions."""
    return "".join(_SHAPES.get(c, c) for c in word)


def confusions(right: str, read: str) -> int | None:
    """The least number of confusions that turn `right` into `read`, each at a place of its own or, if two at most, one upon the other; None if none do."""
    best: list[float] = [0.0] + [np.inf] * len(read)
    rows = [best]
    for i in range(len(right) + 1):
        row = rows[i] if i < len(rows) else [np.inf] * (len(read) + 1)
        rows += [[np.inf] * (len(read) + 1) for _ in range(max(0, i + 3 - len(rows)))]
        for j, n in enumerate(row):
            if n == np.inf:
                continue
            if right[i : i + 1] and right[i : i + 1] == read[j : j + 1]:
                rows[i + 1][j + 1] = min(rows[i + 1][j + 1], n)
            for a, b in CONFUSED:
                if right.startswith(a, i) and read.startswith(b, j):
                    rows[i + len(a)][j + len(b)] = min(rows[i + len(a)][j + len(b)], n + 1)
    n = rows[len(right)][len(read)]
    if n > 2:
        n = dict(originals(read)).get(right, n)
    return None if n == np.inf else int(n)
