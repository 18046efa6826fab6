"""Deeply nested audit reports as flat tables of reports, pages, issues and locations.

Bodies aren't parsed value by value. Every body gets a structural index made of whole-array operations:

* bitmaps of quotes, brackets and delimiters over its bytes, escaped characters and strings masked out;
* the nesting depth by a prefix sum over opening and closing brackets;
* the partner of each bracket and the parent of each token from one stable sort by depth.

Values are then spans between structural positions, decoded only where a table needs them. One pass over the
bodies emits linked rows of all four kinds; no body is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharos.runtime import arrow_batches, bounded_broadcast, cut, spread

_OPEN, _CLOSE = b"{[", b"}]"
_IS = np.zeros((4, 256), bool)  # opening, closing, colon or comma, any of them
_IS[0, list(_OPEN)] = _IS[1, list(_CLOSE)] = _IS[2, list(b":,")] = True
_IS[3] = _IS[0] | _IS[1] | _IS[2]

ROWS = "kind string, report_id bigint, delivery bigint, page_key string, page_no bigint, issue_id string, issue_type string, severity string, criterion string, element string, status string, location_no bigint, path string, file_path string, description string, issues bigint"


#: Members of an issue that become columns of its row.
_TOLD = ("type", "severity", "wcag_criterion", "element", "remediation_status")


#: Members of an issue and of a location that have columns or rows of their own.
_ISSUE_COLUMNS = frozenset((*_TOLD, "id", "location", "locations", "page_number"))
_LOCATION_COLUMNS = frozenset(("path", "file_path", "description", "page_number"))


class Index:
    """The structural index of one JSON text. `whole` tells whether every bracket and string is closed."""

    def __init__(self, text: str):
        self.raw = raw = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        quote = b == 0x22
        slash = b == 0x5C
        if slash.any():
            at = np.flatnonzero(slash)
            start = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            run = np.diff(np.r_[start, len(at)])
            after = at[start] + run  # the character after each run of backslashes
            after = after[(run % 2 == 1) & (after < len(b))]
            quote[after] = False
        inside = (np.cumsum(quote) & 1).astype(bool)
        self.at = at = np.flatnonzero(_IS[3][b] & ~inside)
        self.kind = kind = b[at]
        opening, closing = _IS[0][kind], _IS[1][kind]
        level = np.cumsum(opening.astype(np.int32) - closing.astype(np.int32))
        self.whole = not (len(b) and inside[-1]) and bool(len(at)) and level[-1] == 0 and bool((level >= 0).all())
        depth = np.where(opening | ~closing, level, level + 1)  # a bracket and its content's delimiters have one depth
        self.order = order = np.argsort(depth, kind="stable")
        sorted_open = opening[order]
        group = np.cumsum(sorted_open) - 1  # within a depth, tokens follow the container that opened last
        self.first = np.flatnonzero(sorted_open)
        self.group = np.empty(len(at), np.int64)
        self.group[order] = group
        self.count = np.diff(np.r_[self.first, len(order)])
        self.top = order[self.first[0]] if len(self.first) else -1

    def container(self, token: int) -> np.ndarray:
        """Tokens of the container that `token` opens: the bracket, its own delimiters, the closing bracket."""
        g = self.group[token]
        return self.order[self.first[g] : self.first[g] + self.count[g]]

    def text(self, start: int, end: int) -> bytes:
        return self.raw[start:end].strip()

    def items(self, token: int) -> list[tuple[bytes, int, int, int]]:
        """(key, opening token or -1, start, end) of each member; keys of array items are empty."""
        own = self.container(token)
        is_object = self.kind[token] == 0x7B
        out, key, start = [], b"", self.at[token] + 1
        for t in own[1:]:
            if self.kind[t] == 0x3A and is_object:
                key, start = self.text(start, self.at[t]), self.at[t] + 1
                continue
            value = self.text(start, self.at[t])
            if value:
                nested = value[:1] in (b"{", b"[")
                out.append((key, int(np.searchsorted(self.at, start)) if nested else -1, int(start), int(self.at[t])))
            key, start = b"", self.at[t] + 1
        return out

    def members(self, token: int) -> dict[str, tuple[int, int, int]]:
        return {scalar(k): v for k, *v in self.items(token) if k} if self.kind[token] == 0x7B else {}

    def value(self, member) -> object:
        """The scalar of a member; a container or nothing is None."""
        return None if member is None or member[0] >= 0 else scalar(self.text(member[1], member[2]))


def scalar(raw: bytes) -> object:
    """The value of a scalar's span; the common case of a string without escapes needs no decoder."""
    if len(raw) > 1 and raw[:1] == b'"' == raw[-1:] and b"\\" not in raw:
        return raw[1:-1].decode("utf-8", "replace")
    try:
        return json.loads(raw)
    except ValueError:
        return raw.decode("utf-8", "replace").strip('"')


def as_page(value: object) -> int | None:
    """A page number told as a number or a string of digits, else None."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value)
    m = re.fullmatch(r"\s*(\d{1,9})\s*", str(value))
    return int(m[1]) if m else None


def page_of_key(value: object) -> int | None:
    """A page number in a page key such as ``7``, ``page-7`` or ``Page 7``."""
    m = re.fullmatch(r"\s*(?:page|p\.?|pg\.?)?[\s_#:-]*(\d{1,9})\s*", str(value), re.I) if value is not None and not isinstance(value, bool) else None
    return int(m[1]) if m else None


def opened(body: str | None) -> Index | None:
    """The index of a body whatever it is wrapped in: byte order mark, text before or after, JSON told as a JSON string."""
    for _ in range(3):
        if body is None:
            return None
        body = body.lstrip("﻿ \t\r\n\0")
        if body[:1] == '"':
            try:
                body = json.loads(body.rstrip())
            except ValueError:
                return None
            if not isinstance(body, str):
                return None
            continue
        m = re.search(r"[{\[]", body)
        if not m:
            return None
        index = Index(body[m.start() :])
        if index.whole:
            return index
        end = max(body.rfind("}"), body.rfind("]"))  # words after the end may hold brackets or quotes
        index = Index(body[m.start() : end + 1])
        return index if index.whole else None
    return None


def issue_places(index: Index) -> Iterator[tuple[str | None, int | None, int]]:
    """(page key, page number, opening token) of each object that stands in a list of issues."""
    top = index.members(index.top) if index.kind[index.top] == 0x7B else {}

    def listed(token: int) -> Iterator[int]:
        for _, t, _, _ in index.items(token):
            if t >= 0 and index.kind[t] == 0x7B:
                yield t

    def holder(token: int) -> Iterator[int]:
        if index.kind[token] == 0x5B:
            yield from listed(token)
            return
        own = index.members(token)
        if "issues" in own and own["issues"][0] >= 0:
            yield from listed(own["issues"][0])

    if (pages := top.get("by_page")) and pages[0] >= 0:
        keyed = index.kind[pages[0]] == 0x7B
        for key, t, _, _ in index.items(pages[0]):
            if t < 0:
                continue
            name = scalar(key) if keyed else None
            if not keyed and index.kind[t] == 0x7B:
                own = index.members(t)
                name = next((index.value(own[k]) for k in ("page", "page_number", "page_no") if k in own), None)
            yield None if name is None else str(name), page_of_key(name), -1
            for i in holder(t):
                yield None if name is None else str(name), page_of_key(name), i
    if (by_status := top.get("by_status")) and by_status[0] >= 0 and index.kind[by_status[0]] == 0x7B:
        for _, t, _, _ in index.items(by_status[0]):
            if t >= 0:
                for i in holder(t):
                    yield None, None, i
    if (issues := top.get("issues")) and issues[0] >= 0:
        for i in listed(issues[0]):
            yield None, None, i
    elif index.kind[index.top] == 0x5B:
        for i in listed(index.top):
            yield None, None, i


def _place(index: Index, own: dict) -> dict:
    """The values of a location; nested ones under their paths."""
    out = {}
    for k, v in own.items():
        if v[0] < 0:
            out[k] = index.value(v)
        else:
            out |= dict(leaves(index, v, k))
    return out


def locations_of(index: Index, member) -> list[dict]:
    """The locations of an issue: a list, one object, either told as a JSON string, or a plain path. Null and empty are none."""
    if member is None:
        return []
    token, start, end = member
    if token < 0:
        told = scalar(index.text(start, end))
        if not isinstance(told, str) or not told.strip():
            return []
        inner = opened(told) if told.lstrip()[:1] in "{[\"" else None
        if inner is None:
            return [{"path": told}]
        return locations_of(inner, (inner.top, 0, len(inner.raw)))
    out = []
    if index.kind[token] == 0x7B:
        own = index.members(token)
        return [_place(index, own)] if own else []
    for _, t, s, e in index.items(token):
        if t >= 0 and index.kind[t] == 0x7B:
            out.append(_place(index, index.members(t)))
        else:
            told = scalar(index.text(s, e)) if t < 0 else None
            inner = opened(told) if isinstance(told, str) and told.lstrip()[:1] == "{" else None
            out += locations_of(inner, (inner.top, 0, 0)) if inner else [{"path": told if isinstance(told, str) else None}]
    return out


def leaves(index: Index, member, path: str = "") -> Iterator[tuple[str, str | None]]:
    """(path, value) of each scalar below a member, in order: names joined by dots, places in lists from 1 in brackets; empty containers tell their brackets."""
    token, start, end = member
    if token < 0:
        value = scalar(index.text(start, end))
        yield path, None if value is None else value if isinstance(value, str) else json.dumps(value)
        return
    listed = index.kind[token] == 0x5B
    empty = True
    for n, (key, *inner) in enumerate(index.items(token), 1):
        empty = False
        yield from leaves(index, inner, f"{path}[{n}]" if listed else f"{path}.{scalar(key)}" if path else str(scalar(key)))
    if empty:
        yield path, "[]" if listed else "{}"


def flat_rows(report_id, delivery, body, details: bool = False) -> Iterator[dict]:
    """All rows of one report. A null, cut or unreadable body has none. `details`: also one row for each value that has no column of its own."""
    index = opened(body)
    if index is None:
        return
    base = {"report_id": report_id, "delivery": delivery}
    seen: dict[str, dict] = {}
    pages: dict[str | None, dict] = {}
    for key, page, token in issue_places(index):
        if token < 0:
            pages.setdefault(key, {"kind": "page", "page_key": key, "page_no": page, "issues": 0})
            continue
        own = index.members(token)
        issue_id = index.value(own.get("id"))
        if issue_id is None or "$ref" in own:
            continue
        issue_id = str(issue_id)
        if key is not None and key in pages:
            pages[key]["issues"] += 1
        told = locations_of(index, own.get("location") or own.get("locations"))
        have = seen.setdefault(issue_id, {"told": [], "page": None, "under": None, "key": None, "own": {}, "rest": {}})
        if len(told) > len(have["told"]):
            have["told"] = told
        for name, value in (("page", as_page(index.value(own.get("page_number")))), ("under", page), ("key", key)):
            if have[name] is None:
                have[name] = value
        for name in _TOLD:
            if name not in have["own"] and (value := index.value(own.get(name))) is not None:
                have["own"][name] = str(value)
        if details:
            for name, member in own.items():
                if name not in _ISSUE_COLUMNS:
                    for path, value in leaves(index, member, name):
                        have["rest"].setdefault(path, value)
    top = index.members(index.top) if index.kind[index.top] == 0x7B else {}
    yield base | {"kind": "report", "path": index.value(top.get("html_path")), "issues": len(seen)}
    if details:
        yield from (base | x for x in _report_details(index, top))
    for row in pages.values():
        yield base | row
    for issue_id, x in seen.items():
        own = x["own"]
        fallback = next((p for p in (x["page"], x["under"]) if p is not None), -1)
        yield base | {
            "kind": "issue", "page_key": x["key"], "page_no": fallback, "issue_id": issue_id, "issue_type": own.get("type"), "severity": own.get("severity"),
            "criterion": own.get("wcag_criterion"), "element": own.get("element"), "status": own.get("remediation_status"), "issues": len(x["told"]),
        }
        for path, value in x["rest"].items():
            yield base | {"kind": "detail", "issue_id": issue_id, "path": path, "description": value}
        for n, place in enumerate(x["told"], 1):
            page = as_page(place.get("page_number"))
            text = {k: None if place.get(k) is None else str(place[k]) for k in ("path", "file_path", "description")}
            yield base | {"kind": "location", "issue_id": issue_id, "page_no": fallback if page is None else page, "location_no": n} | text
            if details:
                for path, value in place.items():
                    if path not in _LOCATION_COLUMNS:
                        told = None if value is None else value if isinstance(value, str) else json.dumps(value)
                        yield base | {"kind": "detail", "issue_id": issue_id, "location_no": n, "path": path, "description": told}


def _report_details(index: Index, top: dict) -> Iterator[dict]:
    """Values of a report itself and of its pages that aren't issues."""
    for name, member in top.items():
        if name in ("html_path", "issues"):
            continue
        if name not in ("by_page", "by_status") or member[0] < 0:
            for path, value in leaves(index, member, name):
                yield {"kind": "detail", "path": path, "description": value}
            continue
        keyed = index.kind[member[0]] == 0x7B
        for n, (key, token, start, end) in enumerate(index.items(member[0]), 1):
            at = f"{name}.{scalar(key)}" if keyed else f"{name}[{n}]"
            if token >= 0 and index.kind[token] == 0x7B:
                for inner, own in index.members(token).items():
                    if inner != "issues":
                        for path, value in leaves(index, own, f"{at}.{inner}"):
                            yield {"kind": "detail", "path": path, "description": value}
            elif token < 0:
                for path, value in leaves(index, (token, start, end), at):
                    yield {"kind": "detail", "path": path, "description": value}


_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def _parse(details: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[dict] = []
            for r in pdf.itertuples(index=False):
                held += flat_rows(r.report_id, r.delivery, r.body, details)
                if len(held) > 20_000:
                    yield _frame(held)
                    held = []
            if held:
                yield _frame(held)

    return f


def _frame(rows: list[dict]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("report_id", "delivery", "page_no", "location_no", "issues"):
        pdf[c] = pdf[c].astype("Int64")
    for c in ("page_key", *_COLUMNS[_COLUMNS.index("issue_id") : _COLUMNS.index("location_no")], "path", "file_path", "description"):
        pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)  # a column of missing values alone would be one of numbers
    return pdf


def last_deliveries(reports: DataFrame) -> DataFrame:
    """(report_id, body) of the delivery of each report that counts: of several, the one received last, among those of one time the one of the largest hash.

    Reports and hashes alone are compared; bodies of reports delivered once, which are nearly all, stay where they were
    read, and equal deliveries become one.
    """
    source = reports.where(F.col("report_id").isNotNull()).select("report_id", F.coalesce("received_at", F.timestamp_micros(F.lit(0))).alias("at"), F.xxhash64("body").alias("delivery"), "body")
    told = source.groupBy("report_id").agg(F.count("*").alias("n"), F.max(F.struct("at", "delivery")).alias("last")).where("n > 1")
    again, _ = bounded_broadcast(cut(told.select("report_id", "last.at", "last.delivery")))
    last = source.join(again, ["report_id", "at", "delivery"], "left_semi").groupBy("report_id").agg(F.min("body").alias("body"))
    return source.join(again.select("report_id"), "report_id", "left_anti").select("report_id", "body").unionByName(last)


def report_rows(reports: DataFrame, details: bool = False) -> DataFrame:
    """One row for each report, page, issue and location of `reports`, told apart by `kind`; with `details`, for each further value too.

    Needs `report_id`, `received_at` and `body`; further columns are left alone. Of several deliveries of a report the one
    received last counts. A report without an id can't be linked to and is left out, as is one with a null, empty or cut body.
    """
    arrow_batches(reports.sparkSession)
    source = last_deliveries(reports).select("report_id", F.lit(0).cast("bigint").alias("delivery"), "body")
    return spread(source).mapInPandas(_parse(details), ROWS).drop("delivery")


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The five linked tables; the bodies are parsed once, into a checkpoint.

    reports(report_id, html_path, issues), pages(report_id, page_key, page_no, issues),
    issues(report_id, issue_id, page_key, page_no, issue_type, severity, criterion, element, status, locations),
    locations(report_id, issue_id, location_no, page_no, path, file_path, description),
    details(report_id, issue_id, location_no, path, value): every further value, however deep, under the path of names that
    leads to it; it belongs to the location, else to the issue, else to the report that it names.
    A page links to its report by report_id, an issue to its page by (report_id, page_key), which is NULL for an
    issue that stands under no page, a location to its issue by (report_id, issue_id).
    """
    rows = cut(report_rows(reports, details=True))
    of = lambda kind: rows.where(F.col("kind") == kind)
    return {
        "reports": of("report").select("report_id", F.col("path").alias("html_path"), "issues"),
        "pages": of("page").select("report_id", "page_key", "page_no", "issues"),
        "issues": of("issue").select("report_id", "issue_id", "page_key", "page_no", "issue_type", "severity", "criterion", "element", "status", F.col("issues").alias("locations")),
        "locations": of("location").select("report_id", "issue_id", "location_no", "page_no", "path", "file_path", "description"),
        "details": of("detail").select("report_id", "issue_id", "location_no", "path", F.col("description").alias("value")),
    }


def issue_locations(reports: DataFrame) -> DataFrame:
    """(report_id, issue_id, page_no, location_no): each location of each issue, and location 0 of an issue without any."""
    rows = report_rows(reports)
    placed = rows.where((F.col("kind") == "location") | ((F.col("kind") == "issue") & (F.col("issues") == 0)))
    return placed.select("report_id", "issue_id", "page_no", F.coalesce("location_no", F.lit(0)).cast("bigint").alias("location_no"))
