"""Nested reports against brute force, with nulls, blanks, repeats and empty tables."""

import json
import random
from datetime import datetime

from pharos.operators import nested_json


def flat(body):
    return [(r["issue_id"], r["page_no"], r.get("location_no", 0)) for r in nested_json.flat_rows(1, 0, body) if r["kind"] == "location" or r["kind"] == "issue" and r["issues"] == 0]


def test_places_and_shapes_of_issues():
    body = {
        "by_page": {"page-4": {"issues": [{"id": "a", "context": {"attributes": {"id": "no", "type": "x"}}, "location": [{"path": "p"}, {"page_number": "9"}]}]}, "null": {"issues": [{"id": "b", "location": {}}]}},
        "by_status": {"compliant": [{"$ref": "#/x"}, {"id": "s", "location": "[document] > p"}], "n": 3},
        "issues": [{"id": "a", "page_number": 4, "location": [{"path": "p"}, {"page_number": "9"}]}, {"id": "c", "page_number": 2, "location": '{"page_number": 7}'}, {"id": "d", "location": None}],
    }
    want = [("a", 4, 1), ("a", 9, 2), ("b", -1, 0), ("s", -1, 1), ("c", 7, 1), ("d", -1, 0)]
    text = json.dumps(body)
    for told in (text, "﻿" + text, json.dumps(text), json.dumps(body, indent=1), f"Report:\n{text}\nend"):
        assert sorted(flat(told)) == sorted(want)
    for told in (None, "", "null", "[]", text[: len(text) // 2], '"abc"', "}{", "{"):
        assert flat(told) == []
    listed = json.dumps({"by_page": [{"page": "Page 3", "issues": [{"id": "a\\\"b", "message": "}]{[\\"}]}, {"page": None, "issues": []}]})
    assert flat(listed) == [("a\\\"b", 3, 0)]


def test_index_against_json(hypothesis_values=200):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        return [None, True, rng.randrange(99), 'q"\\{[,:é', ""][kind] if kind < 5 else [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {f'k"{i}': value(depth - 1) for i in range(rng.randrange(4))}

    def read(index, member):
        token, start, end = member
        if token < 0:
            return nested_json.scalar(index.text(start, end))
        if index.kind[token] == 0x7B:
            return {k: read(index, m) for k, m in index.members(token).items()}
        return [read(index, m[1:]) for m in index.items(token)]

    for _ in range(hypothesis_values):
        v = {"x": value(4)}
        for told in (json.dumps(v), json.dumps(v, indent=2, ensure_ascii=False)):
            index = nested_json.Index(told)
            assert index.whole and read(index, (index.top, 0, 0)) == v
            assert not nested_json.Index(told[:-1]).whole


def test_the_last_delivery_counts(spark):
    t = [datetime(2025, 1, i) for i in (1, 2)]
    old, new = json.dumps({"issues": [{"id": "old"}]}), json.dumps({"issues": [{"id": "new"}]})
    df = spark.createDataFrame([(1, t[0], old, 5), (1, t[1], new, 5), (1, t[1], new, 5), (None, t[0], old, 5), (2, None, old, 5), (3, t[0], None, 5)], "report_id bigint, received_at timestamp, body string, kind int")
    assert sorted(map(tuple, nested_json.issue_locations(df).collect())) == [(1, "new", -1, 0), (2, "old", -1, 0)]
    tables = nested_json.report_tables(df)
    assert {k: v.count() for k, v in tables.items()} == {"reports": 2, "pages": 0, "issues": 2, "locations": 0, "details": 0}
    assert nested_json.issue_locations(df.limit(0)).count() == 0


def test_no_value_is_lost():
    body = {
        "summary": {"total": 3, "by": {"minor": [1, {"x": None}]}}, "html_path": "a.html", "by_page": {"4": {"n": 2, "issues": []}}, "by_status": {"open": 5},
        "issues": [{"id": "a", "type": "t", "context": {"html": "<p>", "classes": []}, "location": [{"path": "p", "contrast_ratio": 2.5, "box": {"left": 1}}]}],
    }
    got = {(r.get("issue_id"), r.get("location_no"), r["path"]): r["description"] for r in nested_json.flat_rows(1, 0, json.dumps(body), details=True) if r["kind"] == "detail"}
    assert got == {
        (None, None, "summary.total"): "3", (None, None, "summary.by.minor[1]"): "1", (None, None, "summary.by.minor[2].x"): None, (None, None, "by_page.4.n"): "2", (None, None, "by_status.open"): "5",
        ("a", None, "context.html"): "<p>", ("a", None, "context.classes"): "[]", ("a", 1, "contrast_ratio"): "2.5", ("a", 1, "box.left"): "1",
    }
