"""Term counts against brute force, with nulls, blanks, repeats, clashing names and empty tables."""

import random
from collections import Counter

from pharos.llm import term_counts


def test_terms_against_brute_force(spark):
    rng = random.Random(3)
    values = ["A b", " a-B ", "a_b", "c–d", "\ta b", "", None, "x", "a‑b", "e"]
    rows = [(i, rng.randrange(6), rng.choice(values), rng.choice(["Major", "major ", None]), "extra") for i in range(200)]
    rows += rows[:20] + [(None, 1, "x", "minor", "extra")] * 2 + [(900, None, "x", None, "extra")]
    df = spark.createDataFrame(rows, "issue_key bigint, run_id bigint, type string, severity string, term string")

    def norm(v):
        return "".join("-" if c.isspace() or c in "_-–‑" else c for c in (v or "").strip().lower())

    once = list({r[0]: r for r in rows if r[0] is not None}.values()) + [r for r in rows if r[0] is None]
    n, runs = Counter(), {}
    for _, run, kind, sev, _ in once:
        terms = [("type", "value", norm(kind)), ("severity", "value", norm(sev))] + [("type", "word", w) for w in norm(kind).split("-")]
        for t in terms:
            if t[2]:
                n[t] += 1
                runs.setdefault(t, set()).update({run} - {None})
    for limit in (200_000, 0):  # dictionary broadcast, and joined by salt
        got = term_counts.term_frequencies(df, "run_id", ["type", "severity"], ["type"], key="issue_key", broadcast_rows=limit).collect()
        assert {(r.field_name, r.unit, r.term): (r.occurrences, r.records) for r in got} == {t: (n[t], len(runs[t])) for t in n}
        assert sorted(r.term_id for r in got) == list(range(len(got)))
    assert term_counts.issue_term_frequencies(df.limit(0)).count() == 0
