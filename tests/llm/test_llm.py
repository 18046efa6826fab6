"""Training-data operators on small made-up tables: known answers, brute force, nulls, blanks, repeats and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pharos.llm import answer_pairs, eval_leaks, language_labels, languages, scan_lines, scan_noise, source_mix, subject_areas

from pharos.llm.queries import TOKENIZERS

TEXTS = {
    "en": ["The keeper closed the gate before the storm", "They repaired the long bridge with help from the town", "A nurse took the pulse and changed the dressing", "The band played the slow movement without the organ"],
    "de": ["Die Wärterin schloss das Tor vor dem Sturm", "Sie reparierten die lange Brücke mit Hilfe der Stadt", "Eine Schwester maß den Puls und wechselte den Verband", "Die Kapelle spielte den langsamen Satz ohne die Orgel"],
    "fr": ["La gardienne a fermé la porte avant la tempête", "Ils ont réparé le long pont avec une aide de la ville", "Une infirmière a pris le pouls et changé le pansement", "La fanfare a joué le mouvement lent sans son orgue"],
    "es": ["La guarda cerró la puerta antes de la tormenta", "Ellos repararon el puente largo con ayuda de la ciudad", "Una enfermera tomó el pulso y cambió la venda", "La banda tocó el movimiento lento sin el órgano"],
}


def images(spark, rows):
    schema = "image_id bigint, file_key string, prev string, current string, next string, context string, lang string, text string"
    return spark.createDataFrame([(*r, "clashing") for r in rows], schema)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = []
    for i in range(160):
        code = ["en", "de", "fr", "es"][i % 4]
        s = [f"{rng.choice(TEXTS[code])}." for _ in range(6)]
        rows.append((i, f"f{i % 8}.pdf", None, " ".join(s[:2]), "", " ".join(s), code))
    head = "Handbook of the Library"
    for f in range(8):
        for k in range(3):
            body = f"Page {f * 3 + k} tells that the keeper closed the gate be-\n- {k + 4} -\n{head} {['North', 'South', 'East', 'West', 'Hill', 'Lake', 'Wood', 'Moor'][f]}   {k + 4}\nfore the stonn and the nur5e took the pulse. It ended in\n1978."
            rows.append((1000 + f * 3 + k, f"f{f}.pdf", None, None, None, body.replace("stonn", "storm"), "xx"))
    rows += [rows[-1], (None, None, "a", "b", "c", "d", None), (5000, None, None, None, None, None, None), (5001, "f1.pdf", " ", "", "\n", "x", "en")]
    return images(spark, rows)


def test_page_numbers():
    for s in ("12", "- 12 -", "[ 7 ]", "— l2O —", "Page 3 of 14", "Seite l4 von 20", "p. 9", "xiv", "12/40", "Pagc 4"):
        assert scan_lines.number_form(s) in (1, 2, 3), s
    for s in ("1978.", "3.12", "page 4 of the handbook shows", "", "mix up", "Chapter 7", "12 apples", "on page 4."):
        assert scan_lines.number_form(s) in (0, 4), s


def test_scan_findings(spark, pages):
    got = {tuple(r) for r in scan_noise.scan_findings(pages).collect()}
    for i in range(1000, 1024):
        own = {(r[2], r[3]) for r in got if r[0] == i}
        assert ("hyphenation", "before") in own and ("misread", "nurse") in own and ("page_number", f"- {i % 1000 % 3 + 4} -") in own
        assert any(k == "header" and v.startswith("Handbook of the Library") for k, v in own) and len(own) == 4
    assert all(r[0] >= 1000 for r in got)
    assert scan_noise.scan_findings(pages.limit(0)).count() == 0


def test_repaired_text(spark, pages):
    rows = {(r.image_id, r.field_name): r.text for r in scan_noise.repaired_texts(pages).collect()}
    assert rows[1000, "context"] == "Page 0 tells that the keeper closed the gate before the storm and the nurse took the pulse. It ended in 1978."


def codes(text, recurs=None):
    return np.array(scan_lines.line_features(text, recurs or {})[1])


LINES = [
    "The keeper closed the gate before the long storm came up\nGazette\nand they repaired the bridge with help from the town.\n- 12 -",
    "Gazette\nThe keeper closed the gate before the long storm came up\nand they repaired the bridge with help.",
    "Contents of the year\nThe keeper closed the gate before the long storm came up\nin\n1978.",
    "They ended.",
    "<IMAGE A>a.png</IMAGE A>\n\nThey repaired the bridge.",
]
ROLES = [["body", "header", "body", "page_number"], ["header", "body", "body"], ["heading", "body", "body", "body"], ["body"], ["break", "break", "body"]]


def test_line_model_labels_and_learns():
    m, seqs = scan_lines.LineModel(), [codes(t, {"gazette": 3, scan_lines.header_key("Gazette"): 3}) for t in LINES]
    assert [[scan_lines.STATES[k] for k in p] for p in m.paths([*seqs, np.array([], int)])] == [*ROLES, []]
    r = m.refitted(m.expected(seqs))
    assert np.allclose(r.move.sum(axis=1), 1) and all(np.allclose(e.sum(axis=1), 1) for e in r.emit.values())
    # many texts at once give what each gives by itself
    assert np.allclose(m.expected(seqs), sum(m.expected([s]) for s in seqs)) and m.expected(seqs)[:5].sum() == pytest.approx(len(seqs))


def test_line_model_against_brute_force():
    """Viterbi and expected counts of a short text against all sequences of roles."""
    import itertools

    m, s = scan_lines.LineModel(), codes("Gazette\nThe keeper closed the gate\n7", {scan_lines.header_key("Gazette"): 1})
    k = range(len(scan_lines.STATES))
    score = {q: np.log(m.start[0][q[0]]) + sum(np.log(m.move[a, b]) for a, b in zip(q, q[1:])) + sum(m.log_emit[c, r] for c, r in zip(s, q)) for q in itertools.product(k, repeat=3)}
    assert m.paths([s])[0] == list(max(score, key=score.get))
    total = sum(np.exp(x) for x in score.values())
    want = [sum(np.exp(x) for q, x in score.items() if q[0] == a) / total for a in k]
    assert np.allclose(m.expected([s])[:5], want)


def test_header_keys():
    same = ["Handbook of the Library   12", "12 | HANDBOOK OF THE LIBRARY", "* H@ndbo0k of thc Library *", "  Handbook of the Library"]
    assert len({scan_lines.header_key(s) for s in same}) == 1 and scan_lines.header_key("***") is None
    assert scan_lines.header_key("Gazette") == scan_lines.header_key("gazette 9") and scan_lines.skip_templates("gazette") == []


def test_language_segments(spark):
    rows = []
    rng = random.Random(1)
    for i in range(200):
        code = ["en", "de", "fr", "es"][i % 4]
        rows.append((i, "f", None, f"{rng.choice(TEXTS[code])}.", None, " ".join(f"{x}." for x in rng.sample(TEXTS[code], 3)), [code, "und", None, code, "fr"][i % 5]))
    mixed = f"{TEXTS['en'][0]}. {TEXTS['en'][1]}. <IMAGE X>a.png</IMAGE X> {TEXTS['de'][2]}. {TEXTS['en'][3]}."
    rows += [(900, "f", None, "no sentence", None, mixed, "English"), (901, None, None, None, None, None, None), (902, "f", None, "3.12", None, "", "de")]
    got = {(r.image_id, r.field_name, r.segment_no): r.lang_code for r in language_labels.wrong_labels(images(spark, rows)).collect()}
    assert [got.get((900, "context", n)) for n in (1, 2, 3, 4)] == ["en", "de", "en", None] and (900, "current", 1) not in got
    for i in range(200):
        code, label = ["en", "de", "fr", "es"][i % 4], rows[i][6]
        assert got.get((i, "current", 1)) == (None if label == code else code)
    assert language_labels.wrong_labels(images(spark, rows).limit(0)).count() == 0


def test_labels(spark):
    words = ["EN", " en-US ", "Deutsch", "fra", "Español", "xx", "und", "", None, "pt_BR", "enx"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(languages.label_code(F.col("w"))).collect()
    assert [r[0] for r in rows] == ["en", "en", "de", "fr", "es", None, None, None, None, "pt", None]


def test_answer_pairs(spark):
    docs = spark.createDataFrame([(i, f"{t}. {t}.", c) for i, (c, t) in enumerate([(c, t) for c, ts in TEXTS.items() for t in ts] * 5)], "doc_id bigint, text string, lang string")
    p = f"<figure><img src='a.png'><p>{TEXTS['en'][0]}. {TEXTS['en'][1]}.</p></figure>"
    alt = lambda t: f'<img src="a.png" alt="{t}">'
    cases = [
        (p, alt(TEXTS["en"][2]), None, None), (p, "", "", "empty"), (p, "<p> </p>", None, "empty"), (p, None, "timeout after 9 s", None), (p, '<img src="a.png" alt="" role="presentation">', None, None),
        (p, "I'm sorry, but I can't describe this image.", None, "refusal"), (p, None, "model reply: Lo siento, no puedo describir esta imagen.", "refusal"), (p, p.upper(), None, "copy"), (p, f"Answer: {p}", None, "copy"),
        ("Put simply: " + TEXTS["en"][0] + ".", TEXTS["en"][0] + ".", None, "copy"), (p, '<img src="a.png" alt="A nurse took', None, "truncated"), (p, alt("A nurse took the pulse and cha"), None, "truncated"), (p, alt("A nurse took the..."), None, "truncated"),
        (p, alt(TEXTS["de"][2]), None, "other_language"), (p, alt("Crest"), None, None), (None, None, None, "empty"), (None, "x.", None, None), ("", alt(TEXTS["en"][3]), None, None),
    ]
    rows = [(i, b, a, f, "remediated", 1) for i, (b, a, f, _) in enumerate(cases)] + [(0, cases[0][0], cases[0][1], None, "remediated", 1), (None, p, "", "", "failed", 1), (99, p, "", "", "needs_remediation", 1)]
    df = spark.createDataFrame(rows, "detail_id bigint, before_content string, after_content string, failure_reason string, remediation_status string, defect int")
    got = {r.detail_id: r.defect for r in answer_pairs.broken_pairs(df, docs).collect()}
    assert got == {i: d for i, (_, _, _, d) in enumerate(cases) if d}
    assert answer_pairs.broken_pairs(df.limit(0), docs).count() == 0


def test_pieces_of_words_whatever_their_number(spark):
    for times in (1, 2, 3, 40):
        rows = [f"The keeper closed gate {i} and changed the lock of the park" for i in range(60 * times)]
        cuts = [f"Guard {i} took the pulse and cha" for i in range(times)]
        # a whole word that only ends unended texts is none, though longer ones begin with it
        whole = [f"Visitor {i} may not park here" for i in range(30 * times)] + [f"Visitor {i} came heretofore by bus." for i in range(60 * times)]
        df = spark.createDataFrame([(x,) for x in rows + cuts + whole], "own string")
        assert {r.own for r in answer_pairs.broken_off(df).collect()} == set(cuts)


def test_answers_in_failure_reasons(spark):
    docs = spark.createDataFrame([(f"{t}. {t}.", c) for c, ts in TEXTS.items() for t in ts] * 5, "text string, lang string")
    p = f"<p>{TEXTS['en'][0]}. {TEXTS['en'][1]}.</p>"
    cases = [
        (p, "copy"), (f"model reply: {p}", "copy"), (f"model reply: {TEXTS['de'][2]}.", "other_language"), (f"model reply: {TEXTS['en'][2]}.", None), ("model reply: A nurse took the...", "truncated"),
        ('<img src="a.png" alt="A nurse took', "truncated"), ("cannot parse <figure> element", None), ('model reply: <img src="a.png" alt="A nurse took', "truncated"), ("invalid JSON in model reply", None), ("selector matched no element", None), ("Zeit überschritten, keine Antwort von dem Dienst", None),
    ]
    rows = [(i, p, None, r, "failed") for i, (r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "detail_id bigint, before_content string, after_content string, failure_reason string, remediation_status string")
    assert {r.detail_id: r.defect for r in answer_pairs.broken_pairs(df, docs).collect()} == {i: d for i, (_, d) in enumerate(cases) if d}


def test_document_languages_read_all_documents_without_markup(spark):
    rows = [(f"{t}. {t}.", c) for c, ts in TEXTS.items() for t in ts] * 5
    rows += [(f"Die Wärterin schloss das Tor, und die Schwester fand quarzige und xylophonische Käfer. {TEXTS['de'][2]}.", label) for label in (None, "und")] * 10
    rows += [(f"<figure><strong>{t}</strong>&nbsp;&thinsp;{t}.</figure>", "es") for t in TEXTS["es"]] * 5
    model = answer_pairs.document_languages(spark.createDataFrame(rows, "text string, lang string"))
    told = lambda *ws: dict(zip(model.codes, model.scores([*ws])))
    x = told("quarzige", "xylophonische")
    assert x["de"] - max(v for c, v in x.items() if c != "de") > answer_pairs.LEAD
    x = told("strong", "figure", "nbsp", "thinsp")
    assert x["es"] - max(v for c, v in x.items() if c != "es") < answer_pairs.LEAD
    assert languages.marked_sentences("<p>Eins und zwei. Drei &amp; vier <b>sind</b> mehr</p>\n\n<li>Nur") == [["und", "zwei"], ["vier", "sind", "mehr"]]
    texts = [["strong"], [], ["die", "keeper", "die"], []]
    assert np.allclose(model.all_scores(texts), [model.scores(ws) for ws in texts])


def edits_at_most(item, doc, run=20, per=10):
    """Brute force: whether some run of the item is within its edits of some stretch of the document."""
    for i in range(len(item) - run + 1):
        for n in range(run, min(len(item) - i, 2 * run - 1) + 1):
            a, most = item[i : i + n], n // per
            row = [0] * (len(doc) + 1)  # free start
            for x in range(1, n + 1):
                new = [x]
                for y in range(1, len(doc) + 1):
                    new.append(min(row[y - 1] + (a[x - 1] != doc[y - 1]), row[y] + 1, new[y - 1] + 1))
                row = new
            if min(row) <= most:
                return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(40)), "w1 w2") for k in range(30)] + [(77, "too short", "x"), (78, None, None)]
    docs = []
    for d in range(120):
        ws = items[rng.randrange(30)][1].split()
        s = rng.randrange(0, 15)
        own = ws[s : s + rng.randrange(15, 30)]
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], ["zz"], [own[k], "zz"]])
        around = [rng.choice(vocabulary) for _ in range(30)]
        docs.append((d, " ".join(around[:15]) + ", <b>" + " ".join(own).upper() + "</b>&nbsp;" + " ".join(around[15:])))
    docs += [(900, None), (901, ""), (None, items[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(items + items[:1], "item_id bigint, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in eval_leaks.leaks(df, it).collect()}
    want = {(d, k) for d, t in docs[:120] for k, x, _ in items[:30] if edits_at_most(x.split(), eval_leaks.words(t))}
    assert got == want and len(want) > 30
    assert eval_leaks.leaks(df.limit(0), it).count() == 0 == eval_leaks.leaks(df, it.limit(0)).count()


def test_block_max_search_loses_nothing():
    rng = random.Random(4)
    items = [(k, [f"w{rng.randrange(200)}" for _ in range(30)]) for k in range(100)]
    index = eval_leaks.LeakIndex(items)
    for _ in range(200):
        p = [f"w{rng.randrange(200)}" for _ in range(30)] + items[rng.randrange(100)][1][:20]
        pairs = list(zip(p, p[1:]))
        score = Counter()
        for t in set(pairs) & index.postings.keys():
            score.update(dict(zip(index.postings[t].items, index.postings[t].scores)))
        assert index.above(pairs) == sorted(k for k, x in score.items() if x >= 1) != []


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 40)), ["a", " A", "b", "c", None, " "][i % 6]) for i in range(600)] + [(700, None, "b"), (None, "x", "a")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("A", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 1), ("d", 0.1, 9), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    records, shares = source_mix.mix(df, targets, TOKENIZERS)
    got = {r.source: r for r in shares.collect()}
    assert {k for k, r in got.items() if r.short} == {r.source for r in source_mix.short_sources(df, targets, TOKENIZERS).collect()} == {"c", "d"}
    for k, r in got.items():
        assert abs(r.tokens - r.budget) <= 40 and r.tokens <= r.size * {"a": 1, "b": 2, "c": 1, "d": 9}[k] + 40
    uses = records.groupBy("source", "doc_id").count().agg({"count": "max"}).first()[0]
    assert uses <= 2 and records.where("position < 0 OR position > 1 OR position IS NULL").count() == 0 and records.dropDuplicates(["source", "doc_id", "repeat"]).count() == records.count()
    assert source_mix.short_sources(df.limit(0), targets, TOKENIZERS).count() == 0
    x, w = source_mix.temperature_weights({"a": 900, "b": 90, "c": 10}, 1000, {"a": 1, "b": 4, "c": 4}, None)
    assert got["a"].exponent is not None and got["d"].exponent is None
    e = source_mix.target_exponents({"a": 0.9, "b": 0.1, "c": 0.0}, {"a": 0.3, "b": 0.7, "c": 0.5})
    assert abs(0.9 ** e["a"] - 0.3) < 1e-9 and abs(0.1 ** e["b"] - 0.7) < 1e-9 and e["c"] is None
    assert abs(sum(w.values()) - 1) < 1e-9 and w["c"] * 1000 <= 40.001 and (w["c"] * 1000 > 39 or w["b"] * 1000 > 350)


def test_subjects(spark):
    rng = random.Random(9)
    words = {"sport": "goal match club referee", "music": "choir organ sonata violin", "law": "court judge statute appeal", "none": "heading caption panel table"}
    filler = "the a with from before after near today".split()
    made, labels = [], []
    for i in range(400):
        picks = rng.sample(["sport", "music", "law"], rng.choice([1, 1, 2])) if i % 5 else []
        ss = [" ".join(rng.sample(words[s].split() + filler, 7)) + "." for s in [*picks * 5, *["none"] * 4]]
        made.append((i, " ".join(x.capitalize() for x in ss), ["en", None][i % 2]))
        if i % 2 == 0:
            labels += [(i, s) for s in picks or ["none"]]
    made += [(900, None, "en"), (901, "", "en"), (None, "x y z.", "en")]
    docs = spark.createDataFrame([(*m, 0) for m in made], "doc_id bigint, text string, lang string, subject int")
    told = spark.createDataFrame(labels + labels[:3] + [(None, "law"), (2, None), (12345, "law")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s, "") for s in ("sport", "music", "law")], "subject string, description string")
    items = spark.createDataFrame([(1, "an item that is nowhere here", "x")], "item_id bigint, text string, answer string")
    got = {}
    for r in subject_areas.treated_subjects(docs, told, areas, items).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    want = {i: set() for i in range(400)}
    for i, t, _ in made[:400]:
        for s in ("sport", "music", "law"):
            if any(w in t.lower() for w in words[s].split()):
                want[i].add(s)
    right = sum(got.get(i, set()) == want[i] for i in want)
    assert right >= 0.95 * len(want)
    assert subject_areas.treated_subjects(docs.limit(0), told, areas, items).count() == 0


def test_vocabulary_keeps_terms_of_a_small_share(spark):
    rows = [(["the judge heard the appeal"],)] * 5000 + [(["sędzia wysłuchał apelacji"],)] * 4 + [(["hapax"],)]
    terms, _ = subject_areas.vocabulary(spark.createDataFrame(rows, "sentences array<string>"))
    assert set(terms) == {"the", "judge", "heard", "appeal", "sędzia", "wysłuchał", "apelacji"}


def test_misreadings_of_any_number_of_confusions_and_of_two_letters(spark):
    rows = [("possibilities", 400, False), ("of", 900, False), ("to", 900, False), ("Lisboa".lower(), 90, True), ("nurse", 300, False)]
    read = [("p055ibi1ities", "possibilities"), ("p0551b1l1t1e5", "possibilities"), ("0f", "of"), ("t0", "to"), ("nur5e", "nurse"), ("1i5b0a", None), ("4th", None), ("r0", None)]
    words = spark.createDataFrame(rows + [(r, 1, False) for r, _ in read], "word string, n bigint, is_name boolean")
    assert {r.read: r["item"] for r in scan_noise.misreadings(words).collect()} == {r: w for r, w in read if w}
    assert all(scan_lines.shapes(a) == scan_lines.shapes(b) and scan_lines.confusions(a, b) == 1 for a, b in scan_lines.CONFUSED)
    assert scan_lines.confusions("modern", "rn0dcm") == 4 and scan_lines.confusions("modern", "modest") is None
    for w in ("hand", "million", "window"):
        assert all(n == scan_lines.confusions(v, w) for v, n in scan_lines.originals(w))
