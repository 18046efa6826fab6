"""Trees of single documents, and one document per finding."""

import pytest

from pharos.operators import issues
from pharos.sources.html_tree import parse, parsed


def node(html, name, n=0):
    return [x for x in parse(html) if x["name"] == name][n]


def test_unclosed_tags_stay_open_and_stray_end_tags_are_ignored():
    p = node("<p><b>a</i></div><br><p>b", "p")
    assert p["post"] == 3 and [x["depth"] for x in parse("<p><b>a<br><p>b")] == [1, 2, 3, 3]


def test_text_runs_are_trimmed_and_joined_without_a_separator():
    assert node("<p>Hello <b> World </b></p>", "p")["text"] == "HelloWorld"
    assert node("<div><script>a</script>b</div>", "div")["text"] == "b"
    assert node("<script>x = '</p>'</script>", "script")["text"] == "x = '</p>'"


def test_single_string_needs_one_chain():
    assert node("<a><b> x </b></a>", "a")["string_value"] == " x " and node("<a>x<b>y</b></a>", "a")["string_value"] is None


def test_attributes_entities_and_paths():
    a = node('<div class="x y"><a href="?a&amp;b" href="2" hidden>t</a><a>u</a></div>', "a")
    assert a["attrs"] == {"href": "2", "hidden": ""} and a["path"] == "[document] > div.x.y > a"
    assert node("<div><a>t</a><a>u</a></div>", "a", 1)["path"] == "[document] > div > a:nth-of-type(2)"
    assert node('<p id="i"><b>x</b></p>', "b")["path"] == "p#i > b"
    assert node('<div class="Page_4"><p>x</p></div>', "p")["page"] == 4


def test_empty_and_null_documents():
    assert parse("") == parse(None) == []


CASES = [
    ("<h1>a</h1><h3>b</h3><h2>c</h2>", "heading_hierarchy", ["compliant-heading-hierarchy"]),
    ("<h1>a</h1><h3>b</h3>", "heading_hierarchy", ["skipped-heading-level"]),
    ("<p>x</p>", "heading_hierarchy", ["no-headings"]),
    ("<h2></h2>", "heading_content", ["empty-heading"]),
    ("<title> </title>", "document_title", ["empty-title"]),
    ("<title>Untitled</title>", "document_title", ["generic-title"]),
    ("<p>x</p>", "document_title", ["missing-title"]),
    ("<html lang='e'></html>", "document_language", ["invalid-document-language"]),
    ("<html></html>", "document_language", ["missing-document-language"]),
    ("<p>x</p>", "document_language", []),
    ("<div role='main'></div>", "main_landmark", ["compliant-main-landmark"]),
    ("<a href='#m'>Skip to content</a>", "skip_link", ["compliant-skip-link"]),
    ("<img alt='x'>", "image_alt", ["compliant-alt-text"]),
    ("<a target='_blank' rel='external'>t</a>", "new_window", ["new-window-link-no-warning"] * 2),
    ("<a target='_blank'>t<i class='fa-external-link'></i></a>", "new_window", ["compliant-new-window-link"]),
    ("<a href='/1'>x <b>y</b></a><a href='/2'>x <b>y</b></a>", "link_text", ["compliant-link-text"] * 2),
    ("<a href='/1'>x</a><a href='/2'>X</a>", "link_text", ["compliant-link-text"] * 2 + ["duplicate-link-text-different-url"] * 2),
    ("<table><tr><th rowspan='x'>a</th><td>b</td></tr><tr><td>c</td></tr></table><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "table_headers", ["table-missing-scope"]),
    ("<table><tr><th>a</th><td>b</td></tr><tr></tr></table>", "table_structure", ["table-missing-thead", "table-missing-tbody"]),
    ("<p style='color:#12345'>a</p><p style='color:#eeeeee'>b</p>", "contrast", []),
    ("<p style='background-color:#fff;color:#000'>a</p>", "contrast", ["insufficient-color-contrast"]),
    ("<p style='color:#777777'>a</p>", "contrast", ["insufficient-color-contrast"]),
    ("<h1 style='color:#777777'>a</h1>", "contrast", []),
    ("<input placeholder='x' name='n'>", "form_labels", ["form-control-missing-label"]),
    ("<input aria-labelledby='a b' name='n'><i id='b'>x</i>", "form_labels", []),
    ("<label>Required <input required aria-required='true'></label>", "required_fields", []),
    ("<form><div><p><input type='checkbox'></p><p><input type='checkbox'></p><p><input type='checkbox'></p></div></form>", "fieldsets", ["form-related-controls-no-fieldset"]),
    ("", "landmarks", ["missing-navigation-landmark", "missing-header-landmark", "missing-footer-landmark"]),
]


def test_each_finding(spark):
    rows = spark.createDataFrame([(i, "page-3.html", h) for i, (h, _, _) in enumerate(CASES)], "doc_id bigint, file_path string, html string")
    found = {}
    for r in issues.candidates(parsed(rows)).select("doc_id", "check", "check_ord", "emit_ord", "type").orderBy("doc_id", "check_ord", "emit_ord").collect():
        found.setdefault((r.doc_id, r.check), []).append(r.type)
    for i, (html, check, want) in enumerate(CASES):
        assert found.get((i, check), []) == want, (html, check)


def test_thresholds_and_numbers(spark):
    pages = spark.createDataFrame([(1, "a/page-3.html", "<html lang='en'><a href='/x'>here</a><img>"), (2, "b/Page_4.HTML", None)], "doc_id bigint, file_path string, html string")
    rows = issues.audit(pages).orderBy("issue_seq").collect()
    assert [r.issue_seq for r in rows] == list(range(1, len(rows) + 1)) and {r.location.page_number for r in rows} == {3, 4}
    strict = issues.audit(pages, severity_threshold="critical", number=False).collect()
    assert all(r.remediation_status == "compliant" or r.severity == "critical" for r in strict) and any(r.severity == "minor" or r.remediation_status == "compliant" for r in strict)
    assert not any(r.severity == "info" and r.remediation_status != "compliant" for r in rows)
    assert issues.audit(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<p>a & b</p>", '<img alt="x&quot;y">', "<!DOCTYPE html><p>x</p>", "<script>1<2</script>"])
def test_documents_survive_a_rewrite(html):
    from pharos.operators.remediation import build

    once = build(html).html()
    assert build(once).html() == once and build(html).text() == build(once).text()
