"""Queries that take every branch of a rule: documents of known shapes, dealt out over the parts, and what each shape must give.

A shape is a document and the rows expected of it. The expectations are written down from the rules and are all that the
SQL knows; they aren't derived from what the operators return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.operators import alternative_checks, issues, remediation
from pharos.runtime import table
from pharos.sources import html_tree

Shape = tuple[str, list[tuple]]


def _dealt(spark: SparkSession, sf_dir: str, shapes: list[Shape], start: int = 0) -> DataFrame:
    """One document for each part, of the shape p_partkey % shapes."""
    html = F.element_at(F.array(*[F.lit(h) for h, _ in shapes]), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("doc_id"), F.concat(F.lit("out/page-"), F.col("p_partkey"), F.lit(".html")).alias("file_path"), html.alias("html"))


def _quoted(x) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _expected(shapes: list[Shape], columns: str) -> str:
    rows = ", ".join(f"({k}, {', '.join(_quoted(x) for x in r)})" for k, (_, rs) in enumerate(shapes) for r in rs)
    return f"WITH known(shape, {columns}) AS (VALUES {rows}) SELECT {columns}, count(*) AS n FROM part JOIN known ON shape = p_partkey % {len(shapes)} GROUP BY ALL"


def _checked(shapes: list[Shape], checks: list[str], rules: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = html_tree.parsed(_dealt(spark, sf_dir, shapes))
        found = issues.candidates(pages, checks, rules) if rules is not None else issues.candidates(pages, checks)
        return found.groupBy("type", "severity", "status").agg(F.count("*").alias("n"))

    return query


def _body(inside: str) -> str:
    return f"<html lang='en'><head><title>Parts</title></head><body>{inside}</body></html>"


BAD, GOOD = "needs_remediation", "compliant"

#: Title, language, main landmark, skip link and landmarks, each branch once.
SHELLS: list[Shape] = [
    ("<html><body><p>x</p></body></html>", [("missing-title", "major", BAD), ("missing-document-language", "critical", BAD), ("missing-main-landmark", "major", BAD), ("missing-skip-link", "major", BAD)] + [(f"missing-{k}-landmark", "minor", BAD) for k in ("navigation", "header", "footer")]),
    (
        "<html lang='e'><head><title> </title></head><body><a href='#m'>Skip to main</a><header></header><nav></nav><main id='m'></main><footer></footer></body></html>",
        [("empty-title", "major", BAD), ("invalid-document-language", "major", BAD), ("compliant-main-landmark", "major", GOOD), ("compliant-skip-link", "major", GOOD)] + [(f"compliant-{k}-landmark", "minor", GOOD) for k in ("navigation", "header", "footer")],
    ),
    (
        "<html lang='de-AT'><head><title>Untitled</title></head><body><a href='/x'>Skip</a><div role='main'></div><div role='navigation'></div><div role='banner'></div><div role='contentinfo'></div></body></html>",
        [("generic-title", "minor", BAD), ("compliant-document-language", "critical", GOOD), ("compliant-main-landmark", "major", GOOD), ("missing-skip-link", "major", BAD)] + [(f"compliant-{k}-landmark", "minor", GOOD) for k in ("navigation", "header", "footer")],
    ),
]

_ISSUE = lambda kind, severity, status=BAD: (kind, severity, status)
_PRESENT = _ISSUE("alt-text-present", "info", "remediated")
#: The second set's rules for images, tables, forms and links.
ALTERNATIVES: list[Shape] = [
    (_body("<img src='a.png'>"), [_ISSUE("missing-alt-text", "critical")]),
    (_body("<img src='a.png' alt=''><img src='spacer.gif' alt=''><img src='b.png' alt='' width='10' height='12'><img src='b.png' alt='' width='10' height='40'>"), [_ISSUE("empty-alt-text", "major"), _PRESENT, _PRESENT, _ISSUE("empty-alt-text", "major")]),
    (_body("<img src='a.png' alt='image 3'><img src='a.png' alt='Photo'><img src='a.png' alt='ICON'><img src='a.png' alt='picture'>"), [_ISSUE("generic-alt-text", "major"), _PRESENT, _ISSUE("generic-alt-text-icon", "major"), _ISSUE("generic-alt-text", "major")]),
    (_body("<img src='a.png' data-bda-generated-alt='true' alt='A lamp'><img src='a.png' data-bda-generated-alt='true' alt='photo 12'>"), [_ISSUE("alt-text-present", "info", "auto_remediated")] * 2 + [_ISSUE("generic-alt-text", "major")]),
    (_body(f"<img src='a.png' alt='{'x' * 151}'><img src='a.png' alt='{'x' * 150}'>"), [_ISSUE("long-alt-text", "minor"), _PRESENT]),
    (_body("<img src='Chart1.png' alt='Sales'><img src='a.png' alt='Map' width='301' height='400'><img src='a.png' alt='Map' width='301' height='300'>"), [_PRESENT] * 3 + [_ISSUE("improper-figure-structure", "major")] * 2),
    (_body("<img src='a.png' alt='Map' data-bda-id='7'><p>See Figure 12.</p><img src='a.png' alt='Map' data-bda-id='8'><p>See below.</p>"), [_PRESENT] * 2 + [_ISSUE("improper-figure-structure", "major")]),
    (_body("<figure><img src='chart.png' alt='Sales'></figure><figure><img src='a.png' alt='Map'><figcaption>c</figcaption></figure>"), [_PRESENT] * 2 + [_ISSUE("missing-figcaption", "major")]),
    (_body("<a href='/a'> </a><a href='/a'>Go to</a><a href='/a'>this page</a><a href='/a'><img src='i.png'><img src='j.png' alt='x'></a><a href='/a'><img src='j.png' alt='Home'><img src='i.png'></a>"), [_ISSUE("empty-link", "critical"), _ISSUE("generic-link-text", "major"), _ISSUE("link-image-missing-alt", "critical"), _ISSUE("missing-alt-text", "critical"), _PRESENT, _PRESENT, _ISSUE("missing-alt-text", "critical")]),
    (_body("<select title='Country'></select><input aria-label=' '><label for='z'>Z</label><textarea id='z' required></textarea><label>W <input name='w'></label><input type='reset'>"), [_ISSUE("missing-form-label", "critical")] * 2 + [_ISSUE("missing-aria-required", "minor")]),
    (
        _body("<table><caption>c</caption><tr><th scope='col'>a</th><th scope='col'>b</th><th scope='col'>c</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"),
        [_ISSUE("complex-table-no-ids", "critical")],
    ),
    (_body("<table><caption>c</caption><tr><th scope='col'>a</th><th scope='col'>b</th><th>c</th></tr><tr><td headers='a'>1</td></tr><tr><td>2</td></tr></table>"), [_ISSUE("missing-header-scope", "major")]),
]

_P = "<p>The lamp stands on a table in the hall of the house</p>"
#: What repairs write, by rule: the name of the element and what it says afterwards.
REPAIRS: list[Shape] = [
    (_body("<a href='https://www.lamps.test/x'> </a><a href='/y'></a>"), [("a", "Link to lamps.test"), ("a", "Link to /y")]),
    (_body("<a href='http://lamps.test/x'>Click here</a>"), [("a", "Visit lamps.test website")]),
    (_body("<p>Lamps and shades <a href='/y'>More</a></p>"), [("a", "More about Lamps and shades")]),
    (_body("<p>Lamps and shades of glass, brass and paper <a href='/y'>read more</a></p>"), [("a", "More about Lamps and shades of glass, bra...")]),
    (_body("<a href='/1'>Click here</a><a href='/2'>Read more</a><a href='/3'>Learn more</a><a href='/4'>Details</a>"), [("a", "View details"), ("a", "Read more about this topic"), ("a", "Learn more about this topic"), ("a", "View related information")]),
    (_body("<a href='/1'>https://www.lamps.test/list</a><a href='https://x.test'>www.lamps.test</a>"), [("a", "Visit lamps.test"), ("a", "Visit website")]),
    (_body("<a href='/1' target='_blank'>Terms</a>"), [("a", "Terms(opens in new window)"), ("title", "Terms (opens in new window)")]),
    (_body("<img src='a.png'><img src='b.png' alt=''>"), [("img", "Image description unavailable"), ("img", "Image description unavailable")]),
    (_body("<img src='a.png' alt='' class='bullet small'><div class='site-logo'><img src='b.png' alt=''></div>"), [("img", ""), ("img", "")]),
    (_body("<h1>Lamps</h1><div><img src='a.png' alt='diagram'></div><div>Brass lamp<img src='a.png' alt='Photo'></div>"), [("h", "Lamps"), ("img", "Diagram showing Lamps"), ("img", "Photo of Brass lamp")]),
    (_body("<div><img src='a.png' alt='icon'></div>"), [("img", "Image related to this content")]),
    (_body(f"<h1>Lamps</h1><h2> </h2>{_P}"), [("h", "Lamps"), ("h", "The lamp stands on a...")]),
    (_body("<h1></h1>"), [("h", "Document Title")]),
    (_body("<h1>Lamps</h1><h2></h2><h2></h2>"), [("h", "Lamps"), ("h", "Section 1"), ("h", "Section 2")]),
    (_body("<h1>Lamps</h1><h2>Title</h2><div>Brass and glass</div><h2>Shades</h2><div>Paper</div>"), [("h", "Lamps"), ("h", "Brass and glass"), ("h", "Shades")]),
]


def repair_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links, images and headings say after repair."""
    pages = _dealt(spark, sf_dir, REPAIRS)
    found = issues.audit(pages, detailed=False, checks=["image_alt", "link_text", "new_window", "heading_content"])
    done = remediation.remediate(pages, found)
    nodes = html_tree.flat_nodes(html_tree.parsed(done.select("doc_id", "file_path", "html")))
    kind = F.when(F.col("name").rlike("^h[1-6]$"), "h").when(F.col("name").isin("a", "img"), F.col("name"))
    said = F.when(F.col("name") == "img", F.try_element_at("attrs", F.lit("alt"))).otherwise(F.col("text"))
    told = nodes.where(kind.isNotNull()).select(kind.alias("element"), said.alias("says"))
    titles = nodes.where("name = 'a' AND map_contains_key(attrs, 'title')").select(F.lit("title").alias("element"), F.col("attrs")["title"].alias("says"))
    return told.unionByName(titles).groupBy("element", "says").agg(F.count("*").alias("n"))


QUERIES = {
    "page_shells": _checked(SHELLS, ["document_title", "document_language", "main_landmark", "skip_link", "landmarks"]),
    "alternative_branches": _checked(ALTERNATIVES, ["alt_images", "alt_links", "alt_forms", "alt_tables"], alternative_checks.CHECKS),
    "repair_texts": repair_texts,
}
ORACLE = {
    "page_shells": _expected(SHELLS, "type, severity, status"), "alternative_branches": _expected(ALTERNATIVES, "type, severity, status"),
    "repair_texts": _expected(REPAIRS, "element, says"),
}
