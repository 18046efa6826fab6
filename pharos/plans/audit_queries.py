"""Queries of the accessibility audit over rendered documents; their SQL knows the answer from the rows alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.operators import alternative_checks, dimensions, issues, remediation, reports
from pharos.sources import html_tree, rendered
from pharos.runtime import cut, table


def _found(rows: str, render: Callable, *checks: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = issues.candidates(html_tree.parsed(render(table(spark, sf_dir, rows))), list(checks))
        return found.groupBy("doc_id", "type", "severity", "status").agg(F.count("*").alias("n"))

    return query


def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by name in rendered tables."""
    nodes = html_tree.flat_nodes(html_tree.parsed(rendered.tables(table(spark, sf_dir, "orders"))))
    return nodes.groupBy("name").agg(F.count("*").alias("n"))


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File name and page number of each rendered document."""
    return html_tree.parsed(rendered.images(table(spark, sf_dir, "part"))).select("doc_id", "file_name", "page_number", F.size("nodes").alias("elements"))


def before_content_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative texts of the images in contents before repair, by issue type."""
    rows = table(spark, sf_dir, "remediation_detail").where(F.col("before_content").isNotNull()).dropDuplicates(["detail_id"])
    pages = rows.select(F.col("detail_id").alias("doc_id"), F.lit("").alias("file_path"), F.col("before_content").alias("html"))
    return issues.candidates(html_tree.parsed(pages), ["image_alt"]).groupBy("type", "severity", "status").agg(F.count("*").alias("n"))


def _link_audit(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return issues.audit(rendered.links(table(spark, sf_dir, "customer")), detailed=False, **options)


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audit_summary(_link_audit(spark, sf_dir, number=False))


def issues_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues.audit(rendered.images(table(spark, sf_dir, "part")), detailed=False)
    return reports.by_page(found).select("page_number", "total", "needs_remediation", "remediated", "auto_remediated", "compliant", F.size("issues").alias("listed"))


def issues_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_status(_link_audit(spark, sf_dir, number=False))


def issues_by_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_audit(spark, sf_dir, number=False).groupBy("wcag_criterion", "criterion_name", "criterion_level").agg(F.count("*").alias("n"))


def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_audit(spark, sf_dir, severity_threshold="critical", number=False).groupBy("type", "severity").agg(F.count("*").alias("n"))


def issue_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_audit(spark, sf_dir).select("issue_seq", "id", "doc_id", "type")


def unified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unified_counts(_link_audit(spark, sf_dir, number=False))


def remediation_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _link_audit(spark, sf_dir, number=False).where(F.col("remediation_status") == "needs_remediation")
    return found.groupBy(dimensions.dispatch_outcome(F.col("type")).alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("type").alias("types"))


def criteria_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.criteria(spark).groupBy("criterion_level").agg(F.count("*").alias("n"))


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.types_of_element(dimensions.issue_types(spark), "img").select("type", "criterion", "severity")


QUERIES = {
    "image_alt_audit": _found("part", rendered.images, "image_alt"),
    "figure_audit": _found("part", rendered.figures, "figure"),
    "heading_hierarchy": _found("part", rendered.headings, "heading_hierarchy"),
    "heading_content": _found("part", rendered.headings, "heading_content"),
    "title_audit": _found("part", rendered.images, "document_title"),
    "language_audit": _found("part", rendered.images, "document_language"),
    "main_landmark": _found("part", rendered.images, "main_landmark"),
    "landmark_audit": _found("part", rendered.images, "landmarks"),
    "skip_link": _found("part", rendered.images, "skip_link"),
    "link_text_audit": _found("customer", rendered.links, "link_text"),
    "new_window_links": _found("customer", rendered.links, "new_window"),
    "table_header_audit": _found("orders", rendered.tables, "table_headers"),
    "table_structure_audit": _found("orders", rendered.tables, "table_structure"),
    "color_contrast_audit": _found("part", rendered.colours, "contrast"),
    "form_label_audit": _found("customer", rendered.forms, "form_labels"),
    "required_fields": _found("customer", rendered.forms, "required_fields"),
    "fieldset_groups": _found("supplier", rendered.groups, "fieldsets"),
} | {
    f.__name__: f
    for f in (
        tag_histogram, page_inventory, before_content_images, audit_summary, issues_by_page, issues_by_status, issues_by_criterion, severity_threshold, issue_numbering,
        unified_counts, remediation_dispatch, criteria_lookup, registry_lookup,
    )
}


def _known(rows: str, key: str, shape: str, answers: str) -> str:
    """SQL that joins the shape of each row to the findings of that shape."""
    return f"""
WITH answers(shape, type, severity, status, n) AS (VALUES {answers})
SELECT CAST({key} AS BIGINT) AS doc_id, type, severity, status, CAST(n AS BIGINT) AS n FROM {rows} JOIN answers ON shape = {shape}"""


def _always(rows: str, key: str, *answers: tuple[str, str, str]) -> str:
    return _known(rows, key, "0", ", ".join(f"(0, '{t}', '{s}', '{c}', 1)" for t, s, c in answers))


_BAD, _GOOD = "needs_remediation", "compliant"
# Findings of each shape of rendered.links, by c_custkey % 9; then those of the pair of links, by c_nationkey % 2.
_LINKS = f"""
shapes(shape, type, severity, status, n) AS (VALUES
  (0, 'empty-link-text', 'critical', '{_BAD}', 1), (1, 'compliant-image-link', 'info', '{_GOOD}', 1), (2, 'generic-link-text', 'major', '{_BAD}', 1), (3, 'url-as-link-text', 'minor', '{_BAD}', 1),
  (5, 'compliant-link-text', 'info', '{_GOOD}', 1), (6, 'compliant-link-text', 'info', '{_GOOD}', 1), (7, 'compliant-link-text', 'info', '{_GOOD}', 1), (8, 'compliant-link-text', 'info', '{_GOOD}', 1)),
pairs(even, type, severity, status, n) AS (VALUES
  (0, 'compliant-link-text', 'info', '{_GOOD}', 2), (1, 'compliant-link-text', 'info', '{_GOOD}', 2), (0, 'duplicate-link-text-different-url', 'major', '{_BAD}', 3)),
windows(shape, type, severity, status, n) AS (VALUES
  (5, 'compliant-new-window-link', 'info', '{_GOOD}', 1), (6, 'new-window-link-no-warning', 'minor', '{_BAD}', 1), (7, 'new-window-link-no-warning', 'minor', '{_BAD}', 2)),
pages(type, severity, status, n) AS (VALUES
  ('no-headings', 'major', '{_BAD}', 1), ('compliant-document-title', 'major', '{_GOOD}', 1), ('compliant-document-language', 'critical', '{_GOOD}', 1), ('missing-main-landmark', 'major', '{_BAD}', 1),
  ('missing-skip-link', 'major', '{_BAD}', 1), ('missing-navigation-landmark', 'minor', '{_BAD}', 1), ('missing-header-landmark', 'minor', '{_BAD}', 1), ('missing-footer-landmark', 'minor', '{_BAD}', 1)),
link_rows AS (
  SELECT c_custkey, type, severity, status, n FROM customer JOIN shapes ON shape = c_custkey % 9
  UNION ALL SELECT c_custkey, type, severity, status, n FROM customer JOIN pairs ON even = c_nationkey % 2),
all_rows AS (
  SELECT * FROM link_rows UNION ALL SELECT c_custkey, type, severity, status, n FROM customer JOIN windows ON shape = c_custkey % 9
  UNION ALL SELECT c_custkey, 'compliant-alt-text', 'critical', '{_GOOD}', 1 FROM customer WHERE c_custkey % 9 = 1
  UNION ALL SELECT c_custkey, type, severity, status, n FROM customer CROSS JOIN pages)
"""
_CRITERION = """CASE WHEN type = 'compliant-alt-text' THEN '1.1.1' WHEN type = 'duplicate-link-text-different-url' THEN '2.4.9' WHEN type LIKE '%-window-link%' THEN '3.2.5' WHEN type LIKE '%title' THEN '2.4.2'
  WHEN type LIKE '%language' THEN '3.1.1' WHEN type LIKE '%skip-link' THEN '2.4.1' WHEN type LIKE '%landmark' OR type = 'no-headings' THEN '1.3.1' ELSE '2.4.4' END"""
_COUNTS = f"CAST(coalesce(sum(n) FILTER (status = '{_BAD}'), 0) AS BIGINT) AS needs_remediation, CAST(0 AS BIGINT) AS remediated, CAST(0 AS BIGINT) AS auto_remediated, CAST(coalesce(sum(n) FILTER (status = '{_GOOD}'), 0) AS BIGINT) AS compliant"
_LEVELS = ", ".join(f"CAST(coalesce(sum(n) FILTER (severity = '{s}'), 0) AS BIGINT) AS {s}" for s in ("critical", "major", "minor", "info"))

ORACLE = {
    "image_alt_audit": _known(
        "part", "p_partkey", "p_size % 6",
        f"(0, 'missing-alt-text', 'critical', '{_BAD}', 1), (1, 'empty-alt-text', 'major', '{_BAD}', 1), (2, 'compliant-decorative-image', 'minor', '{_GOOD}', 1), (3, 'generic-alt-text', 'major', '{_BAD}', 1), (4, 'compliant-alt-text', 'critical', '{_GOOD}', 1), (5, 'compliant-decorative-image', 'minor', '{_GOOD}', 1)",
    ),
    "figure_audit": _known("part", "p_partkey", "p_size % 3", f"(0, 'missing-figure-caption', 'major', '{_BAD}', 1), (1, 'empty-figure-caption', 'major', '{_BAD}', 1), (2, 'compliant-figure-structure', 'major', '{_GOOD}', 1)"),
    "heading_hierarchy": _known(
        "part", "p_partkey", "p_size % 8",
        f"(0, 'no-headings', 'major', '{_BAD}', 1), (1, 'compliant-heading-hierarchy', 'major', '{_GOOD}', 1), (2, 'no-h1', 'major', '{_BAD}', 1), (3, 'compliant-heading-hierarchy', 'major', '{_GOOD}', 1), (4, 'no-h1', 'major', '{_BAD}', 1), (5, 'skipped-heading-level', 'major', '{_BAD}', 1), (6, 'no-h1', 'major', '{_BAD}', 1), (7, 'compliant-heading-hierarchy', 'major', '{_GOOD}', 1)",
    ),
    "heading_content": f"""
SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_size % 2 = 1 AND p_size % 5 = 4 THEN 'empty-heading' WHEN p_size % 2 = 1 AND p_size % 5 = 3 THEN 'generic-heading' ELSE 'compliant-heading-content' END AS type,
  CASE WHEN p_size % 2 = 1 AND p_size % 5 = 3 THEN 'minor' ELSE 'major' END AS severity, CASE WHEN p_size % 2 = 1 AND p_size % 5 IN (3, 4) THEN '{_BAD}' ELSE '{_GOOD}' END AS status, CAST(1 AS BIGINT) AS n
FROM part WHERE p_size % 8 <> 0""",
    "title_audit": _always("part", "p_partkey", ("compliant-document-title", "major", _GOOD)),
    "language_audit": _always("part", "p_partkey", ("compliant-document-language", "critical", _GOOD)),
    "main_landmark": _always("part", "p_partkey", ("missing-main-landmark", "major", _BAD)),
    "landmark_audit": _always("part", "p_partkey", *[(f"missing-{k}-landmark", "minor", _BAD) for k in ("navigation", "header", "footer")]),
    "skip_link": _always("part", "p_partkey", ("missing-skip-link", "major", _BAD)),
    "link_text_audit": f"WITH {_LINKS} SELECT CAST(c_custkey AS BIGINT) AS doc_id, type, severity, status, CAST(sum(n) AS BIGINT) AS n FROM link_rows GROUP BY ALL",
    "new_window_links": f"WITH {_LINKS} SELECT CAST(c_custkey AS BIGINT) AS doc_id, type, severity, status, CAST(n AS BIGINT) AS n FROM customer JOIN windows ON shape = c_custkey % 9",
    "table_header_audit": _known(
        "orders", "o_orderkey", "o_orderkey % 7",
        f"(0, 'table-missing-headers', 'major', '{_BAD}', 1), (1, 'table-missing-scope', 'minor', '{_BAD}', 2), (3, 'table-missing-caption', 'minor', '{_BAD}', 1), (4, 'table-missing-headers', 'major', '{_BAD}', 1), (4, 'table-missing-caption', 'minor', '{_BAD}', 1), (6, 'table-missing-scope', 'minor', '{_BAD}', 1), (6, 'table-missing-headers', 'major', '{_BAD}', 1)",
    ),
    "table_structure_audit": _known(
        "orders", "o_orderkey", "o_orderkey % 7",
        f"(0, 'table-missing-tbody', 'minor', '{_BAD}', 1), (1, 'table-missing-thead', 'minor', '{_BAD}', 1), (1, 'table-missing-tbody', 'minor', '{_BAD}', 1), (1, 'table-irregular-headers', 'major', '{_BAD}', 1), (2, 'table-irregular-headers', 'major', '{_BAD}', 1), (3, 'table-missing-headers-id', 'major', '{_BAD}', 1), (3, 'table-irregular-headers', 'major', '{_BAD}', 1), (4, 'table-missing-headers-id', 'major', '{_BAD}', 1), (6, 'table-missing-thead', 'minor', '{_BAD}', 1), (6, 'table-missing-tbody', 'minor', '{_BAD}', 1)",
    ),
    "color_contrast_audit": _known("part", "p_partkey", "p_partkey % 6", f"(0, 'insufficient-color-contrast', 'major', '{_BAD}', 1), (2, 'insufficient-color-contrast', 'major', '{_BAD}', 2), (3, 'insufficient-color-contrast', 'major', '{_BAD}', 1)"),
    "form_label_audit": _known(
        "customer", "c_custkey", "c_nationkey % 7",
        f"(3, 'form-control-missing-name', 'major', '{_BAD}', 1), (4, 'form-control-missing-name', 'major', '{_BAD}', 1), (4, 'form-control-missing-label', 'critical', '{_BAD}', 1), (6, 'form-label-empty', 'major', '{_BAD}', 1)",
    ),
    "required_fields": _known(
        "customer", "c_custkey", "c_nationkey % 7",
        f"(4, 'form-required-field-missing-aria', 'minor', '{_BAD}', 1), (4, 'form-required-field-not-indicated', 'major', '{_BAD}', 1), (6, 'form-required-field-missing-aria', 'minor', '{_BAD}', 1), (6, 'form-required-field-not-indicated', 'major', '{_BAD}', 1)",
    ),
    "fieldset_groups": _known(
        "supplier", "s_suppkey", "s_suppkey % 5",
        f"(0, 'form-related-controls-no-fieldset', 'major', '{_BAD}', 1), (2, 'form-related-controls-no-fieldset', 'minor', '{_BAD}', 1), (4, 'form-fieldset-missing-legend', 'major', '{_BAD}', 1)",
    ),
    "tag_histogram": """
WITH tags(shape, name, n) AS (VALUES (0,'table',1),(0,'tr',2),(0,'td',4),(1,'table',1),(1,'tr',2),(1,'th',2),(1,'td',2),(2,'table',1),(2,'caption',1),(2,'thead',1),(2,'tbody',1),(2,'tr',2),(2,'th',2),(2,'td',2),
  (3,'table',1),(3,'thead',1),(3,'tbody',1),(3,'tr',2),(3,'th',1),(3,'td',2),(4,'table',1),(4,'tbody',1),(4,'tr',11),(4,'td',22),(5,'table',1),(5,'tr',2),(5,'td',3),(6,'table',2),(6,'tr',4),(6,'th',1),(6,'td',4))
SELECT name, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT name, n FROM orders JOIN tags ON shape = o_orderkey % 7 UNION ALL SELECT name, 1 FROM orders CROSS JOIN (VALUES ('html'), ('head'), ('title'), ('body')) AS t(name)) GROUP BY name""",
    "page_inventory": "SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'page-' || p_partkey || '.html' AS file_name, CAST(p_partkey AS INT) AS page_number, CAST(5 AS INT) AS elements FROM part",
    "before_content_images": r"""
WITH once AS (SELECT detail_id, min(before_content) AS html FROM remediation_detail WHERE before_content IS NOT NULL GROUP BY detail_id),
imgs AS (SELECT unnest(regexp_extract_all(html, '<img [^>]*>')) AS tag FROM once),
alts AS (SELECT tag LIKE '% alt=%' AS has, trim(regexp_extract(tag, ' alt="([^"]*)"', 1)) AS alt, tag LIKE '%role="presentation"%' AS deco FROM imgs),
kinds AS (SELECT CASE WHEN NOT has THEN 'missing-alt-text' WHEN alt = '' AND deco THEN 'compliant-decorative-image' WHEN alt = '' THEN 'empty-alt-text'
  WHEN lower(alt) IN ('image', 'diagram', 'photo', 'picture', 'graphic', 'icon') THEN 'generic-alt-text' ELSE 'compliant-alt-text' END AS type FROM alts)
SELECT type, CASE WHEN type IN ('missing-alt-text', 'compliant-alt-text') THEN 'critical' WHEN type = 'compliant-decorative-image' THEN 'minor' ELSE 'major' END AS severity,
  CASE WHEN type LIKE 'compliant%' THEN 'compliant' ELSE 'needs_remediation' END AS status, count(*) AS n FROM kinds GROUP BY ALL""",
    "audit_summary": f"WITH {_LINKS} SELECT CAST(sum(n) AS BIGINT) AS total_issues, {_COUNTS}, {_LEVELS} FROM all_rows",
    "issues_by_page": f"SELECT CAST(p_partkey AS INT) AS page_number, CAST(9 AS BIGINT) AS total, CAST(CASE WHEN p_size % 6 IN (2, 4, 5) THEN 6 ELSE 7 END AS BIGINT) AS needs_remediation, CAST(0 AS BIGINT) AS remediated, CAST(0 AS BIGINT) AS auto_remediated, CAST(CASE WHEN p_size % 6 IN (2, 4, 5) THEN 3 ELSE 2 END AS BIGINT) AS compliant, CAST(9 AS INT) AS listed FROM part",
    "issues_by_status": f"WITH {_LINKS} SELECT status AS remediation_status, CAST(sum(n) AS BIGINT) AS total FROM all_rows GROUP BY ALL",
    "issues_by_criterion": f"""WITH {_LINKS}, known(wcag_criterion, criterion_name, criterion_level) AS (VALUES ('1.1.1', 'Non-text Content', 'A'), ('1.3.1', 'Info and Relationships', 'A'), ('2.4.1', 'Bypass Blocks', 'A'), ('2.4.2', 'Page Titled', 'A'),
  ('2.4.4', 'Link Purpose (In Context)', 'A'), ('2.4.9', 'Link Purpose (Link Only)', 'AAA'), ('3.1.1', 'Language of Page', 'A'), ('3.2.5', 'Change on Request', 'AAA'))
SELECT wcag_criterion, criterion_name, criterion_level, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {_CRITERION} AS c, n FROM all_rows) JOIN known ON wcag_criterion = c GROUP BY ALL""",
    "severity_threshold": f"WITH {_LINKS} SELECT type, severity, CAST(sum(n) AS BIGINT) AS n FROM all_rows WHERE status = '{_GOOD}' OR severity = 'critical' GROUP BY ALL",
    "issue_numbering": f"""WITH {_LINKS}, ranked AS (
  SELECT c_custkey, type, unnest(range(n)) AS copy, CASE WHEN type = 'no-headings' THEN 0 WHEN type LIKE '%title' THEN 1 WHEN type LIKE '%language' THEN 2 WHEN type LIKE '%main-landmark' THEN 3 WHEN type LIKE '%skip-link' THEN 4
    WHEN type LIKE '%navigation%' THEN 5 WHEN type LIKE '%header-landmark' THEN 6 WHEN type LIKE '%footer%' THEN 7 WHEN type = 'compliant-alt-text' THEN 8 WHEN type = 'duplicate-link-text-different-url' THEN 11 WHEN type LIKE '%window-link%' THEN 12
    WHEN type = 'compliant-link-text' THEN 10 ELSE 9 END AS ord FROM all_rows)
SELECT row_number() OVER w AS issue_seq, 'issue-' || row_number() OVER w AS id, CAST(c_custkey AS BIGINT) AS doc_id, type FROM ranked WINDOW w AS (ORDER BY 'out/link/page-' || c_custkey || '.html', ord, copy)""",
    "unified_counts": f"""WITH {_LINKS}, classed AS (SELECT type, severity, CASE WHEN status = '{_GOOD}' THEN 'compliant' ELSE 'non_compliant' END AS class, n FROM all_rows)
SELECT 'severity' AS family, severity AS key, CAST(sum(n) AS BIGINT) AS identified, CAST(0 AS BIGINT) AS remediated, CAST(coalesce(sum(n) FILTER (class = 'compliant'), 0) AS BIGINT) AS compliant, CAST(coalesce(sum(n) FILTER (class = 'non_compliant'), 0) AS BIGINT) AS non_compliant FROM classed GROUP BY severity
UNION ALL SELECT 'type', type, CAST(sum(n) AS BIGINT), CAST(0 AS BIGINT), CAST(coalesce(sum(n) FILTER (class = 'compliant'), 0) AS BIGINT), CAST(coalesce(sum(n) FILTER (class = 'non_compliant'), 0) AS BIGINT) FROM classed GROUP BY type""",
    "remediation_dispatch": f"""WITH {_LINKS} SELECT CASE WHEN type IN ('no-headings', 'missing-main-landmark', 'missing-navigation-landmark', 'missing-header-landmark', 'missing-footer-landmark', 'missing-skip-link') THEN 'works' ELSE 'skipped_no_key' END AS outcome,
  CAST(sum(n) AS BIGINT) AS n, count(DISTINCT type) AS types FROM all_rows WHERE status = '{_BAD}' GROUP BY ALL""",
    "criteria_lookup": "SELECT * FROM (VALUES ('A', CAST(30 AS BIGINT)), ('AA', CAST(20 AS BIGINT)), ('AAA', CAST(28 AS BIGINT))) AS t(criterion_level, n)",
    "registry_lookup": "SELECT * FROM (VALUES ('missing-alt-text', '1.1.1', 'critical'), ('generic-alt-text', '1.1.1', 'major'), ('decorative-image-with-alt', '1.1.1', 'minor')) AS t(type, criterion, severity)",
}


def _repaired(spark: SparkSession, sf_dir: str, pages: DataFrame, *checks: str) -> tuple[DataFrame, DataFrame]:
    """(documents before repair as issues, documents after it as issues) of some checks."""
    before = issues.audit(pages, detailed=False, checks=list(checks))
    after = remediation.remediate(pages, before)
    return before, issues.audit(after.select("doc_id", "file_path", "html"), detailed=False, checks=list(checks), number=False)


def _after_repair(rows: str, render: Callable, *checks: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        after = _repaired(spark, sf_dir, render(table(spark, sf_dir, rows)), *checks)[1]
        return after.groupBy("type", "remediation_status").agg(F.count("*").alias("n"))

    return query


def remediation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the issues of rendered links, by type."""
    pages = rendered.links(table(spark, sf_dir, "customer"))
    done = remediation.remediate(pages, issues.audit(pages, detailed=False, checks=["link_text", "new_window"]))
    return done.select(F.explode("details").alias("d")).groupBy("d.type", "d.status").agg(F.count("*").alias("n"))


def scope_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of the headers of rendered tables after repair. They depend on the text alone, so documents of one text are repaired once and count as often as they came."""
    texts = rendered.tables(table(spark, sf_dir, "orders")).groupBy("html").agg(F.count("*").alias("copies"))
    pages = cut(texts.select(F.monotonically_increasing_id().alias("doc_id"), F.lit("").alias("file_path"), "html", "copies"))  # written, so that all readers agree on the numbers
    done = remediation.remediate(pages, issues.audit(pages, detailed=False, checks=["table_headers"], number=False))
    nodes = html_tree.flat_nodes(html_tree.parsed(done.select("doc_id", "file_path", "html"))).where("name = 'th'")
    found = nodes.groupBy("doc_id", F.coalesce(F.try_element_at("attrs", F.lit("scope")), F.lit("")).alias("scope")).agg(F.count("*").alias("heads"))
    return found.join(pages.select("doc_id", "copies").hint("merge"), "doc_id").groupBy("scope").agg(F.sum(F.col("heads") * F.col("copies")).alias("n"))


QUERIES |= {
    "images_after_repair": _after_repair("part", rendered.images, "image_alt"),
    "figures_after_repair": _after_repair("part", rendered.figures, "figure"),
    "headings_after_repair": _after_repair("part", rendered.headings, "heading_content"),
    "forms_after_repair": _after_repair("customer", rendered.forms, "form_labels", "required_fields"),
    "landmarks_after_repair": _after_repair("supplier", rendered.groups, "main_landmark", "skip_link", "landmarks", "fieldsets"),
    "remediation_outcomes": remediation_outcomes,
    "scope_inference": scope_inference,
}
ORACLE |= {
    "images_after_repair": "SELECT CASE WHEN p_size % 6 IN (2, 5) THEN 'compliant-decorative-image' ELSE 'compliant-alt-text' END AS type, 'compliant' AS remediation_status, count(*) AS n FROM part GROUP BY ALL",
    "figures_after_repair": "SELECT 'compliant-figure-structure' AS type, 'compliant' AS remediation_status, count(*) AS n FROM part",
    "headings_after_repair": "SELECT 'compliant-heading-content' AS type, 'compliant' AS remediation_status, count(*) AS n FROM part WHERE p_size % 8 <> 0",
    "forms_after_repair": "SELECT '' AS type, '' AS remediation_status, CAST(0 AS BIGINT) AS n FROM customer WHERE false",
    "landmarks_after_repair": "SELECT 'compliant-' || k AS type, 'compliant' AS remediation_status, count(*) AS n FROM supplier CROSS JOIN (VALUES ('main-landmark'), ('skip-link'), ('navigation-landmark'), ('header-landmark'), ('footer-landmark')) AS t(k) GROUP BY ALL",
    "remediation_outcomes": f"""WITH {_LINKS}, todo AS (
  SELECT type, n, 0 AS again FROM link_rows WHERE status = '{_BAD}' UNION ALL SELECT type, n, unnest(range(n)) FROM customer JOIN windows ON shape = c_custkey % 9 WHERE status = '{_BAD}')
SELECT type, CASE WHEN type = 'duplicate-link-text-different-url' THEN 'skipped' WHEN again > 0 THEN 'failed' ELSE 'remediated' END AS status, CAST(sum(CASE WHEN type LIKE 'new-window%' THEN 1 ELSE n END) AS BIGINT) AS n FROM todo GROUP BY ALL""",
    "scope_inference": "SELECT 'col' AS scope, CAST(sum(CASE o_orderkey % 7 WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 6 THEN 3 ELSE 2 END) AS BIGINT) AS n FROM orders",
}


def _alternative(rows: str, render: Callable, *checks: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = issues.candidates(html_tree.parsed(render(table(spark, sf_dir, rows))), list(checks), alternative_checks.CHECKS)
        return found.groupBy("type", "severity").agg(F.count("*").alias("n"))

    return query


QUERIES |= {
    "alternative_headings": _alternative("part", rendered.headings, "alt_heading_structure", "alt_page_title", "alt_document_language"),
    "alternative_images": _alternative("part", rendered.images, "alt_images", "alt_main_landmark", "alt_skip_link"),
    "alternative_links": _alternative("customer", rendered.links, "alt_links"),
    "alternative_tables": _alternative("orders", rendered.tables, "alt_tables"),
    "alternative_forms": _alternative("customer", rendered.forms, "alt_forms"),
}
ORACLE |= {
    "alternative_headings": "SELECT 'improper-heading-structure' AS type, 'major' AS severity, CAST(sum(CASE WHEN p_size % 8 IN (2, 4, 5, 6) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM part",
    "alternative_images": """
WITH k AS (SELECT CASE p_size % 6 WHEN 0 THEN 'missing-alt-text' WHEN 1 THEN 'empty-alt-text' ELSE 'alt-text-present' END AS type FROM part
  UNION ALL SELECT 'missing-main-landmark' FROM part UNION ALL SELECT 'missing-skip-link' FROM part)
SELECT type, CASE type WHEN 'missing-alt-text' THEN 'critical' WHEN 'alt-text-present' THEN 'info' ELSE 'major' END AS severity, count(*) AS n FROM k GROUP BY ALL""",
    "alternative_links": "SELECT CASE c_custkey % 9 WHEN 0 THEN 'empty-link' ELSE 'generic-link-text' END AS type, CASE c_custkey % 9 WHEN 0 THEN 'critical' ELSE 'major' END AS severity, count(*) AS n FROM customer WHERE c_custkey % 9 IN (0, 2) GROUP BY ALL",
    "alternative_tables": """
WITH a(shape, type, severity, n) AS (VALUES (0, 'missing-table-headers', 'critical', 1), (0, 'missing-table-caption', 'minor', 1), (1, 'missing-header-scope', 'major', 2), (1, 'missing-table-caption', 'minor', 1), (3, 'missing-table-caption', 'minor', 1),
  (4, 'missing-table-headers', 'critical', 1), (4, 'missing-table-caption', 'minor', 1), (5, 'missing-table-headers', 'critical', 1), (5, 'missing-table-caption', 'minor', 1), (6, 'missing-header-scope', 'major', 1), (6, 'missing-table-headers', 'critical', 1), (6, 'missing-table-caption', 'minor', 2))
SELECT type, severity, CAST(sum(n) AS BIGINT) AS n FROM orders JOIN a ON shape = o_orderkey % 7 GROUP BY ALL""",
    "alternative_forms": """
WITH a(shape, type, severity) AS (VALUES (1, 'missing-form-label', 'critical'), (4, 'missing-form-label', 'critical'), (4, 'missing-aria-required', 'minor'), (6, 'missing-aria-required', 'minor'))
SELECT type, severity, count(*) AS n FROM customer JOIN a ON shape = c_nationkey % 7 GROUP BY ALL""",
}
