"""Queries over the core operators that aren't part of the accessibility audit, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pharos.operators import nested_json
from pharos.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each location of each issue of each report, with the page it is on."""
    return nested_json.issue_locations(table(spark, sf_dir, "audit_report"))


def p2_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_json.report_tables(table(spark, sf_dir, "audit_report"))["reports"]


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_json.report_tables(table(spark, sf_dir, "audit_report"))["pages"]


def p2_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_json.report_tables(table(spark, sf_dir, "audit_report"))["issues"]


def p2_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_json.report_tables(table(spark, sf_dir, "audit_report"))["locations"]


def p2_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of reports, issues and locations that have no column of their own."""
    return nested_json.report_tables(table(spark, sf_dir, "audit_report"))["details"]


QUERIES = {f.__name__: f for f in (p2_found, p2_reports, p2_pages, p2_issues, p2_locations, p2_details)}

# An independent reading of the bodies by DuckDB's JSON functions. A cut body is no valid JSON.
_REPORTS = r"""
WITH bodies AS (
  SELECT DISTINCT report_id, trim(body, chr(65279) || chr(32) || chr(10) || chr(13) || chr(9)) AS body FROM audit_report WHERE body IS NOT NULL),
plain AS (
  SELECT report_id, CASE WHEN starts_with(body, '"') AND json_valid(body) THEN json_extract_string(body, '$') ELSE body END AS body FROM bodies),
good AS (SELECT report_id, CAST(body AS JSON) AS j FROM plain WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
keyed AS (SELECT report_id, j, unnest(json_keys(j->'by_page')) AS page_key FROM good WHERE json_type(j->'by_page') = 'OBJECT'),
pages AS (
  SELECT report_id, page_key, json_extract(j->'by_page', '$."' || page_key || '"') AS p FROM keyed
  UNION ALL
  SELECT report_id, p->>'page', p FROM (SELECT report_id, unnest(CAST(j->'by_page' AS JSON[])) AS p FROM good WHERE json_type(j->'by_page') = 'ARRAY')),
told AS (
  SELECT report_id, page_key, unnest(CAST(p->'issues' AS JSON[])) AS i FROM pages WHERE json_type(p->'issues') = 'ARRAY'
  UNION ALL
  SELECT report_id, NULL, unnest(CAST(j->'issues' AS JSON[])) FROM good WHERE json_type(j->'issues') = 'ARRAY'),
issues AS (
  SELECT report_id, i->>'id' AS issue_id, max(page_key) AS page_key, arg_min(i, page_key IS NULL) AS i FROM told WHERE i->>'id' IS NOT NULL GROUP BY ALL),
placed AS (
  SELECT report_id, issue_id, i, CASE WHEN json_type(i->'location') = 'VARCHAR' THEN CAST(i->>'location' AS JSON) ELSE i->'location' END AS l,
    coalesce(try_cast(i->>'page_number' AS BIGINT), try_cast(nullif(regexp_extract(page_key, '(\d+)', 1), '') AS BIGINT), -1) AS page_no FROM issues),
listed AS (
  SELECT report_id, issue_id, page_no, CASE WHEN json_type(l) = 'ARRAY' THEN CAST(l AS JSON[]) WHEN json_type(l) = 'OBJECT' AND len(json_keys(l)) > 0 THEN [l] ELSE CAST([] AS JSON[]) END AS ls FROM placed)
"""
_LOCATIONS = """
SELECT report_id, issue_id, coalesce(try_cast(x->>'page_number' AS BIGINT), page_no) AS page_no, location_no FROM (
  SELECT report_id, issue_id, page_no, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS location_no FROM listed)
UNION ALL SELECT report_id, issue_id, page_no, 0 FROM listed WHERE len(ls) = 0
"""

ORACLE = {
    "p2_pages": _REPORTS + """SELECT report_id, page_key, coalesce(try_cast(nullif(regexp_extract(max(page_key), '(\\d+)', 1), '') AS BIGINT)) AS page_no, CAST(sum(CASE WHEN json_type(p->'issues') = 'ARRAY' THEN json_array_length(p->'issues') ELSE 0 END) AS BIGINT) AS issues FROM pages GROUP BY report_id, page_key""",
    "p2_issues": _REPORTS + """SELECT report_id, issue_id, page_key, l.page_no, i->>'type' AS issue_type, i->>'severity' AS severity, i->>'wcag_criterion' AS criterion, i->>'element' AS element, i->>'remediation_status' AS status, CAST(len(ls) AS BIGINT) AS locations
FROM issues JOIN listed l USING (report_id, issue_id)""",
    "p2_reports": _REPORTS + "SELECT g.report_id, j->>'html_path' AS html_path, coalesce(n, 0) AS issues FROM good g LEFT JOIN (SELECT report_id, count(*) AS n FROM issues GROUP BY ALL) USING (report_id)",
    "p2_locations": _REPORTS + """SELECT report_id, issue_id, location_no, coalesce(try_cast(x->>'page_number' AS BIGINT), page_no) AS page_no, x->>'path' AS path, x->>'file_path' AS file_path, x->>'description' AS description FROM (
  SELECT report_id, issue_id, page_no, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS location_no FROM listed)""",
    "p2_found": _REPORTS + _LOCATIONS,
}
