"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from pharos.plans import audit_queries, branch_queries, core_queries, pipeline_queries, text_queries

DATA = os.environ.get("PHAROS_TEST_DATA", "/root/testdata/sf0.001")
MODULES = (core_queries, audit_queries, branch_queries, pipeline_queries, text_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE:
        told = db.execute(ORACLE[name])
        at = [d[0] for d in told.description]
        assert sorted(at) == columns
        assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in told.fetchall()), key=repr)


def test_an_issue_table_adds_up(spark):
    from pharos.operators import issues, reports
    from pharos.sources import rendered
    from pharos.runtime import table

    found = issues.audit(rendered.images(table(spark, DATA, "part")), detailed=False).cache()
    total = reports.audit_summary(found).first()
    pages = reports.by_page(found).agg({"total": "sum"}).first()[0]
    assert total.total_issues == pages == reports.by_status(found).agg({"total": "sum"}).first()[0] == sum(total[k] for k in reports.LEVELS)


def test_statuses_are_counted_without_numbers(spark):
    files = QUERIES["issues_by_status"](spark, DATA).inputFiles()
    assert [f.rsplit("/", 1)[1] for f in files] == ["customer.parquet"]


def test_numbers_are_joined_without_a_broadcast_of_all_issues(spark):
    found = QUERIES["issue_numbering"](spark, DATA)
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "[doc_id" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert [r.issue_seq for r in found.orderBy("issue_seq").collect()] == list(range(1, found.count() + 1))


def test_documents_of_one_text_are_repaired_once(spark, tmp_path, monkeypatch):
    from pharos.operators import remediation

    handed = []
    rewrite = remediation.remediate
    monkeypatch.setattr(remediation, "remediate", lambda pages, issues, **k: handed.append(pages.count()) or rewrite(pages, issues, **k))
    spark.range(70).selectExpr("id % 35 AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))  # every key twice
    got = [tuple(r) for r in QUERIES["scope_inference"](spark, str(tmp_path)).collect()]
    assert got == [("col", 10 * (2 + 2 + 2 + 1 + 2 + 0 + 3))] and handed == [7]


def test_reports_are_written(spark, tmp_path):
    from pharos.operators import issues, reports

    pages = spark.createDataFrame([(1, "page-1.html", "<a href='/x'>=here</a>")], "doc_id bigint, file_path string, html string")
    found = issues.audit(pages)
    for kind in ("json", "csv", "text", "html", "other"):
        reports.write_report(found, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == found.count() == spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True).count()
    assert "parent" not in spark.read.json(str(tmp_path / "json")).schema["context"].dataType.names


def test_html_files_are_read(spark, tmp_path):
    from pharos.sources.html_tree import parsed, read_html

    (tmp_path / "sub").mkdir()
    for p in ("page-2.html", "Page_10.HTML", "sub/page3.html", "x.txt"):
        (tmp_path / p).write_text("<p>a</p>")
    assert sorted(r.page_number for r in parsed(read_html(spark, str(tmp_path), recursive=True)).collect()) == [2, 3, 10]
    assert read_html(spark, str(tmp_path)).count() == 2
