"""The table of issues: candidates of all checks, filtered, joined to their criterion, placed and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pharos.operators.audit_checks import CHECKS
from pharos.operators.dimensions import criteria, severity_level
from pharos.runtime import cut
from pharos.sources.html_tree import parsed

DONE = ("remediated", "auto_remediated")


def candidates(trees: DataFrame, checks: list[str] | None = None, rules: dict[str, str] = CHECKS) -> DataFrame:
    """All candidates of a set of checks (default: all), with their place in the order of checks and of findings. No shuffle."""
    chosen = [(i, c, rules[c]) for i, c in enumerate(rules) if checks is None or c in checks]
    found = F.array(*[F.struct(F.lit(i).alias("check_ord"), F.lit(c).alias("check"), F.expr(e).alias("found")) for i, c, e in chosen])
    by_check = trees.select("*", F.explode(found).alias("c"))
    rows = by_check.select("*", "c.check_ord", "c.check", F.posexplode("c.found").alias("emit_ord", "issue")).drop("c")
    return rows.select("doc_id", "file_path", "file_name", "page_number", "nodes", "check_ord", "check", "emit_ord", "issue.*")


def passes(severity: Column, status: Column, threshold: str = "minor", include_remediated: bool = True) -> Column:
    """Compliant rows always stay; others from the threshold up, and, if so asked, unless they are remediated."""
    level = {"critical": 3, "major": 2, "minor": 1, "info": 0}.get(threshold, 1)
    keep = severity_level(severity) >= level
    return (status == "compliant") | (keep & (F.lit(include_remediated) | (status == "needs_remediation")))


def placed(rows: DataFrame, detailed: bool = True) -> DataFrame:
    """Element, location and, where detailed, context of each row, taken from the document's own elements."""
    node = F.expr("get(nodes, pre)")
    above = F.expr("get(nodes, get(nodes, pre).parent)")
    context = F.when(
        node.isNotNull(),
        F.struct(
            node["name"].alias("element_name"), node["attrs"].alias("attributes"), node["text"].alias("text_content"),
            F.struct(above["name"].alias("element_name"), above["attrs"].alias("attributes")).alias("parent"), node["snippet"].alias("html_snippet"),
            F.struct(node["idx"].alias("index"), node["total"].alias("total")).alias("position"),
        ),
    )
    replaced = F.col("type") == "insufficient-color-contrast"  # its location has no page, which reports read as 0
    page = F.when(replaced, F.lit(0)).otherwise(F.coalesce(node["page"], "page_number"))
    told = F.concat(F.col("type"), F.when(F.col("detail") != "", F.concat(F.lit(": "), "detail")).otherwise(""))
    location = F.struct(
        F.when(~replaced, node["path"]).alias("path"), page.alias("page_number"), "file_path", "file_name", F.concat_ws(" in ", node["name"], "file_name").alias("description"),
        "text_color", "background_color", F.col("ratio").alias("contrast_ratio"), F.col("required").alias("required_ratio"), F.col("large").alias("is_large_text"),
    )
    out = rows.select("*", F.coalesce(node["name"], F.lit("")).alias("element"), told.alias("description"), location.alias("location"), *([context.alias("context")] if detailed else []))
    return out.drop("nodes", "detail", "text_color", "background_color", "ratio", "required", "large").withColumnRenamed("pre", "node_pre")


def numbered(issues: DataFrame, order: str = "file_path") -> DataFrame:
    """`issue_seq` and `id` in the order of files, checks and findings, without a sort of all rows in one task.

    Issues are written once, counted by file, the counts summed in file order, and rows numbered within their file. The size
    that is estimated for the written issues is that of compressed columns, so the join is told not to broadcast them.
    """
    issues = cut(issues)
    counts = issues.groupBy(order, "doc_id").agg(F.count("*").alias("n"))
    # counts are one row per document; they are summed by part of a range, then within parts
    parts = cut(counts.repartitionByRange(order, "doc_id").withColumn("part", F.spark_partition_id()))  # written, so that all readers agree on the parts
    sums = parts.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))  # one row per part
    inside = F.sum("n").over(W.partitionBy("part").orderBy(order, "doc_id")) - F.col("n")
    first = parts.withColumn("inside", inside).join(F.broadcast(ahead), "part").select("doc_id", (F.col("inside") + F.col("ahead")).alias("first")).hint("merge")
    own = F.row_number().over(W.partitionBy("doc_id").orderBy("check_ord", "emit_ord"))
    seq = (F.col("first") + own).cast("bigint")
    return issues.join(first, "doc_id").withColumn("issue_seq", seq).withColumn("id", F.concat(F.lit("issue-"), F.col("issue_seq"))).drop("first")


def audit(
    pages: DataFrame, severity_threshold: str = "minor", include_remediated: bool = True, detailed: bool = True, checks: list[str] | None = None, number: bool = True
) -> DataFrame:
    """The issues of pages (doc_id, file_path, html).

    A null or empty page has no elements, and so the findings of an empty document. Extra columns are left alone. A
    document number should be unique; of equal ones both are audited.
    """
    rows = candidates(parsed(pages), checks).where(passes(F.col("severity"), F.col("status"), severity_threshold, include_remediated))
    rows = placed(rows, detailed)
    known = F.broadcast(criteria(pages.sparkSession))  # a fixed table of 78 rows
    rows = rows.join(known, "criterion", "left").fillna("", ["criterion_name", "criterion_level"]).withColumnRenamed("criterion", "wcag_criterion").withColumnRenamed("status", "remediation_status")
    rows = rows.withColumn("remediation_date", F.when(F.col("remediation_status").isin(*DONE), F.current_timestamp()))
    return numbered(rows) if number else rows
