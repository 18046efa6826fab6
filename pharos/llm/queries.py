"""Queries of the training-data operators, over whole tables with production parameters, and SQL where it can tell the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.llm import answer_pairs, eval_leaks, language_labels, scan_noise, source_mix, subject_areas, term_counts
from pharos.runtime import table


#: Folder of the vocabulary files of tokenizers.
TOKENIZERS = os.environ.get("PHAROS_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and words of issue types and severities that are too rare or too common to be useful."""
    counted = term_counts.issue_term_frequencies(table(spark, sf_dir, "audit_issue"))
    return counted.where(F.col("mark").isNotNull()).select("field_name", "unit", "term", "mark")


def p1_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their number of issues and of audit runs."""
    counted = term_counts.issue_term_frequencies(table(spark, sf_dir, "audit_issue"))
    return counted.select("field_name", "unit", "term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divided words, misread words, running headers and page numbers in texts of scanned pages."""
    return scan_noise.scan_findings(table(spark, sf_dir, "image_data"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as continuous paragraphs."""
    return scan_noise.repaired_texts(table(spark, sf_dir, "image_data")).select("image_id", "field_name", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of prompt and answer with their defect."""
    return answer_pairs.broken_pairs(table(spark, sf_dir, "remediation_detail"), table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of texts whose label is missing or wrong, or that hold several languages."""
    return language_labels.wrong_labels(table(spark, sf_dir, "image_data"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every text."""
    found = language_labels.language_segments(table(spark, sf_dir, "image_data"))
    return found.select("image_id", "field_name", "segment_no", "lang_code", F.round("confidence", 4).alias("confidence"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they leak."""
    return eval_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with the number of stretches, the longest run and whether the answer stands in the document too."""
    found = eval_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.select("doc_id", "item_id", F.size("spans").alias("stretches"), "item_words", "has_answer")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their target share."""
    return source_mix.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), TOKENIZERS)


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mix, each use of a record once."""
    return source_mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), TOKENIZERS)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by source."""
    return source_mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), TOKENIZERS)[1]


def p7_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature mix with the entropy of the target shares, as far as repeats allow."""
    return source_mix.tempered_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), TOKENIZERS)


def _subjects(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("documents", "subject_label", "subject_area", "eval_item")]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the subjects they treat."""
    return subject_areas.treated_subjects(*_subjects(spark, sf_dir))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents and sentences by subject."""
    shares = subject_areas.subject_shares(*_subjects(spark, sf_dir))
    treats = (F.col("sentences") >= subject_areas.TREATED * F.col("of")).cast("bigint")
    return shares.groupBy("subject").agg(F.sum(treats).alias("documents"), F.sum("sentences").cast("bigint").alias("sentences"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_term_frequencies, p3_found, p3_paragraphs, p4_found, p5_found, p5_segments, p6_found, p6_leaks, p7_found, p7_records, p7_shares, p7_temperature, p8_found, p8_composition
    )
}

# RE2's \s has ASCII only, so white space is written out; \p{Z} holds all Unicode space separators.
_BLANK = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]"
_JOINT = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}_\p{Pd}\x{2212}\x{00ad}\x{2043}]"
_TERMS = f"""
WITH once AS (SELECT issue_key, min(run_id) AS run_id, min(type) AS type, min(severity) AS severity FROM audit_issue GROUP BY issue_key),
vals AS (
  SELECT issue_key, run_id, 'type' AS field_name, nullif(regexp_replace(lower(regexp_replace(type, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '{_JOINT}', '-', 'g'), '') AS v FROM once
  UNION ALL
  SELECT issue_key, run_id, 'severity', nullif(regexp_replace(lower(regexp_replace(severity, '^{_BLANK}+|{_BLANK}+$', '', 'g')), '{_JOINT}', '-', 'g'), '') FROM once),
terms AS (
  SELECT run_id, field_name, 'value' AS unit, v AS term FROM vals WHERE v IS NOT NULL
  UNION ALL
  SELECT run_id, field_name, 'word', w FROM (SELECT run_id, field_name, unnest(string_split(v, '-')) AS w FROM vals WHERE field_name = 'type' AND v IS NOT NULL) WHERE w <> ''),
counted AS (SELECT field_name, unit, term, count(*) AS occurrences, count(DISTINCT run_id) AS records FROM terms GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'too_rare' WHEN records > 0.5 * (SELECT count(DISTINCT run_id) FROM audit_issue) THEN 'too_common' ELSE '' END AS mark FROM counted)
"""

# Which sources fall short doesn't depend on the tokenizer, so that SQL may count words and marks instead.
ORACLE = {
    "p1_found": _TERMS + "SELECT field_name, unit, term, mark FROM marked WHERE mark <> ''",
    "p1_term_frequencies": _TERMS + "SELECT field_name, unit, term, occurrences, records, mark FROM marked",
    "p7_found": r"""
WITH sizes AS (
  SELECT lower(trim(source)) AS source, sum(len(regexp_extract_all(text, '\w+|[^\w\s]'))) AS size
  FROM (SELECT DISTINCT doc_id, source, text FROM documents) WHERE trim(source) <> '' GROUP BY 1)
SELECT lower(trim(m.source)) AS source FROM mix_target m LEFT JOIN sizes s ON s.source = lower(trim(m.source))
WHERE m.target_share * (SELECT sum(size) FROM sizes) > m.max_repeats * coalesce(s.size, 0)
""",
}
