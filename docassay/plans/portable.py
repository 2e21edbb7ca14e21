"""Plans written once in SQL that Spark and the comparison engine both read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings doc_metadata pdf_pages headings spans cells issues rules benchmarks sites unit_targets".split()

#: Redelivered rows count once: one row of each key, as a relation in brackets.
ONCE = {
    "ISSUES": "(SELECT issue_id, any_value(doc_id) AS doc_id, any_value(category) AS category, any_value(type) AS type, any_value(severity) AS severity, any_value(confidence) AS confidence, any_value(message) AS message, any_value(page_number) AS page_number, any_value(evidence) AS evidence, any_value(included_in_report) AS included, any_value(reviewer_note) AS reviewer_note, any_value(created_at) AS created_at FROM issues GROUP BY issue_id)",
    "META": "(SELECT doc_id, any_value(project_no) AS project_no, any_value(site) AS site, any_value(original_filename) AS filename, any_value(title) AS title, any_value(doc_no) AS doc_no, any_value(rev) AS rev, any_value(page_count) AS page_count, any_value(cover_metadata.document_number) AS cover_no, any_value(cover_metadata.revision) AS cover_rev, any_value(cover_metadata.originator) AS originator, any_value(cover_metadata.contractor) AS contractor FROM doc_metadata GROUP BY doc_id)",
    "PAGES": "(SELECT page_id, any_value(doc_id) AS doc_id, any_value(page_index) AS page_index, any_value(width) AS width, any_value(height) AS height, any_value(orientation) AS orientation, any_value(raw_text) AS raw_text, any_value(header_text) AS header_text, any_value(footer_text) AS footer_text, any_value(page_number) AS page_number, any_value(doc_number) AS doc_number, any_value(has_header) AS has_header, any_value(has_footer) AS has_footer, any_value(has_page_number) AS has_page_number, any_value(has_doc_number) AS has_doc_number, any_value(text_source) AS text_source FROM pdf_pages GROUP BY page_id)",
    "SPANS": "(SELECT item_id, any_value(doc_id) AS doc_id, any_value(seq) AS seq, any_value(text) AS text, any_value(bbox.page_index) AS page_index, any_value(bbox.x0) AS x0, any_value(bbox.y0) AS y0, any_value(bbox.x1) AS x1, any_value(bbox.y1) AS y1, any_value(bbox.page_width) AS page_width, any_value(bbox.page_height) AS page_height FROM spans GROUP BY item_id)",
    "HEADINGS": "(SELECT item_id, any_value(doc_id) AS doc_id, any_value(seq) AS seq, any_value(text) AS text, any_value(level) AS level, any_value(bbox.page_index) AS page_index, any_value(bbox.x0) AS x0, any_value(bbox.y0) AS y0, any_value(bbox.x1) AS x1, any_value(bbox.y1) AS y1, any_value(bbox.page_width) AS page_width, any_value(bbox.page_height) AS page_height FROM headings GROUP BY item_id)",
    "CELLS": "(SELECT cell_id, any_value(doc_id) AS doc_id, any_value(table_index) AS table_index, any_value(text) AS text, any_value(row_index) AS row_index, any_value(col_index) AS col_index, any_value(row_span) AS row_span, any_value(col_span) AS col_span FROM cells GROUP BY cell_id)",
}
# The severities in order, with their three aliases.
SEVERITIES = "(VALUES ('BLOCKER', 1), ('CRITICAL', 2), ('HIGH', 3), ('MAJOR', 4), ('MEDIUM', 5), ('MINOR', 6), ('LOW', 7), ('INFO', 8)) AS s(severity, rank)"


def filled(sql: str) -> str:
    """The SQL with its {ISSUES}-like marks replaced."""
    for name, relation in ONCE.items():
        sql = sql.replace("{" + name + "}", relation)
    return sql.replace("{SEVERITIES}", SEVERITIES)


def _strings(sql: str) -> str:
    """Spark reads a backslash in a string as an escape; the other engine doesn't."""
    return sql.replace("\\", "\\\\")


def plan(sql: str, spark_sql: str | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(query, comparison SQL) of one text; ``spark_sql`` where the engines' functions have different names."""
    text = filled(spark_sql) if spark_sql else _strings(filled(sql))
    reads = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")
    used = {m[1] for m in reads.findall(text)}
    # tables are handed over by name, so no view of the session is touched
    marked = reads.sub(r"\1 {\2}", text.replace("{", "{{").replace("}", "}}"))

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(marked, **{t: table(spark, folder, t) for t in used})

    return run, filled(sql)


def split(plans: dict[str, tuple]) -> tuple[dict, dict]:
    return {k: v[0] for k, v in plans.items()}, {k: v[1] for k, v in plans.items() if v[1]}
