"""Queries of the domain analyzers over the whole document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import consistency, duplicates, findings, geometry, language, layout, references, rules, scorecard, table_math
from ..session import cut
from ..sources.tables import table
from .portable import plan, split


def _items(s: SparkSession, d: str) -> DataFrame:
    return references.ordered_items(table(s, d, "headings"), table(s, d, "spans"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    spans = table(s, d, "spans").dropDuplicates(["item_id"])
    return spans.select("doc_id", "item_id", "seq", "text", "bbox.*")


def _texts(s: SparkSession, d: str) -> DataFrame:
    once = table(s, d, "pdf_pages").dropDuplicates(["page_id"])
    return once.where("raw_text IS NOT NULL").select(F.col("doc_id").alias("text_key"), F.col("page_index").alias("page"), F.col("raw_text").alias("text"))


def _rules(s: SparkSession, d: str) -> DataFrame:
    return rules.loaded(table(s, d, "rules"))


def _drift(s: SparkSession, d: str) -> DataFrame:
    """Titles of documents as entries, their headings as targets."""
    heads = table(s, d, "headings").dropDuplicates(["item_id"]).where("text IS NOT NULL")
    entries = heads.where("level = 1").select("doc_id", "item_id", references.normalized_title(F.regexp_replace("text", r"^[0-9.]+\s+", "")).alias("title"), (F.col("bbox.page_index") + 1).cast("string").alias("label"))
    targets = heads.where("level = 2").select("doc_id", "seq", references.normalized_title(F.regexp_replace("text", r"^[0-9.]+\s+", "")).alias("title"), F.col("bbox.page_index").alias("page_index"), (F.col("bbox.page_index") + 1).cast("string").alias("page_label"))
    return references.drift(entries, targets)


def _faults(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of grammar, wording and spelling."""
    spans = table(s, d, "spans")
    return language.grammar(spans), language.ambiguity(spans), language.spelling(spans)


def _signals(s: SparkSession, d: str, faults: tuple[DataFrame, DataFrame, DataFrame] | None = None, items: DataFrame | None = None) -> DataFrame:
    """The signals of documents; faults and items where they are at hand already."""
    spans = table(s, d, "spans")
    repeats = language.matches(spans.dropDuplicates(["item_id"]).select("doc_id", "item_id", "text"), "text", [r for r in language.GRAMMAR if "REPEATED" in r[0]])
    items, cells = items or cut(_items(s, d)), table(s, d, "cells")  # read by six of the parts below
    said, vague, words = (f.select("doc_id", "page_index") for f in faults or _faults(s, d))
    faults = cut(said.unionByName(vague).unionByName(words))  # counted twice
    metadata = table(s, d, "doc_metadata").select("doc_id", F.concat_ws(" ", "title", "original_filename").alias("named")).unionByName(table(s, d, "documents").select("doc_id", F.col("doc_type").alias("named")))
    return scorecard.signals(items, cells, references.citations(items), repeats, layout.uncontrolled(table(s, d, "pdf_pages")), layout.voids(layout.metrics(_placed(s, d))), _drift(s, d).where("kind = 'PAGE_DRIFT'"), consistency.contradictions(cells, items), faults, metadata)


def _labels(s: SparkSession, d: str) -> DataFrame:
    """Printed labels of pages: what a footer line says, else the number that the page carries."""
    printed = layout.printed_label(_placed(s, d))
    carried = table(s, d, "pdf_pages").dropDuplicates(["page_id"]).groupBy("doc_id", "page_index").agg(F.min(F.regexp_extract("page_number", r"([0-9]+|[ivxlcdm]+)\s*$", 1)).alias("carried")).where("carried <> ''")
    return printed.join(carried, ["doc_id", "page_index"], "full").select("doc_id", "page_index", F.coalesce("label", "carried").alias("label"))


def _contents_drift(s: SparkSession, d: str) -> DataFrame:
    return references.drift(*references.contents(_items(s, d), _labels(s, d)))


def _merged(s: SparkSession, d: str) -> DataFrame:
    # each stream reads the items; they are put together and deduplicated once and written, as are findings that the scorecard counts
    items, pages, spans = cut(_items(s, d)), table(s, d, "pdf_pages"), table(s, d, "spans")
    said, unclear, misspelt = (cut(f) for f in _faults(s, d))
    cells, none = table(s, d, "cells"), F.lit(None).cast("int")
    breaks = findings.as_issues(layout.page_breaks(items), 1, "LAYOUT", F.lit("CROSS_PAGE_BREAK"), F.col("page_index"), F.col("reason"))
    open_pages = findings.as_issues(layout.uncontrolled(pages), 2, "LAYOUT", F.lit("UNCONTROLLED_PAGE"), F.col("page_index"), F.col("missing"))
    trace = references.traceability(items)
    cited = findings.as_issues(trace, 3, "STANDARD_TRACEABILITY", F.col("kind"), none, F.col("code"))
    grammar = findings.as_issues(said, 4, "GRAMMAR", F.upper("type"), F.col("page_index"), F.col("original"))
    sources = references.revision_sources(table(s, d, "doc_metadata"), spans, table(s, d, "headings"), cells)
    revisions = findings.as_issues(references.disagreeing(sources), 5, "TRACEABILITY", F.lit("REVISION_MISMATCH"), F.lit(0), F.concat_ws(" ", "source", "value"))
    status = F.when(F.col("status") == "MISMATCH", "TABLE_MATH_MISMATCH").otherwise(F.col("status"))
    sums = table_math.column_totals(cells).select("doc_id", "table_index", "r", "status").unionByName(table_math.row_totals(cells).select("doc_id", "table_index", "r", "status"))
    math = findings.as_issues(sums.where("status NOT IN ('CORRECT', 'ROUNDING_BOUNDARY')"), 6, "TABLE_MATH", status, none, F.concat_ws(" ", F.lit("table"), "table_index", F.lit("row"), "r"))
    drifts = findings.as_issues(_contents_drift(s, d).where("kind <> 'OK'"), 7, "TRACEABILITY", F.col("kind"), none, F.col("title"))
    words = findings.as_issues(misspelt, 8, "GRAMMAR", F.lit("SPELLING"), F.col("page_index"), F.lower("word"))
    copies = findings.as_issues(duplicates.near_duplicates(spans), 9, "GRAMMAR", F.lit("DUPLICATE_BLOCK"), F.col("page_index"), F.concat_ws(" ", F.lit("block"), "item_id", F.lit("repeats"), "first_item"))
    vague = findings.as_issues(unclear, 10, "GRAMMAR", F.upper("type"), F.col("page_index"), F.col("original"))
    broken = rules.all_findings(_texts(s, d), _rules(s, d))
    ruled = findings.as_issues(broken.withColumn("doc_id", F.col("text_key")), 11, "REFERENCE_PACK", F.col("rule_id"), none, F.concat_ws(" ", "rule_id", "detail", "status"))
    bands = findings.as_issues(consistency.contradictions(cells, items), 12, "TRACEABILITY", F.col("kind"), F.col("page_index"), F.col("quote"))
    rework = findings.as_issues(scorecard.scores(_signals(s, d, (said, unclear, misspelt), items)).where("score <= 2"), 13, "SCORECARD", F.lit("REWORK_ITEM"), none, F.concat_ws(" ", "grp", "item", "score"))
    return findings.merged(breaks, open_pages, cited, grammar, revisions, math, drifts, words, copies, vague, ruled, bands, rework)


def _judged(s: SparkSession, d: str) -> DataFrame:
    """The packs as generic rules, judged on the benchmark texts."""
    pack = _rules(s, d)
    limit, term, ref = F.col("numeric_limit_params"), F.col("terminology_params"), F.col("required_reference_params")
    low = F.when(limit["operator"].isin("GE", "GT"), limit["limit_value"].cast("string"))
    high = F.when(limit["operator"].isin("LE", "LT"), limit["limit_value"].cast("string"))
    parameters = (
        F.when(F.col("kind") == "numeric_limit", F.create_map(F.lit("pattern"), limit["pattern"], F.lit("min_value"), low, F.lit("max_value"), high))
        .when(F.col("kind") == "terminology", F.create_map(F.lit("deprecated_terms"), F.array_join(term["deprecated_terms"], "|"), F.lit("context_keywords"), F.array_join(term["context_keywords"], "|")))
        .otherwise(F.create_map(F.lit("trigger_keywords"), F.array_join(ref["trigger_keywords"], "|"), F.lit("required_standard"), ref["required_standard"], F.lit("exemption_keywords"), F.array_join(ref["exemption_keywords"], "|")))
    )
    kinds = F.create_map(*[F.lit(x) for kv in (("numeric_limit", "numeric_range"), ("terminology", "terminology_consistency"), ("required_reference", "required_citation")) for x in kv])
    generic = pack.select("rule_id", kinds[F.col("kind")].alias("rule_type"), parameters.alias("parameters"))
    cases = table(s, d, "benchmarks").dropDuplicates(["case_no"])
    facts = cases.select(F.col("case_id").alias("fact_id"), F.col("document_text").alias("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("table_value"), F.lit(None).cast("string").alias("prose_value"), F.expr("cast(array() as array<string>)").alias("sections"), F.expr("cast(array() as array<string>)").alias("fields"))
    return rules.judge(s, generic, facts).where("status <> 'NOT_APPLICABLE'")


Q = {
    "txt1_column_totals": lambda s, d: table_math.column_totals(table(s, d, "cells")),
    "txt2_row_totals": lambda s, d: table_math.row_totals(table(s, d, "cells")),
    "txt4_reference_drift": _drift,
    "txt4_contents_drift": _contents_drift,
    "txt5_revision_sources": lambda s, d: references.revision_sources(table(s, d, "doc_metadata"), table(s, d, "spans"), table(s, d, "headings"), table(s, d, "cells")),
    "txt5_revision_mismatch": lambda s, d: references.disagreeing(references.revision_sources(table(s, d, "doc_metadata"), table(s, d, "spans"), table(s, d, "headings"), table(s, d, "cells"))),
    "txt6_citations": lambda s, d: references.citations(_items(s, d)),
    "txt6_traceability": lambda s, d: references.traceability(_items(s, d)),
    "txt7_spelling": lambda s, d: language.spelling(table(s, d, "spans")),
    "txt8_grammar": lambda s, d: language.grammar(table(s, d, "spans")),
    "txt9_unclosed_sections": lambda s, d: language.unclosed(_items(s, d)),
    "txt10_near_duplicates": lambda s, d: duplicates.near_duplicates(table(s, d, "spans")),
    "jon15_similarity_join": lambda s, d: duplicates.near_duplicates(table(s, d, "headings").select("item_id", "doc_id", "seq", "text", "bbox").unionByName(table(s, d, "spans").select("item_id", "doc_id", "seq", "text", "bbox"))),
    "txt11_ambiguity": lambda s, d: language.ambiguity(table(s, d, "spans")),
    "txt12_band_contradictions": lambda s, d: consistency.contradictions(table(s, d, "cells"), _items(s, d)),
    "txt13_page_breaks": lambda s, d: layout.page_breaks(_items(s, d)),
    "txt14_misused_styles": lambda s, d: layout.misused_styles(table(s, d, "headings")),
    "txt15_voids": lambda s, d: layout.voids(layout.metrics(_placed(s, d))),
    "txt16_uncontrolled_pages": lambda s, d: layout.uncontrolled(table(s, d, "pdf_pages")),
    "txt17_navigation_drift": lambda s, d: _drift(s, d).where("kind <> 'OK'"),
    "txt18_signals": _signals,
    "txt20_scorecard": lambda s, d: scorecard.scores(_signals(s, d)),
    "agg20_group_averages": lambda s, d: scorecard.averages(scorecard.scores(_signals(s, d))),
    "txt19_four_baselines": lambda s, d: scorecard.baselines(_signals(s, d)),
    "txt21_one_item": lambda s, d: scorecard.item(_signals(s, d), "references_properly_attributed"),
    "txt23_section_notes": lambda s, d: scorecard.notes(scorecard.scores(_signals(s, d)), scorecard.evidence(_items(s, d))),
    "txt22_non_laboratory_items": lambda s, d: scorecard.not_applicable(_signals(s, d)),
    "txt24_rule_findings": lambda s, d: rules.all_findings(_texts(s, d), _rules(s, d)),
    "txt25_generic_rules": _judged,
    "agg23_pack_confusion": lambda s, d: rules.confusion(table(s, d, "benchmarks"), _rules(s, d)),
    "src5_printed_label": lambda s, d: layout.printed_label(_placed(s, d)),
    "src7_page_metrics": lambda s, d: layout.metrics(_placed(s, d)),
    "src8_page_entities": lambda s, d: layout.entities(table(s, d, "pdf_pages")),
    "set1_merged_issues": _merged,
    "prj14_evidence_boxes": lambda s, d: findings.boxes(table(s, d, "issues")).select("issue_id", "pos", "source", "box.*"),
    "agg15_report_table": lambda s, d: findings.report_rows(table(s, d, "issues")),
    "txt29_verdicts": lambda s, d: findings.verdicts(table(s, d, "issues")),
    "prj1_normalized_boxes": lambda s, d: table(s, d, "spans").dropDuplicates(["item_id"]).select("item_id", geometry.normalized(F.col("bbox")).alias("b")).select("item_id", "b.*"),
    "prj2_part_boxes": lambda s, d: table(s, d, "headings").dropDuplicates(["item_id"]).where("length(text) > 4").select("item_id", geometry.part(F.col("bbox"), F.length("text"), F.lit(2), F.lit(4)).alias("b")).select("item_id", "b.x0", "b.x1"),
    "prj15_valid_boxes": lambda s, d: table(s, d, "spans").dropDuplicates(["item_id"]).where(geometry.valid(F.col("bbox"))).select("item_id"),
    "snk7_placed_marks": lambda s, d: table(s, d, "spans").dropDuplicates(["item_id"]).select("item_id", geometry.placed(F.col("bbox"), F.lit(595.0), F.lit(842.0), F.lit(100)).alias("b")).select("item_id", "b.*"),
    "prj10_evidence_page": lambda s, d: table(s, d, "issues").dropDuplicates(["issue_id"]).select("issue_id", findings.evidence_page(F.col("evidence")).alias("page")),
    "prj16_evidence_text": lambda s, d: table(s, d, "issues").dropDuplicates(["issue_id"]).select("issue_id", findings.evidence_text(F.col("evidence")).alias("text")),
    "prj21_labels": lambda s, d: table(s, d, "issues").dropDuplicates(["issue_id"]).select("issue_id", findings.humanized(F.col("type")).alias("label")),
    "fun_decimals": lambda s, d: numbers.with_decimal(table(s, d, "cells").dropDuplicates(["cell_id"]).select("cell_id", "text"), "text").where("value IS NOT NULL").select("cell_id", F.col("value").cast("double").alias("value"), "unit"),
    "fun_roman": lambda s, d: table(s, d, "pdf_pages").dropDuplicates(["page_id"]).where("page_number IS NOT NULL").select("page_id", numbers.page_value(F.col("page_number")).alias("value")),
}

# Comparison SQL of those that SQL expresses, with the same column names.
O = {
    "prj1_normalized_boxes": "SELECT item_id, coalesce(page_index, 0) AS page_index, greatest(0.0, coalesce(x0, 0.0)) AS x0, greatest(0.0, coalesce(y0, 0.0)) AS y0, greatest(0.0, coalesce(x1, 0.0)) AS x1, greatest(0.0, coalesce(y1, 0.0)) AS y1, CASE WHEN page_width > 0 THEN page_width ELSE 612.0 END AS page_width, CASE WHEN page_height > 0 THEN page_height ELSE 792.0 END AS page_height FROM {SPANS} s",
    "prj15_valid_boxes": "SELECT item_id FROM {SPANS} s WHERE floor(x0) >= 0 AND floor(x0) <= floor(x1) AND floor(x1) <= floor(page_width) AND floor(y0) >= 0 AND floor(y0) <= floor(y1) AND floor(y1) <= floor(page_height)",
    "prj21_labels": "SELECT issue_id, array_to_string(list_transform(string_split(lower(regexp_replace(type, '^(rule_|lt_)', '', 'i')), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM {ISSUES} i",
    "prj16_evidence_text": "SELECT issue_id, CASE WHEN json_valid(evidence) THEN coalesce(nullif(trim(json_extract_string(evidence, '$.original_text')), ''), nullif(trim(json_extract_string(evidence, '$.snippet')), ''), nullif(trim(json_extract_string(evidence, '$.what_it_says')), ''), nullif(trim(json_extract_string(evidence, '$.label')), ''), nullif(trim(json_extract_string(evidence, '$.cited_standard')), ''), nullif(trim(json_extract_string(evidence, '$.detected_value')), ''), nullif(trim(json_extract_string(evidence, '$.stated_value')), '')) END AS text FROM {ISSUES} i",
    "src7_page_metrics": "SELECT doc_id, page_index, least(1.0, sum(greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0)) / max(page_width * page_height)) AS utilization, sum(coalesce(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END, 0)) AS words FROM {SPANS} s GROUP BY doc_id, page_index",
    "txt29_verdicts": "WITH n AS (SELECT doc_id, count(CASE WHEN severity IN ('BLOCKER', 'CRITICAL', 'HIGH') THEN 1 END) AS blockers, count(CASE WHEN severity IN ('MAJOR', 'MEDIUM') THEN 1 END) AS majors, count(*) AS n FROM {ISSUES} i WHERE included GROUP BY doc_id), v AS (SELECT *, CASE WHEN blockers > 0 THEN 'rejected' WHEN majors > 0 THEN 'rework' ELSE 'approved' END AS verdict FROM n) SELECT doc_id, blockers, majors, n - blockers - majors AS minors, verdict, printf('%d blocker(s), %d major and %d minor finding(s): %s', blockers, majors, n - blockers - majors, verdict) AS bottom_line FROM v",
    "txt16_uncontrolled_pages": "WITH e AS (SELECT doc_id, min_by(doc_number, page_index) AS expected FROM {PAGES} p WHERE page_index < 5 AND length(doc_number) >= 10 GROUP BY doc_id), m AS (SELECT p.page_id, p.doc_id, p.page_index, e.expected, array_to_string(list_filter([CASE WHEN NOT coalesce(has_header, false) THEN 'HEADER' END, CASE WHEN NOT coalesce(has_footer, false) THEN 'FOOTER' END, CASE WHEN NOT coalesce(has_page_number, false) THEN 'PAGE_NUMBER' END, CASE WHEN NOT coalesce(has_doc_number, false) OR (e.expected IS NOT NULL AND p.doc_number <> e.expected) THEN 'DOC_NUMBER' END], lambda x: x IS NOT NULL), ',') AS missing FROM {PAGES} p LEFT JOIN e ON e.doc_id = p.doc_id) SELECT * FROM m WHERE missing <> ''",
    "txt15_voids": 'WITH m AS (SELECT doc_id, page_index, least(1.0, sum(greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0)) / max(page_width * page_height)) AS u FROM {SPANS} s GROUP BY doc_id, page_index), w AS (SELECT *, min(page_index) OVER (PARTITION BY doc_id) AS low, max(page_index) OVER (PARTITION BY doc_id) AS high, count(*) OVER (PARTITION BY doc_id) AS n FROM m) SELECT doc_id, page_index, u AS ratio FROM w WHERE n >= 3 AND page_index > low AND page_index < high AND u < 0.25',
    "txt14_misused_styles": "SELECT item_id, doc_id, level, substr(text, 1, 60) AS text FROM {HEADINGS} h WHERE regexp_matches(trim(text), '^(based on|referring to|according to|with reference to|in accordance with|as (shown|described|discussed|noted|stated|indicated|presented|defined) in|pursuant to|following (the|this)|in order to|please note that|note that|in regard to|with regard to)\\b', 'i')",
    "prj2_part_boxes": 'SELECT item_id, round_even(x0 + (x1 - x0) / length(text) * 2, 1) AS x0, round_even(x0 + (x1 - x0) / length(text) * 4, 1) AS x1 FROM {HEADINGS} h WHERE length(text) > 4',
    "snk7_placed_marks": 'WITH b AS (SELECT item_id, page_index, greatest(0.0, least(x0 * 595.0 / page_width, 595.0)) AS a0, greatest(0.0, least(x1 * 595.0 / page_width, 595.0)) AS a1, greatest(0.0, least(842.0 - y1 * 842.0 / page_height, 842.0)) AS b0, greatest(0.0, least(842.0 - y0 * 842.0 / page_height, 842.0)) AS b1 FROM {SPANS} s) SELECT item_id, greatest(0, least(page_index, 99)) AS page_index, a0 AS x0, b0 AS y0, greatest(a1, a0 + 20.0) AS x1, greatest(b1, b0 + 20.0) AS y1 FROM b',
    "src5_printed_label": "SELECT doc_id, page_index, max_by(label, y0) AS label FROM (SELECT doc_id, page_index, y0, regexp_extract(trim(text), '^(?:page\\s+)?([0-9]+|[ivxlcdm]+)(?:\\s+of\\s+[0-9]+)?$', 1, 'i') AS label FROM {SPANS} s WHERE y0 >= page_height * 0.78) t WHERE label <> '' GROUP BY doc_id, page_index",
    "prj10_evidence_page": "WITH e AS (SELECT issue_id, CASE WHEN json_valid(evidence) THEN evidence END AS j FROM {ISSUES} i) SELECT issue_id, CASE WHEN json_extract_string(j, '$.kind') = 'STAGE_FAILURE' THEN NULL ELSE coalesce(TRY_CAST(coalesce(json_extract_string(j, '$.location.page_index'), json_extract_string(j, '$.bounding_box.page_index'), json_extract_string(j, '$.total_location.page_index'), json_extract_string(j, '$.entry_location.page_index'), json_extract_string(j, '$.target_location.page_index'), json_extract_string(j, '$.body_location.page_index'), json_extract_string(j, '$.bibliography_location.page_index'), json_extract_string(j, '$.original_location.page_index'), json_extract_string(j, '$.locations[0].page_index'), json_extract_string(j, '$.operand_locations[0].page_index'), json_extract_string(j, '$.page_index')) AS INT) + 1, CASE WHEN json_extract_string(j, '$.kind') = 'REVISION' THEN 1 END) END AS page FROM e",
}

# Portable plans: exact sums with the dual tolerance, and other analyzers that both engines read.
P = {
    "agg12_order_totals": plan("""
      WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS computed FROM lineitem GROUP BY l_orderkey)
      SELECT o_orderkey, CAST(t.computed AS DOUBLE) AS computed, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS stated,
        CASE WHEN t.computed = CAST(o_totalprice AS DECIMAL(18, 2)) THEN 'CORRECT' WHEN abs(t.computed - CAST(o_totalprice AS DECIMAL(18, 2))) <= greatest(abs(o_totalprice) * 0.005, 1.0) THEN 'ROUNDING_BOUNDARY' ELSE 'MISMATCH' END AS status
      FROM orders JOIN t ON l_orderkey = o_orderkey"""),
    "txt3_grid_expansion": plan(
        """SELECT doc_id, table_index, r, c, max_by(cell_id, row_index * 100000000 + col_index * 100000 + cell_id % 100000) AS cell_id FROM (
             SELECT cell_id, doc_id, table_index, row_index, col_index, r, unnest(range(col_index, col_index + greatest(coalesce(col_span, 1), 1))) AS c FROM (
               SELECT *, unnest(range(row_index, row_index + greatest(coalesce(row_span, 1), 1))) AS r FROM {CELLS} x WHERE text IS NOT NULL) a) b GROUP BY doc_id, table_index, r, c""",
        """SELECT doc_id, table_index, r, c, max_by(cell_id, row_index * 100000000 + col_index * 100000 + cell_id % 100000) AS cell_id FROM (
             SELECT cell_id, doc_id, table_index, row_index, col_index, r, explode(sequence(col_index, col_index + greatest(coalesce(col_span, 1), 1) - 1)) AS c FROM (
               SELECT *, explode(sequence(row_index, row_index + greatest(coalesce(row_span, 1), 1) - 1)) AS r FROM {CELLS} x WHERE text IS NOT NULL) a) b GROUP BY doc_id, table_index, r, c""",
    ),
    "prj11_layout_severity": plan("SELECT issue_id, CASE type WHEN 'CROSS_PAGE_BREAK' THEN 'BLOCKER' WHEN 'UNCONTROLLED_PAGE' THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM {ISSUES} i WHERE category = 'LAYOUT'"),
    "prj7_language_cap": plan("SELECT issue_id, CASE WHEN severity = 'INFO' THEN 'INFO' ELSE 'MINOR' END AS severity FROM {ISSUES} i WHERE category = 'GRAMMAR'"),
    "prj9_stage_failures": plan(
        "SELECT issue_id, 'SYSTEM' AS category, 'HIGH' AS severity, json_extract_string(evidence, '$.stage') AS stage, json_extract_string(evidence, '$.error_code') AS error_code FROM {ISSUES} i WHERE json_valid(evidence) AND json_extract_string(evidence, '$.kind') = 'STAGE_FAILURE'",
        "SELECT issue_id, 'SYSTEM' AS category, 'HIGH' AS severity, get_json_object(evidence, '$.stage') AS stage, get_json_object(evidence, '$.error_code') AS error_code FROM {ISSUES} i WHERE try_parse_json(evidence) IS NOT NULL AND get_json_object(evidence, '$.kind') = 'STAGE_FAILURE'",
    ),
    "prj17_stage_progress": plan("SELECT event_id, CASE event_type WHEN 'signup' THEN 10 WHEN 'view' THEN 30 WHEN 'click' THEN 60 WHEN 'purchase' THEN 90 ELSE 10 END + CAST(round(least(greatest(value, 0), 100) * 20 / 100) AS INT) AS progress FROM events"),
    "prj18_display_rows": plan("SELECT d.doc_id, coalesce(m.title, 'Untitled') AS title, coalesce(m.site, '-') AS site, coalesce(d.source, 'unknown') AS source FROM documents d LEFT JOIN {META} m ON m.doc_id = d.doc_id"),
    "prj20_project_kind": plan("SELECT doc_id, CASE WHEN project_no LIKE '13%' THEN 'A' WHEN project_no LIKE '03%' THEN 'B' ELSE 'OTHER' END AS kind FROM documents"),
    "prj19_status": plan("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'EMPTY' WHEN count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) = 0 THEN 'FINISHED' ELSE 'ACTIVE' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "src9_pack_counts": plan("SELECT pack_id, count(*) AS rules, count(DISTINCT kind) AS kinds, count(CASE WHEN kind = 'numeric_limit' AND numeric_limit_params.limit_value IS NULL THEN 1 END) AS invalid FROM rules GROUP BY pack_id"),
    "src10_pack_registry": plan("SELECT standard, pack_id, count(*) AS rules FROM rules GROUP BY standard, pack_id"),
    "src13_point_scan": plan("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'lab_bench'"),
    "src12_envelope_rows": plan("SELECT doc_id, coalesce(nullif(doc_no, ''), cover_no) AS number, coalesce(contractor, originator) AS party FROM {META} m"),
    "fil_snk4_content_hash": plan("SELECT doc_id, sha256(text) AS sha256, length(text) AS n FROM documents WHERE text IS NOT NULL", "SELECT doc_id, sha2(text, 256) AS sha256, length(text) AS n FROM documents WHERE text IS NOT NULL"),
    "agg13_variants": plan(
        "SELECT project_no, array_to_string(list_sort(list_distinct(list(rev))), ',') AS variants FROM {META} m WHERE rev IS NOT NULL GROUP BY project_no HAVING count(DISTINCT rev) > 1",
        "SELECT project_no, array_join(sort_array(collect_set(rev)), ',') AS variants FROM {META} m WHERE rev IS NOT NULL GROUP BY project_no HAVING count(DISTINCT rev) > 1",
    ),
    "agg14_collapsed": plan(
        "SELECT doc_id, type, count(*) AS n, array_to_string(list_sort(list_distinct(list(message)))[1:8], '; ') AS first_eight, greatest(count(DISTINCT message) - 8, 0) AS more FROM {ISSUES} i WHERE category = 'TRACEABILITY' GROUP BY doc_id, type",
        "SELECT doc_id, type, count(*) AS n, array_join(slice(sort_array(collect_set(message)), 1, 8), '; ') AS first_eight, greatest(count(DISTINCT message) - 8, 0) AS more FROM {ISSUES} i WHERE category = 'TRACEABILITY' GROUP BY doc_id, type",
    ),
    "agg27_acronyms": plan(
        r"SELECT page_id, len(list_distinct(regexp_extract_all(raw_text, '(^|[^A-Za-z])([A-Z]{3,6})([^A-Za-z]|$)', 2))) AS acronyms FROM {PAGES} p WHERE raw_text IS NOT NULL",
        r"SELECT page_id, size(array_distinct(regexp_extract_all(raw_text, '(^|[^A-Za-z])([A-Z]{3,6})([^A-Za-z]|$)', 2))) AS acronyms FROM {PAGES} p WHERE raw_text IS NOT NULL",
    ),
    "mut7_overlay_last_wins": plan("SELECT issue_id, max_by(included_in_report, updated_at) AS included, max(updated_at) AS updated_at FROM issues GROUP BY issue_id"),
    "mut5_create_or_reuse": plan(
        "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY created_at, doc_id) AS reused FROM documents WHERE text IS NOT NULL",
        "SELECT d.doc_id, g.reused FROM documents d JOIN (SELECT md5(text) AS k, min_by(doc_id, struct(created_at, doc_id)) AS reused FROM documents WHERE text IS NOT NULL GROUP BY md5(text)) g ON g.k = md5(d.text)",
    ),
    "mut1_oldest_active": plan("SELECT o_custkey, min(o_orderkey) AS holds, count(*) AS active FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey"),
    "mut2_transitions": plan("SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events"),
    "mut3_delete_guards": plan("SELECT d.doc_id, CASE WHEN n.n > 5 THEN 'HAS_ISSUES' WHEN d.source = 'project_archive' THEN 'ARCHIVED' ELSE 'ALLOWED' END AS outcome FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {ISSUES} i GROUP BY doc_id) n ON n.doc_id = d.doc_id"),
    "mut4_retry_failed": plan("SELECT user_id, max(event_id) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id"),
}


def queries() -> dict:
    return {**Q, **split(P)[0]}


def oracle_sql() -> dict:
    from .independent import oracle_sql as other_ways
    from .portable import filled

    return {**{k: v for k, v in other_ways().items() if k in Q}, **{k: filled(v) for k, v in O.items() if v}, **split(P)[1]}
