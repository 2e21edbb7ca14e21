"""Content signals of documents and a scorecard over them.

Spans take the section of the last heading above them; sections are aggregated per document into
signals; a score is one CASE over signals; averages come from one rollup. Items and their rules are data.

Defined results: a document without headings has no sections and scores by its text alone; an item that
does not apply scores null and is left out of averages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import with_heading

# Sections by what their headings say.
SECTIONS = {
    "summary": r"(?i)\b(?:summary|ringkasan|zusammenfassung|resumen|resumo|résumé|сводка|主要发现|所見)",
    "introduction": r"(?i)\b(?:introduction|background|scope|ruang lingkup|umfang|étendue|alcance|escopo)",
    "methodology": r"(?i)\b(?:methodology|methods?|procedure|approach)\b",
    "results": r"(?i)\b(?:results?|survey|measurements?|thickness|épaisseur|medición|pressure|tekanan|presión)",
    "discussion": r"(?i)\b(?:discussion|assessment|review)",
    "conclusions": r"(?i)\b(?:conclusions?|kesimpulan)",
    "recommendations": r"(?i)\b(?:recommend\w*|actions?|repairs?|tindakan|maßnahmen|medidas|mesures)",
    "references": r"(?i)\b(?:references?|bibliography|certificates)",
}
#: Items: group, key, score (SQL over the signals, in the reference's order of conditions).
ITEMS = [
    ("I", "message_clear", "IF(words_summary < 20, 2, 4)"),
    ("I", "logical_approach", "IF(approach_logical, 5, 3)"),
    ("I", "adequate_research", "CASE WHEN has_references AND baseline_work THEN 5 WHEN baseline_work THEN 3 ELSE 2 END"),
    ("I", "adequate_comparison", "IF(external_benchmark, 5, 3)"),
    ("I", "conclusions_supported", "IF(contradictions > 0, 3, 5)"),
    ("I", "value_stated", "IF(value_stated, 5, 2)"),
    ("I", "objective_met", "IF(objectives_met, 5, 3)"),
    ("I", "original_free_of_plagiarism", "3"),
    ("I", "timely", "3"),
    ("II", "objective_tone", "IF(objective_tone, 4, 3)"),
    ("II", "sections_logical", "IF(sections_logical, 5, 3)"),
    ("II", "readership_level", "3"),
    ("II", "free_of_jargon", "IF(unexplained_jargon, 4, 5)"),
    ("II", "english_usage", "IF(language_findings >= 10 OR key_section_faults > 0, 2, 4)"),
    ("II", "concise", "IF(counts_repeated, 3, 5)"),
    ("II", "interesting", "3"),
    ("II", "free_of_personal_opinion", "3"),
    ("II", "no_over_explain", "IF(counts_repeated, 3, 5)"),
    ("II", "standard_writing_practice", "IF(NOT has_references OR uncontrolled > 0 OR drifts > 0, 2, 5)"),
    ("II", "layout_and_whitespace", "IF(voids > 0 OR uncontrolled > 0, 3, 5)"),
    ("III", "sufficient_background", "IF(words_introduction >= 80, 5, 2)"),
    ("III", "purpose_of_work_clear", "IF(purpose_of_work, 5, 3)"),
    ("III", "objective_of_work_clear", "IF(objective_of_work, 5, 3)"),
    ("III", "purpose_of_report_clear", "IF(purpose_of_report, 5, 1)"),
    ("III", "objective_of_report_clear", "IF(scope_stated, 3, 1)"),
    ("III", "format_stated", "IF(format_stated, 5, 1)"),
    ("III", "work_referenced", "IF(has_references, 5, 1)"),
    ("III", "experimental_steps_outlined", "CASE WHEN non_laboratory THEN NULL WHEN steps_outlined THEN 5 ELSE 3 END"),
    ("III", "adequate_detail_to_repeat", "CASE WHEN non_laboratory THEN NULL WHEN procedure_repeatable THEN 5 ELSE 3 END"),
    ("III", "free_of_trade_names", "3"),
    ("III", "test_standards_cited", "IF(has_references AND edition_cited, 5, 3)"),
    ("IV", "results_clearly_stated", "IF(words_results >= 30, 4, 2)"),
    ("IV", "results_free_of_discussion", "IF(words_discussion > 0, 4, 3)"),
    ("IV", "graphs_and_tables_proper", "CASE WHEN drifts > 0 THEN 2 WHEN tables > 0 OR figures_named THEN 4 ELSE 3 END"),
    ("IV", "sufficient_results", "IF(words_results >= 100, 4, 2)"),
    ("IV", "discussion_relates_to_others", "CASE WHEN non_laboratory THEN NULL WHEN words_discussion > 0 THEN 5 ELSE 2 END"),
    ("IV", "discussion_length_appropriate", "CASE WHEN non_laboratory THEN NULL WHEN words_discussion > 0 THEN 5 ELSE 2 END"),
    ("IV", "conclusions_follow_from_results", "IF(contradictions > 0, 3, 5)"),
    ("IV", "conclusions_clear", "IF(figures_in_conclusions OR contradictions > 0, 2, 5)"),
    ("IV", "references_properly_attributed", "IF(has_references, 5, 1)"),
    ("IV", "sentence_paragraph_length", "4"),
]
# Document types that are no laboratory reports, and the order of sections in a report.
NON_LABORATORY = r"\b(?:SOR|STATEMENT OF REQUIREMENTS|SPECIFICATION|PROCEDURE)\b"
ORDER = ["summary", "introduction", "methodology", "results", "discussion", "conclusions", "recommendations"]
OWNER = r"(?i)\b(?:owner|responsible(?:\s+party)?|assigned\s+to)\s*[:=-]?\s*[A-Z][\w.-]+"
DATE = r"(?i)\b(?:by|before|due(?:\s+date)?|no\s+later\s+than|target(?:\s+date)?)\s+(?:[0-9]{1,2}\s+[A-Z][a-z]+\s+20[0-9]{2}|[A-Z][a-z]+\s+[0-9]{1,2},?\s+20[0-9]{2}|(?:end\s+of\s+)?20[0-9]{2}|Q[1-4]\s+20[0-9]{2})\b"
STEPS = r"(?i)\b(?:step\s*[0-9]+|[0-9]+[.)]|first|then|finally)\b"


#: Characters of a section's text in a note.
EXCERPT = 180
# The section that an item rests on.
EVIDENCE = {
    "summary": "message_clear value_stated", "methodology": "logical_approach experimental_steps_outlined adequate_detail_to_repeat",
    "introduction": "adequate_research purpose_of_report_clear purpose_of_work_clear objective_of_work_clear objective_of_report_clear format_stated",
    "discussion": "adequate_comparison discussion_relates_to_others discussion_length_appropriate",
    "conclusions": "conclusions_supported objective_met conclusions_follow_from_results conclusions_clear sentence_paragraph_length",
    "references": "work_referenced test_standards_cited references_properly_attributed", "results": "results_clearly_stated results_free_of_discussion graphs_and_tables_proper sufficient_results",
}


def sections(items: DataFrame) -> DataFrame:
    """(doc_id, item_id, section_item, section, text): each span with the section of the last heading at or above it."""
    name = F.coalesce(*[F.when(F.col("head.text").rlike(p), k) for k, p in SECTIONS.items()], F.lit("other"))
    return with_heading(items).where("NOT is_heading").select("doc_id", "item_id", F.col("head.item_id").alias("section_item"), F.when(F.col("head").isNull(), None).otherwise(name).alias("section"), "text")


def _content(items: DataFrame) -> DataFrame:
    """One row of text signals for each document; lines of a document are put together, as phrases run over them."""
    named = lambda c: F.coalesce(*[F.when(c.rlike(p), k) for k, p in SECTIONS.items()])
    placed = with_heading(items.where("text IS NOT NULL")).where("NOT is_heading")
    row = F.struct("page_index", "y0", "seq", "item_id", "text", named(F.col("head.text")).alias("section"))
    docs = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("text", F.array_join("rows.text", "\n"))
    for k in ORDER:
        docs = docs.withColumn(f"s_{k}", F.expr(f"transform(filter(rows, r -> r.section = '{k}' AND trim(r.text) <> ''), r -> trim(r.text))"))
    actions = F.col("s_recommendations")
    docs = docs.withColumn("recommendations_actionable", (F.size(actions) > 0) & F.forall(actions, lambda t: t.rlike(OWNER) & t.rlike(DATE)))
    for k in ORDER:
        docs = docs.withColumn(f"s_{k}", F.array_join(f"s_{k}", "\n"))
    has = lambda c, p: F.col(c).rlike(p)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), 0)
    repeatable = (F.length("s_methodology") >= 120) & has("s_methodology", STEPS) & has("s_methodology", r"(?i)\b(?:calculate|measur|test|inspect|equation|formula|parameter|criteria)\w*\b")
    intro, body = "s_introduction", "text"
    purpose = has(intro, r"(?i)\bpurpose\s+of\s+(?:this\s+)?(?:report|document)\b")
    objective = has(intro, r"(?i)\bobjective\s+of\s+(?:the\s+)?(?:work|study|project)\b")
    figures = has("s_conclusions", r"(?i)\b(?:Table|Figure|Fig\.)\s*[0-9]+(?:-[0-9]+)?\b")
    return docs.select(
        "doc_id", "recommendations_actionable",
        repeatable.alias("procedure_repeatable"), (repeatable & has("s_methodology", r"(?i)\b(?:then|subsequently|following|step\s*[0-9]+|[0-9]+[.)])\b")).alias("approach_logical"), has("s_methodology", STEPS).alias("steps_outlined"),
        has(body, r"(?i)\b(?:previous|prior|historical|baseline|earlier\s+study)\b").alias("baseline_work"),
        (has(body, r"(?i)\b(?:benchmark|compared\s+with|compared\s+against)\b") & has(body, r"(?i)\b(?:reference|study|published|literature)\b")).alias("external_benchmark"),
        has("s_summary", r"(?i)\b(?:result|conclud|demonstrat|recommend|benefit|decision|can\s+operate)\w*\b").alias("value_stated"),
        has(body, r"(?i)\b(?:objective|objectives)\b.{0,100}\b(?:met|achieved|addressed)\b").alias("objectives_met"),
        (~has(body, r"(?i)\b(?:I believe|we believe|best ever|unmatched|revolutionary)\b")).alias("objective_tone"),
        F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b[A-Z][A-Z0-9/-]{1,}\b"), 0))).alias("acronyms"),
        (F.size(F.array_intersect(F.array_intersect(numbers("s_summary"), numbers("s_results")), numbers("s_conclusions"))) >= 3).alias("counts_repeated"),
        has(body, r"(?i)\b(?:references?|bibliography|codes? and standards?)\b").alias("references_named"), has(body, r"(?i)\b(?:table|figure)\s+[0-9]").alias("figures_named"),
        has(body, r"(?i)\b(?:ASME|API|ASTM|ISO)\b[^\n]{0,60}\b(?:19|20)[0-9]{2}\b").alias("edition_cited"),
        has(intro, r"(?i)\b(?:purpose of (?:the )?(?:work|study|project)|objective|scope of work)\b").alias("purpose_of_work"), has(intro, r"(?i)\b(?:objective|objectives|scope of work)\b").alias("objective_of_work"),
        purpose.alias("purpose_of_report"), (purpose & objective).alias("purpose_distinct"), has(intro, r"(?i)\bscope(?: of work)?\b").alias("scope_stated"),
        has(intro, r"(?i)\b(?:report format|format of (?:this )?report|organized into|structured as)\b").alias("format_stated"),
        figures.alias("figures_in_conclusions"), has("s_conclusions", r"(?i)(?:Criticality|Priority)\s*[0-9]+\s*=\s*[0-9]+").alias("counts_restated"),
    )


def signals(items: DataFrame, cells: DataFrame, citations: DataFrame, repeats: DataFrame, uncontrolled: DataFrame, voids: DataFrame, drifts: DataFrame, contradictions: DataFrame, faults: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row of signals for each document with items.

    contradictions: doc_id, item_id, ...; faults: doc_id, page_index of the language findings;
    metadata: doc_id, named (title, file name and type).
    """
    words = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    placed = sections(items)
    own = placed.groupBy("doc_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("section") == k, words)), F.lit(0)).alias(f"words_{k}") for k in SECTIONS], F.sum(F.coalesce(words, F.lit(0))).alias("words"),
        *[F.max(F.col("section") == k).alias(f"has_{k}") for k in SECTIONS if k != "references"],
    )
    name = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(ORDER.index(k)) if k in ORDER else F.lit(None).cast("int")) for k, p in SECTIONS.items()])
    heads = items.where("is_heading AND text IS NOT NULL").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_index", "y0", "seq", "item_id", name.alias("n")))).alias("h"), F.max(F.col("text").rlike(r"(?i)\b(?:abbreviations?|acronyms?|glossary)\b")).alias("abbreviations"), F.max(F.upper("text").rlike(NON_LABORATORY)).alias("head_type"))
    heads = heads.withColumn("n", F.filter("h.n", lambda x: x.isNotNull())).select("doc_id", ((F.size("n") > 0) & (F.col("n") == F.array_sort("n"))).alias("sections_logical"), "abbreviations", "head_type")
    typed = metadata.select("doc_id", F.upper("named").rlike(NON_LABORATORY).alias("named_type")).groupBy("doc_id").agg(F.max("named_type").alias("named_type"))
    count = lambda df, c: df.groupBy("doc_id").agg(F.count("*").alias(c))
    where = placed.where("section IN ('summary', 'conclusions', 'recommendations') AND trim(text) <> ''").join(items.select("item_id", "page_index"), "item_id").select("doc_id", "page_index").distinct()
    claimed = contradictions.join(placed.where("section IN ('summary', 'conclusions')").select("item_id"), "item_id", "left_semi")
    tables = cells.groupBy("doc_id").agg(F.count_distinct("table_index").alias("tables"))
    cited = citations.groupBy("doc_id").agg(F.count("*").alias("citations"), F.count("year").alias("dated_citations"))
    out = own
    counted = [(repeats, "repeats"), (uncontrolled, "uncontrolled"), (voids, "voids"), (drifts, "drifts"), (claimed, "contradictions"), (faults, "language_findings"), (faults.join(where, ["doc_id", "page_index"], "left_semi"), "key_section_faults")]
    for other in (_content(items), heads, typed, tables, cited, *[count(df, c) for df, c in counted]):
        out = out.join(other, "doc_id", "left")
    out = out.na.fill(0, ["tables", "citations", "dated_citations", "acronyms", *[c for _, c in counted]]).na.fill(False)
    conclusions = F.expr("NOT figures_in_conclusions AND NOT counts_restated AND contradictions = 0")
    return out.withColumns({"has_references": F.col("references_named"), "unexplained_jargon": F.expr("acronyms > 12 AND NOT abbreviations"), "non_laboratory": F.expr("head_type OR named_type"), "conclusions_valid": conclusions}).drop("head_type", "named_type")


def scores(signal_rows: DataFrame) -> DataFrame:
    """(doc_id, grp, item, score): the long scorecard of all items."""
    parts = ", ".join(f"struct('{g}' AS grp, '{k}' AS item, CAST({c} AS INT) AS score)" for g, k, c in ITEMS)
    return signal_rows.select("doc_id", F.explode(F.expr(f"array({parts})")).alias("s")).select("doc_id", "s.*")


def item(signal_rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, grp, item, score) of one item by its name; an unknown name is an error."""
    if name not in {k for _, k, _ in ITEMS}:
        raise ValueError(f"unknown item: {name}")
    return scores(signal_rows).where(F.col("item") == name)


def evidence(items: DataFrame) -> DataFrame:
    """(doc_id, section, heading, page, excerpt): of each kind of section its first heading with text, with the beginning of that text."""
    named = F.coalesce(*[F.when(F.col("head.text").rlike(p), k) for k, p in SECTIONS.items()])
    placed = with_heading(items.where("trim(text) <> ''")).where("NOT is_heading AND head IS NOT NULL").withColumn("section", named).where("section IS NOT NULL")
    first = F.min_by(F.struct(F.col("head.text").alias("heading"), (F.col("page_index") + 1).alias("page"), F.substring(F.trim("text"), 1, EXCERPT).alias("excerpt")), F.struct("page_index", "y0", "seq", "item_id"))
    return placed.groupBy("doc_id", "section").agg(first.alias("f")).select("doc_id", "section", "f.*")


def notes(score_rows: DataFrame, sections_found: DataFrame) -> DataFrame:
    """(doc_id, item, score, section, note): each scored item with the place in the document that it rests on.

    An item that doesn't apply has no note. Items without a section of their own rest on the summary.
    """
    own = F.create_map(*[F.lit(x) for k, names in EVIDENCE.items() for name in names.split() for x in (name, k)])
    asked = score_rows.where("score IS NOT NULL").withColumn("section", F.coalesce(own[F.col("item")], F.lit("summary")))
    met = asked.join(sections_found, ["doc_id", "section"], "left")
    begin = F.concat("item", F.lit(": "), F.col("score"), F.lit("/5. "))
    note = (
        F.when(F.col("heading").isNotNull(), F.concat(begin, F.lit("Source section “"), "heading", F.lit("”, PDF page "), "page", F.lit(". Evidence: “"), "excerpt", F.lit("”")))
        .when(F.col("section") == "references", F.concat(begin, F.lit("No references or bibliography section was detected in the extracted document headings/text.")))
        .otherwise(F.concat(begin, F.lit("The document did not yield a matching section heading and text excerpt for this item; manual review is needed.")))
    )
    return met.select("doc_id", "item", "score", "section", note.alias("note"))


def baselines(signal_rows: DataFrame) -> DataFrame:
    """(doc_id, purpose_distinct, procedure_repeatable, conclusions_valid, recommendations_actionable): the four baselines."""
    return signal_rows.select("doc_id", "purpose_distinct", "procedure_repeatable", "conclusions_valid", "recommendations_actionable")


def not_applicable(signal_rows: DataFrame) -> DataFrame:
    """(doc_id, item, score, status) of the items that apply to laboratory reports only; NOT_APPLICABLE has a null score."""
    judged = scores(signal_rows).where(F.col("item").isin("experimental_steps_outlined", "adequate_detail_to_repeat", "discussion_relates_to_others", "discussion_length_appropriate"))
    return judged.select("doc_id", "item", "score", F.when(F.col("score").isNull(), "NOT_APPLICABLE").otherwise("EVALUATED").alias("status"))


def averages(score_rows: DataFrame) -> DataFrame:
    """(doc_id, grp, average, rework): averages of each group and over all (grp 'ALL'), two decimals; items at 2 or less need rework."""
    rolled = score_rows.rollup("doc_id", "grp").agg(F.round(F.avg("score"), 2).alias("average"), F.count_if(F.col("score") <= 2).alias("rework"), F.grouping("grp").alias("g"))
    return rolled.where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("g") == 1, "ALL").otherwise(F.col("grp")).alias("grp"), "average", "rework")
