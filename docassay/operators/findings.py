"""Findings of all analyzers as one issues table: normalisation, evidence, first-wins merging, report rows.

Defined results: unknown severities keep their label and rank last; unreadable evidence has no boxes and
no page; findings with equal identity keep the first of the earliest stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity and confidence of the findings of each analyzer.
GRADES = {
    "TABLE_MATH_MISMATCH": ("HIGH", 1.0), "UNIT_MISMATCH": ("MEDIUM", 0.95), "MALFORMED_ROW": ("LOW", 0.9),
    "PAGE_DRIFT": ("MEDIUM", 1.0), "TARGET_NOT_FOUND": ("LOW", 0.9), "DUPLICATE_TARGET": ("LOW", 0.8),
    "STANDARD_NOT_IN_BIBLIOGRAPHY": ("MEDIUM", 0.9), "EDITION_YEAR_MISMATCH": ("HIGH", 0.95), "AMBIGUOUS_CITATION": ("LOW", 0.7),
    "CROSS_PAGE_BREAK": ("BLOCKER", 0.95), "UNCONTROLLED_PAGE": ("MAJOR", 0.95), "REVISION_MISMATCH": ("CRITICAL", 1.0),
    "REWORK_ITEM": ("MAJOR", 1.0), "CATEGORY_BAND_CONTRADICTION": ("BLOCKER", 1.0), "DUPLICATE_BAND": ("BLOCKER", 1.0), "STAGE_FAILURE": ("HIGH", 1.0),
}
#: Members of an evidence record that hold one box, and those that hold a list of boxes.
SINGLE_BOXES = ["location", "bounding_box", "total_location", "entry_location", "target_location", "body_location", "bibliography_location", "original_location"]
LISTED_BOXES = ["locations", "operand_locations"]
BOX = "struct<page_index:int,x0:double,y0:double,x1:double,y1:double,page_width:double,page_height:double>"
TEXT_KEYS = ["original_text", "snippet", "what_it_says", "label", "cited_standard", "detected_value", "stated_value"]


def grade(kind: Column) -> tuple[Column, Column]:
    """(severity, confidence) of a kind of finding; others are MINOR, 0.8."""
    level = F.create_map(*[F.lit(x) for k, (s, _) in GRADES.items() for x in (k, s)])
    sure = F.create_map(*[F.lit(x) for k, (_, c) in GRADES.items() for x in (k, c)])
    return F.coalesce(level[kind], F.lit("MINOR")), F.coalesce(sure[kind], F.lit(0.8))


def capped(severity: Column) -> Column:
    """Findings of language are never worse than MINOR; INFO stays INFO."""
    return F.when(severity == "INFO", "INFO").otherwise("MINOR")


def as_issues(found: DataFrame, stream: int, category: str, kind: Column, page: Column, message: Column) -> DataFrame:
    """(stream, doc_id, category, type, severity, confidence, page_number, message) of one analyzer's findings; pages from 1."""
    severity, confidence = grade(kind)
    severity = capped(severity) if category == "GRAMMAR" else severity
    return found.select(F.lit(stream).alias("stream"), "doc_id", F.lit(category).alias("category"), kind.alias("type"), severity.alias("severity"), confidence.alias("confidence"), (page + 1).cast("int").alias("page_number"), message.alias("message"))


def merged(*streams: DataFrame) -> DataFrame:
    """All streams in one table; equal findings once, with a stable key."""
    every = streams[0]
    for s in streams[1:]:
        every = every.unionByName(s)
    identity = F.sha2(F.concat_ws("|", "doc_id", "category", "type", F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.coalesce("message", F.lit(""))), 256)
    first = F.min(F.struct("stream", "severity", "confidence")).alias("f")
    return every.withColumn("issue_key", identity).groupBy("issue_key", "doc_id", "category", "type", "page_number", "message").agg(first).select("issue_key", "doc_id", "category", "type", "f.severity", "f.confidence", "page_number", "message", "f.stream")


def _from(member: str):
    return lambda b: F.struct(F.lit(member).alias("source"), b.alias("box"))


def boxes(issues: DataFrame) -> DataFrame:
    """(issue_id, pos, source, box): all boxes of an evidence record, single members first."""
    once = issues.dropDuplicates(["issue_id"])
    single = [F.struct(F.lit(k).alias("source"), F.from_json(F.get_json_object("evidence", f"$.{k}"), BOX).alias("box")) for k in SINGLE_BOXES]
    listed = [F.transform(F.coalesce(F.from_json(F.get_json_object("evidence", f"$.{k}"), f"array<{BOX}>"), F.expr(f"cast(array() as array<{BOX}>)")), _from(k)) for k in LISTED_BOXES]
    every = F.filter(F.concat(F.array(*single), *listed), lambda x: x["box"].isNotNull() & x["box"]["x0"].isNotNull() & x["box"]["y0"].isNotNull() & x["box"]["x1"].isNotNull() & x["box"]["y1"].isNotNull())
    return once.select("issue_id", F.posexplode(every).alias("pos", "b")).select("issue_id", "pos", "b.source", "b.box")


def evidence_page(evidence: Column) -> Column:
    """The page (from 1) of the first place an evidence record names; a revision without a place is on page 1, a failed stage on none."""
    kind = F.get_json_object(evidence, "$.kind")
    place = F.coalesce(*[F.get_json_object(evidence, f"$.{k}.page_index") for k in SINGLE_BOXES], *[F.get_json_object(evidence, f"$.{k}[0].page_index") for k in LISTED_BOXES], F.get_json_object(evidence, "$.page_index"))
    return F.when(kind == "STAGE_FAILURE", None).otherwise(F.coalesce(place.try_cast("int") + 1, F.when(kind == "REVISION", 1)))


def evidence_text(evidence: Column) -> Column:
    """The first text that an evidence record holds."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(evidence, f"$.{k}")), F.lit("")) for k in TEXT_KEYS])


def humanized(kind: Column) -> Column:
    """A type as a label: prefixes off, words apart, first letters large."""
    return F.initcap(F.replace(F.lower(F.regexp_replace(kind, r"^(?i)(?:rule_|lt_)", "")), F.lit("_"), F.lit(" ")))


def report_rows(issues: DataFrame, minors: bool = True) -> DataFrame:
    """(doc_id, category, type, label, occurrences, pages, messages): included issues of a report, grouped; pages in natural order."""
    once = issues.dropDuplicates(["issue_id"]).where("included_in_report")
    kept = once if minors else once.where("severity NOT IN ('MINOR', 'INFO')")
    pages = F.array_join(F.transform(F.array_sort(F.collect_set("page_number")), lambda p: p.cast("string")), ", ")
    first = F.transform(F.array_sort(F.collect_set(F.struct(F.col("first"), F.col("message")))), lambda s: s["message"])
    by_message = kept.groupBy("doc_id", "category", "type", "page_number", "message").agg(F.min("issue_id").alias("first"), F.count("*").alias("n"))
    grouped = by_message.groupBy("doc_id", "category", "type").agg(F.sum("n").alias("occurrences"), pages.alias("pages"), F.array_join(F.array_distinct(first), "; ").alias("messages"))
    return grouped.select("doc_id", "category", "type", humanized(F.col("type")).alias("label"), "occurrences", "pages", "messages")


def verdicts(issues: DataFrame) -> DataFrame:
    """(doc_id, blockers, majors, minors, verdict, bottom_line) of each document's included issues."""
    once = issues.dropDuplicates(["issue_id"]).where("included_in_report")
    n = once.groupBy("doc_id").agg(F.count_if(F.col("severity").isin("BLOCKER", "CRITICAL", "HIGH")).alias("blockers"), F.count_if(F.col("severity").isin("MAJOR", "MEDIUM")).alias("majors"), F.count("*").alias("n"))
    verdict = F.when(F.col("blockers") > 0, "rejected").when(F.col("majors") > 0, "rework").otherwise("approved")
    minor = F.col("n") - F.col("blockers") - F.col("majors")
    line = F.format_string("%d blocker(s), %d major and %d minor finding(s): %s", "blockers", "majors", minor, verdict)
    return n.select("doc_id", "blockers", "majors", minor.alias("minors"), verdict.alias("verdict"), line.alias("bottom_line"))


def latest(runs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order with a tie-break."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).where("_n = 1").drop("_n")
