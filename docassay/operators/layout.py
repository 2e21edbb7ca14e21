"""Layout of pages: sentence breaks between pages, misused heading styles, voids, uncontrolled pages, metrics.

Blocks are the text items of a page; first and last blocks are aggregates, neighbours come by ``lead``
over the distinct pages of a document.

Defined results: null texts give no block; a document of fewer than three pages has no void; a page
without known metrics is not judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words and marks that leave a sentence open, marks that end it, what opens a continuation, footers, narrative openings.
CONJUNCTION = r"(?i)\b(and|or|but|nor|so|yet|with|as|to|for|of|in|on|at|by|from|the|a|an)\s*$"
CONTINUES = r"[,;–—-]\s*$"
TERMINAL = r"[.!?:]\s*['\")\]]*$"
STARTS_ON = r"(?i)^(and|or|but|which|that|with|as|to|for)\b"
FOOTER = r"^(?i)\s*(?:page\s+[0-9]+(?:\s+of\s+[0-9]+)?|[0-9]+|[ivxlcdm]+|[A-Z0-9\-_/]{6,})\s*$"
NARRATIVE = r"^(?i)\s*(?:based\s+on|referring\s+to|according\s+to|with\s+reference\s+to|in\s+accordance\s+with|as\s+(?:shown|described|discussed|noted|stated|indicated|presented|defined)\s+in|pursuant\s+to|following\s+(?:the|this)|in\s+order\s+to|please\s+note\s+that|note\s+that|in\s+regard\s+to|with\s+regard\s+to)\b"
PAGE_NUMBER = r"(?i)\b(?:page\s+[0-9]+(?:\s+of\s+[0-9]+)?|[0-9]+\s*/\s*[0-9]+|[ivxlcdm]+)\b"
DOC_NUMBER = r"(?i)\b(?:[A-Z0-9]{2,}-[A-Z0-9\-_/]{4,}|DOC(?:NO)?[:\s#]+[A-Z0-9\-_/]+)\b"
#: Utilisation below which an inner page is a void.
VOID = 0.25


def page_breaks(items: DataFrame) -> DataFrame:
    """(doc_id, page_index, next_page, last_item, first_item, reason) where a sentence runs over a page's end."""
    body = items.where(F.col("text").isNotNull() & (F.trim("text") != "") & ~F.col("text").rlike(FOOTER))
    place = F.struct("y0", "x0", "seq", "item_id")
    pages = body.groupBy("doc_id", "page_index").agg(F.max_by(F.struct("item_id", "text"), place).alias("last"), F.min_by(F.struct("item_id", "text"), place).alias("first"))
    order = Window.partitionBy("doc_id").orderBy("page_index")
    pairs = pages.withColumn("next_page", F.lead("page_index").over(order)).withColumn("next", F.lead("first").over(order)).where("next_page IS NOT NULL")
    last, first = F.trim("last.text"), F.trim("next.text")
    opens = first.rlike(r"^\p{Ll}") | first.rlike(STARTS_ON)
    reason = F.when(last.rlike(CONJUNCTION), "conjunction").when(last.rlike(CONTINUES), "punctuation").when(~last.rlike(TERMINAL) & opens, "continues")
    return pairs.withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "page_index", "next_page", F.col("last.item_id").alias("last_item"), F.col("next.item_id").alias("first_item"), "reason")


def misused_styles(headings: DataFrame) -> DataFrame:
    """(doc_id, item_id, level, text): headings that begin like narrative text."""
    return headings.dropDuplicates(["item_id"]).where(F.trim("text").rlike(NARRATIVE)).select("doc_id", "item_id", "level", F.substring("text", 1, 60).alias("text"))


def metrics(items: DataFrame) -> DataFrame:
    """(doc_id, page_index, utilization, words) of a page from the boxes of its items."""
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    words = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    sums = items.groupBy("doc_id", "page_index").agg(F.sum(area).alias("used"), F.max(F.col("page_width") * F.col("page_height")).alias("whole"), F.sum(F.coalesce(words, F.lit(0))).alias("words"))
    return sums.select("doc_id", "page_index", F.least(F.lit(1.0), F.try_divide("used", "whole")).alias("utilization"), "words")


def voids(page_metrics: DataFrame) -> DataFrame:
    """(doc_id, page_index, ratio): inner pages used for less than VOID; values above 1 count as percent."""
    every = Window.partitionBy("doc_id")
    marked = page_metrics.withColumn("low", F.min("page_index").over(every)).withColumn("high", F.max("page_index").over(every)).withColumn("n", F.count("*").over(every))
    ratio = F.when(F.col("utilization") > 1, F.col("utilization") / 100).otherwise(F.col("utilization"))
    return marked.where("n >= 3 AND page_index > low AND page_index < high").withColumn("ratio", ratio).where(F.col("ratio") < VOID).select("doc_id", "page_index", "ratio")


def entities(pdf_pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, page_index, page_label, doc_number): taken from the header, else the footer, else the body."""
    once = pdf_pages.dropDuplicates(["page_id"])
    first = lambda pattern: F.coalesce(*[F.expr(f"nullif(regexp_extract({c}, '{pattern}', 0), '')") for c in ("header_text", "footer_text", "raw_text")])
    return once.select("page_id", "doc_id", "page_index", first(PAGE_NUMBER.replace("\\", "\\\\")).alias("page_label"), first(DOC_NUMBER.replace("\\", "\\\\")).alias("doc_number"))


def uncontrolled(pdf_pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, page_index, expected, missing): pages that lack a control mark, or carry another document number.

    The expected number is the first one of ten signs or more on the first five pages.
    """
    once = pdf_pages.dropDuplicates(["page_id"])
    expected = once.where("page_index < 5 AND length(doc_number) >= 10").groupBy("doc_id").agg(F.min_by("doc_number", "page_index").alias("expected"))
    missing = F.filter(F.array(
        F.when(~F.coalesce("has_header", F.lit(False)), "HEADER"), F.when(~F.coalesce("has_footer", F.lit(False)), "FOOTER"),
        F.when(~F.coalesce("has_page_number", F.lit(False)), "PAGE_NUMBER"),
        F.when(~F.coalesce("has_doc_number", F.lit(False)), "DOC_NUMBER").when(F.col("expected").isNotNull() & (F.col("doc_number") != F.col("expected")), "DOC_NUMBER"),
    ), lambda x: x.isNotNull())
    return once.join(expected, "doc_id", "left").withColumn("missing", F.array_join(missing, ",")).where("missing <> ''").select("page_id", "doc_id", "page_index", "expected", "missing")


def printed_label(items: DataFrame) -> DataFrame:
    """(doc_id, page_index, label): the lowest footer line that is an explicit or bare page number."""
    t = F.trim("text")
    label = F.regexp_extract(t, r"^(?i)(?:page\s+)?([0-9]+|[ivxlcdm]+)(?:\s+of\s+[0-9]+)?$", 1)
    low = items.where(F.col("y0") >= F.col("page_height") * 0.78).withColumn("label", label).where("label <> ''")
    return low.groupBy("doc_id", "page_index").agg(F.max_by("label", F.struct("y0", "seq", "item_id")).alias("label"))
