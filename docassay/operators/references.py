"""References of a document to itself and to standards: drift of page labels, revisions, citations.

Tiered matching is one equi-join per tier on the document, with the best tier kept by an aggregate;
reading order is a window over (page, y, x) that ends with the arrival number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import page_value

# How standards are cited, by family: pattern, group of the code and of the year.
STANDARDS = {
    "ASME": r"\b(ASME\s+(?:(?:SEC(?:TION)?\.?)\s*)?[IVXLCDM]+(?:\s+(?:DIV(?:ISION)?\.?)\s*[0-9]+)?)(?:\s*[-:,(]\s*((?:19|20)[0-9]{2})\)?)?\b",
    "API": r"\b(API\s+(?:(?:STD|SPEC|RP)\s+)?[0-9]{1,4}[A-Z]?)(?:\s*[-:,(]\s*((?:19|20)[0-9]{2})\)?)?\b",
    "ASTM": r"\b(ASTM\s+[A-Z][0-9]{1,4}(?:/[A-Z][0-9]{1,4})?M?)(?:\s*[-:,(]\s*((?:19|20)[0-9]{2})\)?)?\b",
    "ISO": r"\b((?:EN\s+)?ISO\s+[0-9]{3,6}(?:-[0-9]+)?)(?:\s*[-:,(]\s*((?:19|20)[0-9]{2})\)?)?\b",
    "SITE": r"\b((?:QN|MPC|TRS)\s+[0-9]{1,4})(?:\s*[-:,(]\s*((?:19|20)[0-9]{2})\)?)?\b",
}
# Codes that stand without a series, headings of a bibliography, entries of a list of contents, revision labels.
BARE_API = ["510", "570", "579", "650", "653", "1104", "5L", "6A"]
BIBLIOGRAPHY = r"^(?i)(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:NORMATIVE\s+)?(?:REFERENCES?|BIBLIOGRAPHY|CODES?\s+AND\s+STANDARDS?)$"
ENTRY = r"^(?i)(.+?)(?:[.\s\t_–—]{2,}|\s{2,}|\t+)([ivxlcdm]+|[0-9]+)\s*$"
REVISION = r"(?i)\bREV(?:ISION)?\s*(?:NO\.?|NUMBER)?\s*[:#._-]?\s*([A-Z0-9]{1,8})\b"
FILE_REVISION = r"(?i)(?:^|[_\s-])REV(?:ISION)?[._\s-]?([A-Z0-9]{1,8})(?=$|[._\s-])"


def ordered_items(headings: DataFrame, spans: DataFrame) -> DataFrame:
    """Headings and spans of a document with their place in reading order."""
    columns = ["item_id", "doc_id", "seq", "text", F.col("bbox.page_index").alias("page_index"), F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0")]
    return headings.select(*columns, F.lit(True).alias("is_heading")).unionByName(spans.select(*columns, F.lit(False).alias("is_heading"))).dropDuplicates(["item_id"])


def normalized_code(code: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(code)), r"[.,]$", ""), r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\bSEC(?:TION)?\.?\s*", "SECTION "), r"\bDIV(?:ISION)?\.?\s*", "DIVISION ")
    return F.regexp_replace(t, "^EN ISO ", "ISO ")


def _cited_as(family: str):
    return lambda code, year: F.struct(F.lit(family).alias("family"), code.alias("code"), year.alias("year"))


def citations(items: DataFrame) -> DataFrame:
    """(doc_id, item_id, page_index, y0, x0, family, code, year, section, ambiguous): all citations; those behind the first bibliography heading are REFERENCE."""
    starts = F.trim(F.col("text")).rlike(BIBLIOGRAPHY) & (F.col("is_heading") | (F.length("text") <= 80))
    any_citation = F.expr("false")
    for pattern in STANDARDS.values():
        any_citation = any_citation | F.col("text").rlike("(?i)" + pattern)
    # the first bibliography heading of a document is an aggregate; what stands behind it is a comparison of places
    place = F.struct("page_index", "y0", "x0", "seq", "item_id")
    readable = items.where(F.col("text").isNotNull())
    first = readable.where(starts).groupBy("doc_id").agg(F.min(place).alias("first"))
    marked = readable.where(any_citation).join(first, "doc_id", "left").withColumn("section", F.when(place >= F.col("first"), "REFERENCE").otherwise("BODY"))
    # all families in one pass over the texts
    cited = F.concat(*[
        F.zip_with(F.regexp_extract_all("text", F.lit("(?i)" + p), 1), F.regexp_extract_all("text", F.lit("(?i)" + p), 2), _cited_as(family))
        for family, p in STANDARDS.items()
    ])
    found = marked.withColumn("c", F.explode(cited)).select("doc_id", "item_id", "page_index", "y0", "x0", "c.family", normalized_code(F.col("c.code")).alias("code"), F.col("c.year").try_cast("int").alias("year"), "section")
    number = F.regexp_extract("code", r"^API ([0-9]+[A-Z]?)$", 1)
    return found.withColumn("ambiguous", (F.col("family") == "API") & (number != "") & ~number.isin(BARE_API))


def traceability(items: DataFrame, include_missing: bool = True) -> DataFrame:
    """(doc_id, kind, code, year): citations of the body that the bibliography lacks or gives in another edition, each once."""
    all_citations = citations(items)
    listed = all_citations.where("section = 'REFERENCE'").groupBy("doc_id", "code").agg(F.collect_set("year").alias("years"))
    body = all_citations.where("section = 'BODY'").join(listed, ["doc_id", "code"], "left")
    kind = (
        F.when(F.col("ambiguous"), "AMBIGUOUS_CITATION")
        .when(F.col("years").isNull(), "STANDARD_NOT_IN_BIBLIOGRAPHY" if include_missing else None)
        .when(F.col("year").isNotNull() & (F.size("years") > 0) & ~F.array_contains("years", F.col("year")), "EDITION_YEAR_MISMATCH")
    )
    return body.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("doc_id", "kind", "code", "year").agg(F.count("*").alias("citations"))


def normalized_title(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[.\s_–—]+$", ""), r"\s+", " ")


# Headings of lists of contents, figures and tables, captions, and what may stand before a section number.
LISTS = {
    "TOC": r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:TABLE\s+OF\s+CONTENTS|CONTENTS|TOC)\b",
    "LOF": r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:LIST\s+OF\s+FIGURES|FIGURES|LOF)\b",
    "LOT": r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+)?(?:LIST\s+OF\s+TABLES|TABLES|LOT)\b",
}
CAPTION = r"(?i)^\s*(?:FIGURE|FIG\.?|TABLE)\s+[0-9]+(?:[.\-:\s].*)?$"
SECTION = r"^(?:(?:figure|fig\.?|table|section)\s+)?([0-9]+(?:\.[0-9]+)*\b)"


def toc_entries(items: DataFrame) -> DataFrame:
    """(doc_id, item_id, title, label): lines that end with leader dots or wide space and a page label."""
    t = F.col("text")
    return items.where(t.rlike(ENTRY)).select("doc_id", "item_id", normalized_title(F.regexp_extract(t, ENTRY, 1)).alias("title"), F.regexp_extract(t, ENTRY, 2).alias("label"))


def contents(items: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, targets) of the lists of contents, figures and tables of each document, as ``drift`` takes them.

    labels: doc_id, page_index, label, the printed labels. A page with the heading of a list holds entries (of its texts);
    a list is headed by a text only in a document without such a heading. Targets are the headings and the captions of
    all other pages, headings first, each with the label of its page, null where none is printed.
    """
    kind = F.coalesce(*[F.when(F.col("text").rlike(p), k) for k, p in LISTS.items()])
    named = items.where("text IS NOT NULL").withColumn("list", kind)
    starts = named.where("list IS NOT NULL").groupBy("doc_id", "page_index").agg(F.max("is_heading").alias("by_heading"))
    documents = starts.groupBy("doc_id").agg(F.max("by_heading").alias("any_heading"))
    pages = starts.join(documents, "doc_id").where("by_heading = any_heading").select("doc_id", "page_index")
    lines = named.where("NOT is_heading AND list IS NULL").join(pages, ["doc_id", "page_index"], "left_semi")
    targets = named.where(F.col("is_heading") & (F.trim("text") != "") | F.col("text").rlike(CAPTION)).join(pages, ["doc_id", "page_index"], "left_anti")
    placed = targets.join(labels.select("doc_id", "page_index", F.col("label").alias("page_label")), ["doc_id", "page_index"], "left")
    order = F.struct(F.expr("NOT is_heading AS caption"), "page_index", "y0", "x0", "item_id")
    return toc_entries(lines), placed.select("doc_id", order.alias("seq"), normalized_title(F.col("text")).alias("title"), "page_index", "page_label")


def drift(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, item_id, title, label, target_label, tier, matches, delta, kind).

    entries: doc_id, item_id, title, label; targets: doc_id, seq, title, page_index, page_label. An exact
    title outranks one that begins with the other, which outranks an equal section number; of the best
    tier the first target counts. Each tier is an equi-join: whole title, section number, and for the
    beginnings the part of the longer title that has the length of one of the other side's titles.
    """
    section = lambda c: F.regexp_extract(c, SECTION, 1)
    lengths = lambda df: df.groupBy("doc_id").agg(F.collect_set(F.length("title")).alias("lengths"))  # noqa: E731  as many as titles have lengths
    e = entries.select("doc_id", "item_id", "title", section(F.col("title")).alias("section"))
    t = targets.select("doc_id", "seq", "page_index", "page_label", "title", section(F.col("title")).alias("section"))
    found = ["doc_id", "item_id", "tier", "seq", "page_index", "page_label"]
    exact = e.join(t.drop("section"), ["doc_id", "title"]).withColumn("tier", F.lit(1)).select(*found)
    parts = lambda df, other: df.join(lengths(other), "doc_id").withColumn("n", F.explode("lengths")).where("n < length(title)").withColumn("title", F.expr("left(title, n)"))
    longer_entry = parts(e, t).join(t.drop("section"), ["doc_id", "title"])
    longer_target = parts(t, e).join(e.drop("section"), ["doc_id", "title"])
    begun = longer_entry.withColumn("tier", F.lit(2)).select(*found).unionByName(longer_target.withColumn("tier", F.lit(2)).select(*found))
    numbered = e.where("section <> ''").drop("title").join(t.drop("title"), ["doc_id", "section"]).withColumn("tier", F.lit(3)).select(*found)
    candidates = exact.unionByName(begun).unionByName(numbered)
    best = candidates.groupBy("doc_id", "item_id", "tier").agg(F.min_by(F.struct("page_index", "page_label"), "seq").alias("t"), F.count_distinct("page_index").alias("matches")).groupBy("doc_id", "item_id").agg(F.min_by(F.struct("tier", "t", "matches"), "tier").alias("b"))
    out = entries.select("doc_id", "item_id", "title", "label").join(best, ["doc_id", "item_id"], "left").select("doc_id", "item_id", "title", "label", F.col("b.t.page_label").alias("target_label"), F.col("b.tier").alias("tier"), F.coalesce(F.col("b.matches"), F.lit(0)).alias("matches"))
    a, b = page_value(F.col("target_label")), page_value(F.col("label"))
    unlabelled = F.col("target_label").isNull() | (F.trim("target_label") == "")
    delta = F.when(F.col("tier").isNull() | unlabelled, 0).when(a.isNotNull() & b.isNotNull(), a - b).when(F.lower("target_label") != F.lower("label"), 1).otherwise(0)
    kind = F.when(F.col("tier").isNull(), "TARGET_NOT_FOUND").when(F.col("matches") > 1, "DUPLICATE_TARGET").when(delta != 0, "PAGE_DRIFT").otherwise("OK")
    return out.withColumn("delta", delta.cast("int")).withColumn("kind", kind)


def revision_token(text: Column) -> Column:
    """A revision in its common form: no label, letters and digits only, digits without leading zeros, 8 signs at most."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"^REV(?:ISION)?\s*(?:NO\.?|NUMBER)?\s*[:#.-]?\s*", ""), "[^A-Z0-9]", "")
    t = F.when((t == "") | (F.length(t) > 8), None).otherwise(t)
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)


def revision_sources(metadata: DataFrame, spans: DataFrame, headings: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, source, pos, value): the revision by file name, cover page and revision table, where stated."""
    once = metadata.dropDuplicates(["doc_id"])
    name = once.select("doc_id", F.lit("FILENAME").alias("source"), F.lit(1).alias("pos"), F.regexp_extract(F.regexp_replace("original_filename", r"\.[^.]*$", ""), FILE_REVISION, 1).alias("raw"))
    stated = once.select("doc_id", F.lit("COVER").alias("source"), F.lit(2).alias("pos"), F.col("cover_metadata.revision").alias("raw"))
    cover = ordered_items(headings, spans).where("page_index = 0 AND text IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("y0", "x0", "seq", "item_id")
    context = F.concat_ws(" ", "text", F.lead("text", 1).over(order), F.lead("text", 2).over(order))
    seen = cover.withColumn("n", F.row_number().over(order)).withColumn("context", context).withColumn("raw", F.regexp_extract("context", REVISION, 1)).where("raw <> ''").groupBy("doc_id").agg(F.min_by("raw", "n").alias("raw"))
    page = seen.select("doc_id", F.lit("COVER_PAGE").alias("source"), F.lit(3).alias("pos"), "raw")
    table = cells.dropDuplicates(["cell_id"]).where("text IS NOT NULL")
    heads = table.where(F.trim("text").rlike(r"^(?i)(?:REV(?:ISION)?\.?(?:\s*NO\.?)?)$")).groupBy("doc_id", "table_index", "col_index").agg(F.min("row_index").alias("head_row"))
    below = table.join(heads, ["doc_id", "table_index", "col_index"]).where("row_index > head_row").where(F.trim("text").rlike("^[A-Za-z0-9]{1,3}$"))
    sheet = below.groupBy("doc_id").agg(F.max_by("text", "row_index").alias("raw")).select("doc_id", F.lit("REVISION_SHEET").alias("source"), F.lit(4).alias("pos"), "raw")
    every = name.unionByName(stated).unionByName(page).unionByName(sheet)
    return every.withColumn("value", revision_token(F.col("raw"))).where("value IS NOT NULL").select("doc_id", "source", "pos", "value")


def disagreeing(sources: DataFrame) -> DataFrame:
    """(doc_id, source, value) of sources that differ from the most frequent value; if none is frequent, of all."""
    counted = sources.groupBy("doc_id", "value").agg(F.count("*").alias("votes"), F.min("pos").alias("first"))
    top = counted.groupBy("doc_id").agg(F.count("*").alias("values"), F.max("votes").alias("top"), F.max_by("value", F.struct("votes", -F.col("first"))).alias("top_value")).where("values > 1")
    return sources.join(top, "doc_id").where("top = 1 OR value <> top_value").select("doc_id", "source", "value")
