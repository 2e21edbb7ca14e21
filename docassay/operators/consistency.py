"""Bands of categories defined in tables against what the text claims.

Definitions are harvested from table rows, claims from text; both become interval structs, and an
equi-join on document, entity and category meets them.

Defined results: a row without a readable interval defines nothing; of several definitions of one
category in a document the first counts; null texts claim nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import same_interval, with_interval

# Words that name categories and ranges.
LABELS = "criticality|priority|category|risk band|classification|tier"
CATEGORY = r"(?i)\b(?:criticality|priority|category|tier|classification|class|level)?\s*([0-9]+[A-Za-z]?)\b"
CLAIM = r"(?i)\b(criticality|priority|category|tier|class)\s+([0-9]+[A-Za-z]?)\b[^.;\n]{0,60}?((?:[0-9.,]+\s*(?:<=|<|≤)\s*[A-Za-z][\w-]*\s*(?:<=|<|≤)\s*[0-9.,]+)|(?:[A-Za-z][\w-]*\s*(?:<=|>=|<|>|≤|≥)\s*[0-9]+(?:[.,][0-9]+)?)|(?:between\s+[0-9.,]+\s+and\s+[0-9.,]+)|(?:[0-9.,]+\s+to\s+[0-9.,]+))"


def definitions(cells: DataFrame) -> DataFrame:
    """(doc_id, entity, category, band, table_index, row_index): category bands stated by table rows."""
    once = cells.dropDuplicates(["cell_id"]).where("text IS NOT NULL AND trim(text) <> ''")
    labelled = once.withColumn("entity", F.lower(F.regexp_extract("text", f"(?i)({LABELS})", 1))).where("entity <> ''").groupBy("doc_id", "table_index").agg(F.min_by("entity", F.struct("row_index", "col_index")).alias("entity"))
    rows = with_interval(once.join(labelled, ["doc_id", "table_index"]), "text").withColumn("category", F.when((F.col("col_index") == 0) | F.col("text").rlike(r"(?i)\b(?:criticality|priority|category|tier|classification|class)\s+[0-9]"), F.regexp_extract("text", CATEGORY, 1)))
    named = rows.where("category <> '' AND band IS NULL").select("doc_id", "table_index", "row_index", "entity", F.col("col_index").alias("named_col"), "category")
    banded = rows.where("band IS NOT NULL").select("doc_id", "table_index", "row_index", F.col("col_index").alias("band_col"), "band")
    met = named.join(banded, ["doc_id", "table_index", "row_index"]).where("named_col <> band_col").groupBy("doc_id", "table_index", "row_index", "entity", "category").agg(F.min_by("band", "band_col").alias("band"))
    return met.groupBy("doc_id", "entity", "category").agg(F.min_by(F.struct("band", "table_index", "row_index"), F.struct("table_index", "row_index")).alias("d")).select("doc_id", "entity", "category", "d.*")


def claims(items: DataFrame) -> DataFrame:
    """(doc_id, item_id, page_index, entity, category, band, quote): category bands claimed in text."""
    p = F.lit(CLAIM)
    found = items.where(F.col("text").rlike(CLAIM)).withColumn("m", F.explode(F.arrays_zip(F.regexp_extract_all("text", p, 1).alias("e"), F.regexp_extract_all("text", p, 2).alias("c"), F.regexp_extract_all("text", p, 3).alias("b"), F.regexp_extract_all("text", p, 0).alias("q"))))
    found = found.select("doc_id", "item_id", "page_index", F.lower("m.e").alias("entity"), F.col("m.c").alias("category"), F.col("m.b").alias("claimed"), F.col("m.q").alias("quote"))
    return with_interval(found, "claimed").drop("claimed").where("band IS NOT NULL")


def contradictions(cells: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, page_index, entity, category, kind, quote): claims that differ from the definition, and bands claimed for two categories."""
    said, defined = claims(items), definitions(cells).select("doc_id", "entity", "category", F.col("band").alias("defined"))
    wrong = said.join(defined, ["doc_id", "entity", "category"]).where(~same_interval(F.col("band"), F.col("defined"))).select("doc_id", "item_id", "page_index", "entity", "category", F.lit("CATEGORY_BAND_CONTRADICTION").alias("kind"), "quote")
    # one band for two categories: equal bands of an item fall together, so no pair is formed
    same = Window.partitionBy("doc_id", "item_id", "entity", F.round("band.low", 2), F.round("band.high", 2), "band.low_inc", "band.high_inc")
    twice = said.withColumn("least", F.min("category").over(same)).withColumn("most", F.max("category").over(same)).where("least <> most AND category > least").select("doc_id", "item_id", "page_index", "entity", "category", F.lit("DUPLICATE_BAND").alias("kind"), "quote")
    return wrong.unionByName(twice)
