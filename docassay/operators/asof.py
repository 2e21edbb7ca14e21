"""As-of join of items to the last heading at or above them, without ordering a whole document at once.

Three steps keep every ordered group as small as a page or as a document's list of pages: the last
heading of each page, carried to the pages behind it, and the last heading within each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def with_heading(items: DataFrame, out: str = "head") -> DataFrame:
    """Adds struct(item_id, text) of the last heading at or above an item; a heading stands before a text at its place.

    items: doc_id, item_id, seq, text, page_index, y0, is_heading. An item before any heading gets null.
    """
    heading = F.when(F.col("is_heading"), F.struct("item_id", "text"))
    place = F.struct("y0", F.expr("NOT is_heading AS after"), "seq", "item_id")
    pages = items.groupBy("doc_id", "page_index").agg(F.max_by(heading, F.when(F.col("is_heading"), place)).alias("last"))
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.select("doc_id", "page_index", F.last("last", True).over(before).alias("_carried"))
    inside = Window.partitionBy("doc_id", "page_index").orderBy("y0", F.col("is_heading").desc(), "seq", "item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = items.withColumn("_own", F.last(heading, True).over(inside))
    return own.join(carried, ["doc_id", "page_index"], "left").withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_carried")
