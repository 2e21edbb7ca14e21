"""Totals of tables checked against their operands, exactly and with a dual tolerance.

Cells with spans fill the grid first. Summary rows cut a column into blocks, and subtotals into segments, by a
running count; sums, units and malformed operands are aggregated by block, and a total adds up its blocks. All
of it is keyed by the table, so the cells are moved once, or not at all where they already lie by document.

Defined results: a table of fewer than two rows, or without a summary row, gives nothing; an operand
that is no number gives MALFORMED_ROW for its total; different units give UNIT_MISMATCH; a redelivered
cell counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import DECIMAL, header_unit, neutral, with_decimal

#: Tolerance: share of the stated value in percent, and least amount.
PERCENT, LEAST = 0.5, 1.0
# What summary rows and columns are called.
GRAND, SUB = r"^(?i)\s*GRAND\s+TOTAL\b", r"^(?i)\s*SUB-?TOTAL\b"
TOTAL = r"^(?i)\s*(?:TOTALS?|SUM|SUMMARY|OVERALL\s+TOTAL)\b"
ANY_TOTAL = r"^(?i)\s*(?:GRAND|SUB|TOTAL|SUM|OVERALL)"  # how all of them begin
TOTAL_COLUMN = r"^(?i)\s*(?:GRAND\s+)?(?:TOTALS?|SUM|SUMMARY)\b"
_TABLE = ["doc_id", "table_index"]


def _placed(cells: DataFrame, *more: str) -> DataFrame:
    """The cell that covers a place last, of each place. A redelivered cell is equal to the first one, so it changes nothing here."""
    spread = cells.where("text IS NOT NULL").withColumn("r", F.explode(F.expr("sequence(row_index, row_index + greatest(coalesce(row_span, 1), 1) - 1)"))).withColumn("c", F.explode(F.expr("sequence(col_index, col_index + greatest(coalesce(col_span, 1), 1) - 1)")))
    own = F.max_by(F.struct("cell_id", "text", *more), F.struct("row_index", "col_index", "cell_id"))
    return spread.groupBy(*_TABLE, "r", "c").agg(own.alias("own")).select(*_TABLE, "r", "c", "own.*")


def grid(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, r, c, cell_id, text): each place of the grid with the cell that covers it last."""
    return _placed(cells.dropDuplicates(["cell_id"]))


def judged(delta: str, stated: str) -> str:
    """SQL: status of a difference under the dual tolerance."""
    return f"CASE WHEN {delta} = 0 THEN 'CORRECT' WHEN {delta} <= greatest(abs({stated}) * {PERCENT / 100}, {LEAST}) THEN 'ROUNDING_BOUNDARY' ELSE 'MISMATCH' END"


def column_totals(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, r, c, kind, stated, computed, delta, operands, status) of each total of a column."""
    kind = F.when(~F.col("text").rlike(ANY_TOTAL), None).when(F.col("text").rlike(GRAND), "GRAND_TOTAL").when(F.col("text").rlike(SUB), "SUBTOTAL").when(F.col("text").rlike(TOTAL), "COLUMN_TOTAL")
    labelled = cells.where("text IS NOT NULL AND doc_id IS NOT NULL AND table_index IS NOT NULL").withColumn("label", kind)
    # tables without a summary row leave here; what follows stays where its table is
    kept = labelled.withColumn("any", F.max("label").over(Window.partitionBy(*_TABLE))).where("any IS NOT NULL")
    by_row, by_column = Window.partitionBy(*_TABLE, "r"), Window.partitionBy(*_TABLE, "c").orderBy("r")
    whole, before = by_column.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_column.rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("r") > 0, F.col("label"))
    rows = _placed(kept, "label").withColumn("kind", F.min_by(named, F.when(named.isNotNull(), F.col("c"))).over(by_row)).withColumn("label_col", F.min(F.when(named.isNotNull(), F.col("c"))).over(by_row))
    # a block: the rows of a column behind a summary row, with the next one at its end
    columns = rows.select(
        *_TABLE, "r", "c", "text", "kind", (F.col("kind").isNotNull() & (F.col("c") != F.col("label_col"))).alias("beside"),
        F.max(F.when(F.col("r") == 0, header_unit(F.col("text")))).over(whole).alias("head_unit"), F.count("kind").over(before).alias("block"),
        F.max(F.col("kind").isNotNull() & (F.col("c") != F.col("label_col"))).over(whole).alias("used"),
    ).where("r > 0 AND used")
    body = with_decimal(columns.withColumnRenamed("text", "_text"), "_text").withColumn("own", F.coalesce("unit", "head_unit")).withColumn("blank", neutral(F.col("_text")))
    last, plain = F.col("kind").isNotNull(), F.col("kind").isNull() & ~F.col("blank")
    at_end = lambda column: F.max(F.when(last, column))
    blocks = body.groupBy(*_TABLE, "c", "block").agg(
        at_end(F.col("r")).alias("r"), at_end(F.col("kind")).alias("kind"), at_end(F.col("value")).alias("stated"), at_end(F.col("own")).alias("total_unit"), at_end(F.col("beside")).alias("beside"), at_end(F.col("blank")).alias("blank"),
        F.sum(F.when(plain, F.col("value"))).alias("sum"), F.count_if(plain).alias("n"), F.count_if(plain & F.col("value").isNull()).alias("bad"),
        F.min(F.when(plain, F.coalesce("own", F.lit("")))).alias("low"), F.max(F.when(plain, F.coalesce("own", F.lit("")))).alias("high"),
    ).where("kind IS NOT NULL")
    # a subtotal takes its segment; a grand total takes the subtotals where there are any, else all rows; a total takes all rows
    order = Window.partitionBy(*_TABLE, "c").orderBy("block")
    earlier, sub = order.rowsBetween(Window.unboundedPreceding, -1), (F.col("kind") == "SUBTOTAL") & ~F.col("blank")
    blocks = blocks.withColumn("segment", F.count_if(F.col("kind") == "SUBTOTAL").over(earlier))
    until, segment = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*_TABLE, "c", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    plain_over = lambda w: F.struct(F.sum("sum").over(w).alias("computed"), F.sum("n").over(w).alias("operands"), F.sum("bad").over(w).alias("malformed"), F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"))
    subs = F.struct(
        F.sum(F.when(sub, F.col("stated"))).over(earlier).alias("computed"), F.count_if(sub).over(earlier).alias("operands"), F.count_if(sub & F.col("stated").isNull()).over(earlier).alias("malformed"),
        F.min(F.when(sub, F.coalesce("total_unit", F.lit("")))).over(earlier).alias("low"), F.max(F.when(sub, F.coalesce("total_unit", F.lit("")))).over(earlier).alias("high"),
    )
    taken = F.when(F.col("kind") == "SUBTOTAL", plain_over(segment)).when((F.col("kind") == "GRAND_TOTAL") & (F.col("segment") > 0), subs).otherwise(plain_over(until))
    totals = blocks.withColumn("taken", taken).where("beside AND stated IS NOT NULL AND taken.operands > 0").select(*_TABLE, "r", "c", "kind", "stated", F.col("taken.computed").cast(DECIMAL).alias("computed"), "total_unit", "taken.operands", "taken.malformed", "taken.low", "taken.high")
    out = totals.withColumn("delta", F.expr("abs(computed - stated)"))
    status = F.expr(f"CASE WHEN malformed > 0 THEN 'MALFORMED_ROW' WHEN low <> high OR (total_unit IS NOT NULL AND high <> '' AND total_unit <> high) THEN 'UNIT_MISMATCH' ELSE {judged('delta', 'stated')} END")
    return out.select(*_TABLE, "r", "c", "kind", "stated", "computed", "delta", "operands", status.alias("status"))


def row_totals(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, r, stated, computed, delta, operands, status) where the rightmost column is a total.

    Column 0 may hold text; a row with any other text is left out; at least two operands are needed.
    """
    places = grid(cells)
    last = places.where("r = 0").groupBy(*_TABLE).agg(F.max("c").alias("last_c"), F.max_by("text", "c").alias("head"))
    tables = last.where("last_c >= 2").where(F.col("head").rlike(TOTAL_COLUMN)).select(*_TABLE, "last_c")
    body = places.where("r > 0").join(tables, _TABLE)
    body = with_decimal(body, "text").select(*_TABLE, "r", "c", "last_c", "value", neutral(F.col("text")).alias("blank"))
    is_total, operand = F.col("c") == F.col("last_c"), (F.col("c") < F.col("last_c")) & F.col("value").isNotNull()
    rows = body.groupBy(*_TABLE, "r").agg(
        F.max(F.when(is_total, F.col("value"))).alias("stated"), F.sum(F.when(operand, F.col("value"))).cast(DECIMAL).alias("computed"), F.count_if(operand).alias("operands"),
        F.count_if((F.col("c") > 0) & (F.col("c") < F.col("last_c")) & F.col("value").isNull() & ~F.col("blank")).alias("other"),
    )
    out = rows.where("stated IS NOT NULL AND operands >= 2 AND other = 0").withColumn("delta", F.expr("abs(computed - stated)"))
    return out.select(*_TABLE, "r", "stated", "computed", "delta", "operands", F.expr(judged("delta", "stated")).alias("status"))
