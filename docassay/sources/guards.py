"""Guards of a scan: tables too large or too many to be read, each with a warning, none dropped silently.

Defined results: a table at a bound passes; a table without any cell with a place counts as page 0;
a redelivered cell counts once; no cells give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Most tables of a page, cells, rows and columns of a table.
TABLES, CELLS, ROWS, COLUMNS = 20, 500, 100, 30


def guarded(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, page_index, cells, rows, columns, warnings, kept) of each table."""
    once = cells.dropDuplicates(["cell_id"])
    sizes = once.groupBy("doc_id", "table_index").agg(
        F.coalesce(F.min("bbox.page_index"), F.lit(0)).alias("page_index"), F.count("*").alias("cells"),
        F.max(F.col("row_index") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1))).alias("rows"), F.max(F.col("col_index") + F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1))).alias("columns"),
    )
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("table_index"))
    checks = [("TOO_MANY_TABLES", nth > TABLES), ("TOO_MANY_CELLS", F.col("cells") > CELLS), ("TOO_MANY_ROWS", F.col("rows") > ROWS), ("TOO_MANY_COLUMNS", F.col("columns") > COLUMNS)]
    found = sizes.withColumn("warnings", F.array_join(F.array_compact(F.array(*[F.when(c, name) for name, c in checks])), ","))
    return found.withColumn("kept", F.col("warnings") == "")
