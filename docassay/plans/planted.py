"""Operators on documents that are made of the order tables, so that what they must find is known from the orders.

Every order becomes a document; its findings follow from its status, priority, lines and dates by a plain
statement over the order tables, which is the comparison SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import consistency, findings, language, layout, references, scorecard, table_math
from ..sources import guards
from ..sources.tables import table

_BOX = "named_struct('page_index', {page}, 'x0', 50.0D, 'y0', {y}, 'x1', 250.0D, 'y1', {y} + 12, 'page_width', 612.0D, 'page_height', 792.0D)"


def _cells(s: SparkSession, d: str, *, rows: bool) -> DataFrame:
    """One table for each order: a header, its lines, and a column of amounts with a total, or totals at the end of rows.

    Lines and totals are moved to their order once, before they become cells.
    """
    money = lambda name: F.col(name).cast("decimal(18,2)")
    given = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_index"), F.lit(False).alias("total"), money("l_extendedprice").alias("price"), money("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    if not rows:
        stated = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1_000).alias("row_index"), F.lit(True).alias("total"), money("o_totalprice").alias("price"))
        given = given.drop("quantity", "flag").unionByName(stated)
    sums = [F.sum("quantity").alias("quantity"), F.max("flag").alias("flag")] if rows else [F.max("price").alias("stated")]
    # the number of the table is a column: a literal among the keys would hide the order of the rows, and each step would sort again
    lines = given.repartition("doc_id").groupBy("doc_id", "row_index", "total").agg(F.sum("price").alias("price"), F.max(F.lit(0)).alias("table_index"), *sums)
    label = F.concat(F.lit("Line "), F.col("row_index"))
    if rows:
        total = F.expr("quantity + price + CASE flag WHEN 'R' THEN 0.6 WHEN 'A' THEN 0 ELSE quantity + 0.01 * price END")
        parts = [label, F.col("quantity").cast("string"), F.col("price").cast("string"), total.cast("decimal(18,2)").cast("string")]
        head = ["Item", "Quantity", "Price", "Total"]
    else:
        parts, head = [F.when(F.col("total"), "Total").otherwise(label), F.when(F.col("total"), F.col("stated")).otherwise(F.col("price")).cast("string")], ["Item", "Amount"]
    # the first line brings the header
    first = F.min(F.when(~F.col("total"), F.col("row_index"))).over(Window.partitionBy("doc_id")) == F.col("row_index")
    row = lambda index, texts: [F.struct(index.alias("row_index"), F.lit(i).alias("col_index"), text.alias("text")) for i, text in enumerate(texts)]
    own = row(F.col("row_index").cast("int"), parts)
    made = F.when(~F.col("total") & F.col("first"), F.array(*row(F.lit(0), map(F.lit, head)), *own)).otherwise(F.array(*own))
    out = lines.withColumn("first", first).select("doc_id", "table_index", F.explode(made).alias("cell")).select("doc_id", "table_index", "cell.*")
    return out.select(F.expr("doc_id * 100000 + row_index * 10 + col_index").alias("cell_id"), "doc_id", "table_index", "text", "row_index", "col_index", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))


def _spans(s: SparkSession, d: str, text: str, page: str = "0", y: str = "100.0D", first: int = 0) -> DataFrame:
    """A text for each order, as SQL over the orders."""
    return table(s, d, "orders").selectExpr(f"o_orderkey * 10 + {first} AS item_id", "o_orderkey AS doc_id", f"{first} AS seq", f"{text} AS text", f"{_BOX.format(page=page, y=y)} AS bbox")


GRAMMAR = "CASE o_orderstatus WHEN 'F' THEN 'The results was filed.' WHEN 'P' THEN 'A nine-teen mm plate, 12.5 vs 12.6789 mm.' ELSE concat('Checked in the in the hall in 202 ', day(o_orderdate) % 10, ' again.') END"
WORDING = "CASE o_orderstatus WHEN 'F' THEN 'Use sufficient water.' WHEN 'P' THEN 'Plates of 316 and 316L.' ELSE 'Adequate distance as applicable, inspected by the owner.' END"
_SHIFT = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"


def _drift(s: SparkSession, d: str) -> DataFrame:
    """A list of contents whose entry names the chapter of the order, which stands a page later for status F and is missing for P."""
    heads = _spans(s, d, "'Table of Contents'", "0").unionByName(_spans(s, d, "concat(day(o_orderdate), '.1 Chapter ', o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN ' and others' ELSE '' END)", "month(o_orderdate)", first=1)).unionByName(_spans(s, d, "'Annex'", "40", first=2)).withColumn("level", F.lit(1))
    lines = _spans(s, d, f"concat(day(o_orderdate), '.1 Chapter ', o_orderpriority, ' ........ ', day(o_orderdate))", "0", "120.0D", 3).unionByName(_spans(s, d, "concat('Nothing like ', o_custkey, ' ..... iv')", "0", "140.0D", 4))  # noqa: F541
    labels = table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "month(o_orderdate) AS page_index", f"cast(day(o_orderdate) + {_SHIFT} AS string) AS label")
    return references.drift(*references.contents(references.ordered_items(heads.drop("level"), lines), labels)).select("doc_id", "item_id", "tier", "delta", "kind")


def _bands(s: SparkSession, d: str) -> DataFrame:
    """A table that defines a band for the size of an order, and a text that claims another one for status F."""
    orders = table(s, d, "orders")
    parts = F.array(F.lit("Criticality"), F.lit("Range"), F.expr("concat('Criticality ', substr(o_orderpriority, 1, 1))"), F.expr("concat('0 < RUL <= ', month(o_orderdate))"))
    cells = orders.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(parts).alias("k", "text")).selectExpr("doc_id * 10 + k AS cell_id", "doc_id", "0 AS table_index", "text", "cast(k div 2 AS int) AS row_index", "cast(k % 2 AS int) AS col_index", "1 AS row_span", "1 AS col_span")
    said = _spans(s, d, f"concat('For criticality ', substr(o_orderpriority, 1, 1), ' we take 0 < RUL <= ', month(o_orderdate) + {_SHIFT})")
    return consistency.contradictions(cells, references.ordered_items(said.limit(0), said)).select("doc_id", "category", "kind")


def _votes(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    return references.disagreeing(orders.selectExpr("o_custkey AS doc_id", "concat('order ', o_orderkey) AS source", "o_orderkey AS pos", "o_orderstatus AS value"))


def _words(s: SparkSession, d: str) -> DataFrame:
    """Three spans in a line for each order; the last one is near for status F and far for the others."""
    at = lambda n, x0, x1, text: _spans(s, d, text, first=n).selectExpr("item_id", "doc_id", "seq", "text", f"named_struct('page_index', 0, 'x0', {x0}, 'y0', 100.0D + {n}, 'x1', {x1}, 'y1', 112.0D, 'page_width', 612.0D, 'page_height', 792.0D) AS bbox")
    far = table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "CASE WHEN o_orderstatus = 'F' THEN 160.0D ELSE 300.0D END AS far")
    third = at(2, "0.0D", "0.0D", "o_orderpriority").join(far, "doc_id").withColumn("bbox", F.col("bbox").withField("x0", F.col("far")).withField("x1", F.col("far") + 50)).drop("far")
    return at(0, "50.0D", "100.0D", "'order'").unionByName(at(1, "110.0D", "150.0D", "cast(o_orderkey AS string)")).unionByName(third)


def _once(s: SparkSession, d: str) -> DataFrame:
    """Two streams with equal findings: the first one counts."""
    orders = table(s, d, "orders").selectExpr("o_custkey AS doc_id", "o_orderpriority AS kind", "month(o_orderdate) AS page", "o_orderstatus AS message")
    streams = [findings.as_issues(orders.where(w), n, "LAYOUT", F.col("kind"), F.col("page"), F.col("message")) for n, w in ((1, "message = 'F'"), (2, "message <> 'P'"))]
    return findings.merged(*streams).select("doc_id", F.col("type"), "page_number", "message", "stream")


_HEADS = {1: "'Methodology'", 2: "CASE WHEN o_orderstatus = 'F' THEN 'Executive summary' ELSE 'Annex' END"}


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Three items for each order: one on its method, one on its summary, one on references; the last doesn't apply to status P."""
    return table(s, d, "orders").selectExpr("o_orderkey AS doc_id", "explode(array(named_struct('grp', 'I', 'item', 'logical_approach', 'score', 1 + day(o_orderdate) % 5), named_struct('grp', 'I', 'item', 'interesting', 'score', 3), named_struct('grp', 'II', 'item', 'work_referenced', 'score', CASE WHEN o_orderstatus <> 'P' THEN 2 END))) AS s").select("doc_id", "s.*")


def _notes(s: SparkSession, d: str) -> DataFrame:
    heads = _spans(s, d, _HEADS[1], y="100.0D", first=1).unionByName(_spans(s, d, _HEADS[2], "1", "100.0D", 2))
    texts = _spans(s, d, "concat('Steps of ', o_orderkey)", y="120.0D", first=3).unionByName(_spans(s, d, "concat('In short ', o_orderpriority)", "1", "120.0D", 4))
    return scorecard.notes(_scores(s, d), scorecard.evidence(references.ordered_items(heads, texts))).select("doc_id", "item", "note")


def _rework(s: SparkSession, d: str) -> DataFrame:
    low = _scores(s, d).where("score <= 2")
    return findings.as_issues(low, 13, "SCORECARD", F.lit("REWORK_ITEM"), F.lit(None).cast("int"), F.concat_ws(" ", "grp", "item", "score")).select("doc_id", "type", "severity", "message")


def _band_issues(s: SparkSession, d: str) -> DataFrame:
    return findings.as_issues(_bands(s, d), 12, "TRACEABILITY", F.col("kind"), F.lit(0), F.col("category")).select("doc_id", "type", "severity", "page_number", "message")


def queries() -> dict:
    return {
        "src3_table_guards": lambda s, d: guards.guarded(table(s, d, "cells")),
        "src3_order_guards": lambda s, d: guards.guarded(_cells(s, d, rows=False).withColumn("bbox", F.struct(F.lit(0).alias("page_index")))).select("doc_id", "cells", "rows", "warnings"),
        "prj12_order_rework": _rework,
        "prj13_order_bands": _band_issues,
        "txt23_order_notes": _notes,
        "txt1_order_totals": lambda s, d: table_math.column_totals(_cells(s, d, rows=False)).select("doc_id", "kind", F.col("stated").cast("double").alias("stated"), F.col("computed").cast("double").alias("computed"), "operands", "status"),
        "txt2_line_totals": lambda s, d: table_math.row_totals(_cells(s, d, rows=True)).select("doc_id", "r", F.col("delta").cast("double").alias("delta"), "operands", "status"),
        "txt3_grid_of_spans": lambda s, d: table_math.grid(table(s, d, "cells")).select("doc_id", "table_index", "r", "c", "cell_id"),
        "txt4_order_contents": _drift,
        "txt8_order_grammar": lambda s, d: language.grammar(_spans(s, d, GRAMMAR)).select("doc_id", "rule_id", "type", "original", "suggestion"),
        "txt9_order_endings": lambda s, d: language.unclosed(references.ordered_items(_spans(s, d, "CASE WHEN o_orderpriority < '3' THEN 'Conclusions' ELSE 'Annex' END", y="90.0D"), _spans(s, d, "concat('The order ', o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' is due by' WHEN 'P' THEN ' is closed.' ELSE ' is open' END)", first=1))).select("doc_id", "text"),
        "txt11_order_wording": lambda s, d: language.ambiguity(_spans(s, d, WORDING)).select("doc_id", "rule_id", "type", "original"),
        "txt12_order_bands": _bands,
        "txt13_order_breaks": lambda s, d: layout.page_breaks(references.ordered_items(_spans(s, d, "''").limit(0), _spans(s, d, "concat('The order stands ', CASE o_orderstatus WHEN 'F' THEN 'nor' WHEN 'P' THEN 'here:' ELSE o_orderpriority END)", y="700.0D").unionByName(_spans(s, d, "CASE WHEN o_orderpriority < '3' THEN 'goes on here.' ELSE 'Begins.' END", "1", first=1)))).select("doc_id", "page_index", "next_page", "reason"),
        "txt14_order_styles": lambda s, d: layout.misused_styles(_spans(s, d, "concat(CASE o_orderstatus WHEN 'F' THEN 'Based on order ' WHEN 'P' THEN 'As shown in order ' ELSE 'Order ' END, o_orderkey)").withColumn("level", F.lit(2))).select("doc_id", "text"),
        "src5_order_labels": lambda s, d: layout.printed_label(_spans(s, d, "concat('Page ', day(o_orderdate), ' of 31')", "month(o_orderdate)", "CASE WHEN o_orderstatus = 'F' THEN 300.0D ELSE 760.0D END").select("doc_id", "item_id", "seq", "text", "bbox.*")),
        "agg11_order_votes": _votes,
        "win5_merged_streams": _once,
        "win12_joined_lines": lambda s, d: language.lines(_words(s, d)).select("doc_id", "text", "x0", "x1"),
        "agg20_order_averages": lambda s, d: scorecard.averages(table(s, d, "orders").selectExpr("o_custkey AS doc_id", "o_orderpriority AS grp", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1 + day(o_orderdate) % 5 END AS score")),
    }


_LINES = "(SELECT l_orderkey, l_linenumber, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS price, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS quantity, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"
_JUDGED = "CASE WHEN delta = 0 THEN 'CORRECT' WHEN delta <= greatest(abs(stated) * 0.005, 1) THEN 'ROUNDING_BOUNDARY' ELSE 'MISMATCH' END"
O = {
    "src3_table_guards": """WITH t AS (SELECT doc_id, table_index, coalesce(min(page), 0) AS page_index, count(*) AS cells, max(row_index + greatest(coalesce(row_span, 1), 1)) AS rows, max(col_index + greatest(coalesce(col_span, 1), 1)) AS columns
          FROM (SELECT cell_id, any_value(doc_id) AS doc_id, any_value(table_index) AS table_index, any_value(row_index) AS row_index, any_value(col_index) AS col_index, any_value(row_span) AS row_span, any_value(col_span) AS col_span, any_value(bbox.page_index) AS page FROM cells GROUP BY cell_id) c GROUP BY doc_id, table_index),
        w AS (SELECT t.*, (SELECT count(*) FROM t o WHERE o.doc_id = t.doc_id AND o.page_index = t.page_index AND o.table_index <= t.table_index) AS nth FROM t),
        x AS (SELECT doc_id, table_index, page_index, cells, rows, columns, concat_ws(',', CASE WHEN nth > 20 THEN 'TOO_MANY_TABLES' END, CASE WHEN cells > 500 THEN 'TOO_MANY_CELLS' END, CASE WHEN rows > 100 THEN 'TOO_MANY_ROWS' END, CASE WHEN columns > 30 THEN 'TOO_MANY_COLUMNS' END) AS warnings FROM w)
        SELECT *, warnings = '' AS kept FROM x""",
    "src3_order_guards": "SELECT o.k AS doc_id, 2 * o.n + 2 * coalesce(l.n, 0) + CASE WHEN l.n > 0 THEN 2 ELSE 0 END AS cells, CASE WHEN o.n > 0 THEN 1001 ELSE 1 + l.top END AS rows, CASE WHEN o.n > 0 THEN 'TOO_MANY_ROWS' ELSE '' END AS warnings FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY ALL) o LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY ALL) l ON l.k = o.k",
    "prj12_order_rework": "SELECT o_orderkey AS doc_id, 'REWORK_ITEM' AS type, 'MAJOR' AS severity, 'I logical_approach ' || (1 + day(o_orderdate) % 5) AS message FROM orders WHERE day(o_orderdate) % 5 < 2 UNION ALL SELECT o_orderkey, 'REWORK_ITEM', 'MAJOR', 'II work_referenced 2' FROM orders WHERE o_orderstatus <> 'P'",
    "prj13_order_bands": "SELECT o_orderkey AS doc_id, 'CATEGORY_BAND_CONTRADICTION' AS type, 'BLOCKER' AS severity, 1 AS page_number, substr(o_orderpriority, 1, 1) AS message FROM orders WHERE o_orderstatus = 'F'",
    "txt23_order_notes": """SELECT o_orderkey AS doc_id, 'logical_approach' AS item, 'logical_approach: ' || (1 + day(o_orderdate) % 5) || '/5. Source section “Methodology”, PDF page 1. Evidence: “Steps of ' || o_orderkey || '”' AS note FROM orders
        UNION ALL SELECT o_orderkey, 'interesting', 'interesting: 3/5. ' || CASE o_orderstatus WHEN 'F' THEN 'Source section “Executive summary”, PDF page 2. Evidence: “In short ' || o_orderpriority || '”' ELSE 'The document did not yield a matching section heading and text excerpt for this item; manual review is needed.' END FROM orders
        UNION ALL SELECT o_orderkey, 'work_referenced', 'work_referenced: 2/5. No references or bibliography section was detected in the extracted document headings/text.' FROM orders WHERE o_orderstatus <> 'P'""",
    "txt1_order_totals": f"""SELECT o_orderkey AS doc_id, 'COLUMN_TOTAL' AS kind, CAST(stated AS DOUBLE) AS stated, CAST(computed AS DOUBLE) AS computed, operands, {_JUDGED} AS status FROM (
        SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS stated, sum(price) AS computed, count(*) AS operands, abs(sum(price) - CAST(any_value(o_totalprice) AS DECIMAL(18, 2))) AS delta
        FROM orders JOIN {_LINES} l ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice) t""",
    "txt2_line_totals": f"""SELECT l_orderkey AS doc_id, l_linenumber AS r, CAST(delta AS DOUBLE) AS delta, 2 AS operands, {_JUDGED} AS status FROM (
        SELECT *, abs(stated - quantity - price) AS delta FROM (SELECT *, CAST(quantity + price + CASE flag WHEN 'R' THEN 0.6 WHEN 'A' THEN 0 ELSE quantity + 0.01 * price END AS DECIMAL(18, 2)) AS stated FROM {_LINES} l) t) u""",
    "txt3_grid_of_spans": """SELECT doc_id, table_index, r, c, max_by(cell_id, row_index * 100000000 + col_index * 100000 + cell_id % 100000) AS cell_id FROM (
        SELECT *, unnest(range(col_index, col_index + greatest(coalesce(col_span, 1), 1))) AS c FROM (SELECT *, unnest(range(row_index, row_index + greatest(coalesce(row_span, 1), 1))) AS r FROM {CELLS} x WHERE text IS NOT NULL) a) b GROUP BY ALL""",
    "txt4_order_contents": """SELECT o_orderkey AS doc_id, o_orderkey * 10 + 3 AS item_id, CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS delta, CASE o_orderstatus WHEN 'F' THEN 'PAGE_DRIFT' ELSE 'OK' END AS kind FROM orders
        UNION ALL SELECT o_orderkey, o_orderkey * 10 + 4, NULL, 0, 'TARGET_NOT_FOUND' FROM orders""",
    "txt8_order_grammar": """SELECT o_orderkey AS doc_id, rule_id, type, original, suggestion FROM orders JOIN (VALUES
        ('F', 'RULE_GRAMMAR_AGREEMENT', 'grammar_error', 'results was', 'results were'), ('P', 'RULE_GRAMMAR_SPLIT_WORD', 'spelling_split', 'nine-teen', 'nineteen'), ('P', 'RULE_SIGFIG_INCONSISTENCY', 'sigfig_inconsistency', '12.5 vs 12.6789', NULL),
        ('O', 'RULE_GRAMMAR_REPEATED_PHRASE', 'repeated_phrase', 'in the in the', 'in the')) AS v(status, rule_id, type, original, suggestion) ON status = o_orderstatus
        UNION ALL SELECT o_orderkey, 'RULE_GRAMMAR_SPLIT_YEAR', 'spelling_split', '202 ' || day(o_orderdate) % 10, '202' || day(o_orderdate) % 10 FROM orders WHERE o_orderstatus = 'O'""",
    "txt9_order_endings": "SELECT o_orderkey AS doc_id, 'The order ' || o_orderkey || ' is due by' AS text FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '3'",
    "txt11_order_wording": """SELECT o_orderkey AS doc_id, rule_id, type, original FROM orders JOIN (VALUES
        ('F', 'VAGUE_SUFFICIENT', 'vague_directive', 'sufficient water'), ('P', 'MIXED_GRADE', 'material_grade', ' 316'), ('P', 'MIXED_GRADE', 'material_grade', ' 316L'),
        ('O', 'VAGUE_ADEQUATE', 'vague_directive', 'Adequate distance'), ('O', 'VAGUE_AS_APPROPRIATE', 'vague_directive', 'as applicable')) AS v(status, rule_id, type, original) ON status = o_orderstatus""",
    "txt12_order_bands": "SELECT o_orderkey AS doc_id, substr(o_orderpriority, 1, 1) AS category, 'CATEGORY_BAND_CONTRADICTION' AS kind FROM orders WHERE o_orderstatus = 'F'",
    "txt13_order_breaks": "SELECT o_orderkey AS doc_id, 0 AS page_index, 1 AS next_page, CASE o_orderstatus WHEN 'F' THEN 'conjunction' ELSE 'continues' END AS reason FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_orderpriority < '3'",
    "txt14_order_styles": "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'Based on order ' ELSE 'As shown in order ' END || o_orderkey AS text FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "src5_order_labels": "SELECT o_orderkey AS doc_id, CAST(month(o_orderdate) AS INT) AS page_index, CAST(day(o_orderdate) AS VARCHAR) AS label FROM orders WHERE o_orderstatus <> 'F'",
    "agg11_order_votes": """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS votes, min(o_orderkey) AS first FROM orders GROUP BY ALL),
        t AS (SELECT o_custkey, arg_max(o_orderstatus, votes * 1000000000 - first) AS top_value, max(votes) AS top FROM c GROUP BY o_custkey HAVING count(*) > 1)
        SELECT o.o_custkey AS doc_id, 'order ' || o_orderkey AS source, o_orderstatus AS value FROM orders o JOIN t ON t.o_custkey = o.o_custkey WHERE top = 1 OR o_orderstatus <> top_value""",
    "win5_merged_streams": "SELECT DISTINCT o_custkey AS doc_id, o_orderpriority AS type, CAST(month(o_orderdate) + 1 AS INT) AS page_number, o_orderstatus AS message, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS stream FROM orders WHERE o_orderstatus <> 'P'",
    "win12_joined_lines": "SELECT o_orderkey AS doc_id, 'order ' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN ' ' || o_orderpriority ELSE '' END AS text, 50.0 AS x0, CASE o_orderstatus WHEN 'F' THEN 210.0 ELSE 150.0 END AS x1 FROM orders",
    "agg20_order_averages": """WITH v AS (SELECT o_custkey AS doc_id, o_orderpriority AS grp, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1 + day(o_orderdate) % 5 END AS score FROM orders)
        SELECT doc_id, coalesce(grp, 'ALL') AS grp, round(avg(score), 2) AS average, count(CASE WHEN score <= 2 THEN 1 END) AS rework FROM v GROUP BY GROUPING SETS ((doc_id, grp), (doc_id))""",
}


def oracle_sql() -> dict[str, str]:
    from .portable import filled

    return {name: filled(sql) for name, sql in O.items()}
