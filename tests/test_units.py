"""Quantities: number notations, units in and around cells, pairs against brute force."""

import itertools

import pytest
from pyspark.sql import Row

from docassay.operators import units

CELLS = "cell_id long, doc_id long, table_index int, text string, row_index int, col_index int, row_span int, col_span int, extra string"
TARGETS = [("Design pressure", "kPa"), ("Tan length", "m"), ("Motor power", "kW"), ("Ratio", "1"), ("Design temperature", "K")]


def tables(spark, columns, title="Equipment list 1", unit_row=None, doc=1, first=1):
    """Cells of one table: columns maps a header to the texts below it."""
    n = len(next(iter(columns.values())))
    rows, k = [], itertools.count(first)
    rows.append((next(k), doc, 0, title, 0, 0, 1, len(columns) + 1, "x"))
    rows.append((next(k), doc, 0, "Tag", 1, 0, 1, 1, "x"))
    rows += [(next(k), doc, 0, h, 1, c, 1, 1, "x") for c, h in enumerate(columns, 1)]
    start = 2
    if unit_row:
        rows.append((next(k), doc, 0, "", 2, 0, 1, 1, "x"))
        rows += [(next(k), doc, 0, u, 2, c, 1, 1, "x") for c, u in enumerate(unit_row, 1)]
        start = 3
    for i in range(n):
        rows.append((next(k), doc, 0, f"P-{i}", start + i, 0, 1, 1, "x"))
        rows += [(next(k), doc, 0, texts[i], start + i, c, 1, 1, "x") for c, texts in enumerate(columns.values(), 1)]
    return rows


def values(spark, rows):
    got = units.cell_values(spark, spark.createDataFrame(rows, CELLS), spark.createDataFrame(TARGETS, "quantity string, common_unit string")).collect()
    return {(r.tag, r.quantity): r.value for r in got}


def test_number_notations(spark):
    texts = ["1,234.56", "1.234,56", "1 234,56", "12,5", "1,234", "10'728", "4,616,062", "3.5e2", "1.2 x 10^3", "5.0E+01", "(7.5)", "-3", "−4", "1.234.567", "0.5"]
    want = [1234.56, 1234.56, 1234.56, 12.5, 1234, 10728, 4616062, 350, 1200, 50, -7.5, -3, -4, 1234567, 0.5]
    got = values(spark, tables(spark, {"Design pressure (kPa)": texts}))
    for i, w in enumerate(want):
        assert got[f"P-{i}", "Design pressure"] == pytest.approx(w), texts[i]


def test_units_in_and_around(spark):
    rows = tables(spark, {"Design pressure": ["2 bar", "0.5", "14,5 psi"], "TAN LENGTH, ft": ["3' 6\"", "10", "148'-5 1/2\""], "Motor power": ["5", "hp 2", "1 W"]}, title="List; motor power in x100 W", unit_row=["MPa", "-", "-"])
    got = values(spark, rows)
    assert got["P-0", "Design pressure"] == pytest.approx(200)
    assert got["P-1", "Design pressure"] == pytest.approx(500)
    assert got["P-2", "Design pressure"] == pytest.approx(14.5 * 6.894757293168361)
    assert got["P-0", "Tan length"] == pytest.approx(3.5 * 0.3048)
    assert got["P-1", "Tan length"] == pytest.approx(3.048)
    assert got["P-2", "Tan length"] == pytest.approx((148 + 5.5 / 12) * 0.3048)
    assert got["P-0", "Motor power"] == pytest.approx(0.5)
    assert got["P-1", "Motor power"] == pytest.approx(2 * 0.745699872)
    assert got["P-2", "Motor power"] == pytest.approx(0.001)


def test_temperature_offset(spark):
    got = values(spark, tables(spark, {"Design temperature": ["100 °C", "212 deg F", "373.15 K", "-40 degF"]}))
    assert [round(got[f"P-{i}", "Design temperature"], 6) for i in range(4)] == [373.15, 373.15, 373.15, 233.15]


def test_neutral_null_and_foreign_units(spark):
    got = values(spark, tables(spark, {"Design pressure (bar)": ["-", "TBD", "", None, "see note", "5 mm", "3"], "Remarks": ["2 off"] * 7}))
    assert got == {("P-5", "Design pressure"): None, ("P-6", "Design pressure"): pytest.approx(300)}


def test_pairs_against_brute_force(spark):
    pressures = ["2 bar", "200 kPa", "0.2 MPa", "29.0075 psi", "2.009 bar", "2.02 bar", "0", "0 bar", "-2 bar"]
    rows = []
    for i, p in enumerate(pressures):
        made = tables(spark, {"Design pressure (kPa)": [p]}, doc=i + 1, first=1 + 10 * i)
        rows += made + made[-1:]  # the last cell comes twice
    cells = spark.createDataFrame(rows, CELLS)
    targets = spark.createDataFrame(TARGETS, "quantity string, common_unit string")
    v = {r.cell_id: r.value for r in units.cell_values(spark, cells, targets).collect()}
    assert len(v) == len(pressures)
    want = {(a, b) for a in v for b in v if a < b and abs(v[a] - v[b]) <= 0.005 * max(abs(v[a]), abs(v[b])) * (1 + 1e-9)}
    got = units.equal_quantities(spark, cells, spark.createDataFrame([], RULES), targets).collect()
    assert sorted((r.key_a, r.key_b) for r in got) == sorted(want) and len(want) > 5


RULES = "rule_no long, kind string, title string, message_template string, recommendation_template string, numeric_limit_params struct<parameter_name:string,pattern:string,operator:string,limit_value:double,tolerance:double,context_pattern:string>"


def test_rule_units_from_text(spark):
    def rule(n, value, title="Limit", message="over {limit} of x", advice="to {limit} or", pattern="a ([0-9]+)", name="Shell design pressure"):
        return n, "numeric_limit", title, message, advice, Row(parameter_name=name, pattern=pattern, operator="LE", limit_value=value, tolerance=0.0, context_pattern=None)

    rules = spark.createDataFrame([
        rule(1, 2.0, title="Limit for shell (bar)"), rule(2, 0.2, message="over {limit} MPa of {standard}"), rule(3, 200.0, advice="Bring to {limit} kPa or justify."), rule(4, 29.0075, pattern=r"a\s*([0-9]+)\s*psi"),
        rule(5, 9.0), rule(6, 50.0, message="over {limit}% of x", name="Shell joint ratio"), rule(7, 0.5, name="Shell joint ratio"), rule(8, None, title="(bar)"),
    ], RULES)
    targets = spark.createDataFrame(TARGETS, "quantity string, common_unit string")
    got = {r.rule_no: r.value for r in units.rule_values(spark, rules, targets).collect()}
    assert got == {1: pytest.approx(200), 2: pytest.approx(200), 3: pytest.approx(200), 4: pytest.approx(200, rel=1e-4), 6: pytest.approx(0.5), 7: pytest.approx(0.5)}
    pairs = {(r.key_a, r.key_b) for r in units.equal_quantities(spark, spark.createDataFrame([], CELLS), rules, targets).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)}


def test_empty_tables(spark):
    targets = spark.createDataFrame([], "quantity string, common_unit string")
    assert units.equal_quantities(spark, spark.createDataFrame([], CELLS), spark.createDataFrame([], RULES), targets).count() == 0


def test_source_defaults(spark):
    """A unit of the source counts where neither the cell nor what stands around it names one."""
    grid = [["Tag", "Design pressure"], ["V-1", "12"], ["V-2", "1.2 MPa"], ["V-3", "soft"], ["V-4", "5 furlong"]]
    rows = [(d * 100 + r * 10 + c, d, 0, t, r, c, 1, 1) for d in (1, 2) for r, line in enumerate(grid) for c, t in enumerate(line)]
    cells = spark.createDataFrame(rows, "cell_id long, doc_id long, table_index int, text string, row_index int, col_index int, row_span int, col_span int")
    targets = spark.createDataFrame([("Design pressure", "bar")], "quantity string, common_unit string")
    defaults = spark.createDataFrame([(1, "Design pressure", "bar"), (1, "Design pressure", "bar")], "doc_id long, quantity string, unit string")
    got = {(r.doc_id, r.tag): (r.value and round(r.value, 6), r.unit_from) for r in units.cell_values(spark, cells, targets, defaults).collect()}
    assert got == {(1, "V-1"): (12.0, "SOURCE"), (2, "V-1"): (None, None), (1, "V-2"): (12.0, "CELL"), (2, "V-2"): (12.0, "CELL"), (1, "V-4"): (None, "CELL"), (2, "V-4"): (None, "CELL")}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("docassay_")]
