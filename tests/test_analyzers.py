"""Analyzers on small constructed records, against expected findings or brute force."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docassay.functions import numbers
from docassay.operators import consistency, duplicates, findings, geometry, language, layout, references, rules, scorecard, table_math

BOX = "struct<page_index:int,x0:double,y0:double,x1:double,y1:double,page_width:double,page_height:double>"
SPAN = f"item_id long, doc_id long, seq int, text string, bbox {BOX}, clash string"
HEAD = f"item_id long, doc_id long, seq int, text string, level int, bbox {BOX}"
CELL = "cell_id long, doc_id long, table_index int, text string, row_index int, col_index int, row_span int, col_span int"


def box(page=0, y=100.0, x=50.0):
    x, y = float(x), float(y)
    return Row(page_index=page, x0=x, y0=y, x1=x + 200, y1=y + 12, page_width=612.0, page_height=792.0)


def spans(spark, rows):
    return spark.createDataFrame([(i, *r[:1], i, r[1], box(*r[2:]), "c") for i, r in enumerate(rows)], SPAN)


def heads(spark, rows, first=1000):
    return spark.createDataFrame([(first + i, r[0], i, r[1], r[2], box(*r[3:])) for i, r in enumerate(rows)], HEAD)


def cells(spark, *grids):
    rows, k = [], itertools.count()
    for t, grid in enumerate(grids):
        rows += [(next(k), 1, t, text, r, c, 1, 1) for r, line in enumerate(grid) for c, text in enumerate(line) if text is not ...]
    return spark.createDataFrame(rows, CELL)


# ---- numbers ------------------------------------------------------------------------------------


def test_decimals(spark):
    cases = [("8,071.25", "8071.25", None), ("8.071,25", "8071.25", None), ("8 071,25", "8071.25", None), ("0,75", "0.75", None), ("(3,400.50)", "-3400.5", None), ("$2,750.10", "2750.1", "$"), ("42.7 MPa", "42.7", "MPa"), ("3.25%", "3.25", "%"), ("(18.4 kg)", "-18.4", "kg"), ("6,000", "6000", None), ("3 lbs", "3", "lb"), ("+7", "7", None), ("1\u00a0457", "1457", None), ("1035,3\u00a0cm", "1035.3", "cm"), ("２，５％", "2.5", "%"), ("4.000.000", "4000000", None), ("Rp 5", "5", "Rp")]
    nothing = ["", " ", "-", "--", "n/a", "tbd", "V-2041-B", "line 6-P-1203", "see 4.2", "weld W12/W13", "approved", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([c[0] for c in cases] + nothing)], "i int, t string")
    got = {r.i: r for r in numbers.with_decimal(df, "t").collect()}
    for i, (text, value, unit) in enumerate(cases):
        assert got[i].value == Decimal(value) and got[i].unit == unit, text
    assert all(got[len(cases) + i].value is None for i in range(len(nothing)))
    assert numbers.with_decimal(df.where("t = '6,000'"), "t", "de").first().value == 6
    assert all(r.value == Decimal(r.i) / 100 for r in numbers.with_decimal(spark.range(1, 100).selectExpr("id AS i", "format_string('%.2f', id / 100D) AS t"), "t").collect())


def test_romans_against_counting(spark):
    def roman(n):
        out = ""
        for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            while n >= v:
                out, n = out + s, n - v
        return out

    df = spark.createDataFrame([(n, roman(n)) for n in range(1, 4000)] + [(None, t) for t in ("iiii", "vx", "abc", "", "ic")], "n int, t string")
    assert df.withColumn("v", numbers.roman(F.col("t"))).where("NOT (v <=> n)").count() == 0


def test_intervals(spark):
    cases = [("0 < RUL <= 6", (0, 6, False, True)), ("RUL > 14", (14, None, False, True)), ("0 to 6 years", (0, 6, True, True)), ("between 6 and 14 years", (6, 14, True, True)), ("greater than 14 yrs", (14, None, False, True)), ("less than or equal to 0", (None, 0, True, True)), ("5 < X", (5, None, False, True)), ("X ≤ 2,5", (None, 2.5, True, True)), ("0 < RUL 2026 ≤ 6 yr", (0, 6, False, True)), ("good", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in numbers.with_interval(df, "t").collect():
        assert (tuple(r.band) if r.band else None) == cases[r.i][1], r.t


# ---- tables -------------------------------------------------------------------------------------


def test_column_totals(spark):
    good = [["Item", "Weight (kg)"], ["A", "10.50"], ["B", "20.25"], ["C", "30.25"], ["Total", "61.00"]]
    near = [["Item", "W"], ["A", "100"], ["B", "200"], ["Total", "300.9"]]
    wrong = [["Item", "W"], ["A", "100"], ["B", "200"], ["Total", "310"]]
    sub = [["Item", "W"], ["A", "1"], ["B", "2"], ["Subtotal", "3"], ["C", "4"], ["D", "-"], ["Sub-total", "4"], ["Grand Total", "7"]]
    units = [["Item", "W"], ["A", "1 kg"], ["B", "2 mm"], ["Total", "3"]]
    bad = [["Item", "W"], ["A", "1"], ["B", "see note"], ["Total", "1"]]
    plain = [["Item", "W"], ["A", "1"]]
    got = {(r.table_index, r.kind, r.r): r for r in table_math.column_totals(cells(spark, good, near, wrong, sub, units, bad, plain)).collect()}
    status = {k: r.status for k, r in got.items()}
    assert status == {(0, "COLUMN_TOTAL", 4): "CORRECT", (1, "COLUMN_TOTAL", 3): "ROUNDING_BOUNDARY", (2, "COLUMN_TOTAL", 3): "MISMATCH", (3, "SUBTOTAL", 3): "CORRECT", (3, "SUBTOTAL", 6): "CORRECT", (3, "GRAND_TOTAL", 7): "CORRECT", (4, "COLUMN_TOTAL", 3): "UNIT_MISMATCH", (5, "COLUMN_TOTAL", 3): "MALFORMED_ROW"}
    assert got[0, "COLUMN_TOTAL", 4].computed == Decimal("61") and got[2, "COLUMN_TOTAL", 3].delta == 10


def test_column_totals_move_the_cells_once(spark):
    """Disk: one exchange of the cells, none where they already lie by document; redelivered cells and blocks count as before."""
    from docassay.plans import planted

    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    grid = [["Item", "Mass (kg)"], ["a", "1"], ["b", "-"], ["Subtotal", "1"], ["c", "2"], ["d", "3"], ["Subtotal", "5"], ["Total", "6"], ["Grand total", "6"]]
    made = cells(spark, grid)
    twice = table_math.column_totals(made.unionByName(made))
    assert moved(twice) == 1
    assert [(r.kind, r.computed, r.operands, r.status) for r in twice.orderBy("r").collect()] == [("SUBTOTAL", 1, 1, "CORRECT"), ("SUBTOTAL", 5, 2, "CORRECT"), ("COLUMN_TOTAL", 6, 3, "CORRECT"), ("GRAND_TOTAL", 6, 2, "CORRECT")]
    assert moved(planted.queries()["txt1_order_totals"](spark, "/root/testdata/sf0.001")) == 1


def test_row_totals_and_spans(spark):
    rows = [["Item", "Q1", "Q2", "Total"], ["A", "1", "2", "3"], ["B", "5", "5", "12"], ["C", "x", "5", "5"], ["D", "1", "-", "1"]]
    got = {r.r: r.status for r in table_math.row_totals(cells(spark, rows)).collect()}
    assert got == {1: "CORRECT", 2: "MISMATCH"}
    merged = spark.createDataFrame([(1, 1, 0, "a", 0, 0, 2, 2), (2, 1, 0, "b", 1, 1, 1, 1)], CELL)
    assert {(r.r, r.c): r.text for r in table_math.grid(merged).collect()} == {(0, 0): "a", (0, 1): "a", (1, 0): "a", (1, 1): "b"}
    assert table_math.column_totals(merged.limit(0)).count() == 0


# ---- references ---------------------------------------------------------------------------------


def test_standards(spark):
    body = spans(spark, [(1, "Forgings to ASTM A182-2018 and API STD 620-2018.", 0, 10), (1, "See API 9999 and ISO 9001.", 0, 20), (2, "No standard here.", 0, 10)])
    refs = heads(spark, [(1, "References", 1, 3, 10)]).unionByName(heads(spark, [(1, "ASTM A182:2018", 2, 3, 20), (1, "API STD 620-2008", 2, 3, 30)], 2000))
    items = references.ordered_items(refs, body)
    got = {(r.kind, r.code, r.year) for r in references.traceability(items).collect()}
    assert got == {("EDITION_YEAR_MISMATCH", "API STD 620", 2018), ("AMBIGUOUS_CITATION", "API 9999", None), ("STANDARD_NOT_IN_BIBLIOGRAPHY", "ISO 9001", None)}
    assert {r.kind for r in references.traceability(items, include_missing=False).collect()} == {"EDITION_YEAR_MISMATCH", "AMBIGUOUS_CITATION"}


def test_drift_tiers(spark):
    entries = spark.createDataFrame([(1, i, t, p) for i, (t, p) in enumerate([("scope", "1"), ("scope of work", "2"), ("2.1 limits", "iv"), ("missing", "3"), ("twice", "5")])], "doc_id long, item_id long, title string, label string")
    targets = spark.createDataFrame([(1, i, t, p, l) for i, (t, p, l) in enumerate([("scope", 0, "1"), ("scope of work and terms", 3, "4"), ("2.1 boundaries", 4, "5"), ("twice", 5, "5"), ("twice", 6, "6"), ("scope", 9, "10")])], "doc_id long, seq int, title string, page_index int, page_label string")
    got = {r.title: (r.tier, r.delta, r.kind) for r in references.drift(entries, targets).collect()}
    assert got["2.1 limits"] == (3, 1, "PAGE_DRIFT") and got["missing"] == (None, 0, "TARGET_NOT_FOUND") and got["twice"] == (1, 0, "DUPLICATE_TARGET")
    assert got["scope"][2] == "DUPLICATE_TARGET" and got["scope of work"][0] == 2


def test_revisions(spark):
    meta = spark.createDataFrame([(1, "a_RevB.pdf", Row(revision="Rev B")), (2, "a_RevB.pdf", Row(revision="C")), (3, "plain.pdf", Row(revision="C")), (4, "x_Rev02.pdf", Row(revision="Rev 2"))], "doc_id long, original_filename string, cover_metadata struct<revision:string>")
    cover = spans(spark, [(1, "Revision", 0, 10), (1, "No. D", 0, 20), (2, "text", 0, 10)])
    table = spark.createDataFrame([(1, 2, 0, "Rev", 0, 0, 1, 1), (2, 2, 0, "A", 1, 0, 1, 1), (3, 2, 0, "B", 2, 0, 1, 1)], CELL)
    sources = references.revision_sources(meta, cover, heads(spark, [(9, "x", 1)]), table)
    got = {(r.doc_id, r.source): r.value for r in sources.collect()}
    assert got[1, "FILENAME"] == "B" and got[1, "COVER_PAGE"] == "D" and got[2, "REVISION_SHEET"] == "B" and got[4, "FILENAME"] == "2" == got[4, "COVER"]
    bad = {(r.doc_id, r.source) for r in references.disagreeing(sources).collect()}
    assert bad == {(1, "COVER_PAGE"), (2, "COVER")}


# ---- language -----------------------------------------------------------------------------------


def test_grammar(spark):
    texts = ["The the pump failed.", "in the in the drum", "built in 202 6 here", "a nine-teen part", "parts comprising by steel", "its was open", "it's thickness is fine", "to loose pressure fast", "The results was good", "12.5 vs 12.6789 mm", "12.5 vs 12.5001 mm", "All is well here.", None, "   "]
    got = {(r.rule_id, r.original, r.suggestion) for r in language.grammar(spans(spark, [(1, t, 0, 20 * i) for i, t in enumerate(texts)])).collect()}
    assert ("RULE_GRAMMAR_REPEATED_WORD", "The the", "The") in got and ("RULE_GRAMMAR_REPEATED_PHRASE", "in the in the", "in the") in got
    assert ("RULE_GRAMMAR_SPLIT_YEAR", "202 6", "2026") in got and ("RULE_GRAMMAR_HOMOPHONE", "to loose pressure", "to lose pressure") in got
    assert {r[0] for r in got} == {"RULE_GRAMMAR_REPEATED_WORD", "RULE_GRAMMAR_REPEATED_PHRASE", "RULE_GRAMMAR_SPLIT_YEAR", "RULE_GRAMMAR_SPLIT_WORD", "RULE_GRAMMAR_COMPRISING_BY", "RULE_GRAMMAR_HOMOPHONE", "RULE_GRAMMAR_AGREEMENT", "RULE_SIGFIG_INCONSISTENCY"}
    assert sum(r[0] == "RULE_SIGFIG_INCONSISTENCY" for r in got) == 1


def test_match_offsets(spark):
    import re

    texts = ["approximately ten, sufficiently strong and approximately so", "x approximately", "äö approximately y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = sorted((r.i, r.start, r.end) for r in language.matches(df, "text", language.VAGUE).where("rule_id LIKE 'VAGUE%'").collect())
    want = sorted((i, m.start(), m.end()) for i, t in enumerate(texts) for _, kind, p, _ in language.VAGUE if kind == "vague_directive" for m in re.finditer(p, t, re.I))
    assert got == want


def test_ambiguity_and_grades(spark):
    df = spans(spark, [(1, "Plates of 316 and 316L were tested by the owner.", 0, 10), (2, "Only 304L here."), (3, "Clean thoroughly as appropriate.")])
    got = {(r.doc_id, r.rule_id) for r in language.ambiguity(df).collect()}
    assert got == {(1, "MIXED_GRADE"), (1, "PASSIVE_AGENT"), (3, "VAGUE_CLEAN"), (3, "VAGUE_AS_APPROPRIATE")}


def test_spelling(spark):
    rows = [(1, "the pressure vessel inspection", 0, i * 20.0) for i in range(8)] + [(2, "the presure vesel inspektion", 0, 10.0), (2, "PSV valve-12 xy", 0, 30.0)]
    got = {(r.word, r.suggestion) for r in language.spelling(spans(spark, rows)).collect()}
    assert got == {("presure", "pressure"), ("vesel", "vessel"), ("inspektion", "inspection")}


def test_spelling_of_listed_typos_and_unknown_words(spark):
    often = [(1, "the preasure gauge", 0, i * 20.0) for i in range(8)]
    rows = often + [(2, "teh yeild of gauge zorbifax", 0, 10.0), (2, "qzj 高温高压容器", 0, 30.0)]
    got = {(r.word, r.suggestion, r.confidence) for r in language.spelling(spans(spark, rows)).collect()}
    assert got == {("preasure", "pressure", 0.95), ("teh", "the", 0.95), ("yeild", "yield", 0.95), ("zorbifax", None, 0.80)}
    terms = spark.createDataFrame([("Yeild",), ("zorbifax",)], "term string")
    assert {r.word for r in language.spelling(spans(spark, rows), terms).collect()} == {"preasure", "teh"}


def test_spelling_keeps_its_meaning_with_size(spark):
    rows = [(d, " ".join(["pressure"] * 100_000), 0, 10.0) for d in range(10)] + [(d, "presure", 0, 30.0) for d in range(5)]
    assert {(r.word, r.suggestion) for r in language.spelling(spans(spark, rows)).collect()} == {("presure", "pressure")}


def test_lines_and_unclosed(spark):
    df = spark.createDataFrame([(1, 1, 0, "The pump", Row(0, 10.0, 100.0, 60.0, 112.0, 612.0, 792.0), "c"), (2, 1, 1, "was opened", Row(0, 65.0, 101.0, 120.0, 112.0, 612.0, 792.0), "c"), (3, 1, 2, "far away", Row(0, 300.0, 101.0, 350.0, 112.0, 612.0, 792.0), "c"), (4, 1, 3, "below", Row(0, 10.0, 130.0, 60.0, 142.0, 612.0, 792.0), "c")], SPAN)
    assert [(r.text, r.x1) for r in language.lines(df).collect()] == [("The pump was opened", 120.0)]
    items = references.ordered_items(heads(spark, [(1, "Executive Summary", 1, 0, 10), (1, "Annex", 1, 1, 10), (2, "Recommendations", 1, 0, 10), (3, "Conclusion", 1, 0, 10)]), spans(spark, [(1, "All is closed.", 0, 20), (1, "this one is left open by", 0, 30), (1, "so is this one to", 1, 20), (2, "Repaired by the end 2031", 0, 20), (3, "no mark but whole", 0, 20)]))
    assert {r.text for r in language.unclosed(items).collect()} == {"this one is left open by", "Repaired by the end 2031"}


# ---- duplicates ---------------------------------------------------------------------------------


def naive_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio_is_the_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(2))
        assert duplicates.ratio(a, b) == pytest.approx(naive_ratio(a, b))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = "valve pump vessel drain header inspection thickness radiography examination accepted welds supports bearing casing nozzle flange".split()
    base = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(12)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(3):
            w = t.split()
            if rng.random() < 0.8:
                w[rng.randrange(9)] = rng.choice(words)
            if rng.random() < 0.4:
                rng.shuffle(w)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(i % 2, t, i // 8, 100.0 + i) for i, t in enumerate(texts)] + [(0, "short text", 0, 90.0), (0, None, 0, 95.0)]
    df = spans(spark, rows)
    ordered = {d: sorted(((r[2], i, r[1]) for i, r in enumerate(rows) if r[0] == d and r[1] and len(r[1]) >= 30)) for d in (0, 1)}
    key = lambda t: " ".join(sorted(t.lower().split(" ")))

    def similar(a, b):
        if a == b:
            return True
        wa, wb = ({w for w in t.lower().split() if len(w) >= 4} for t in (a, b))
        need = max(2, -(-min(len(wa), len(wb), 12) // 5))
        return len(wa & wb) >= need and abs(len(a) - len(b)) <= 0.35 * max(len(a), len(b)) and naive_ratio(key(a), key(b)) >= 85

    want = {}
    for rows_of in ordered.values():
        for j, (_, i, t) in enumerate(rows_of):
            first = next((k for _, k, u in rows_of[:j] if similar(u, t)), None)
            if first is not None:
                want[i] = first
    got = {r.item_id: r.first_item for r in duplicates.near_duplicates(df.unionByName(df.limit(5))).collect()}
    assert set(got) == set(want) and len(want) > 10
    text = {i: r[1] for i, r in enumerate(rows)}
    assert all(got[i] == want[i] or text[got[i]] == text[want[i]] or similar(text[got[i]], text[i]) for i in got)


# ---- layout -------------------------------------------------------------------------------------


def test_page_breaks(spark):
    rows = [(1, "The pump was opened and", 0, 700), (1, "closed again.", 1, 50), (1, "It ends here.", 1, 700), (1, "new text", 2, 50), (1, "no mark here", 2, 700), (1, "lower case goes on.", 4, 50), (1, "Page 4", 4, 750)]
    # a colon ends a page, a comma and "nor" don't, "that" is no mark of an open sentence before a capital
    rows += [(2, "The parts are:", 0, 700), (2, "bolts", 1, 50), (2, "neither bolts nor", 1, 700), (2, "Nuts", 2, 50), (2, "bolts, nuts,", 2, 700), (2, "Rings", 3, 50), (2, "we found that", 3, 700), (2, "Rings fit.", 4, 50)]
    got = {(r.doc_id, r.page_index, r.next_page, r.reason) for r in layout.page_breaks(references.ordered_items(heads(spark, [(9, "x", 1)]), spans(spark, rows))).collect()}
    assert got == {(1, 0, 1, "conjunction"), (1, 2, 4, "continues"), (2, 1, 2, "conjunction"), (2, 2, 3, "punctuation")}


def test_voids_and_styles(spark):
    metrics = spark.createDataFrame([(1, 0, 0.02), (1, 1, 0.44), (1, 2, 0.09), (1, 3, 0.31), (2, 0, 0.1), (2, 1, 0.1), (3, 0, 51.0), (3, 1, 22.0), (3, 2, 64.0)], "doc_id long, page_index int, utilization double")
    assert {(r.doc_id, r.page_index) for r in layout.voids(metrics).collect()} == {(1, 2), (3, 1)}
    assert [r.text for r in layout.misused_styles(heads(spark, [(1, "Based on the survey", 1), (1, "Scope", 1)])).collect()] == ["Based on the survey"]


def test_boxes(spark):
    df = spark.createDataFrame([(1, None), (2, Row(-1, -5.0, 2.0, 10.0, 20.0, 0.0, 0.0)), (3, Row(9, 10.0, 20.0, 700.0, 30.0, 612.0, 792.0))], f"i int, b {BOX}")
    got = {r.i: r.n for r in df.withColumn("n", geometry.normalized(F.col("b"))).collect()}
    assert got[1] == Row(0, 0.0, 0.0, 0.0, 0.0, 612.0, 792.0) and got[2].x0 == 0 and got[2].page_width == 612
    assert [r.i for r in df.where(geometry.valid(geometry.normalized(F.col("b")))).collect()] == [1, 2]
    p = df.where("i = 3").select(geometry.placed(F.col("b"), F.lit(306.0), F.lit(396.0), F.lit(3)).alias("p")).first().p
    assert p.page_index == 2 and p.x0 == 5 and p.x1 == 306 and p.y0 == 381 and p.y1 == 401


# ---- rules --------------------------------------------------------------------------------------

RULES = "rule_no long, rule_id string, pack_id string, kind string, requires_engineering_judgement boolean, numeric_limit_params struct<parameter_name:string,pattern:string,operator:string,limit_value:double,tolerance:double,context_pattern:string>, terminology_params struct<term:string,preferred_term:string,deprecated_terms:array<string>,context_keywords:array<string>>, required_reference_params struct<trigger_keywords:array<string>,required_standard:string,required_clause:string,exemption_keywords:array<string>>"


def pack(spark):
    limit = lambda op, v, tol=0.0: Row("Shell pressure", r"shell\s+pressure\s*(?:of|is)?\s*([0-9.]+)", op, v, tol, None)
    return spark.createDataFrame([
        (1, "LE", "p", "numeric_limit", False, limit("LE", 10.0), None, None), (2, "GE", "p", "numeric_limit", True, limit("GE", 5.0, 1.0), None, None), (3, "EQ", "p", "numeric_limit", False, limit("EQ", 7.0), None, None),
        (4, "TERM", "p", "terminology", False, None, Row("vessel", "vessel", ["old vessel", "pot"], ["vessel"]), None), (5, "REF", "p", "required_reference", False, None, None, Row(["support skirt"], "QN 410", None, ["spare"])),
        (6, "NONE", "p", "terminology", False, None, None, None), (7, "BAD", "p", "numeric_limit", False, Row("Shell pressure", "(a+)+([0-9])", "LE", 1.0, 0.0, None), None, None),
    ], RULES)


def test_rule_findings(spark):
    rows = [(1, 1, "The shell pressure of 12 and shell pressure 7."), (2, 1, "The shell pressure is 4.5"), (3, 1, "The old vessel leaks."), (4, 1, "The old vessel and another vessel; a pot."), (5, 1, "A support skirt."), (5, 2, "per QN 410"), (6, 1, "The support skirt, spare"), (7, 1, "Support skirt here"), (8, 1, None), (9, 1, "")]
    texts = spark.createDataFrame(rows, "text_key long, page int, text string")
    ready = rules.loaded(pack(spark))
    assert ready.count() == 5
    got = {(r.text_key, r.rule_id, r.detail, r.status) for r in rules.all_findings(texts, ready).collect()}
    assert got == {(1, "LE", "12.0", "NON_COMPLIANT"), (1, "EQ", "12.0", "NON_COMPLIANT"), (2, "EQ", "4.5", "NON_COMPLIANT"), (4, "TERM", "old vessel", "NON_COMPLIANT"), (4, "TERM", "pot", "NON_COMPLIANT"), (7, "REF", None, "NON_COMPLIANT")}


def test_confusion(spark):
    cases = spark.createDataFrame([(1, "p", "The shell pressure of 12", ["LE", "EQ"]), (2, "p", "Support skirt", []), (3, "p", "nothing", ["TERM"])], "case_no long, pack_id string, document_text string, expected_triggers array<string>")
    r = rules.confusion(cases, rules.loaded(pack(spark))).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 11) and r.precision == pytest.approx(0.6667) and r.recall == pytest.approx(0.6667) and r.fpr == pytest.approx(0.0833)


def test_generic_rules(spark):
    rows = [
        ("a", "numeric_range", {"pattern": r"pressure (\d+)", "min_value": "10", "max_value": "20"}, "pressure 25", "FINDING"), ("b", "numeric_range", {"pattern": r"pressure (\d+)", "max_value": "25", "inclusive_max": "false"}, "pressure 25", "FINDING"),
        ("c", "numeric_range", {"pattern": r"pressure (\w+)"}, "pressure high", "UNRESOLVED"), ("d", "numeric_range", {"pattern": r"(a+)+b"}, "x", "UNRESOLVED"), ("e", "required_citation", {"trigger_keywords": "weld", "required_standard": "QN 410", "exemption_keywords": "spare"}, "weld spare", "PASS"),
        ("f", "required_citation", {"trigger_keywords": "weld", "required_standard": "QN 410"}, "weld", "FINDING"), ("g", "required_citation", {"trigger_keywords": "weld", "required_standard": "QN 410"}, "none", "NOT_APPLICABLE"), ("h", "unit_compatibility", {"pattern": r"\d+ (bar|psi)", "allowed_units": "bar"}, "30 psi", "FINDING"),
        ("i", "unit_compatibility", {"pattern": r"\d+ (bar|psi)", "allowed_units": "bar|psi"}, "30 psi", "PASS"), ("j", "terminology_consistency", {"deprecated_terms": "old (vessel)|pot", "context_keywords": "pump"}, "pot and pump", "FINDING"), ("k", "terminology_consistency", {"deprecated_terms": "pot", "context_keywords": "pump"}, "pot", "PASS"),
        ("l", "table_prose_reconciliation", {"tolerance": "1"}, "", "PASS"), ("m", "applicability_condition", {"condition_pattern": "steam"}, "steam", "UNRESOLVED"), ("n", "applicability_condition", {"condition_pattern": "steam"}, "x", "NOT_APPLICABLE"),
        ("o", "required_section_field", {"section_name": "S", "field_name": "f"}, "", "PASS"), ("p", "required_section_field", {"section_name": "S", "field_name": "g"}, "", "FINDING"), ("q", "required_section_field", {"section_name": "T", "field_name": "g"}, "", "NOT_APPLICABLE"),
        ("r", "citation_edition_match", {"citation_pattern": r"QN 410-(\d{4})", "expected_edition": "2021"}, "QN 410-2020", "FINDING"), ("s", "citation_edition_match", {"citation_pattern": r"QN 410-(\d{4})", "expected_edition": "2021"}, "QN 410-2021", "PASS"), ("t", "other", {}, "", "UNRESOLVED"),
    ]
    bundle = spark.createDataFrame([r[:3] for r in rows], rules.GENERIC)
    facts = spark.createDataFrame([(r[0], r[3], 1, "5", "5.5", ["S"], ["S.f"]) for r in rows], rules.FACTS)
    got = {r.rule_id: r.status for r in rules.judge(spark, bundle, facts).where("fact_id = rule_id").collect()}
    assert got == {r[0]: r[4] for r in rows}
    with pytest.raises(ValueError, match="500"):
        rules.judge(spark, spark.range(501).selectExpr("cast(id as string) AS rule_id", "'x' AS rule_type", "map('a', 'b') AS parameters"), facts)


# ---- bands, scorecard, findings -----------------------------------------------------------------


def test_bands(spark):
    table = cells(spark, [["Criticality", "Remaining life"], ["1", "RUL > 14"], ["2", "0 < RUL 2026 ≤ 6 yr"]])
    items = references.ordered_items(heads(spark, [(9, "x", 1)]), spans(spark, [(1, "Criticality 2 means 6 < RUL <= 14 years", 0, 10), (1, "Criticality 1 is RUL > 14", 0, 20), (1, "criticality 1: 0 to 6 and then criticality 3: 0 to 6", 0, 30)]))
    got = {(r.category, r.kind, r.item_id) for r in consistency.contradictions(table, items).collect()}
    assert ("2", "CATEGORY_BAND_CONTRADICTION", 0) in got and ("1", "CATEGORY_BAND_CONTRADICTION", 2) in got and ("3", "DUPLICATE_BAND", 2) in got and not any(x[2] == 1 for x in got)


def test_scorecard_averages(spark):
    rows = spark.createDataFrame([(1, "I", "a", 4), (1, "I", "b", 2), (1, "II", "c", 5), (1, "II", "d", None), (2, "I", "a", 3)], "doc_id long, grp string, item string, score int")
    got = {(r.doc_id, r.grp): (r.average, r.rework) for r in scorecard.averages(rows).collect()}
    assert got == {(1, "I"): (3.0, 1), (1, "II"): (5.0, 0), (1, "ALL"): (3.67, 1), (2, "I"): (3.0, 0), (2, "ALL"): (3.0, 0)}


def test_scorecard_has_all_items(spark):
    h = heads(spark, [(1, "Introduction", 1, 0, 10), (1, "Methodology", 1, 0, 30), (1, "Conclusions", 1, 0, 60), (2, "Test procedure", 1, 0, 10)])
    said = [(1, "The purpose of this", 0, 15), (1, "report is stated. Scope of work.", 0, 20), (1, "Step 1 is to measure.", 0, 40), (1, "See Table 3.", 0, 70), (2, "Do it.", 0, 20)]
    items = references.ordered_items(h, spans(spark, said))
    none = spark.createDataFrame([], "doc_id long, item_id long, page_index int, year int, named string")
    signals = scorecard.signals(items, cells(spark), none, none, none, none, none, none, none, none)
    rows = scorecard.scores(signals).collect()
    groups = {g: sum(r.doc_id == 1 and r.grp == g for r in rows) for g in ("I", "II", "III", "IV")}
    assert groups == {"I": 9, "II": 11, "III": 11, "IV": 10}
    got = {(r.doc_id, r.item): r.score for r in rows}
    assert got[1, "purpose_of_report_clear"] == 5 and got[1, "objective_of_report_clear"] == 3 and got[1, "conclusions_clear"] == 2 and got[1, "sections_logical"] == 5 and got[1, "experimental_steps_outlined"] == 5
    assert {k for (doc, k), v in got.items() if v is None and doc == 2} == {"experimental_steps_outlined", "adequate_detail_to_repeat", "discussion_relates_to_others", "discussion_length_appropriate"}
    assert {tuple(r) for r in scorecard.baselines(signals).collect()} == {(1, False, False, False, False), (2, False, False, True, False)}
    assert {(r.doc_id, r.status) for r in scorecard.not_applicable(signals).collect()} == {(1, "EVALUATED"), (2, "NOT_APPLICABLE")}


def test_merged_first_wins(spark):
    one = spark.createDataFrame([(1, 0, "x"), (1, 0, "x"), (2, 1, "y")], "doc_id long, page_index int, m string")
    a = findings.as_issues(one, 1, "LAYOUT", F.lit("UNCONTROLLED_PAGE"), F.col("page_index"), F.col("m"))
    b = findings.as_issues(one, 2, "LAYOUT", F.lit("UNCONTROLLED_PAGE"), F.col("page_index"), F.col("m"))
    got = findings.merged(b, a).collect()
    assert len(got) == 2 and all(r.stream == 1 and r.severity == "MAJOR" for r in got)


def test_evidence(spark):
    import json

    b = {"page_index": 2, "x0": 1, "y0": 2, "x1": 3, "y1": 4, "page_width": 612.0, "page_height": 792.0}
    rows = [(1, json.dumps({"kind": "TABLE_MATH", "operand_locations": [b, b], "total_location": b})), (2, json.dumps({"kind": "REVISION", "locations": []})), (3, json.dumps({"kind": "STAGE_FAILURE", "page_index": 4})), (4, "{"), (5, None)]
    df = spark.createDataFrame(rows, "issue_id long, evidence string")
    assert [(r.pos, r.source) for r in findings.boxes(df).orderBy("pos").collect()] == [(0, "total_location"), (1, "operand_locations"), (2, "operand_locations")]
    pages = {r.issue_id: r.p for r in df.select("issue_id", findings.evidence_page(F.col("evidence")).alias("p")).collect()}
    assert pages == {1: 3, 2: 1, 3: None, 4: None, 5: None}


def test_last_heading_against_brute_force(spark):
    from docassay.operators.asof import with_heading

    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.randrange(5), f"t{i}", rng.randrange(4), float(rng.randrange(6) * 10), rng.random() < 0.25) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id long, doc_id long, seq int, text string, page_index int, y0 double, is_heading boolean")
    order = sorted(rows, key=lambda r: (r[1], r[4], r[5], not r[6], r[2], r[0]))
    want, last = {}, {}
    for r in order:
        if r[6]:
            last[r[1]] = r[0]
        want[r[0]] = last.get(r[1])
    got = {r.item_id: r.head.item_id if r.head else None for r in with_heading(df).collect()}
    assert got == want


def test_similarity_join_takes_headings_and_spans(spark, tmp_path):
    from docassay.plans import analyzers

    heads(spark, [(1, "Thickness survey of the lower shell plates", 1, 0, 100)]).write.parquet(f"{tmp_path}/headings.parquet")
    spans(spark, [(1, "Thickness survey of the lower shell plating", 0, 200)]).write.parquet(f"{tmp_path}/spans.parquet")
    rows = analyzers.Q["jon15_similarity_join"](spark, str(tmp_path)).collect()
    assert len(rows) == 1 and 85 <= rows[0].similarity < 95


def test_items_and_notes(spark):
    with pytest.raises(ValueError, match="nothing"):
        scorecard.item(spark.range(1), "nothing")
    found = scorecard.evidence(references.ordered_items(heads(spark, [(1, "2 Methodology", 1, 0, 10), (1, "Summary", 1, 1, 10), (2, "Summary", 1, 0, 10)]), spans(spark, [(1, "First step.", 0, 20), (1, "Second step.", 0, 30), (1, "x" * 500, 1, 20), (2, None, 0, 20), (2, " ", 0, 30)])))
    assert {(r.doc_id, r.section, r.heading, r.page, len(r.excerpt)) for r in found.collect()} == {(1, "methodology", "2 Methodology", 1, 11), (1, "summary", "Summary", 2, 180)}
    scored = spark.createDataFrame([(1, "I", "logical_approach", 5), (1, "I", "timely", None), (3, "I", "logical_approach", 3)], "doc_id long, grp string, item string, score int")
    assert {(r.doc_id, r.item, "First step." in r.note) for r in scorecard.notes(scored, found).collect()} == {(1, "logical_approach", True), (3, "logical_approach", False)}
