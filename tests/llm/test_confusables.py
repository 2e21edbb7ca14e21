"""Consistent text forms: what looks the same, what does not, pairs against brute force."""

from docassay.llm import confusables

ITEM = "item_id long, doc_id long, text string, form string, seq int"
SAME = [
    ("Valve", "Ｖａｌｖｅ"), ("café", "café"), ("no break", "no break"), ("thin space", "thin space"), ("hidden", "hid​den"), ("soft", "so­ft"), ("caps", "саps"), ("TOP", "ΤΟΡ"),
    ("field", "ﬁeld"), ("office", "oﬃce"), ("off-line", "off‐line"), ("25 K", "25 K"), ("5 Ω", "5 Ω"), ("3 Å", "3 Å"), ("µm", "μm"), ("été", "е́té"), ("ё", "ë"), ("ทำ", "ทํา"), ("ポンプ", "ﾎﾟﾝﾌﾟ"), ("IV", "Ⅳ"), ("xii", "ⅻ"), ("SOL", "ՏՕᏞ"), ("WELD", "ᎳᎬᏞᎠ"), ("Q1", "𝐐𝟏"), ("a", "𝚊"),
]
APART = [("m2", "m²"), ("Tag", "TAG"), ("resume", "résumé"), ("done", "done."), ("a-b", "a–b"), ("A", "Å"), ("и", "й"), ("1", "l")]


def forms(spark, texts):
    df = spark.createDataFrame([(i, 1, t, "clash", 0) for i, t in enumerate(texts)], ITEM)
    return {r.item_id: r.f for r in confusables.consistent(df, "text", "f").collect()}


def test_looks(spark):
    flat = [t for pair in SAME + APART for t in pair]
    got = forms(spark, [*flat, None, ""])
    for i, pair in enumerate(SAME):
        assert got[2 * i] == got[2 * i + 1], pair
    for i, pair in enumerate(APART, len(SAME)):
        assert got[2 * i] != got[2 * i + 1], pair
    assert got[len(flat)] is None and got[len(flat) + 1] == ""


def test_forms_are_stable(spark):
    flat = [t for pair in SAME for t in pair] + ["Р-8653 ｍ３ x" * 5000]
    once = forms(spark, flat)
    again = forms(spark, [once[i] for i in range(len(flat))])
    assert once == again


def test_pairs_against_brute_force(spark):
    rows = [(i, i % 3, t, "clash", 0) for i, t in enumerate([t for pair in SAME for t in (pair[0], pair[0], pair[1])] * 3)]
    rows = [(i, (i // 9) % 2, t, f, s) for i, _, t, f, s in rows]
    df = spark.createDataFrame(rows + rows[:5], ITEM)
    form = forms(spark, [t for _, _, t, _, _ in rows])
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and form[a[0]] == form[b[0]])
    heads, spans = df.where("item_id % 2 = 0"), df.where("item_id % 2 = 1")
    assert sorted((r.item_a, r.item_b) for r in confusables.alike(heads, spans).collect()) == want and want
    assert confusables.alike(heads.limit(0), spans.limit(0)).count() == 0
