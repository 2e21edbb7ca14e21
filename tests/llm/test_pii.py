"""Personal information: every form found with its exact place, decoys kept, readable placeholders."""

from pyspark.sql import functions as F

from docassay.llm import pii

DOC = "doc_id long, text string, pii_type string"
NAMES = [("Naomi", "Jasperon"), ("Owen", "Kestrand"), ("Élodie", "d'Aumersac"), ("Katrin", "Krautmann-Vogt"), ("Bambang", "Suryomandra")]


def corpus():
    rows = []
    for i, (g, s) in enumerate(NAMES * 4):
        local = f"{pii.fold(g)}.{pii.fold(s)}" if i % 2 else f"{pii.fold(s)}_{pii.fold(g)[0]}" if i % 4 else f"{pii.fold(g)}+qa"
        rows.append(f"Prepared by {g} {s}, reachable at {local}@mail.sempala.example. The Vickers and Charpy results are attached. The team visited Eastmere and Coldwater Ness in week {i}.")
        rows.append(f"Bernoulli's equation gives 38.{i} bar. The pump was opened in Eastmere. Prepared with care.")
    return rows


CASES = [
    ("Mr. Jasperon agreed. During the walkdown OWEN KESTRAND pointed out the clamp.", [("NAME", "Jasperon"), ("NAME", "OWEN KESTRAND")]),
    ("Cc: Kestrand, Owen <owen.kestrand (at) inspect.test>; tel. 01632 960057 ext. 37.", [("NAME", "Kestrand, Owen"), ("EMAIL", "owen.kestrand (at) inspect.test"), ("PHONE", "01632 960057 ext. 37")]),
    ("Contact N. Jasperon or Naomi M. Jasperon at naomi at mail dot sempala dot example or x[at]y.example.", [("NAME", "N. Jasperon"), ("NAME", "Naomi M. Jasperon"), ("EMAIL", "naomi at mail dot sempala dot example"), ("EMAIL", "x[at]y.example")]),
    ("Rédigé par Élodie d'Aumersac, n° de sécurité sociale 9 00 13 99 740 258 40, au 01.99.00.55.51.", [("NAME", "Élodie d'Aumersac"), ("ID_NUMBER", "9 00 13 99 740 258 40"), ("PHONE", "01.99.00.55.51")]),
    ("Als Besucher ist Krautmann-Vogt, Katrin, Steuer-ID 00 621 013 184, unter +49 (0)30 55501-38 oder 0049 30 5550178 oder 030/5550103.", [("NAME", "Krautmann-Vogt, Katrin"), ("ID_NUMBER", "00 621 013 184"), ("PHONE", "+49 (0)30 55501-38"), ("PHONE", "0049 30 5550178"), ("PHONE", "030/5550103")]),
    ("Call +1 (555) 010-5526, (555) 010-5529, 555-010-5587, 555.010.5501, +628125550112, 0812 5550 0148, (021) 555-0131, +34 955 501 099 or 955 50 10 66.", [("PHONE", x) for x in ("+1 (555) 010-5526", "(555) 010-5529", "555-010-5587", "555.010.5501", "+628125550112", "0812 5550 0148", "(021) 555-0131", "+34 955 501 099", "955 50 10 66")]),
    ("The welder (SSN 900-51-7115) and (ID card ZZ 43 30 23 Q), passport no. XX2894959, NIK 9993144442064859, NPWP 99.756.971.9-970.000, DNI 00001762G.", [("ID_NUMBER", x) for x in ("900-51-7115", "ZZ 43 30 23 Q", "XX2894959", "9993144442064859", "99.756.971.9-970.000", "00001762G")]),
    ("Sent to Unit 9, 95 Quarrel Lane, Eastmere ZQ8 5XX by courier. Invoice address: 118 Millrace Street, Coldwater Ness.", [("ADDRESS", "Unit 9, 95 Quarrel Lane, Eastmere ZQ8 5XX"), ("ADDRESS", "118 Millrace Street, Coldwater Ness")]),
    ("Dikirim ke Jl. Merapi Baru No. 172, Kota Sempala 99264 lewat kurir, lalu Jalan Kenari II/21, RT 06/RW 08, Sempala lewat kurir.", [("ADDRESS", "Jl. Merapi Baru No. 172, Kota Sempala 99264"), ("ADDRESS", "Jalan Kenari II/21, RT 06/RW 08, Sempala")]),
    ("Au 90 bis, avenue du Four, 00888 Saint-Orlin. An Am Kesselhaus 103a, 00974 Brackenau. An Grubenstr. 167, 00679 Altmoor.", [("ADDRESS", "90 bis, avenue du Four, 00888 Saint-Orlin"), ("ADDRESS", "Am Kesselhaus 103a, 00974 Brackenau"), ("ADDRESS", "Grubenstr. 167, 00679 Altmoor")]),
    ("A Calle del Molino 38, 00026 Villarsol, a Avda. Cantera 37, 3.º B, 00274 Villarsol y Rua da Forja, 34, 0099-545 Pedralva.", [("ADDRESS", "Calle del Molino 38, 00026 Villarsol"), ("ADDRESS", "Avda. Cantera 37, 3.º B, 00274 Villarsol"), ("ADDRESS", "Rua da Forja, 34, 0099-545 Pedralva")]),
    ("Tag HX-9108@unit38 was renamed. Readings @ 38 °C. Purchase order 555-6719-17. Drawing 7643-63-1883. Serial no. 2588612699142608. The Vickers and Charpy results. Bernoulli's equation. Route 21 Harbour line. The team visited Eastmere.", []),
]


def test_every_form(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(corpus() + [t for t, _ in CASES])], DOC)
    base = len(corpus())
    rows = pii.found(spark, docs).collect()
    for i, (text, want) in enumerate(CASES):
        got = sorted((r.start_pos, r.pii_type, text[r.start_pos : r.end_pos]) for r in rows if r.doc_id == base + i)
        assert [(k, t) for _, k, t in got] == sorted(want, key=lambda x: text.index(x[1])), text


def test_redaction(spark):
    text = CASES[1][0]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*corpus(), text, "", None])], DOC)
    got = {r.doc_id: r for r in pii.redacted(spark, docs).collect()}
    n = len(corpus())
    assert got[n].text == "Cc: [NAME] <[EMAIL]>; tel. [PHONE]." and got[n].n_mentions == 3
    assert got[n + 1].text == "" and got[n + 2].text is None
    assert "Vickers and Charpy" in got[0].text and "Eastmere" in got[0].text and "[EMAIL]" in got[0].text


def test_disclosure_counts(spark):
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(corpus())], DOC)
    got = {r.term: r for r in pii.disclosure(pii.first_pass(docs)).collect()}
    assert got["jasperon"].linked >= 2 and got["jasperon"].bits > 2 and "eastmere" not in got and "vickers" not in got and "prepared" not in got
    assert pii.found(spark, docs.limit(0)).count() == 0


def test_copies_count_once(spark):
    """A text with very many copies neither hides the names in it nor makes its values public."""
    copied = "The walkdown with Jasperon ended. Jasperon, Jasperon and Kestrand signed. Tel. 01632 960057."
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate([*corpus(), *[copied] * 400])], DOC)
    got = [(r.doc_id, r.pii_type) for r in pii.found(spark, docs).where(f"doc_id >= {len(corpus())}").collect()]
    assert len(got) == 400 * 4 and sum(k == "NAME" for _, k in got) == 400 * 3  # one of them "Surname, Given"
    counts = {r.term: r.n for r in pii.disclosure(pii.first_pass(docs)).collect()}
    alone = {r.term: r.n for r in pii.disclosure(pii.first_pass(spark.createDataFrame([(i, t, "") for i, t in enumerate([*corpus(), copied])], DOC))).collect()}
    assert counts == alone


def test_public_values_are_kept(spark):
    """An address that stands in very many different texts reveals nobody."""
    docs = [f"Letter {i} of 12 Quarrel Lane, Eastmere 00188 on pump {i}. Call 01632 9{i:05d}." for i in range(120)]
    got = {(r.pii_type, r.n) for r in pii.found(spark, spark.createDataFrame([(i, t, "") for i, t in enumerate(docs)], DOC)).groupBy("pii_type").agg(F.count("*").alias("n")).collect()}
    assert got == {("PHONE", 120)}


def test_names_by_join_equal_names_by_set(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*corpus(), *(t for t, _ in CASES), "Mr. Unheard came."])], DOC)
    terms = pii.protected_terms(pii.first_pass(docs))
    rows = lambda df: sorted(map(tuple, df.collect()))
    one, other = rows(pii.names_by_set(spark, docs.select("doc_id", "text"), terms)), rows(pii.names_by_join(docs.select("doc_id", "text"), terms))
    assert one == other and len(one) > 20


def test_street_words_in_any_spelling(spark):
    texts = {"Sent to 12 Rue de la Paix, 75002 Paris by post.": "12 Rue de la Paix, 75002 Paris", "Al 5 Avenue Victor Hugo.": "5 Avenue Victor Hugo", "En calle Mayor 5, 28013 Madrid.": "calle Mayor 5, 28013 Madrid", "Di jalan Merdeka 5, Sempala 99264.": "jalan Merdeka 5, Sempala 99264", "At 12 Oak street, Eastmere.": "12 Oak street, Eastmere"}
    rows = pii.found(spark, spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOC)).collect()
    assert {r.doc_id: list(texts)[r.doc_id][r.start_pos : r.end_pos] for r in rows if r.pii_type == "ADDRESS"} == dict(enumerate(texts.values()))
    # the other words of streets are words of other kinds too
    assert not [x for x in pii.proposals("Check 5 Pump drive shafts and 3 Main way valves.", []) if x[0] == 2]


def test_long_empty_and_missing(spark):
    text = "The pump was opened and closed again. " * 30_000 + "Mail naomi.jasperon@example.com."
    rows = [(1, text, ""), (2, "", ""), (3, None, ""), (None, "Mail a.b@example.com", "")]
    got = pii.found(spark, spark.createDataFrame(rows, DOC)).collect()
    assert [(r.doc_id, r.pii_type, r.end_pos) for r in got] == [(1, "EMAIL", len(text) - 1)]
    kept = {r.doc_id: r.text for r in pii.redacted(spark, spark.createDataFrame(rows, DOC)).collect()}
    assert len(kept) == 4 and kept[1].endswith("Mail [EMAIL].") and kept[3] is None
