"""Scanned pages: planted noise is found and repaired, clean lines are left alone."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docassay.llm import ocr_repair as ocr

SENTENCES = ["The contractor shall replace the support skirt before the next filling cycle.", "Thickness readings on the storage tank ranged over several grid points.", "The data sheet gives a capacity of 6039 litres, whereas the vendor manual gives 8863 litres.", "Personnel entering the flare area need a permit signed by the area authority.", "The heat-treated coupons came from the same plate as the relief valve.", "Ultrasonic scanning of the transfer line revealed pitting along the waterline.", "Because access was restricted, the non-return valve could not be examined from inside."]
PAGE = "page_id long, doc_id long, page_index int, raw_text string, header_text string, footer_text string, page_number string, text_source string, repeated string"


def page(rng, doc, index, noise):
    """(row, truth): a scanned page with its furniture, broken and misread lines."""
    head, foot, number = f"CONFIDENTIAL - 13-{2000 + doc}-016-INS-0888", "Printed copies are uncontrolled", f"Page {index + 4} of 45"
    words, lines, line, truth = " ".join(rng.sample(SENTENCES, 5)).split(), [], "", set()
    for w in words:
        if line and len(line) + 1 + len(w) > 60:
            if len(w) > 7 and w.isalpha() and rng.random() < 0.5:
                lines.append(f"{line} {w[:4]}-")
                truth.add((len(lines), "BROKEN"))
                line = w[4:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    lines.append(line)
    for i, text in enumerate(lines):
        if noise and rng.random() < 0.3:
            spots = [w for w in text.split() if len(w) > 6 and w.isalpha() and "e" in w[1:-1] and w in words]
            if spots:
                lines[i] = text.replace(spots[0], spots[0][:1] + spots[0][1:].replace("e", "c", 1), 1)
                truth.add((i + 1, "CHARS"))
    body = [head, *lines, foot, number]
    truth |= {(0, "FURNITURE"), (len(body) - 2, "FURNITURE"), (len(body) - 1, "FURNITURE")}
    return (doc * 100 + index, doc, index, "\n".join(body), head, foot if rng.random() < 0.7 else None, number, "OCR", "clash"), truth


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    made = [page(rng, doc, index, True) for doc in range(60) for index in range(3)]
    clean = [(100_000 + i, 1, 0, " ".join(rng.sample(SENTENCES, 7)), None, None, None, "TEXT_LAYER", "clash") for i in range(120)]
    odd = [(999_999, 1, 0, "", None, None, None, "OCR", ""), (999_998, 1, 0, None, None, None, None, "OCR", ""), (999_997, None, 0, "x" * 5000, None, None, None, None, "")]
    rows = [r for r, _ in made]
    return spark.createDataFrame(rows + rows[:7] + clean + odd, PAGE), {(r[0], *t) for r, truth in made for t in truth}


def test_planted_noise(spark, corpus):
    df, truth = corpus
    got = {(r.page_id, r.line_no, r.kind) for r in ocr.defects(spark, df).where("page_id < 10000").collect()}
    for kind in ("FURNITURE", "BROKEN", "CHARS"):
        g, t = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(g & t) >= 0.9 * len(t) and len(g & t) >= 0.9 * len(g), (kind, len(g), len(t), len(g & t))


def test_paragraphs_are_continuous(spark, corpus):
    df, _ = corpus
    texts = [r.text for r in ocr.paragraphs(spark, df).where("page_id < 10000").collect()]
    whole = sum(any(s in t for s in SENTENCES) for t in texts)
    assert len(texts) >= 180 and whole >= 0.95 * len(texts)
    assert not any("CONFIDENTIAL" in t for t in texts[:50])


def test_vocabulary_and_operations():
    rng = random.Random(1)
    learnt = [("e", "c", 3.0), ("rn", "m", 2.0), ("m", "rn", 2.0), ("l", "", 1.0), ("", "x", 1.0)]
    confusions, seen = ocr.Confusions(learnt), set()
    for _ in range(400):
        for word in ("inspection", "external", "vessel", "maintenance", "5280"):
            if made := confusions.corrupt(word, rng):
                seen |= {op[0] for op in made[1]} | ({"RI"} if any(op[0] == "R" and len(op) > 2 for op in made[1]) else set())
                assert "".join(ocr.applied(op, c) for c, op in zip(*made, strict=True)) == word
    assert seen == {"K", "R", "D", "I", "RI"}
    assert ocr.key_of("S355") == "s000" and ocr.key_of("Tank") == "tank" and ocr.form_of("S355") == "S355" and ocr.form_of("Tank") == "tank"


def test_confusions_are_learnt_from_scans():
    words = "western northern afternoon pressure vessel nozzle reading flange number support".split()
    unknown = Counter({w.replace("rn", "m"): 2 for w in words[:3]} | {w.replace("e", "c", 1): 1 for w in words[3:]} | {"zzzzz": 9, "flamge": 50})
    got = {(true, read): n for true, read, n in ocr.learnt_confusions(unknown, set(words))}
    assert set(got) == {("rn", "m"), ("e", "c")} and got["e", "c"] > got["rn", "m"]


def test_words_beyond_the_common_ones_are_joined(spark, corpus, monkeypatch):
    """The result doesn't depend on which words are sent and which are joined."""
    df, _ = corpus
    words = ocr.vocabulary(df)
    rows = sorted({ocr.form_of(w) for w in " ".join(SENTENCES).replace(".", " ").replace(",", " ").split() if w.isalpha() and len(w) > 4})
    forms = spark.createDataFrame([(f := w.replace("e", "c", 1), ocr.key_of(f)) for w in rows], "form string, form_key string").distinct()
    clean = [" ".join(SENTENCES)] * 20
    every = {r.word for r in words.collect()}
    model = ocr.train_editor(clean, ocr.Common(every), ocr.Confusions([("e", "c", 1.0)]))
    editor = ocr.Editor(model, max(map(len, every)))

    def fixed(common):
        rare = words.where(~F.col("word").isin(sorted(common)) if common else F.lit(True))
        asked = forms.where(~F.col("form_key").isin(sorted(common)) if common else F.lit(True))
        return {r.form: (r.text, r.at) for r in ocr.corrections(spark, asked, rare, editor, ocr.Common(common)).collect()}

    sent, joined, mixed = fixed(every), fixed(set()), fixed(set(sorted(every)[::2]))
    assert sent == joined == mixed and sum(t is not None for t, _ in sent.values()) > 20
    # a filter that is full only costs joins
    monkeypatch.setattr(ocr, "candidate_filter", lambda rare: np.full(ocr.FILTER_BITS // 8, 255, np.uint8))
    assert fixed(set()) == sent


def test_a_vocabulary_of_two_million_words_keeps_misread_words_unknown(spark):
    """Beyond the common words the look-up is a join, so a large vocabulary makes no misread word known."""
    many = spark.range(2_000_000).select(F.concat(F.lit("w"), F.translate(F.conv(F.col("id").cast("string"), 10, 26), "0123456789", "qrstuvwxyz")).alias("word")).unionByName(spark.createDataFrame([("pressure",), ("vessel",)], "word string"))
    forms = spark.createDataFrame([(f, f) for f in ("prcssure", "vesscl", "unheard", "pressure")], "form string, form_key string")
    model = ocr.train_editor(["pressure vessel reading were here"] * 60, ocr.Common(set()), ocr.Confusions([("e", "c", 1.0)]))
    got = {r.form: r.text for r in ocr.corrections(spark, forms, many, ocr.Editor(model, 12), ocr.Common(set())).collect()}
    assert got == {"prcssure": "pressure", "vesscl": "vessel", "unheard": None}


def test_empty(spark, corpus):
    df, _ = corpus
    assert ocr.defects(spark, df.limit(0)).count() == 0


def test_long_words_and_words_without_neighbours(spark, corpus):
    df, _ = corpus
    long = [(500_000, 7, 0, "pressure " + "x" * 300 + " prcssure\n\n" + "漢字" * 50, None, None, None, "OCR", "")]
    clean = [(600_000 + i, 7, 0, "pressure " + "x" * 300, None, None, None, "TEXT_LAYER", "") for i in range(3)]
    got = {(r.line_no, r.kind) for r in ocr.defects(spark, df.unionByName(spark.createDataFrame(long + clean, PAGE))).where("page_id = 500000").collect()}
    assert (2, "CHARS") not in got


def test_a_redelivered_page_makes_no_word_known(spark):
    pages = spark.createDataFrame([(1, 1, 0, "alpha beta", None, None, None, "TEXT_LAYER", "")] * 2 + [(2, 1, 0, "beta S355 gamma", None, None, None, "TEXT_LAYER", ""), (3, 1, 0, "S400 x", None, None, None, "TEXT_LAYER", "")], PAGE)
    assert {r.word for r in ocr.vocabulary(pages).collect()} == {"beta", "s000"}


def test_the_bound_of_examples_takes_from_all_pages(monkeypatch):
    monkeypatch.setattr(ocr, "TRAIN_EXAMPLES", 200)
    pages = ["alpha " * 400, "zulu " * 400]
    data = ocr.editor_examples(pages, ocr.Common({"alpha", "zulu"}), ocr.Confusions([("a", "o", 1.0), ("u", "v", 1.0)]), 11)
    assert len(data) == 200 and {"ca", "co", "cv"} <= {x[1] for x, _ in data}


def test_the_models_are_fitted_on_all_pages(spark):
    """A confusion that only three of 2,500 scanned pages show is learnt, whichever pages these are."""
    words = "pressure vessel nozzle reading flange number support inspection external maintenance".split()
    clean = [(10_000 + i, 1, 0, " ".join(words), None, None, None, "TEXT_LAYER", "") for i in range(3)]
    odd = {i: w.replace("e", "q", 1) for i, w in zip(ODD_PAGES, ("pressure", "vessel", "reading"), strict=True)}
    scans = [(i, 1, i, "\n".join([words[i % 10], f"the {odd.get(i, words[i % 7])} of", words[i % 9]]), None, None, None, "OCR", "") for i in range(2_500)]
    got = {(r.page_id, r.line_no) for r in ocr.defects(spark, spark.createDataFrame(scans + clean, PAGE)).where("kind = 'CHARS'").collect()}
    assert got == {(i, 1) for i in odd}


#: Pages that a choice of 1,500 by the hash of the page id left out.
ODD_PAGES = (1, 4, 7)


def test_a_model_depends_on_its_rows_only(spark, monkeypatch):
    rows = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(" ".join(SENTENCES).lower().replace(".", "").replace(",", "").split())], "form string, times long").dropDuplicates(["form"])
    confusions = ocr.Confusions([("e", "c", 1.0), ("l", "i", 1.0)])
    for bound in (60_000, 20):  # one share, and several
        monkeypatch.setattr(ocr, "SHARE_ROWS", bound)
        a, b = (ocr.fitted(rows.repartition(n), lambda given: ocr.word_examples(given, confusions, 11), 3, 7) for n in (1, 5))
        assert a.ids == b.ids and a.classes == b.classes and np.array_equal(a.w, b.w) and a.seen_with == b.seen_with
        assert {"K", "Re"} <= set(a.classes) and a.classes.index("Re") in a.seen_with["c"]
