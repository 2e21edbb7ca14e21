"""Sentence units: whole texts covered, known hard cases in each script."""

from hypothesis import given, settings
from hypothesis import strategies as st

from docassay.llm import sentences


def units(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


CASES = [
    ["Clause 4.9.7. applies to the drum vs. the older limit of 37.6 mm.", "Was it isolated?", "Work stopped at 5 p.m.", "See Fig. 40 and Sec. 4.12 for the nozzle."],
    ["The log says \"Stop the pump. Wait for cooling.\" next to entry no. 48.", "\"The drum is not safe.\"", "Use min. 47 bolts, max. torque 6585 N.m.", "pH was below 7."],
    ["Messrs. Jasperon and Co. supplied plates acc. to QN 752 Rev. B.", "Spare parts are gaskets, seals, etc.", "Dr. Ellis signed at 9:30 a.m. on site.", "The reading drifted ... and then settled."],
    ["Am 3. Mai wurde Nr. 5436 ausgetauscht.", "Geprüft wurden Dichtungen, Bolzen usw.", "Im Protokoll steht: „Pumpe stoppen. Abkühlung abwarten.“, und zwar ohne Unterschrift.", "Der Abtrag beträgt ca. 13,8 mm, d. h. weniger als in Tab. 13."],
    ["La vanne était-elle fermée ?", "M. d'Aumersac a signé le rapport n° 9547.", "Le registre indique « Arrêter la pompe. Attendre. » à la ligne 25.", "La perte est d'env. 14 mm, c.-à-d. moins que l'art. 6."],
    ["El Ing. Zubirreta firmó el informe núm. 796.", "¿Estaba cerrada la válvula?", "Se revisaron juntas, pernos, etc."],
    ["Утонение составляет ок. 42,5 мм, т. е. меньше допуска по п. 2.5.", "См. рис. 25 и гл. 5.11.", "В журнале записано: «Остановить насос. Ждать.», подпись отсутствует."],
    ["Ir. Prawitana menandatangani laporan pada pukul 14.30.", "Suku cadang meliputi gasket, dll.", "Penipisan 5,7 mm, a.l. pada LV-9183 dan No. 9289."],
]


def test_spaced_scripts():
    for want in CASES:
        assert units(" ".join(want)) == want


def test_lines_wrap_and_spaces_are_lost():
    assert units("The owner asked for a second\nopinion.The drum was\nopened.  It failed.") == ["The owner asked for a second\nopinion.", "The drum was\nopened.", "It failed."]


def test_spaceless_scripts():
    assert units("弁は閉じていたか？日誌には「ポンプを停止。冷却を待つ。」と記載されていた。計算した。") == ["弁は閉じていたか？", "日誌には「ポンプを停止。冷却を待つ。」と記載されていた。", "計算した。"]
    assert units("记录写明“泵已停。等待冷却。”，随后由值班员确认。请勿打开旁路！") == ["记录写明“泵已停。等待冷却。”，随后由值班员确认。", "请勿打开旁路！"]
    thai = ["ความดันทดสอบคงที่ที่ 40.8 บาร์เป็นเวลา 13 นาทีโดยไม่มีการรั่วไหล", "ควรวัดความหนาของปั๊มป้อนซ้ำภายใน 2 สัปดาห์", "ผู้ตรวจสอบเปิดปั๊มป้อน", "ตารางที่ 28 แสดงค่าที่วัดได้"]
    assert units(" ".join(thai)) == thai


def test_word_lattice():
    own = sentences.Lexicon(("ตรวจสอบ", "ถังเก็บ", "ต้องมี"))
    assert own.words("ผู้ตรวจสอบ") == ["ผู้", "ตรวจสอบ"] and own.words("") == []
    assert "".join(own.words("กขคถังเก็บ")) == "กขคถังเก็บ" and own.words("กขคถังเก็บ")[-1] == "ถังเก็บ"
    # brute force: no segmentation of a short run is cheaper
    def cost(words):
        return sum(own.cost.get(w, sentences.UNKNOWN if len(w) == 1 else 1e9) for w in words)

    def every(run):
        return [[run[:k], *rest] for k in range(1, len(run) + 1) for rest in every(run[k:])] if run else [[]]

    for run in ("ต้องมีผู้", "について本", "したが弁は", "记录了泵"):
        assert abs(cost(own.words(run)) - min(map(cost, every(run)))) < 1e-9


def test_gaps_without_terminators_in_japanese_and_chinese():
    assert units("弁を閉じました ただし記録はない") == ["弁を閉じました", "ただし記録はない"]
    assert units("检查已经完了\n请勿打开旁路") == ["检查已经完了", "请勿打开旁路"]
    assert units("弁を 閉じる前に確認する。") == ["弁を 閉じる前に確認する。"]


def test_words_of_the_corpus(spark):
    import itertools

    heads, tails = ["検査員が", "配管を", "圧力計は"], ["開放した", "確認した", "交換する", "測定した"]
    texts = ["。".join(a + b for a, b in itertools.product(heads, tails))] * 3 + ["plain text", None, ""]
    got = set(sentences.corpus_words(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert {"検査員が", "配管を", "圧力計は"} <= got and "検査" not in got and "員が" not in got
    assert sentences.corpus_words(spark.createDataFrame([], "text string")) == ()


def test_headings_and_items():
    text = "5.3 Material certificates\n \n(a) record the reading\n(b) tighten all bolts\n\n- one\n- two\n\n1) first\n2) second\n\nScope\nThe first sentence of a longer paragraph stands here and goes\non. The next one."
    assert units(text) == ["5.3 Material certificates", "(a) record the reading", "(b) tighten all bolts", "- one", "- two", "1) first", "2) second", "Scope", "The first sentence of a longer paragraph stands here and goes\non.", "The next one."]


def test_null_empty_and_long():
    assert units("") == [] and sentences.sentence_spans(None) == [] and units(" \n\t ") == []
    assert units("no end") == ["no end"]
    many = "This is one. " * 20_000
    assert len(units(many)) == 20_000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\"“”«»()-。」ก", max_size=60))
def test_units_cover_the_text_in_order(text):
    spans = sentences.sentence_spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert sorted("".join("".join(text[a:b].split()) for a, b in spans)) == sorted("".join(text.split()))


def test_plan(spark):
    pages = spark.createDataFrame([(1, "TEXT_LAYER", "One. Two.", "c"), (1, "TEXT_LAYER", "One. Two.", "c"), (2, "OCR", "No.", "c"), (3, "TEXT_LAYER", None, "c"), (4, "TEXT_LAYER", "", "c")], "page_id long, text_source string, raw_text string, kind string")
    cases = spark.createDataFrame([(9, "Only one")], "case_no long, document_text string")
    got = sorted(tuple(r) for r in sentences.corpus_units(pages, cases).collect())
    assert got == [("benchmark", 9, 0, 8), ("page", 1, 0, 4), ("page", 1, 5, 9)]
    assert sentences.corpus_units(pages.limit(0), cases.limit(0)).count() == 0
