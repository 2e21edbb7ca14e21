"""Language of paragraphs: held-out accuracy, mixed pages, wrong and missing labels."""

import numpy as np

from docassay.llm import langid

TEXTS = {
    "en": ["The pump was opened during the shutdown and showed a worn bearing.", "Thickness readings ranged over the whole shell course.", "The owner asked for a second opinion before the repair."],
    "de": ["Die Pumpe wurde während des Stillstands geöffnet und zeigte ein Lager.", "Der Gutachter empfiehlt, die Messung zu wiederholen.", "Zwischen Zeichnung und Datenblatt besteht ein Unterschied."],
    "fr": ["La pompe a été ouverte pendant l'arrêt et présente un roulement usé.", "L'inspecteur recommande de répéter la mesure.", "Un écart subsiste entre le plan et la fiche technique."],
    "ru": ["Насос был вскрыт во время останова и показал износ.", "Эксперт рекомендует повторить измерение.", "Между чертежом и листом данных имеется расхождение."],
    "zh": ["检查人员在泵房打开输送管线，发现轻微腐蚀。", "建议在十周内重新测量输送管线的厚度，并记录结果。", "图纸与数据表之间相差三十毫米，须由负责人确认。"],
}
PAGE = "page_id long, lang string, raw_text string, text_source string, declared string"


def pages(spark, rows):
    return spark.createDataFrame([(i, lang, text, "TEXT_LAYER", "clash") for i, (lang, text) in enumerate(rows)], PAGE)


def training(spark):
    rows = [(label, "\n\n".join(t[i:] + t[:i])) for lang, t in TEXTS.items() for label in (lang, lang.upper()) for i in range(3)] * 3
    wrong = [("en", TEXTS["de"][0]), ("fr", TEXTS["en"][1])]
    return pages(spark, rows + wrong)


HELD_OUT = {"en": "Scaffolding blocked the view of the vessel until the afternoon.", "de": "Das Sicherheitsventil ist bis zum nächsten Stillstand zu ersetzen.", "fr": "Le réservoir tampon a été ouvert dans le parc de stockage.", "ru": "Перед вскрытием требуется разрешение владельца участка.", "zh": "打开设备之前须取得区域负责人的许可。"}


def test_held_out(spark):
    model = langid.fit(training(spark))
    best, sure = langid.decide(*langid.scores(list(HELD_OUT.values()), model))
    assert [langid.LANGS[i] for i in best] == list(HELD_OUT) and (sure > 0.8).all()


def test_mislabelled_paragraphs(spark):
    long = lambda lang: HELD_OUT[lang] + " " + TEXTS[lang][1]
    rows = [("en-US", long("en") + "\n \n\n" + long("de")), (None, long("fr")), ("und", "12.5\n13.4"), ("de", long("de")), ("de", ""), ("xx", long("ru")), ("fr", None)]
    train = training(spark)
    new = pages(spark, rows).selectExpr("page_id + 1000 AS page_id", "lang", "raw_text", "text_source", "declared")
    both = train.unionByName(new).unionByName(new)
    got = {(r.page_id, r.para_no): r.lang for r in langid.mislabelled(spark, both).where("page_id >= 1000").collect()}
    assert got == {(1000, 1): "de", (1001, 0): "fr", (1005, 0): "ru"}


def test_labels_and_paragraphs():
    assert [langid.named_language(x) for x in ("EN", "en-US", "pt_BR", "English", "ger", "und", "", None, "unknown")] == ["en", "en", "pt", "en", "de", None, None, None, None]
    assert langid.paragraphs("\n a\nb\n \n\nc") == [" a\nb", "c"] and langid.paragraphs(None) == [] and langid.paragraphs("") == []


def test_long_texts_are_scored_whole():
    model = np.log(np.random.default_rng(0).dirichlet(np.ones(langid.BUCKETS), len(langid.LANGS)).T)
    text = "the pump was opened "
    one, n = langid.scores([text * 30_000], model)
    assert n[0] > 1_500_000 and np.isfinite(one).all()
    short, k = langid.scores([text * 10, text * 10], model)
    assert np.allclose(short[0], short[1]) and k[0] == k[1]


def test_no_pages(spark):
    empty = training(spark).limit(0)
    assert langid.mislabelled(spark, empty).count() == 0


def test_redelivered_pages_count_once_in_the_fit(spark):
    import numpy as np

    rows = [(1, "en", "the pump was opened and the valve was closed again"), (2, "de", "die Pumpe wurde geöffnet und das Ventil wieder geschlossen")]
    once, again = spark.createDataFrame(rows, "page_id long, lang string, raw_text string"), spark.createDataFrame(rows + rows[:1] * 9, "page_id long, lang string, raw_text string")
    assert np.allclose(langid.fit(once), langid.fit(again))
