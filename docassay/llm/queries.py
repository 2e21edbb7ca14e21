"""Queries and comparison SQL of the operators on training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import confusables, langid, mixing, ocr_repair, packing, pii, sentences


def _p3_forms(spark: SparkSession, d: str) -> DataFrame:
    items = confusables.items(table(spark, d, "headings"), table(spark, d, "spans")).dropDuplicates(["item_id"])
    return confusables.consistent(items, "text").select("item_id", "doc_id", "form")


def _p6_segments(spark: SparkSession, d: str) -> DataFrame:
    pages = langid.text_pages(table(spark, d, "pdf_pages"))
    return langid.segments(spark, pages, langid.fit(pages)).dropDuplicates(["page_id", "para_no"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: sentences.corpus_units(table(s, d, "pdf_pages"), table(s, d, "benchmarks")),
        "p3_found": lambda s, d: confusables.alike(table(s, d, "headings"), table(s, d, "spans")),
        "p3_forms": _p3_forms,
        "p5_found": lambda s, d: ocr_repair.defects(s, table(s, d, "pdf_pages")),
        "p5_paragraphs": lambda s, d: ocr_repair.paragraphs(s, table(s, d, "pdf_pages")),
        "p6_found": lambda s, d: langid.mislabelled(s, table(s, d, "pdf_pages")),
        "p6_segments": _p6_segments,
        "p8_assign": lambda s, d: packing.assign(table(s, d, "documents"), table(s, d, "containers")),
        "p8_fill": lambda s, d: packing.fill(packing.assign(table(s, d, "documents"), table(s, d, "containers"))),
        "p9_mix": lambda s, d: mixing.mixture(s, table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.shares(s, table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: pii.found(s, table(s, d, "documents")),
        "p10_redacted": lambda s, d: pii.redacted(s, table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    # the form character by character: each is looked up in one table, twice, as in between accents are composed
    items = "(SELECT item_id, any_value(doc_id) AS doc_id, any_value(text) AS text FROM (SELECT item_id, doc_id, text FROM headings UNION ALL SELECT item_id, doc_id, text FROM spans) GROUP BY item_id)"
    mapped = {**confusables._common(), **confusables._rare(), **confusables.ROMAN, **{k: v for k, v in confusables.LIGATURES.items() if len(k) == 1}}
    rows = ", ".join(f"({ord(k)}, {confusables._quoted(v)})" for k, v in mapped.items())
    gone = " OR ".join(f"ascii(c) BETWEEN {a} AND {b}" for a, b in ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)))
    one = "SELECT item_id, doc_id, text, nfc_normalize(coalesce(string_agg(coalesce(t, c), '' ORDER BY i), '')) AS form FROM (SELECT item_id, doc_id, text, unnest(string_split({form}, '')) AS c, unnest(range(len(string_split({form}, '')))) AS i FROM {of}) u LEFT JOIN m ON m.k = ascii(c) WHERE c = '' OR NOT ({gone}) GROUP BY item_id, doc_id, text"
    am = "replace({x}, chr(3661) || chr(3634), chr(3635))"
    forms = f"""WITH m(k, t) AS (VALUES {rows}), a AS (SELECT item_id, doc_id, text, nfc_normalize(text) AS form FROM {items} WHERE text IS NOT NULL),
        b AS ({one.format(form=am.format(x="form"), of="a", gone=gone)}), f AS ({one.format(form="form", of="b", gone=gone)})"""
    return {
        "p3_forms": f"{forms} SELECT item_id, doc_id, form FROM f UNION ALL SELECT item_id, doc_id, NULL FROM {items} WHERE text IS NULL",
        "p3_found": f"{forms} SELECT a.item_id AS item_a, b.item_id AS item_b FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.form = b.form AND a.item_id < b.item_id AND a.text <> b.text",
    }
