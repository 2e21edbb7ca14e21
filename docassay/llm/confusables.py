"""Visually identical texts brought to one form of characters.

DuckDB runs inside each Arrow batch: ``translate`` maps compatibility forms, look-alike letters and
spaces, ``regexp_replace`` drops invisible characters, ``replace`` resolves ligatures, and
``nfc_normalize`` composes accents before and after. Case, superscripts, accents and punctuation stay.

Defined results: null stays null, an empty text stays empty; items equal as stored make no pair;
a redelivered item counts once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that have the shape of a Latin letter, with that letter.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹονϲϳ", "ABEZHIKMNOPTYXCovcj")
ARMENIAN = ("ՕՏՍհոսօց", "OSUhnuog")
CHEROKEE = ("ᎪᎳᎬᎻᏚᏞᏢᎠᎢᏃᏦᎷᏤᏟ", "AWEHSLPDTZKMVC")
# Composed letters of other scripts with the shape of a composed Latin letter.
COMPOSED = ("ЁёЇїЀѐӒӓӐӑӦӧΆΈΊΌΎό", "ËëÏïÈèÄäĂăÖöÁÉÍÓÝó")
# Signs with the shape of another sign (micro sign, hyphens, colon and slash forms).
SIGNS = ("µ‐‑﹣∶∕", "μ---:/")
# Spaces other than U+0020.
SPACES = "               　"
# Ligatures and digraphs with their letters, and the Thai vowel am in two signs.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "ํา": "ำ"}
# Roman numerals that are one character, with their letters, and where all rare forms stand.
ROMAN = {chr(c): x for c in range(0x2160, 0x2180) if (x := unicodedata.normalize("NFKC", chr(c))) != chr(c)}
RARE = "[\u2160-\u217f\uff61-\uff9f\U0001d400-\U0001d7ff\u0531-\u0586\u13a0-\u13f5]"
#: Characters that leave no mark: soft hyphen, joiners, zero-width spaces, direction marks, selectors.
INVISIBLE = "[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]"
#: DuckDB's memory in one Python worker.
MEMORY = "200MB"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _common() -> dict[str, str]:
    """Characters that map to one other: full-width forms, Cyrillic, Greek, signs and spaces."""
    pairs: dict[str, str] = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
    pairs.update({"￠": "¢", "￡": "£", "￢": "¬", "￥": "¥", "￦": "₩"})
    for source, target in (CYRILLIC, GREEK, COMPOSED, SIGNS):
        pairs.update(zip(source, target, strict=True))
    pairs.update(dict.fromkeys(SPACES, " "))
    return pairs


def _rare() -> dict[str, str]:
    """Half-width syllables and marks, letters and digits of formulas (their compatibility form is one character), Armenian, Cherokee."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFFA0)}
    pairs.update({chr(c): x for c in range(0x1D400, 0x1D800) if len(x := unicodedata.normalize("NFKC", chr(c))) == 1 and x != chr(c)})
    for source, target in (ARMENIAN, CHEROKEE):
        pairs.update(zip(source, target, strict=True))
    return pairs


def _form(column: str, pairs: dict[str, str], ligatures: dict[str, str]) -> str:
    source, target = "".join(pairs), "".join(pairs.values())
    # the second translation catches look-alikes that the first normalisation composed
    expression = f"regexp_replace(nfc_normalize({column}), {_quoted(INVISIBLE)}, '', 'g')"
    for ligature, letters in ligatures.items():
        expression = f"replace({expression}, {_quoted(ligature)}, {_quoted(letters)})"
    return f"nfc_normalize(translate(nfc_normalize(translate({expression}, {_quoted(source)}, {_quoted(target)})), {_quoted(source)}, {_quoted(target)}))"


def form_sql(column: str = "text") -> str:
    """The DuckDB expression of the consistent form; every step is a DuckDB function.

    Texts with a rare form go through the whole table; for all others, which it doesn't change, a short one is enough.
    """
    whole = _form(column, {**_common(), **_rare()}, {**LIGATURES, **ROMAN})
    return f"CASE WHEN regexp_matches({column}, {_quoted(RARE)}) THEN {whole} ELSE {_form(column, _common(), LIGATURES)} END"


def consistent(df: DataFrame, column: str, out: str = "form") -> DataFrame:
    """All columns, and the consistent form of a text column."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": True})
        sql = f"SELECT CASE WHEN text IS NULL OR regexp_full_match(text, '[\\x00-\\x7f]*') THEN text ELSE {form_sql()} END AS form FROM piece"
        for batch in batches:
            piece = pa.table({"text": batch.column(batch.schema.get_field_index(column)).cast(pa.string())})
            con.register("piece", piece)
            form = con.sql(sql).to_arrow_table().column("form").combine_chunks()
            con.unregister("piece")
            if isinstance(form, pa.ChunkedArray):
                form = pa.concat_arrays(form.chunks) if form.num_chunks else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form.cast(pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def items(headings: DataFrame, spans: DataFrame) -> DataFrame:
    """(item_id, doc_id, text) of headings and spans together."""
    return headings.select("item_id", "doc_id", "text").unionByName(spans.select("item_id", "doc_id", "text"))


def alike(headings: DataFrame, spans: DataFrame) -> DataFrame:
    """(item_a, item_b): items of one document whose texts look the same and differ as stored.

    Only groups that hold two different stored texts are paired; groups of equal copies, however
    large, end in the aggregation.
    """
    formed = consistent(items(headings, spans).where("text IS NOT NULL"), "text")
    # a group is named by the hash of its form, its members by the hash of the stored text: the texts stay behind
    keyed = formed.select("doc_id", "item_id", F.xxhash64("form", "doc_id").alias("look"), F.xxhash64("text").alias("stored"), F.hash("form").alias("look2"))
    mixed = keyed.groupBy("doc_id", "look", "look2").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("doc_id", "look", "look2")
    members = keyed.join(mixed, ["doc_id", "look", "look2"], "left_semi").dropDuplicates(["item_id"])
    a = members.select("doc_id", "look", "look2", F.col("item_id").alias("item_a"), F.col("stored").alias("stored_a"))
    b = members.select("doc_id", "look", "look2", F.col("item_id").alias("item_b"), F.col("stored").alias("stored_b"))
    return a.join(b, ["doc_id", "look", "look2"]).where("item_a < item_b AND stored_a <> stored_b").select("item_a", "item_b")
