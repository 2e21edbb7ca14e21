"""Files of a folder as rows: header checks, content hashes, text of word-processing files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an archive: entries, bytes when unpacked, ratio of unpacked to packed bytes; largest file.
ENTRIES, UNPACKED, RATIO, LARGEST = 2_000, 200_000_000, 100, 50_000_000
_REQUIRED = {"[Content_Types].xml", "word/document.xml"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, sha256, kind, reject_code, content) of each file; the kind follows the first bytes, not the name."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.when(F.substring("content", 1, 5) == F.lit(b"%PDF-"), "pdf").when(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"), "docx").otherwise("unknown")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[^\w.\- ]", "_")
    declared = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    out = read.select("path", name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), declared.alias("declared"), "content")
    code = F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > LARGEST, "TOO_LARGE").when(F.col("kind") == "unknown", "TYPE").when(F.col("declared") != F.col("kind"), "TYPE_CONFLICT").otherwise(F.when(F.col("kind") == "docx", archive_code("content")))
    return out.withColumn("reject_code", code).drop("declared")


def check_archive(content: bytes | None) -> str | None:
    """Why an archive is rejected, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            entries = z.infolist()
            if len(entries) > ENTRIES:
                return "ARCHIVE_ENTRIES"
            if any(e.flag_bits & 1 for e in entries):
                return "ARCHIVE_ENCRYPTED"
            if any(e.filename.startswith("/") or ".." in re.split(r"[\\/]", e.filename) for e in entries):
                return "ARCHIVE_PATH"
            size = sum(e.file_size for e in entries)
            if size > UNPACKED or size > RATIO * max(1, sum(e.compress_size for e in entries)):
                return "ARCHIVE_SIZE"
            return None if {e.filename for e in entries} >= _REQUIRED else "ARCHIVE_PARTS"
    except zipfile.BadZipFile:
        return "ARCHIVE_BROKEN"


def archive_code(column: str):
    from pyspark.sql.types import StringType

    return F.udf(check_archive, StringType())(F.col(column))


def paragraphs_of(content: bytes) -> list[tuple[int, str | None, str]]:
    """(seq, style, text) of the paragraphs of a word-processing file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for i, p in enumerate(root.iter(f"{_W}p")):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        out.append((i, None if style is None else style.get(f"{_W}val"), "".join(t.text or "" for t in p.iter(f"{_W}t"))))
    return out


def docx_items(accepted: DataFrame) -> DataFrame:
    """(path, seq, text, level, warning): paragraphs of accepted word-processing files; level by heading style, null for text.

    An unreadable file gives one row with a warning and no text, so no file stops the others.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for seq, style, text in paragraphs_of(content):
                        level = re.search(r"(?i)heading\s*([1-9])", style or "")
                        if text.strip():
                            rows.append((path, seq, text, int(level[1]) if level else None, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "seq", "text", "level", "warning"]).astype({"level": "Int32"})

    return accepted.where("kind = 'docx' AND reject_code IS NULL").select("path", "content").mapInPandas(read, "path string, seq int, text string, level int, warning string")
