"""Language of each page and of each of its paragraphs, with a confidence.

Multinomial naive Bayes over hashed character n-grams. The labels that come with the pages are noisy,
so the model is fitted twice: once on all training paragraphs, and again without those that the first
model assigns elsewhere. Counting happens in the executors (each batch adds up its own counts before
the shuffle); only the matrix of log probabilities, whose size is fixed, reaches the driver and is
sent back to the workers. Scoring gathers rows of that matrix and adds them up per paragraph in numpy.

Defined results: null and empty pages give no paragraph; a paragraph without letters gets no language
and confidence 0; a label that names no known language counts as none; a redelivered page counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Language codes with the spellings of labels that name them.
LABELS = {
    "en": "en eng english",
    "id": "id ind indonesian",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french",
    "es": "es spa spanish",
    "pt": "pt por portuguese",
    "ru": "ru rus russian",
    "zh": "zh zho chi chinese",
    "ja": "ja jpn japanese",
    "th": "th tha thai",
}
LANGS = list(LABELS)
#: n-gram lengths, buckets they are hashed to, and the weight of an unseen n-gram.
ORDERS, BUCKETS, SMOOTHING = (1, 2, 3), 1 << 15, 0.5
#: Bound of the labelled pages the model is fitted on; beyond it a hash of the page id thins them out.
TRAIN_PAGES = 60_000
#: Characters scored at once; bounds the memory of a worker.
CHUNK_CHARS = 200_000

_NAMED = {spelling: code for code, spellings in LABELS.items() for spelling in spellings.split()}


def named_language(label: str | None) -> str | None:
    """The language a label names: case and region ('en-US', 'pt_BR') don't matter."""
    return _NAMED.get((label or "").strip().lower().replace("_", "-").split("-")[0])


def paragraphs(text: str | None) -> list[str]:
    """Runs of non-blank lines."""
    out: list[str] = []
    lines: list[str] = []
    for line in (text or "").split("\n"):
        if line.strip():
            lines.append(line)
        elif lines:
            out.append("\n".join(lines))
            lines = []
    if lines:
        out.append("\n".join(lines))
    return out


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, index of its text): letters in lower case, all else as a space, one space before each text."""
    codes = np.frombuffer((" " + " ".join(texts)).lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if texts else np.empty(0, np.uint64)
    lengths = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = (codes >= 128) & ~((codes >= 0x2000) & (codes < 0x2070)) & (codes != 0xA0) | (codes >= 97) & (codes < 123)
    codes = np.where(letter, codes, np.uint64(32))
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                continue
            m = len(codes) - n + 1
            h = np.full(m, n, np.uint64)
            some = np.zeros(m, bool)
            for i in range(n):
                h = (h * np.uint64(1_000_003)) ^ codes[i : i + m]
                some |= letter[i : i + m]
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
            keep = some & (owner[:m] == owner[n - 1 :])
            buckets.append(h[keep].astype(np.int64))
            owners.append(owner[:m][keep])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts longer than a chunk in pieces, and the text each piece belongs to."""
    out, owner = [], []
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t)), CHUNK_CHARS):
            out.append(t[k : k + CHUNK_CHARS])
            owner.append(i)
    return out, np.array(owner, np.int64)


def scores(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log score of each text by language, number of its n-grams)."""
    if any(len(t) > CHUNK_CHARS for t in texts):
        pieces, of = _pieces(texts)
        by_piece, n = scores(pieces, model)
        total = np.stack([np.bincount(of, by_piece[:, i], len(texts)) for i in range(model.shape[1])], 1)
        return total, np.bincount(of, n, len(texts)).astype(np.int64)
    total, count = np.zeros((len(texts), model.shape[1])), np.zeros(len(texts), np.int64)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK_CHARS):
            size += len(texts[end])
            end += 1
        bucket, owner = hashed(texts[start:end])
        # sparse rows: distinct (text, bucket) with their counts
        pair, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
        rows, cols = pair // BUCKETS, pair % BUCKETS
        for i in range(model.shape[1]):
            total[start:end, i] += np.bincount(rows, model[cols, i] * times, end - start)
        count[start:end] += np.bincount(owner, minlength=end - start)
        start = end
    return total, count


def decide(total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language or -1, its posterior probability)."""
    if not len(total):
        return np.empty(0, np.int64), np.empty(0)
    # n-grams overlap, so their evidence is counted at the weight of one order
    z = (total - total.max(1, keepdims=True)) / len(ORDERS)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    best = np.where(count > 0, total.argmax(1), -1)
    return best, np.where(count > 0, p.max(1), 0.0)


def _counts(pages: DataFrame, model: np.ndarray | None) -> np.ndarray:
    """Counts (bucket by language) over labelled pages (lang, raw_text), added up in the executors."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGS), BUCKETS), np.int64)
        for batch in batches:
            texts, labels = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if code := named_language(lang):
                    own = paragraphs(text)
                    texts += own
                    labels += [LANGS.index(code)] * len(own)
            if not texts:
                continue
            label = np.array(labels)
            if sent.value is not None:
                best, _ = decide(*scores(texts, sent.value))
                keep = best == label
                texts, label = [t for t, k in zip(texts, keep, strict=True) if k], label[keep]
            texts, of = _pieces(texts)
            label = label[of]
            for k in range(0, len(texts), 500):
                bucket, owner = hashed(texts[k : k + 500])
                sums += np.bincount(label[k + owner] * BUCKETS + bucket, minlength=sums.size).reshape(sums.shape) if len(bucket) else 0
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket])], names=["lang", "bucket", "n"])

    rows = pages.select("lang", "raw_text").mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((BUCKETS, len(LANGS)))
    out[rows.column("bucket").to_numpy(), rows.column("lang").to_numpy()] = rows.column("n").to_numpy()
    return out


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    p = counts + SMOOTHING
    out = np.log(p / p.sum(0))
    out[:, counts.sum(0) == 0] -= 50.0  # a language without training text is never chosen
    return out


def fit(pages: DataFrame, bound: int = TRAIN_PAGES) -> np.ndarray:
    """Log probabilities (bucket by language) from labelled pages (page_id, lang, raw_text)."""
    labelled = pages.where("raw_text IS NOT NULL AND lang IS NOT NULL").select("page_id", "lang", "raw_text")
    n = labelled.count()
    if n > bound:
        labelled = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    labelled = labelled.dropDuplicates(["page_id"])  # about the bound's pages at most; a redelivered one counts once
    model = _log_probabilities(_counts(labelled, None))
    return _log_probabilities(_counts(labelled, model))


def text_pages(pdf_pages: DataFrame) -> DataFrame:
    """(page_id, lang, raw_text) of the text-layer pages, each once."""
    return pdf_pages.where("text_source = 'TEXT_LAYER'").select("page_id", "lang", "raw_text")


def segments(spark: SparkSession, pages: DataFrame, model: np.ndarray) -> DataFrame:
    """(page_id, declared, para_no, n_chars, lang, confidence, page_lang, page_confidence) of each paragraph."""
    sent = spark.sparkContext.broadcast(model)
    schema = "page_id bigint, declared string, para_no int, n_chars int, lang string, confidence double, page_lang string, page_confidence double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, declared, numbers, texts, page = [], [], [], [], []
            for i, (key, label, text) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                for j, paragraph in enumerate(paragraphs(text)):
                    ids.append(key)
                    declared.append(named_language(label))
                    numbers.append(j)
                    texts.append(paragraph)
                    page.append(i)
            total, count = scores(texts, sent.value)
            best, sure = decide(total, count)
            page = np.array(page, np.int64)
            whole, every = np.zeros((batch.num_rows, len(LANGS))), np.zeros(batch.num_rows, np.int64)
            np.add.at(whole, page, total)
            np.add.at(every, page, count)
            page_best, page_sure = decide(whole, every)
            name = lambda k: LANGS[k] if k >= 0 else None
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(declared, pa.string()), pa.array(numbers, pa.int32()), pa.array([len(t.strip()) for t in texts], pa.int32()),
                 pa.array([name(k) for k in best], pa.string()), pa.array(sure, pa.float64()), pa.array([name(k) for k in page_best[page]], pa.string()), pa.array(page_sure[page], pa.float64())],
                names=["page_id", "declared", "para_no", "n_chars", "lang", "confidence", "page_lang", "page_confidence"],
            )

    return pages.select("page_id", "lang", "raw_text").mapInArrow(assign, schema)


#: A paragraph shorter than this many characters is not reported.
REPORT_CHARS = 30


def mislabelled(spark: SparkSession, pdf_pages: DataFrame) -> DataFrame:
    """(page_id, para_no, lang) of paragraphs whose language is not the declared one, or where none is declared."""
    pages = text_pages(pdf_pages)
    found = segments(spark, pages, fit(pages)).where(f"lang IS NOT NULL AND n_chars >= {REPORT_CHARS} AND (declared IS NULL OR declared <> lang)")
    return found.select("page_id", "para_no", "lang").dropDuplicates(["page_id", "para_no"])
