"""Near-duplicate blocks within a document.

Equal texts fall together first; each distinct text is then compared with those that share enough of
its words. A prefix filter on words ordered by rarity keeps the candidates: two texts that share the
needed number of words share one of the rarer words of each. Lengths are banded into the join key, and
pairs carry keys and counts of characters only: what two texts have in common of each character bounds
their similarity from above, so most pairs end there. The similarity of sorted words is computed last, on
Arrow batches, with a bit-parallel longest common subsequence. Texts with fewer than two words in Latin
letters go by their words in any script, and by groups of three signs where there are no spaces.

Defined results: texts of fewer than thirty characters, in the margins of a page or boilerplate are no
candidates; each later block reports its first match; null texts give nothing; no candidate is capped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut

#: Similarity in percent, shortest block, largest relative difference of lengths, shortest word, share of words.
THRESHOLD, SHORTEST, LENGTH_GAP, WORD, SHARED = 85, 30, 0.35, 4, 0.2
#: Characters that are counted one by one (all others together), and scripts without spaces.
COUNTED, SPACELESS = "abcdefghijklmnopqrstuvwxyz0123456789 ", "\u0e01-\u0e5b\u3041-\u30ff\u3400-\u9fff"
# Boilerplate lines.
BOILERPLATE = ["confidential", "proprietary", "all rights reserved"]


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word operation for each sign of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity in percent: twice the common length over both lengths."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def blocks(spans: DataFrame) -> DataFrame:
    """(doc_id, item_id, seq, page_index, clean) of the candidate blocks."""
    once = spans.dropDuplicates(["item_id"]).where("text IS NOT NULL").select("doc_id", "item_id", "seq", "bbox.*", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("clean"))
    margin = (F.col("page_height") > 0) & ((F.col("y1") <= F.col("page_height") * 0.08) | (F.col("y0") >= F.col("page_height") * 0.92))
    plain = F.lower("clean").rlike(r"^page\s+[0-9]+(\s+of\s+[0-9]+)?$") | F.lower("clean").isin(BOILERPLATE)
    return once.where((F.length("clean") >= SHORTEST) & ~F.coalesce(margin, F.lit(False)) & ~plain).select("doc_id", "item_id", "seq", "page_index", "clean")


def near_duplicates(spans: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, page_index, first_item, first_page, similarity) of each block that repeats an earlier one."""
    every = blocks(spans)
    order = F.struct("page_index", "seq", "item_id")
    # distinct texts of a document with their first block; copies of it are found without comparing
    texts = every.groupBy("doc_id", "clean").agg(F.min(order).alias("first")).withColumn("text_key", F.xxhash64("doc_id", "clean"))
    low = F.lower("clean")
    latin = F.array_distinct(F.regexp_extract_all(low, F.lit(f"[a-z0-9]{{{WORD},}}"), 0))
    other = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}&&[^{SPACELESS}]]{{{WORD},}}"), 0), F.regexp_extract_all(low, F.lit(f"(?=([{SPACELESS}]{{3}}))"), 1)))
    # what the texts are made of is read five times below: written once
    made = cut(texts.select("doc_id", "text_key", "first", F.length("clean").alias("n"), F.when(F.size(latin) >= 2, latin).otherwise(other).alias("words"), F.array_join(F.array_sort(F.split(low, " ")), " ").alias("sorted")))
    words = made.where("size(words) >= 2")
    df = words.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("df"))
    ranked = words.select("doc_id", "text_key", "n", F.size("words").alias("size"), F.explode("words").alias("word")).join(df, ["doc_id", "word"]).groupBy("doc_id", "text_key", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    # a pair needs max(2, ceil(0.2 * its fewer words, up to twelve)) in common; two is the least, so a prefix leaves one word out
    prefix = ranked.withColumn("k", F.explode(F.slice("w", 1, F.col("size") - 1))).select("doc_id", "text_key", "n", F.col("k.word").alias("word"), F.floor(F.log(F.col("n").cast("double")) / F.lit(0.43078)).cast("int").alias("band"))
    a = prefix.select("doc_id", "word", F.col("text_key").alias("a"), F.col("n").alias("na"), F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"))
    b = prefix.select("doc_id", "word", F.col("text_key").alias("b"), F.col("n").alias("nb"), "band")
    # a common subsequence is no longer than the shorter text, so the threshold bounds the lengths too
    near = f"a < b AND abs(na - nb) <= {LENGTH_GAP} * greatest(na, nb) AND 200.0 * least(na, nb) >= {threshold} * (na + nb)"
    pairs = a.join(b, ["doc_id", "word", "band"]).where(near).select("a", "b").distinct()
    counts = F.array(*[F.length("sorted") - F.length(F.replace("sorted", F.lit(c), F.lit(""))) for c in COUNTED])
    side = words.withColumn("least", F.expr(f"greatest(2, cast(ceil(least(size(words), 12) * {SHARED}) as int))")).withColumn("counts", counts).withColumn("rest", F.col("n") - F.aggregate("counts", F.lit(0), lambda s, x: s + x))
    left = side.select(F.col("text_key").alias("a"), "doc_id", F.col("n").alias("na"), F.col("first").alias("fa"), F.col("words").alias("wa"), F.col("sorted").alias("sa"), F.col("least").alias("la"), F.col("counts").alias("ca"), F.col("rest").alias("ra"))
    right = side.select(F.col("text_key").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb"), F.col("words").alias("wb"), F.col("sorted").alias("sb"), F.col("least").alias("lb"), F.col("counts").alias("cb"), F.col("rest").alias("rb"))
    common = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.least("ra", "rb"), lambda s, x: s + x)
    judged = pairs.join(left, "a").join(right, "b").where((200.0 * common >= threshold * (F.col("na") + F.col("nb"))) & (F.size(F.array_intersect("wa", "wb")) >= F.least("la", "lb")))
    similar = judged.withColumn("similarity", _ratio("sa", "sb")).where(F.col("similarity") >= threshold)
    earlier = similar.select("doc_id", F.greatest("fa", "fb").alias("later"), F.least("fa", "fb").alias("first"), "similarity")
    linked = earlier.groupBy("doc_id", F.col("later.item_id").alias("text_first")).agg(F.min_by(F.struct("first", "similarity"), "first").alias("m"))
    # each block: a copy of its text's first block, or, being that first block, its text's first match
    own = every.withColumn("text_key", F.xxhash64("doc_id", "clean")).drop("clean").join(made.select("doc_id", "text_key", "first"), ["doc_id", "text_key"]).select("doc_id", "item_id", "page_index", "first")
    matched = own.withColumn("text_first", F.col("first.item_id")).join(linked, ["doc_id", "text_first"], "left")
    copy = F.col("item_id") != F.col("first.item_id")
    anchor = F.when(F.col("m").isNotNull(), F.col("m.first")).when(copy, F.col("first"))
    return matched.where(copy | F.col("m").isNotNull()).select("doc_id", "item_id", "page_index", anchor["item_id"].alias("first_item"), anchor["page_index"].alias("first_page"), F.when(F.col("m").isNotNull(), F.col("m.similarity")).otherwise(100.0).alias("similarity"))
