"""Sources mixed to target weights by subset-sum fitting of each source's budget.

Documents are counted by exact token length (source, length, count): this histogram, whose size is
bounded by the longest text, is all that reaches the driver. The largest mixture that no source
limits sets the budgets. Whole passes over a source come first; of the last pass each length gives
its proportional count. What remains is less than one document of each length; single documents at
random bring it below the width of the program's table, and the bounded-knapsack program fills the rest
as closely as lengths allow. Documents are then chosen by a seeded hash, so many for each length.

Defined results: null and empty texts take no part; a source without documents cannot contribute, its
share is spread over the others in proportion and it is reported with 0; sources that are no target
take no part; ties of the hash go by doc_id; without targets or documents there is no row.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import FOLDER, VOCABULARY, sized

#: Width of the knapsack program's table in tokens, and bits of the hash that part a length's documents for ranking.
KNAPSACK_TOKENS, PART_BITS = 1 << 16, 6


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length, so that the total comes closest to the budget without passing it."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    parent = np.full(budget + 1, -1, np.int32)
    chunks: list[tuple[int, int]] = []
    for length, count in zip(lengths, counts, strict=True):
        count, k = min(count, budget // length), 1
        while count > 0:  # counts in powers of two
            take = min(k, count)
            weight = take * length
            new = np.zeros(budget + 1, bool)
            new[weight:] = reach[: budget + 1 - weight]
            new &= ~reach
            parent[new] = len(chunks)
            chunks.append((length, take))
            reach |= new
            count -= take
            k *= 2
        if reach[budget]:
            break
    total = int(np.nonzero(reach)[0][-1])
    out: dict[int, int] = {}
    while total:
        length, take = chunks[parent[total]]
        out[length] = out.get(length, 0) + take
        total -= length * take
    return out


def choose(histogram: dict[int, int], budget: int, seed: int) -> dict[int, int]:
    """How many documents of each length make up the budget: proportional counts, single ones at random, then the knapsack."""
    whole = sum(k * n for k, n in histogram.items())
    if budget >= whole:
        return dict(histogram)
    chosen = {k: n * budget // whole for k, n in histogram.items()}
    left = budget - sum(k * n for k, n in chosen.items())
    order = sorted(histogram)
    random.Random(seed).shuffle(order)
    while left > KNAPSACK_TOKENS:
        before = left
        for k in order:
            if left <= KNAPSACK_TOKENS:
                break
            if chosen[k] < histogram[k] and k <= left:
                chosen[k] += 1
                left -= k
        if left == before:
            break
    some = [k for k in order if chosen[k] < histogram[k] and k <= left]
    for k, n in bounded_knapsack(some, [histogram[k] - chosen[k] for k in some], left).items():
        chosen[k] += n
    return chosen


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[dict[str, int], dict[str, float]]:
    """(token budget, share) of each source that can contribute; the total is the largest that none limits, unless given."""
    able = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    weight = sum(t[0] for t in able.values())
    share = {s: t[0] / weight for s, t in able.items()}
    most = min((available[s] * targets[s][1] / share[s] for s in able), default=0)
    total = most if total is None else min(total, most)
    return {s: int(share[s] * total + 1e-6) for s in able}, share


def _plan(spark: SparkSession, items: DataFrame, mix_targets: DataFrame, total: int | None, seed: int) -> tuple[DataFrame, dict, dict, dict, dict]:
    """The plan (source, n_tokens, passes, extra), and what it rests on."""
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in mix_targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").dropDuplicates(["source"]).collect()}
    rows = items.groupBy("source", "n_tokens").count().collect()  # one row for each source and exact length
    histogram: dict[str, dict[int, int]] = {}
    for r in rows:
        histogram.setdefault(r.source, {})[r.n_tokens] = r["count"]
    available = {s: sum(k * n for k, n in h.items()) for s, h in histogram.items()}
    budget, share = budgets(available, goal, total)
    plan = []
    for i, source in enumerate(sorted(budget)):
        passes = min(budget[source] // available[source], goal[source][1])
        rest = budget[source] - passes * available[source] if passes < goal[source][1] else 0
        extra = choose(histogram[source], rest, seed + i) if rest else {}
        plan += [(source, k, int(passes), int(extra.get(k, 0))) for k in histogram[source]]
    frame = spark.createDataFrame(plan or [("", 0, 0, 0)], "source string, n_tokens bigint, passes int, extra bigint")
    return frame, goal, available, budget, share


def _items(documents: DataFrame, mix_targets: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Sized documents of the target sources, written to the shared folder as two passes read them."""
    wanted = mix_targets.where("source IS NOT NULL").select(F.col("source").alias("wanted")).distinct()
    mine = documents.join(F.broadcast(wanted), F.col("source") == F.col("wanted"), "left_semi")
    return cut(sized(mine, folder, vocabulary).where("n_tokens > 0"))


def mixture(spark: SparkSession, documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 9, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, doc_id, n_tokens, uses): how often each chosen document is used."""
    items = _items(documents, mix_targets, folder, vocabulary)
    plan = _plan(spark, items, mix_targets, total, seed)[0].where("passes > 0 OR extra > 0")
    return _pick(items, plan, seed)


def _pick(items: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents of each (source, length) in the order of a seeded hash, as many as planned.

    The hash range is cut into parts; counts of the parts give where each begins, so no task ranks
    all documents of a length.
    """
    ranked = items.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.shiftrightunsigned("h", 64 - PART_BITS).cast("int"))
    sizes = ranked.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("begun", F.coalesce(F.sum("n").over(before), F.lit(0))).join(plan, ["source", "n_tokens"]).select("source", "n_tokens", "part", "begun", "passes", "extra")
    inside = Window.partitionBy("source", "n_tokens", "part").orderBy("h", "doc_id")
    placed = ranked.withColumn("rank", F.row_number().over(inside)).join(sizes, ["source", "n_tokens", "part"])
    uses = F.col("passes") + F.when(F.col("begun") + F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return placed.select("source", "doc_id", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")


def shares(spark: SparkSession, documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 9, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, budget_tokens, documents, used_tokens, most_uses, actual_share) of each target."""
    items = _items(documents, mix_targets, folder, vocabulary)
    plan, goal, available, budget, _ = _plan(spark, items, mix_targets, total, seed)
    used = _pick(items, plan.where("passes > 0 OR extra > 0"), seed).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    goals = spark.createDataFrame([(s, *t, available.get(s, 0), budget.get(s, 0)) for s, t in sorted(goal.items())] or [("", 0.0, 0, 0, 0)], "source string, target_share double, max_repeats int, available_tokens bigint, budget_tokens bigint").where("source <> ''")
    out = goals.join(F.broadcast(used), "source", "left").na.fill(0, ["documents", "used_tokens", "most_uses"])
    return spark.sql(
        """SELECT source, target_share, max_repeats, available_tokens, budget_tokens, documents, used_tokens, most_uses,
                  coalesce(try_divide(used_tokens, (SELECT sum(used_tokens) FROM {used})), 0D) AS actual_share FROM {out}""", used=used, out=out)  # fmt: skip
