"""Containers of fixed capacity filled with items, by first-fit decreasing in randomised groups.

A hash of the item key spreads the items over groups of bounded size, so no group depends on how keys,
sources or lengths are distributed. In each group the items go by decreasing size into the first bin
with room; a tournament tree over the bins' free room finds it in logarithmic time. An item larger
than the capacity is cut into full pieces and a rest; all others stay whole.

Defined results: a null text is no item; an empty text is an item of size 0 and takes no room; equal
items are packed each; without items or containers there is no row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import FOLDER, VOCABULARY, sized

#: Items of a group on average; more cost time, fewer cost room in each group's last bins.
GROUP_ITEMS = 8_000


class Tournament:
    """Free room of bins in a complete binary tree; each node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for the size; the room is taken."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        bin_no = node - self.leaves
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return bin_no


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes at most the capacity, in decreasing order."""
    if not sizes:
        return []
    total = sum(sizes)
    # first fit leaves at most one bin half empty, so twice the total is room enough
    tree = Tournament(min(len(sizes), 2 * total // capacity + 2), capacity)
    return [tree.place(s) for s in sizes]


def assign(documents: DataFrame, containers: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, doc_id, start_token, n_tokens) of every piece."""
    items = sized(documents, folder, vocabulary).select("doc_id", "n_tokens")
    # the kinds are a small fixed table: they become one array that every item is exploded by
    kinds = [(r.container_kind, r.capacity_tokens) for r in containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()]
    each_kind = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity_tokens")) for k, c in kinds] or [F.lit(None).cast("struct<container_kind:string,capacity_tokens:bigint>")])
    groups = max(1, -(-documents.count() // GROUP_ITEMS))
    # each item meets the few container kinds; long items are cut into pieces here
    each = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(groups))).withColumn("k", F.explode(each_kind)).where("k IS NOT NULL").select("doc_id", "n_tokens", "grp", "k.*")
    pieces = each.withColumn("piece", F.explode(F.expr("sequence(0L, greatest(0L, (n_tokens - 1) div capacity_tokens))"))).select(
        "container_kind", "capacity_tokens", "grp", "doc_id", (F.col("piece") * F.col("capacity_tokens")).alias("start_token"),
        F.expr("least(capacity_tokens, n_tokens - piece * capacity_tokens)").alias("n_tokens"),
    )
    # full pieces fill a container by themselves, wherever they are
    whole = pieces.where("n_tokens = capacity_tokens").select("container_kind", "capacity_tokens", F.expr("concat('w', doc_id, '-', start_token)").alias("container_id"), "doc_id", "start_token", "n_tokens")
    schema = "container_kind string, capacity_tokens bigint, container_id string, doc_id bigint, start_token bigint, n_tokens bigint"

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        kind, capacity, group = (k.as_py() for k in key)
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("start_token", "ascending")])
        bins = first_fit_decreasing(table.column("n_tokens").to_pylist(), capacity)
        return pa.table({
            "container_kind": pa.array([kind] * len(bins), pa.string()), "capacity_tokens": pa.array([capacity] * len(bins), pa.int64()),
            "container_id": pa.array([f"g{group}-{b}" for b in bins], pa.string()), "doc_id": table.column("doc_id").cast(pa.int64()),
            "start_token": table.column("start_token").cast(pa.int64()), "n_tokens": table.column("n_tokens").cast(pa.int64()),
        })

    return pieces.where("n_tokens < capacity_tokens").groupBy("container_kind", "capacity_tokens", "grp").applyInArrow(pack, schema).unionByName(whole)


def fill(assigned: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, containers, items, tokens, least_containers, filled) of an assignment."""
    per = assigned.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return per.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"),
        F.ceil(F.sum("tokens") / F.first("capacity_tokens")).alias("least_containers"), (F.sum("tokens") / (F.count("*") * F.first("capacity_tokens"))).alias("filled"),
    )
