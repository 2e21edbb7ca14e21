"""Containers and mixtures: exactness of the inner algorithms, whole items, shares."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docassay.llm import mixing, packing, tokens

DOC = "doc_id long, text string, source string, n_tokens string"


def naive_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 90))
def test_tournament_is_first_fit(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    assert packing.first_fit_decreasing(sizes, capacity) == naive_first_fit(sizes, capacity)


def documents(spark, n=300):
    rows = [(i, ("pump valve seal " * (1 + i * 7 % 120)).strip(), "abc"[i % 3], "clash") for i in range(n)]
    return spark.createDataFrame([*rows, (n, "", "a", ""), (n + 1, None, "a", ""), (n + 2, "word " * 3000, None, "")], DOC)


def test_assignment_keeps_items_whole(spark):
    docs = documents(spark)
    kinds = spark.createDataFrame([("small", 100), ("large", 1000)], "container_kind string, capacity_tokens long")
    rows = packing.assign(docs, kinds).collect()
    own = tokens.encoding()
    size = {r.doc_id: len(own.encode_ordinary(r.text)) for r in docs.where("text IS NOT NULL").collect()}
    for kind, capacity in (("small", 100), ("large", 1000)):
        mine = [r for r in rows if r.container_kind == kind]
        for key, group in itertools.groupby(sorted(mine, key=lambda r: r.container_id), key=lambda r: r.container_id):
            assert sum(r.n_tokens for r in group) <= capacity, key
        for doc, n in size.items():
            parts = sorted((r.start_token, r.n_tokens) for r in mine if r.doc_id == doc)
            assert sum(p[1] for p in parts) == n and (len(parts) == 1 or n > capacity)
            assert all(a + b == c for (a, b), (c, _) in itertools.pairwise(parts))
    full = {r.container_kind: r for r in packing.fill(packing.assign(docs, kinds)).collect()}
    assert full["large"].filled > 0.95 and full["large"].containers <= 1.1 * full["large"].least_containers
    assert packing.assign(docs.limit(0), kinds).count() == 0 and packing.assign(docs, kinds.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 60))
def test_knapsack_is_exact(histogram, budget):
    chosen = mixing.bounded_knapsack(list(histogram), list(histogram.values()), budget)
    total = sum(k * n for k, n in chosen.items())
    sums = {0}
    for k, n in histogram.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert total == max(s for s in sums if s <= budget) and all(n <= histogram[k] for k, n in chosen.items())


def test_choose_comes_close():
    histogram = {k: 50 + k % 7 for k in range(20, 400)}
    chosen = mixing.choose(histogram, 1_234_567, 3)
    assert sum(k * n for k, n in chosen.items()) == 1_234_567 and all(n <= histogram[k] for k, n in chosen.items())


def test_mixture(spark):
    docs = documents(spark)
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("missing", 0.1, 4)], "source string, target_share double, max_repeats int")
    rows = mixing.mixture(spark, docs, goals).collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.uses <= cap[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    got = {r.source: r for r in mixing.shares(spark, docs, goals).collect()}
    assert got["missing"].actual_share == 0 and sum(r.actual_share for r in got.values()) == pytest.approx(1)
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert got[s].actual_share == pytest.approx(want, abs=0.002) and got[s].used_tokens <= got[s].budget_tokens
    again = mixing.mixture(spark, docs.repartition(7), goals).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.mixture(spark, docs.limit(0), goals).count() == 0 and mixing.shares(spark, docs, goals.limit(0)).count() == 0


def test_long_texts_are_counted_whole():
    own = tokens.encoding()
    text = "The pump was opened. " * 20_000
    assert tokens.count_tokens(text, own) == len(own.encode_ordinary(text))


def test_token_counts_of_long_texts_are_whole():
    """Long texts without spaces, with long runs of them, and in pieces: the count of the whole text."""
    import random

    own, rng = tokens.encoding(), random.Random(4)
    signs = "".join(chr(rng.choice([rng.randrange(0x3042, 0x3094), rng.randrange(0x4E00, 0x8000)])) for _ in range(249_986))
    assert tokens.count_tokens(signs, own) == len(own.encode_ordinary(signs))
    for text in ("pump" + " " * 3000 + "valve", " " * 2500, "\n\t" * 900 + "x", "a　" + " " * 1500 + "\tb c", "x " * 1200, "word" + " " * 1001, "", "\x1c" * 1500 + "y"):
        assert tokens.count_tokens(text, own) == len(own.encode_ordinary(text)), repr(text[:20])
    assert tokens.count_tokens(" " * 3_000_000 + "end", own) > 1
