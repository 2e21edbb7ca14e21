"""Nested records: labels, parent links, round trip, boxes."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from docassay.operators import nested

ISSUES = "issue_id long, evidence string, kind string"
BOX = {"x0": 1, "y0": 2, "x1": 3, "y1": 4}


def test_labels_and_parents(spark):
    record = {"a": {"b": [BOX, {"c": None}]}, "d": json.dumps({"e": BOX}), "f": "[1, 2", "g": True}
    rows = nested.nodes(spark.createDataFrame([(7, json.dumps(record), "k")], ISSUES), "issue_id", "evidence").collect()
    by_path = {r.path: r for r in rows}
    assert by_path["a.b[1].c"].parent_path == "a.b[1]" and by_path["a.b[1]"].parent_path == "a.b" and by_path["a.b"].parent_path == "a" and by_path["a"].parent_path == "" and by_path[""].parent_path is None
    assert by_path["a.b[0].x1"].dewey == "0.0.0.2" and by_path["a.b[0].x1"].parent_dewey == "0.0.0" and by_path["a"].parent_dewey == ""
    assert by_path["d.e.x0"].value == "1" and by_path["f"].value == "[1, 2" and by_path["a.b[1].c"].kind == "null"
    assert by_path["a.b[0]"].schema_path == "a.b[]"


def test_boxes(spark):
    rows = [(1, json.dumps({"p": BOX, "q": [[BOX]], "r": {"x0": 1, "y0": 2, "x1": 3}}), ""), (1, json.dumps({"p": BOX, "q": [[BOX]]}), ""), (2, json.dumps(json.dumps([{"s": BOX}])), ""), (3, '{"p": {"x0": 1', ""), (4, None, ""), (5, json.dumps(BOX), ""), (6, "", ""), (8, json.dumps({"a.b": {"c": {**BOX, "x0": None}}}), "")]
    got = {(r.issue_id, r.box_path) for r in nested.boxes(spark.createDataFrame(rows, ISSUES), "issue_id", "evidence").collect()}
    assert got == {(1, "p"), (1, "q[0][0]"), (2, "[0].s"), (5, ""), (8, "a.b.c")}


def test_deep_records_are_read():
    deep = "[" * 60_000 + json.dumps(BOX) + "]" * 60_000
    assert sum(1 for _ in nested.label(deep)) == 60_000 + 5
    assert list(nested.label("[" * 60_000)) == []


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet="ab c", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="xyz", min_size=1, max_size=2), x, max_size=3), max_leaves=20))
def test_round_trip(value):
    """Rebuilding the value from labels alone gives it back; the deep reader agrees with the library."""
    text = json.dumps(value)
    assert nested._read_deep(text) == value
    built = {}
    for dewey, _, _, name, kind, leaf in nested.label(text):
        new = {} if kind == "object" else [] if kind == "array" else None if kind == "null" else leaf == "true" if kind == "boolean" else json.loads(leaf) if kind == "number" else leaf
        if dewey:
            parent = built[dewey.rpartition(".")[0]]
            parent.append(new) if isinstance(parent, list) else parent.__setitem__(name, new)
        built[dewey] = new
    assert built[""] == value


def test_flat_tables(spark):
    rows = [(1, json.dumps({"k": "v", "o": [{"n": 1}, {"n": 2}]}), ""), (2, None, "")]
    got = {(r.table_name, r.dewey): r for r in nested.flat_tables(spark.createDataFrame(rows, ISSUES), "issue_id", "evidence").collect()}
    assert set(got) == {("root", ""), ("o[]", "1.0"), ("o[]", "1.1")} and json.loads(got["o[]", "1.1"].members) == {"n": "2"} and got["o[]", "1.1"].parent_dewey == "1"


def rebuilt(rows):
    """The record from the rows of its flat tables alone."""
    leaf = lambda kind, value: [] if kind == "array" else {} if kind == "object" else None if kind == "null" else value == "true" if kind == "boolean" else json.loads(value) if kind == "number" else value
    built = {}
    for r in sorted(rows, key=lambda r: [int(x) for x in r.dewey.split(".")] if r.dewey else []):
        built[r.dewey] = new = leaf(r.kind, r.value)
        kinds = json.loads(r.member_kinds or "{}")
        for k, v in json.loads(r.members or "{}").items():
            new[k] = leaf(kinds[k], v)
        if r.dewey:
            owner = built[r.owner_dewey]
            if isinstance(owner, list):
                owner.append(new)
            elif r.owner_dewey == r.parent_dewey:
                owner[r.name] = new
            else:
                owner.setdefault(r.name, []).append(new)
    return built[""]


def test_flat_tables_alone_give_the_record_back(spark):
    records = [
        {"blocks": [{"lines": [{"dir": [1, 0.5]}, {"dir": []}], "n": None}], "sources": ["A", "1", None, True], "q": [[1, [2]], [], {}], "e": {}, "z": [], "a.b": {"c[0]": [{"d": "x"}]}},
        [1, "two", [3]],
        [],
        "text",
        {"k": {"k": {"k": [{"k": [{"k": "1"}]}]}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "") for i, r in enumerate(records)], ISSUES)
    rows = nested.flat_tables(df, "issue_id", "evidence").collect()
    for i, record in enumerate(records):
        assert rebuilt([r for r in rows if r.issue_id == i]) == record
    tables = {(r.issue_id, r.dewey): r.table_name for r in rows}
    assert all(tables[r.issue_id, r.owner_dewey] == r.owner_table for r in rows if r.dewey)
    assert {r.value for r in rows if r.table_name == "blocks[].lines[].dir[]"} == {"1", "0.5"}


def test_empty(spark):
    assert nested.boxes(spark.createDataFrame([], ISSUES), "issue_id", "evidence").count() == 0
