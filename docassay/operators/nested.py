"""Deeply nested JSON as flat related tables, by Dewey labels.

Every node of a record gets an ordinal path identifier ('' the root, '0.3.1' the second child of the
fourth child of the first child). A parent's label is the child's label without its last ordinal, so
parent links need no lookup; nodes with one schema path (member names, array positions left out) form
one table.

Defined results: null and unreadable texts give no node; a string that itself holds a JSON object or
array counts as the value it holds; empty objects and arrays are nodes without children; a redelivered
record counts once; any depth is read (an iterative reader takes over beyond the parser's limit).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows per Arrow batch written back; bounds the memory of a worker.
OUT_ROWS = 20_000

_SCALAR = json.JSONDecoder()
_SPACE = " \t\r\n"


def _read_deep(text: str):
    """A JSON reader without recursion, for records nested beyond the limit of the library's parser."""
    stack: list = []
    root: list = []
    holder, key, i, n = root, None, 0, len(text)

    def skip(at: int) -> int:
        while at < n and text[at] in _SPACE:
            at += 1
        return at

    def put(value) -> None:
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[key] = value

    def member(at: int) -> tuple[str, int]:
        name, at = _SCALAR.raw_decode(text, at)
        at = skip(at)
        if not isinstance(name, str) or text[at : at + 1] != ":":
            raise ValueError("member name expected")
        return name, skip(at + 1)

    i = skip(i)
    while True:
        opened = text[i : i + 1]
        if opened and opened in "{[":
            new: dict | list = {} if opened == "{" else []
            put(new)
            stack.append((holder, key))
            holder, key = new, None
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if opened == "{" else "]"):
                if opened == "{":
                    key, i = member(i)
                continue
        else:
            value, i = _SCALAR.raw_decode(text, i)
            put(value)
            i = skip(i)
        while True:  # after a value
            if not stack:
                if skip(i) != n:
                    raise ValueError("text after the value")
                return root[0]
            mark = text[i : i + 1]
            if mark == ",":
                i = skip(i + 1)
                if isinstance(holder, dict):
                    key, i = member(i)
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("end of a container expected")
            holder, key = stack.pop()
            i = skip(i + 1)


def read_json(text: str | None):
    """(value, True), or (None, False) where the text can't be read."""
    if text is None:
        return None, False
    try:
        return json.loads(text), True
    except RecursionError:
        try:
            return _read_deep(text), True
        except (ValueError, RecursionError):
            return None, False
    except ValueError:
        return None, False


def _held(value):
    """A string that holds an object or array counts as that value."""
    while isinstance(value, str) and value.lstrip(_SPACE)[:1] in ("{", "[", '"') and len(value) > 1:
        inner, good = read_json(value)
        if not good or not isinstance(inner, (dict, list, str)):
            break
        if isinstance(inner, str) and inner.lstrip(_SPACE)[:1] not in ("{", "["):
            break
        value = inner
    return value


def label(text: str | None) -> Iterator[tuple[str, str, str, str | None, str, str | None]]:
    """(dewey, path, schema_path, name, kind, value) of every node of one record, parents first."""
    root, good = read_json(text)
    if not good:
        return
    stack = [("", "", "", None, root)]
    while stack:
        dewey, path, schema, name, value = stack.pop()
        value = _held(value)
        if isinstance(value, dict):
            yield dewey, path, schema, name, "object", None
            dot, sdot, top = (f"{path}." if path else ""), (f"{schema}." if schema else ""), (f"{dewey}." if dewey else "")
            stack.extend((f"{top}{i}", f"{dot}{k}", f"{sdot}{k}", k, v) for i, (k, v) in reversed(list(enumerate(value.items()))))
        elif isinstance(value, list):
            yield dewey, path, schema, name, "array", None
            top = f"{dewey}." if dewey else ""
            stack.extend((f"{top}{i}", f"{path}[{i}]", f"{schema}[]", None, v) for i, v in reversed(list(enumerate(value))))
        elif value is None:
            yield dewey, path, schema, name, "null", None
        elif isinstance(value, bool):
            yield dewey, path, schema, name, "boolean", str(value).lower()
        elif isinstance(value, (int, float)):
            yield dewey, path, schema, name, "number", repr(value)
        else:
            yield dewey, path, schema, name, "string", value


def nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """All nodes: (key, dewey, parent_dewey, ordinal, depth, path, parent_path, schema_path, name, kind, value)."""
    names = ["dewey", "path", "schema_path", "name", "kind", "value"]

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_key", pa.int64())] + [(n, pa.string()) for n in names])

        def batch(keys: list, rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())] + [pa.array(c, pa.string()) for c in columns], schema=schema)

        for b in batches:
            keys, rows = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in label(text):
                    rows.append(row)
                    keys.append(k)
                    if len(rows) >= OUT_ROWS:
                        yield batch(keys, rows)
                        keys, rows = [], []
            yield batch(keys, rows)

    flat = df.select(F.col(key).cast("bigint").alias("record_key"), F.col(column).alias("record_text")).where("record_text IS NOT NULL").mapInArrow(
        shred, "record_key bigint, dewey string, path string, schema_path string, name string, kind string, value string"
    )
    return flat.select(
        F.col("record_key").alias(key),
        "dewey",
        # truncation: the label without its last ordinal, the path without its last step
        F.expr("CASE WHEN dewey = '' THEN NULL ELSE regexp_replace(dewey, '(^|\\\\.)[0-9]+$', '') END").alias("parent_dewey"),
        F.expr("try_cast(substring_index(dewey, '.', -1) AS int)").alias("ordinal"),
        F.expr("CASE WHEN dewey = '' THEN 0 ELSE size(split(dewey, '\\\\.')) END").alias("depth"),
        "path",
        # of a member the name and its dot are cut (a name may hold dots), of an array item the position
        F.expr("CASE WHEN dewey = '' THEN NULL WHEN name IS NULL THEN regexp_replace(path, '\\\\[[0-9]+\\\\]$', '') ELSE regexp_replace(left(path, length(path) - length(name)), '\\\\.$', '') END").alias("parent_path"),
        "schema_path", "name", "kind", "value",
    )


def boxes(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, box_path) of each object with members x0, y0, x1 and y1.

    Children are grouped by their parent label; four distinct names make a box. Partial aggregation
    happens before the shuffle, and redelivered records fall together in it.
    """
    found = nodes(df, key, column).where("name IN ('x0', 'y0', 'x1', 'y1')")
    return found.groupBy(key, "parent_dewey", "parent_path").agg(F.bit_or(F.expr("CASE name WHEN 'x0' THEN 1 WHEN 'y0' THEN 2 WHEN 'x1' THEN 4 ELSE 8 END")).alias("members")).where("members = 15").select(key, F.col("parent_path").alias("box_path")).distinct()


def table_rows(text: str | None) -> Iterator[tuple]:
    """Rows of one record's tables, parents first: the root, every object and every item of an array.

    (table_name, dewey, parent_dewey, ordinal, depth, path, members, owner_dewey, owner_table, name, kind, value, member_kinds).
    An array that is a member has no row of its own: its items hang by its name from the object that has
    it. So the owner of a row is its parent, or that object. Scalars and empty arrays are members.
    """
    root, good = read_json(text)
    if not good:
        return
    stack = [("", None, None, 0, "", "", None, None, None, _held(root))]
    while stack:
        dewey, parent, ordinal, depth, path, schema, owner, owner_table, name, value = stack.pop()
        table, top = schema or "root", f"{dewey}." if dewey else ""
        kind, leaf = _kind(value)
        members: dict[str, tuple[str, str | None]] = {}
        below = []
        if kind == "object":
            dot, sdot = (f"{path}." if path else ""), (f"{schema}." if schema else "")
            for i, (k, v) in enumerate(value.items()):
                v = _held(v)
                if isinstance(v, dict):
                    below.append((f"{top}{i}", dewey, i, depth + 1, f"{dot}{k}", f"{sdot}{k}", dewey, table, k, v))
                elif isinstance(v, list) and v:
                    below.extend((f"{top}{i}.{j}", f"{top}{i}", j, depth + 2, f"{dot}{k}[{j}]", f"{sdot}{k}[]", dewey, table, k, _held(x)) for j, x in enumerate(v))
                else:
                    members[k] = _kind(v)
        elif kind == "array":
            below.extend((f"{top}{i}", dewey, i, depth + 1, f"{path}[{i}]", f"{schema}[]", dewey, table, None, _held(v)) for i, v in enumerate(value))
        stack.extend(reversed(below))
        order = sorted(members)
        values, kinds = ({k: members[k][1] for k in order}, {k: members[k][0] for k in order}) if order else (None, None)
        yield table, dewey, parent, ordinal, depth, path, _compact(values), owner, owner_table, name, kind, leaf, _compact(kinds)


def _kind(value) -> tuple[str, str | None]:
    """(kind, value as text) of a node; objects and arrays have no value."""
    if isinstance(value, dict):
        return "object", None
    if isinstance(value, list):
        return "array", None
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    return ("number", repr(value)) if isinstance(value, (int, float)) else ("string", value)


def _compact(value: dict | None) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def flat_tables(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per root, object and array item: its table (schema path), key, label, parent label, members and value.

    parent_dewey is the label of the parent node; owner_dewey and owner_table name the nearest ancestor that
    has a row, and name is the member of it that the row belongs to (null in an array). The tables alone
    give the record back.
    """
    fields = [("table_name", pa.string()), (key, pa.int64()), ("dewey", pa.string()), ("parent_dewey", pa.string()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("members", pa.string())]
    fields += [(n, pa.string()) for n in ("owner_dewey", "owner_table", "name", "kind", "value", "member_kinds")]
    schema = pa.schema(fields)

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=schema)

        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for table, *rest in table_rows(text):
                    rows.append((table, k, *rest))
                    if len(rows) >= OUT_ROWS:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    types = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int"}
    once = df.dropDuplicates([key]).select(F.col(key).cast("bigint").alias(key), F.col(column).alias("record_text"))
    return once.where("record_text IS NOT NULL").mapInArrow(shred, ", ".join(f"`{n}` {types[t]}" for n, t in fields))
