"""Deeply nested records as related flat tables, by shared inlining.

`schema_graph` reads the graph of a typed record: its elements (structs, arrays of structs,
maps) and which element holds which. An element that occurs once and under one parent only
is inlined into it. One that is repeated, that several parents hold (in-degree above one) or
that holds itself has one table, whatever the parent; its rows name the kind of their parent
and its place. `shred` makes the tables: each row carries the key of its parent and its own
position, and columns of the parents that are asked for ride along.

`from_json_forms` first brings JSON records of varying form to one type, guided by that
type; elements that nest in groups of themselves (lines inside lines) go into the table of
their element, with the place of their group.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# ---------------------------------------------------------------- typed records


def record_key(*parts: Column) -> Column:
    """One string that identifies a record: its parts in order, nulls told from blanks."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts])


def hashable(col: Column, dtype: T.DataType) -> Column:
    """A column in which maps are sorted entries, so that it can be hashed."""
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(col)
        kept = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), hashable(e["value"], dtype.valueType).alias("value"))) if _has_map(dtype.valueType) else entries
        return F.array_sort(kept)
    if isinstance(dtype, T.ArrayType) and _has_map(dtype.elementType):
        return F.transform(col, lambda x: hashable(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and _has_map(dtype):
        return F.struct(*[hashable(col.getField(f.name), f.dataType).alias(f.name) for f in dtype])
    return col


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype)
    return isinstance(dtype, T.MapType) or (isinstance(dtype, T.ArrayType) and _has_map(dtype.elementType))


def content_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A 64-bit hash of what a record says, to tell records of one key apart."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.xxhash64(*[hashable(F.col(f"`{c}`"), kinds[c]) for c in columns or df.columns])


# ---------------------------------------------------------------- the graph


@dataclass
class Element:
    """A kind of element: the scalar fields it has anywhere, who holds it and how."""

    name: str
    fields: dict[str, T.DataType] = field(default_factory=dict)
    parents: set[str] = field(default_factory=set)
    repeated: bool = False
    recursive: bool = False

    @property
    def shared(self) -> bool:
        return len(self.parents) > 1 or self.recursive

    @property
    def tabled(self) -> bool:
        return self.repeated or self.shared or not self.parents


def _element(dtype: T.DataType) -> tuple[list[tuple[str, T.DataType]], bool] | None:
    """(fields, whether repeated) of a type that is an element; None for plain values, among
    them arrays of scalars and arrays of arrays."""
    if isinstance(dtype, T.StructType):
        return [(f.name, f.dataType) for f in dtype], False
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return [(f.name, f.dataType) for f in dtype.elementType], True
    if isinstance(dtype, T.MapType):
        value = dtype.valueType
        inner = [(f.name, f.dataType) for f in value] if isinstance(value, T.StructType) else [("value", value)]
        return [("key", dtype.keyType), *inner], True
    return None


def schema_graph(schema: T.StructType, root: str = "records") -> tuple[dict[str, Element], dict[tuple[str, ...], str]]:
    """Elements by name, and the element that each path of field names leads to.

    Occurrences of one field name are one element if the scalar fields they have in common
    are of one type; else the later one is an element of its own, `<parent>_<name>`.
    """
    elements = {root: Element(root)}
    at: dict[tuple[str, ...], str] = {(): root}

    def visit(path: tuple[str, ...], fields: list[tuple[str, T.DataType]], above: tuple[str, ...]) -> None:
        parent = at[path]
        for name, dtype in fields:
            found = _element(dtype)
            if not found:
                continue
            inner, repeated = found
            plain = {n: t for n, t in inner if not _element(t)}
            known = elements.get(name)
            unlike = name == root or known is not None and any(known.fields.get(n, t) != t for n, t in plain.items())
            key = f"{parent}_{name}" if unlike else name
            node = elements.setdefault(key, Element(key))
            node.fields |= plain
            node.parents.add(parent)
            node.repeated |= repeated
            node.recursive |= key in above
            at[(*path, name)] = key
            visit((*path, name), inner, (*above, key))

    visit((), [(f.name, f.dataType) for f in schema], (root,))
    return elements, at


# ---------------------------------------------------------------- the tables


def place_of(table: str, keys: list[str]) -> Column:
    """The place of a row of `table` in its record, as rows of shared children name it: steps
    `<table>:<position>` joined by '/'. `keys` are the table's key columns without the record's."""
    steps = []
    for k in keys:
        if k.endswith("_in"):
            continue
        steps.append(F.when(F.col(k) != "", F.col(k)) if k.endswith("_at") else F.concat(F.lit(f"{k.removesuffix('_no')}:"), F.col(k).cast("string")))
    return F.concat_ws("/", *steps) if steps else F.lit("")


def shred(df: DataFrame, key: Column, root: str = "records", key_name: str = "record_key", carry: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Tables by element name: `root` and one for each element that isn't inlined.

    Rows of a table have the record's key (`key_name`), the positions of their parents and
    their own (`<table>_no`, from 0). A table that several parents share has instead
    `<table>_in`, the parent element, and `<table>_at`, the place in the record of the row
    that the parent is or is inlined in (place_of), before its own position. `carry` names columns of a table that its child
    tables carry too, so that no join is needed to name a parent.

    Arrays of scalars stay values of their row. Null and empty arrays and maps have no child
    rows; null array members give a row of nulls; a shared singleton that is null has no
    row. Entries of a map come in the order of their keys. Rows of equal content stay; use
    distinct() on a table where repeats aren't wanted. A field that is named like a key
    column or a carried one is `<name>_value`.
    """
    carry = carry or {}
    elements, at = schema_graph(df.schema, root)
    made: dict[str, list[DataFrame]] = {}

    def inlined(path: tuple[str, ...], col: Column, fields: list[tuple[str, T.DataType]], prefix: str = "") -> tuple[list[tuple[str, Column]], list[tuple[tuple[str, ...], Column, T.DataType]]]:
        """Values of a row, and the elements below it that have tables of their own."""
        values, below = [], []
        for name, dtype in fields:
            inner, here = col.getField(name), (*path, name)
            if here not in at:
                values.append((prefix + name, inner))
            elif elements[at[here]].tabled:
                below.append((here, inner, dtype))
            else:
                more, deeper = inlined(here, inner, _element(dtype)[0], f"{prefix}{name}_")
                values += more
                below += deeper
        return values, below

    def visit(frame: DataFrame, table: str, keys: list[str], carried: list[str], values: list, below: list) -> None:
        taken = {*keys, *carried, key_name}
        columns = [c.alias(n if n not in taken else f"{n}_value") for n, c in values]
        rows = frame.select(key_name, *keys, *carried, *columns)
        made.setdefault(table, []).append(rows)
        riding = [*carried, *[c for c in carry.get(table, []) if c not in carried]]
        found = dict(values)
        kept = [F.col(c) if c in carried else found[c].alias(c) for c in riding]
        for path, col, dtype in below:
            child = elements[at[path]]
            no = f"{child.name}_no"
            if child.shared:
                own = [F.lit(at[path[:-1]]).alias(f"{child.name}_in"), place_of(table, keys).alias(f"{child.name}_at")]
                down_keys = [f"{child.name}_in", f"{child.name}_at", no]
            else:
                own = [F.col(k) for k in keys]
                down_keys = [*keys, no]
            fields, _ = _element(dtype)
            if isinstance(dtype, T.StructType):
                down = frame.filter(col.isNotNull()).select(key_name, *own, *kept, F.lit(0).alias(no), col.alias("_item"))
            elif isinstance(dtype, T.ArrayType):
                down = frame.select(key_name, *own, *kept, F.posexplode(col).alias(no, "_item"))
            else:
                entries = F.map_entries(col)
                down = frame.select(key_name, *own, *kept, F.posexplode(entries if _has_map(dtype.valueType) else F.array_sort(entries)).alias(no, "_item"))
            item = F.col("_item")
            if isinstance(dtype, T.MapType):
                value = item.getField("value")
                struct = isinstance(dtype.valueType, T.StructType)
                more, deeper = inlined(path, value, fields[1:]) if struct else ([("value", value)], [])
                visit(down, child.name, down_keys, riding, [("key", item.getField("key")), *more], deeper)
            else:
                visit(down, child.name, down_keys, riding, *inlined(path, item, fields))

    keyed = df.select(key.alias(key_name), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    visit(keyed, root, [], [], *inlined((), F.col("_row"), [(f.name, f.dataType) for f in df.schema]))
    return {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for name, parts in made.items()}


# ---------------------------------------------------------------- JSON of any form


def _scalar(value: Any, dtype: T.DataType) -> Any:
    if value is None or isinstance(value, (dict, list)):
        return None
    try:
        if isinstance(dtype, T.StringType):
            return value if isinstance(value, str) else json.dumps(value)
        if isinstance(dtype, T.BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(value, str):
            value = float(value) if "." in value else int(value)
        whole = int(value)
        bits = 31 if isinstance(dtype, T.IntegerType) else 63
        return whole if whole == value and -(1 << bits) <= whole < 1 << bits else None
    except (ValueError, OverflowError):
        return None


#: The field of an element that takes the place of the groups around it in its container:
#: positions joined by '/', null for elements in no group.
GROUP = "group_at"


def _members(value: Any, name: str, dtype: T.StructType, key: str | None) -> Iterator[dict]:
    """The elements in a container whatever its form: a list, one bare element, an object
    from key to element, to list of elements or to scalar, or groups of all these. What a
    group says holds for its members, and GROUP tells where the group stands."""
    fields = {f.name for f in dtype.fields}
    scalars = [f.name for f in dtype.fields if f.name not in (key, GROUP) and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]

    def one(item: Any, at: str | None, no: int) -> Iterator[dict]:
        if isinstance(item, dict):
            if name in item:  # a group of elements of the same kind
                shared = {k: v for k, v in item.items() if k != name}
                for x in _members(item[name], name, dtype, key):
                    inner = x.get(GROUP)
                    yield shared | x | {GROUP: f"{no}" if inner is None else f"{no}/{inner}"}
            else:
                yield {key: at} | item if key and at is not None else item
        elif isinstance(item, list):
            for i, x in enumerate(item):
                yield from one(x, at, i)
        elif key and at is not None and len(scalars) == 1:
            yield {key: at, scalars[0]: item}

    if isinstance(value, list):
        yield from one(value, None, 0)
    elif isinstance(value, dict):
        if fields & value.keys():
            yield from one(value, None, 0)
        else:
            for i, (k, v) in enumerate(value.items()):
                yield from one(v, k, i)


def fit(value: Any, dtype: T.DataType, name: str = "", keys: dict[str, str] | None = None) -> Any:
    """A parsed JSON value as a value of `dtype`; what doesn't fit is null.

    `keys` names, for each repeated element, the field that holds its key where the
    container is an object from key to element.
    """
    keys = keys or {}
    if isinstance(dtype, T.StructType):
        if not isinstance(value, dict):
            return None
        names = [f.name for f in dtype.fields]
        while not any(n in value for n in names):
            inner = [v for v in value.values() if isinstance(v, dict)]
            if len(inner) != 1:
                break
            value = inner[0]
        # Singleton objects around the record itself are inlined too.
        for v in list(value.values()):
            if isinstance(v, dict) and sum(n in v for n in names) > sum(n in value for n in names):
                value = {k: x for k, x in value.items() if x is not v} | v
        return {f.name: fit(value.get(f.name), f.dataType, f.name, keys) for f in dtype.fields}
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StructType):
            return [fit(x, dtype.elementType, name, keys) for x in _members(value, name, dtype.elementType, keys.get(name))]
        return [fit(x, dtype.elementType, name, keys) for x in value] if isinstance(value, list) else None
    if isinstance(dtype, T.MapType):
        pair = T.StructType([T.StructField(keys.get(name, "key"), T.StringType()), T.StructField("path", dtype.valueType)])
        found = [(x.get(pair.names[0]), x) for x in _members(value, name, pair, pair.names[0])]
        return [(str(k), fit(next((v for n, v in x.items() if n != pair.names[0] and not isinstance(v, (dict, list))), None), dtype.valueType)) for k, x in found if k is not None]
    return _scalar(value, dtype)


def parse(text: str | None, dtype: T.StructType, keys: dict[str, str]) -> dict | None:
    """A JSON text as a record; null where it isn't one object (byte-order marks aside)."""
    if text is None:
        return None
    try:
        value = json.loads(text.lstrip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None
    return fit(value, dtype, "", keys) if isinstance(value, dict) else None


def from_json_forms(payload: Column, dtype: T.StructType, keys: dict[str, str]) -> Column:
    """JSON of varying form as a struct of `dtype`; null where the text is no object."""
    arrow = to_arrow_type(dtype)

    @F.arrow_udf(dtype)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([parse(t, dtype, keys) for t in texts.to_pylist()], arrow)

    return read(payload)
