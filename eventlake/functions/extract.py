"""Typed columns from JSON payloads, and what is left of the payload."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELD_TYPES, OVERFLOW, Extracted, TableConfig

_INTS = {"Int32": (-(2**31), 2**31 - 1), "Int64": (-(2**63), 2**63 - 1)}


def resolve(doc, path: str):
    """The value at a dotted path of object keys; None if there is none. Arrays are never indexed."""
    for key in path.split("."):
        if not isinstance(doc, dict) or key not in doc:
            return None
        doc = doc[key]
    return doc


def coerce(value, kind: str):
    """A JSON value as the declared type; None where it doesn't fit. Integers only from integers, booleans only from booleans."""
    if value is None:
        return None
    if kind == "Boolean":
        return value if isinstance(value, bool) else None
    if kind == "Utf8":
        return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (bool, int, float)) else None
    if kind == "Binary":
        return value.encode() if isinstance(value, str) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if kind == "Float64":
        return float(value)
    low, high = _INTS[kind]
    return value if isinstance(value, int) and low <= value <= high else None


def residue(doc, paths: list[str]):
    """The document without the paths and the parents that this empties; None if nothing is left."""

    def cut(node, keys: list[str]):
        if not isinstance(node, dict) or keys[0] not in node:
            return
        if len(keys) == 1:
            del node[keys[0]]
        else:
            cut(node[keys[0]], keys[1:])
            if node[keys[0]] == {}:
                del node[keys[0]]

    for path in paths:
        cut(doc, path.split("."))
    return doc or None


def _strict(raw: bytes):
    def refuse(name):
        raise ValueError(name)

    return json.loads(raw.decode(), parse_constant=refuse)


def extracted(rows: DataFrame, config: TableConfig, mode: str = "quarantine") -> DataFrame:
    """`rows` with the declared columns, and the overflow if it is kept, in the payload's place.

    A payload that is no JSON goes whole to the overflow with null columns; mode="failfast" raises instead. A
    document that is no object is all overflow. With payload_format "binary" nothing is read. One Arrow pass
    over the payload alone; the other columns pass by as they are.
    """
    if mode not in ("quarantine", "failfast"):
        raise ValueError(mode)
    parse, fields, keep = config.payload_format == "json", config.fields, config.preserve_overflow
    types = {"Utf8": pa.string(), "Int32": pa.int32(), "Int64": pa.int64(), "Float64": pa.float64(), "Boolean": pa.bool_(), "Binary": pa.binary()}
    at = rows.columns.index("payload")

    def one(raw: bytes) -> tuple:
        none = [None] * len(fields)
        if not parse or raw is None:
            return *none, raw
        try:
            doc = _strict(raw)
        except (ValueError, RecursionError):
            if mode == "failfast":
                raise
            return *none, raw
        if not isinstance(doc, dict):
            return *none, raw
        values = [coerce(resolve(doc, f.path), f.kind) for f in fields]
        rest = residue(doc, [f.path for f in fields])
        return *values, None if rest is None else json.dumps(rest, separators=(",", ":"), sort_keys=True, ensure_ascii=False).encode()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [one(p.as_py()) for p in batch.column(at)]
            new = [pa.array([g[i] for g in got], types[f.kind]) for i, f in enumerate(fields)]
            new += [pa.array([g[-1] for g in got], pa.binary())] * keep
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols[:at], *new, *cols[at + 1 :]], names=names)

    head, tail = rows.schema.fields[:at], rows.schema.fields[at + 1 :]
    ddl = lambda fs: [f"`{f.name}` {f.dataType.simpleString()}" for f in fs]
    middle = [f"`{f.name}` {FIELD_TYPES[f.kind].simpleString()}" for f in fields] + [f"{OVERFLOW} binary"] * keep
    names = [*rows.columns[:at], *[f.name for f in fields], *[OVERFLOW] * keep, *rows.columns[at + 1 :]]
    return rows.mapInArrow(batches, ", ".join([*ddl(head), *middle, *ddl(tail)]))


def lifted(payload: Column, field: Extracted) -> Column:
    """A number or boolean field by from_json alone, inside generated code, where no overflow is wanted. Strings and binaries need `extracted`."""
    if field.kind in ("Utf8", "Binary"):
        raise ValueError("from_json would render objects as strings; use extracted()")
    ddl = FIELD_TYPES[field.kind].simpleString()
    for key in reversed(field.path.split(".")):
        ddl = f"struct<`{key}`:{ddl}>"
    out = F.from_json(payload.cast("string"), ddl, {"allowNonNumericNumbers": "false"})
    for key in field.path.split("."):
        out = out.getField(key)
    return out
