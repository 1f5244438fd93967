"""Schemas of the log and the lake, table configurations, and the table-name rule."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("sequence", T.LongType(), False), T.StructField("topic", T.StringType(), False), T.StructField("partition", T.IntegerType(), False),
    T.StructField("payload", T.BinaryType(), False), T.StructField("timestamp_ms", T.LongType(), False), T.StructField("idempotency_key", T.StringType()),
])
LAKE = T.StructType([*LOG.fields, T.StructField("event_date", T.DateType(), False), T.StructField("event_hour", T.IntegerType(), False)])
API_COLUMNS = ("sequence", "topic", "partition", "timestamp_ms", "payload", "idempotency_key")

# Stable field ids of the lake columns, the first id of extracted ones, and the overflow's.
FIELD_IDS = {"sequence": 1, "topic": 2, "partition": 3, "payload": 4, "timestamp_ms": 5, "idempotency_key": 6, "event_date": 7, "event_hour": 8}
FIRST_EXTRACTED_ID, OVERFLOW_ID = 100, 99
OVERFLOW = "_payload_overflow"
TABLE_NAME = r"\A[a-zA-Z][a-zA-Z0-9_-]{0,127}\z"
FIELD_TYPES = {"Utf8": T.StringType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "Float64": T.DoubleType(), "Boolean": T.BooleanType(), "Binary": T.BinaryType()}


def valid_table_name(name: Column) -> Column:
    return name.rlike(TABLE_NAME)


def check_table_name(name: str) -> str:
    if not re.fullmatch(r"[a-zA-Z][a-zA-Z0-9_-]{0,127}", name, re.ASCII):
        raise ValueError(f"not a table name: {name!r}")
    return name


@dataclass(frozen=True)
class Extracted:
    """A typed column lifted from a JSON payload."""

    name: str
    path: str
    kind: str
    nullable: bool = True


@dataclass(frozen=True)
class TableConfig:
    fields: tuple[Extracted, ...] = ()
    payload_format: str = "binary"
    preserve_overflow: bool = True

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if taken := {*FIELD_IDS, OVERFLOW} & {*names} or {n for n in names if names.count(n) > 1}:
            raise ValueError(f"field names are taken: {sorted(taken)}")
        if unknown := {f.kind for f in self.fields} - {*FIELD_TYPES}:
            raise ValueError(f"unknown field types: {sorted(unknown)}")

    @staticmethod
    def parse(text: str) -> TableConfig | None:
        """From JSON; a text that can't be parsed counts as no configuration."""
        try:
            doc = json.loads(text)
            fields = tuple(Extracted(f["name"], f.get("path", f["name"]), f["type"], f.get("nullable", True)) for f in doc.get("fields", []))
            return TableConfig(fields, doc.get("payload_format", "binary"), doc.get("preserve_overflow", True))
        except (ValueError, KeyError, TypeError, AttributeError):
            return None


def lake_schema(config: TableConfig | None = None) -> T.StructType:
    """The lake's columns; with extracted fields these stand in the payload's place, the overflow after them."""
    if config is None or config.payload_format != "json" or not config.fields:
        return LAKE
    head = [LAKE[c] for c in ("sequence", "topic", "partition", "timestamp_ms", "idempotency_key")]
    fields = [T.StructField(f.name, FIELD_TYPES[f.kind], f.nullable) for f in config.fields]
    overflow = [T.StructField(OVERFLOW, T.BinaryType())] * config.preserve_overflow
    return T.StructType([*head, *fields, *overflow, LAKE["event_date"], LAKE["event_hour"]])
