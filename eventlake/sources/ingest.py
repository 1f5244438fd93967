"""Decoding of write requests into rows for the log."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EVENT = "payload string, partition int, timestamp_ms bigint, idempotency_key string"


def normalised(rows: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Missing partitions are 0, missing times are now; payloads are bytes. `partition` and `timestamp_ms` of 0 stay."""
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    return rows.withColumns({
        "partition": F.coalesce("partition", F.lit(0)).cast("int"), "timestamp_ms": F.coalesce("timestamp_ms", now).cast("long"), "payload": F.encode(F.col("payload").cast("string"), "UTF-8"),
    })


def zero_as_missing(rows: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """The wire's default values: time 0 is now, an empty key is none."""
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    return rows.withColumns({"timestamp_ms": F.when(F.col("timestamp_ms") == 0, now).otherwise(F.col("timestamp_ms")), "idempotency_key": F.nullif("idempotency_key", F.lit(""))})


def json_writes(requests: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Single writes from the column `body`; the other columns pass by. Bodies that are no JSON object or have no payload are left out: see `rejected`."""
    event = F.from_json("body", _EVENT)
    parsed = requests.withColumn("_e", event).where("_e.payload is not null")
    return normalised(parsed.select(*[c for c in requests.columns if c != "body"], "_e.*"), now_ms)


def rejected(requests: DataFrame) -> DataFrame:
    return requests.where(F.from_json("body", _EVENT).getField("payload").isNull())


def json_bulk(requests: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Bulk writes from `body`, {records: [...]}, a row for each record with its place in the request as `item`."""
    parsed = requests.withColumn("_r", F.from_json("body", f"records array<struct<{_EVENT.replace(' ', ':')}>>".replace(",:", ",")).getField("records"))
    rows = parsed.select(*[c for c in requests.columns if c != "body"], F.posexplode("_r").alias("item", "_e")).select("*", "_e.*").drop("_e")
    return normalised(rows.where("payload is not null"), now_ms)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("varint too long")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message; raises on malformed input."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("truncated field")
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = struct.unpack("<q" if kind == 1 else "<i", data[at : at + size])[0], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _event(data: bytes) -> dict:
    """payload = 1, timestamp_ms = 2, idempotency_key = 3, headers = 4 (read over)."""
    out = {"payload": b"", "partition": None, "timestamp_ms": 0, "idempotency_key": ""}
    for n, v in wire_fields(data):
        if n == 1:
            out["payload"] = bytes(v)
        elif n == 2:
            out["timestamp_ms"] = _signed(v)
        elif n == 3:
            out["idempotency_key"] = v.decode()
    return out


def _record(data: bytes) -> dict:
    """payload = 1, partition = 2, timestamp_ms = 3, idempotency_key = 4."""
    out = {"payload": b"", "partition": 0, "timestamp_ms": 0, "idempotency_key": ""}
    for n, v in wire_fields(data):
        if n in (1, 4):
            out["payload" if n == 1 else "idempotency_key"] = bytes(v) if n == 1 else v.decode()
        elif n in (2, 3):
            out["partition" if n == 2 else "timestamp_ms"] = _signed(v)
    return out


def decoded(body: bytes, bulk: bool) -> list[dict] | None:
    """The events of a message; None if it is malformed."""
    try:
        return [_record(v) for n, v in wire_fields(body) if n == 1] if bulk else [_event(body)]
    except (ValueError, IndexError, UnicodeDecodeError, AttributeError, TypeError, struct.error):
        return None


def protobuf_writes(requests: DataFrame, bulk: bool, now_ms: Column | None = None) -> DataFrame:
    """Writes from binary `body`: a message each, or a batch of records. Single events take their partition from the text column
    `x_partition`, 0 if it is missing or no number. Malformed bodies are left out. The columns are request_id, item and the event's."""
    kind = "request_id bigint, x_partition string, item int, payload binary, partition int, timestamp_ms bigint, idempotency_key string"
    types = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in kind.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for rid, x, body in zip(*(batch.column(c).to_pylist() for c in ("request_id", "x_partition", "body")), strict=True):
                for i, e in enumerate(decoded(body or b"", bulk) or []):
                    rows.append((rid, x, i, *(e[c] for c in names[3:])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    rows = requests.select("request_id", "x_partition", "body").mapInArrow(batches, kind)
    if not bulk:
        rows = rows.withColumn("partition", F.coalesce(F.expr("try_cast(x_partition as int)"), F.lit(0)))
    return zero_as_missing(rows.drop("x_partition"), now_ms)
