"""Avro object container files (null codec), as the public Avro specification has them; enough for manifests and their lists."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

MAGIC = b"Obj\x01"
_HEADER = {"type": "map", "values": "bytes"}


def _number(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(schema, value) -> bytes:
    """A value's binary form. A union is of null and one other type."""
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)) and isinstance(schema, dict):
        return encode(kind, value)
    if isinstance(kind, list):
        other = next(k for k in kind if k != "null")
        return _number(kind.index("null")) if value is None else _number(kind.index(other)) + encode(other, value)
    if kind in ("int", "long"):
        return _number(value)
    if kind in ("string", "bytes"):
        raw = value.encode() if kind == "string" else bytes(value)
        return _number(len(raw)) + raw
    if kind == "record":
        return b"".join(encode(f["type"], value[f["name"]]) for f in schema["fields"])
    if kind == "array":
        return (_number(len(value)) + b"".join(encode(schema["items"], v) for v in value) if value else b"") + b"\0"
    if kind == "map":
        return (_number(len(value)) + b"".join(encode("string", k) + encode(schema["values"], v) for k, v in value.items()) if value else b"") + b"\0"
    raise ValueError(f"no such Avro type: {kind}")


def _read_number(at: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = at.read(1)[0]
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return (n >> 1) ^ -(n & 1)


def _items(at: io.BytesIO) -> Iterator[None]:
    while n := _read_number(at):
        if n < 0:
            _read_number(at)  # the block's bytes
        for _ in range(abs(n)):
            yield


def decode(schema, at: io.BytesIO):
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)) and isinstance(schema, dict):
        return decode(kind, at)
    if isinstance(kind, list):
        chosen = kind[_read_number(at)]
        return None if chosen == "null" else decode(chosen, at)
    if kind in ("int", "long"):
        return _read_number(at)
    if kind in ("string", "bytes"):
        raw = at.read(_read_number(at))
        return raw.decode() if kind == "string" else raw
    if kind == "record":
        return {f["name"]: decode(f["type"], at) for f in schema["fields"]}
    if kind == "array":
        return [decode(schema["items"], at) for _ in _items(at)]
    if kind == "map":
        return {decode("string", at): decode(schema["values"], at) for _ in _items(at)}
    raise ValueError(f"no such Avro type: {kind}")


def header(schema: dict, extra: dict[str, str], sync: bytes) -> bytes:
    values = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null"} | {k: v.encode() for k, v in extra.items()}
    return MAGIC + encode(_HEADER, values) + sync


def block(n: int, body: bytes, sync: bytes) -> bytes:
    return _number(n) + _number(len(body)) + body + sync


def read_file(raw: bytes) -> tuple[dict[str, bytes], list[dict]]:
    """Header entries and records."""
    at = io.BytesIO(raw)
    if at.read(4) != MAGIC:
        raise ValueError("not an Avro file")
    head = decode(_HEADER, at)
    schema, sync, out = json.loads(head["avro.schema"]), at.read(16), []
    while at.tell() < len(raw):
        n, _ = _read_number(at), _read_number(at)
        out += [decode(schema, at) for _ in range(n)]
        if at.read(16) != sync:
            raise ValueError("broken block")
    return head, out
