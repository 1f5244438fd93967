"""Scalar functions on columns; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def _floor_div(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def event_date(timestamp_ms: Column) -> Column:
    """The UTC date, rounded down for times before 1970, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(timestamp_ms / F.lit(DAY_MS).cast("double")).cast("int"))


def event_hour(timestamp_ms: Column) -> Column:
    return F.floor(F.pmod(timestamp_ms, F.lit(DAY_MS)) / HOUR_MS).cast("int")


def date_text(date: Column) -> Column:
    """YYYY-MM-DD as SQL shows it: years past 9999 without a sign, those before 1 counted back from 1 BC and marked as such."""
    text, year = date.cast("string"), F.year(date)
    far = F.concat(F.format_string("%04d", F.when(year < 1, 1 - year).otherwise(year)), F.right(text, F.lit(6)), F.when(year < 1, " (BC)").otherwise(""))
    return F.when(date.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")), text).otherwise(far)


def hex_key(n: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(n), 16, "0"))


def text_of(payload: Column) -> Column:
    """UTF-8 with what can't be decoded replaced; never an error."""
    return F.make_valid_utf8(payload.cast("string"))


def namespace_levels(text: Column, separator: str = "\x1f") -> Column:
    """Levels, trimmed, without blank ones. The separator is U+001F in paths and a dot in settings."""
    return F.filter(F.transform(F.split(text, "\\Q" + separator + "\\E"), lambda x: F.trim(x)), lambda x: x != "")


def metadata_version(name: Column) -> Column:
    """N of v{N}.metadata.json, else null."""
    return F.nullif(F.regexp_extract(name, r"(?:^|/)v(\d+)\.metadata\.json$", 1), F.lit("")).cast("long")


def bucket_and_key(uri: Column) -> Column:
    """struct(bucket, key) of scheme://bucket/key; nulls for anything else."""
    part = lambda i: F.when(uri.rlike(r"^[a-z0-9]+://[^/]+"), F.regexp_extract(uri, r"^[a-z0-9]+://([^/]+)/?(.*)$", i))
    return F.struct(part(1).alias("bucket"), part(2).alias("key"))


def segment_key(topic: Column, partition: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("segments/"), topic, F.lit("/"), partition.cast("string"), F.lit("/"), hex_key(start), F.lit("-"), hex_key(end), F.lit(".json"))


def parse_segment_key(key: Column) -> Column:
    """struct(topic, partition, start, end) of a segment key; null for anything else."""
    pattern = r"segments/([^/]+)/(\d+)/([0-9a-f]{16})-([0-9a-f]{16})\.json$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    number = lambda i: F.conv(part(i), 16, 10).cast("long")
    return F.when(key.rlike(pattern), F.struct(part(1).alias("topic"), part(2).cast("int").alias("partition"), number(3).alias("start"), number(4).alias("end")))


def event_size(payload: Column, extra: int = 64) -> Column:
    """An estimate of a stored event's bytes: 64 over the payload when flushing, 100 when compacting."""
    return F.octet_length(payload).cast("long") + extra


def safe_ratio(total: Column, n: Column) -> Column:
    """0.0 over nothing."""
    return F.when(n > 0, total / n).otherwise(0.0)


def bound_bytes(value: Column, kind: str) -> Column:
    """A column's bound as files record it: big-endian two's complement, 8 bytes of a long or 4 of an int or date; texts as UTF-8."""
    if kind == "string":
        return value.cast("binary")
    number = F.datediff(value, F.lit("1970-01-01").cast("date")) if kind == "date" else value
    digits = {"long": 16, "int": 8, "date": 8}[kind]
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(digits)))
