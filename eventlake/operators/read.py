"""Reads of the log: offset and time ranges, merged partitions, pages, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import event_date, event_hour, text_of
from ..schema import API_COLUMNS


def offset_range(log: DataFrame, topic: str, partition: int, offset: int, limit: int) -> DataFrame:
    found = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("sequence") >= offset))
    return found.orderBy("sequence").limit(limit)


def in_time(rows: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """timestamp_ms >= since and < until; with date bounds beside them, which prune directories."""
    if since is not None:
        rows = rows.where(F.col("timestamp_ms") >= since)
    if until is not None:
        rows = rows.where(F.col("timestamp_ms") < until)
    if "event_date" in rows.columns:
        for bound, low in ((since, True), (until, False)):
            if bound is not None:
                day = event_date(F.lit(bound))
                rows = rows.where(F.col("event_date") >= day if low else F.col("event_date") <= day)
    return rows


def from_offsets(log: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows from each partition's start on (topic, partition, start_offset); a partition without one is read whole."""
    both = log.join(offsets.select("topic", "partition", "start_offset"), ["topic", "partition"], "left")
    return both.where(F.col("sequence") >= F.coalesce("start_offset", F.lit(0))).drop("start_offset")


def merged(log: DataFrame, topic: str, since: int | None, limit: int, offsets: DataFrame | None = None, compat_cap: bool = False) -> DataFrame:
    """All partitions of a topic by time, then partition and sequence.

    compat_cap reads only the first max(2 * limit, 1000) rows of each partition before `since` applies.
    """
    rows = log.where(F.col("topic") == topic)
    rows = rows if offsets is None else from_offsets(rows, offsets)
    if compat_cap:
        order = F.row_number().over(Window.partitionBy("topic", "partition").orderBy("sequence"))
        rows = rows.withColumn("_row", order).where(F.col("_row") <= max(2 * limit, 1000)).drop("_row")
    return in_time(rows, since).orderBy("timestamp_ms", "partition", "sequence").limit(limit)


def time_range(log: DataFrame, topic: str, partition: int, since: int, until: int, limit: int) -> DataFrame:
    rows = log.where((F.col("topic") == topic) & (F.col("partition") == partition))
    return in_time(rows, since, until).orderBy("timestamp_ms", "sequence").limit(limit)


def page(log: DataFrame, topic: str, since: int | None, limit: int) -> DataFrame:
    """A page of a merged read, each row with has_more: whether there is one row more than the page."""
    probe = merged(log, topic, since, limit + 1)
    place = F.row_number().over(Window.orderBy("timestamp_ms", "partition", "sequence"))  # limit + 1 rows at most
    return probe.withColumn("_row", place).withColumn("has_more", F.max("_row").over(Window.partitionBy()) > limit).where(F.col("_row") <= limit).drop("_row")


def hot_and_cold(cold: DataFrame, hot: DataFrame, flush: DataFrame) -> DataFrame:
    """What the lake has, and of the hot log what is above the flush marks."""
    from .log import uncommitted

    return cold.select(*API_COLUMNS).unionByName(uncommitted(hot, flush).select(*API_COLUMNS))


def on_day_hours(rows: DataFrame, day: str, first: int, last: int) -> DataFrame:
    return rows.where((F.col("event_date") == F.lit(day).cast("date")) & F.col("event_hour").between(first, last))


def parse_fields(text: str | None) -> list[str]:
    """A comma list, trimmed, blanks left out; nothing means all. Unknown names raise, with the valid ones."""
    names = [x for x in (p.strip() for p in (text or "").split(",")) if x]
    if unknown := [n for n in names if n not in API_COLUMNS]:
        raise ValueError(f"unknown fields {unknown}; valid fields: {', '.join(API_COLUMNS)}")
    return [c for c in API_COLUMNS if c in names] if names else []


def projected(rows: DataFrame, fields: str | None, default: tuple[str, ...] = ("payload", "timestamp_ms")) -> DataFrame:
    return rows.select(*(parse_fields(fields) or default))


def as_json(rows: DataFrame, fields: str | None = None) -> Column:
    """A row's requested fields as JSON, the payload as text; null keys stay."""
    names = parse_fields(fields) or ("payload", "timestamp_ms")
    return F.to_json(F.struct(*[text_of(F.col(n)).alias(n) if n == "payload" else F.col(n) for n in names]), {"ignoreNullFields": "false"})


def arrow_stream(rows: DataFrame, fields: str | None = None) -> bytes:
    """An Arrow IPC stream with columns in their fixed order; no rows give a stream with the schema only."""
    import io

    import pyarrow as pa

    table = rows.select(*(parse_fields(fields) or API_COLUMNS)).toArrow()
    with pa.ipc.new_stream(out := io.BytesIO(), table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def with_partition_columns(log: DataFrame) -> DataFrame:
    return log.select("*", event_date(F.col("timestamp_ms")).alias("event_date"), event_hour(F.col("timestamp_ms")).alias("event_hour"))
