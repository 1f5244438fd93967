"""The plain store: JSON segments whose names carry their offset range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import parse_segment_key, segment_key

_ROW = "sequence bigint, topic string, partition int, payload array<int>, timestamp_ms bigint, idempotency_key string"


def write_segments(rows: DataFrame, root: str, size: int = 10_000) -> None:
    """Writes JSON rows below root/{segment key}; a segment is `size` sequences of one partition, so a repeated write replaces it."""
    start = (F.floor((F.col("sequence") - 1) / size) * size + 1).cast("long")
    segment = segment_key(F.col("topic"), F.col("partition"), start, start + size - 1)
    payload = F.transform(F.sequence(F.lit(1), F.octet_length("payload")), lambda i: F.conv(F.hex(F.substring(F.col("payload"), i, F.lit(1))), 16, 10).cast("int"))
    payload = F.when(F.octet_length("payload") == 0, F.array().cast("array<int>")).otherwise(payload)
    out = rows.select("sequence", "topic", "partition", payload.alias("payload"), "timestamp_ms", "idempotency_key", segment.alias("segment"))
    out.repartition("segment").sortWithinPartitions("segment", "sequence").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").json(root)


def read_segments(spark: SparkSession, root: str, topic: str | None = None, partition: int | None = None, start_offset: int = 0) -> DataFrame:
    """Rows from `start_offset` on. Segments that end before it, or are of other topics or partitions, aren't opened."""
    rows = spark.read.schema(f"{_ROW}, segment string").json(root)
    key = parse_segment_key(F.col("segment"))
    rows = rows.where(key.getField("end") >= start_offset).where(F.col("sequence") >= start_offset)
    rows = rows if topic is None else rows.where(key.getField("topic") == topic)
    rows = rows if partition is None else rows.where(key.getField("partition") == partition)
    hexed = F.concat_ws("", F.transform("payload", lambda b: F.lpad(F.hex(b), 2, "0")))
    return rows.withColumn("payload", F.unhex(hexed)).drop("segment")
