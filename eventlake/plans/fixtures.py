"""The canonical log made of the `events` table, and lakes written from it."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import date_text
from ..operators.lake import LakeTable
from ..operators.log import first_of_key, with_sequence, write_batch
from ..operators.read import with_partition_columns
from ..sources.files import scratch_dir

#: The same in DuckDB: `src` are all events as write requests, `log` what the log holds of them.
LOG_SQL = """
src AS (
  SELECT event_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", props AS payload, epoch_us(ts) // 1000 AS timestamp_ms,
         concat(user_id, ':', CAST(CAST(ts AS DATE) AS VARCHAR)) AS idempotency_key, value
  FROM events
), log AS (
  SELECT row_number() OVER (PARTITION BY topic, "partition" ORDER BY event_id) AS sequence, topic, "partition", payload, timestamp_ms, idempotency_key,
         DATE '1970-01-01' + CAST(timestamp_ms // 86400000 AS INTEGER) AS event_date, CAST((timestamp_ms // 3600000) % 24 AS INTEGER) AS event_hour, event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY topic, "partition", idempotency_key ORDER BY event_id) AS copy FROM src)
  WHERE copy = 1
)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write requests: event_id (the order of arrival), topic, partition, payload, timestamp_ms, idempotency_key, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(
        "event_id", F.col("event_type").alias("topic"), F.pmod("user_id", F.lit(4)).cast("int").alias("partition"), F.encode("props", "UTF-8").alias("payload"),
        F.floor(micros / 1000).cast("long").alias("timestamp_ms"), F.concat_ws(":", F.col("user_id").cast("string"), date_text(ts.cast("date"))).alias("idempotency_key"), "value",
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its date and hour; the payload is bytes."""
    return with_partition_columns(write_batch(requests(spark, sf_dir), "event_id"))


def _kept(rows: DataFrame, path: str, *by: str) -> DataFrame:
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


_LAKES: dict[tuple[str, str], str] = {}
#: Rows of the first snapshot of each lake: those before this time, the middle of the events' month.
CUT_MS = 1_705_276_800_000


def lake_root(spark: SparkSession, sf_dir: str) -> str:
    """A lake with a table for each topic, written once a session and input, in two snapshots: rows before CUT_MS, then the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAKES:
        base = scratch_dir(spark)
        root = f"{base.rstrip('/')}/lake-{uuid.uuid4().hex}"
        # Numbering reads its rows twice, so the choice of each key's first is kept; by topic, so a table's writes read no other's rows.
        kept = _kept(first_of_key(requests(spark, sf_dir), "event_id"), f"{root}/.first")
        rows = _kept(with_partition_columns(with_sequence(kept, "event_id")), f"{root}/.log", "topic")

        def one(topic: str) -> None:
            clock = iter((CUT_MS / 1000, CUT_MS / 1000 + 86_400))
            table = LakeTable(spark, root, topic, granularity="day", clock=lambda: next(clock))
            for part in (F.col("timestamp_ms") < CUT_MS, F.col("timestamp_ms") >= CUT_MS):
                table.append([table.stage(rows.where((F.col("topic") == topic) & part))])

        with ThreadPoolExecutor(4) as pool:  # a few tables at a time
            list(pool.map(one, [r.topic for r in rows.select("topic").distinct().orderBy("topic").collect()]))
        _LAKES[key] = root
    return _LAKES[key]


def lakes(spark: SparkSession, sf_dir: str) -> list[LakeTable]:
    root = lake_root(spark, sf_dir)
    from ..operators.lake import tables

    return [LakeTable(spark, root, r.name, granularity="day") for r in tables(spark, root).collect()]
