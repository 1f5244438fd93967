"""The registered queries and their DuckDB SQL, by the operators' names."""

from __future__ import annotations

import struct
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.extract import extracted, lifted
from ..operators import checks as C
from ..operators import log as L
from ..operators import metrics as M
from ..operators import read as R
from ..operators.lake import CompactionPolicy, candidates, greedy_batches
from ..operators.manifests import live_files
from ..schema import FIELD_IDS, Extracted, TableConfig, valid_table_name
from ..sources import ingest
from ..sources.files import scratch_dir
from ..sources.segments import read_segments, write_segments
from .fixtures import CUT_MS, LOG_SQL, lakes, log, requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: 2024-01-10 and 2024-01-12.
T0, T1 = 1_704_844_800_000, 1_705_017_600_000
LOG_COLUMNS = ["sequence", "topic", "partition", "payload", "timestamp_ms", "idempotency_key"]


def query(sql: str | None = None, raw: bool = False, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with SQL over `src` and `log` (or over the tables themselves if raw); it may be recursive."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH RECURSIVE" if recursive else "WITH"
            ORACLES[f.__name__] = sql if raw else f"{head} {LOG_SQL} {sql}" if not sql.lstrip().startswith(",") else f"{head} {LOG_SQL}{sql}"
        return f

    return add


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns with the payload as text."""
    return rows.select(*[S.text_of(F.col("payload")).alias("payload") if c == "payload" else F.col(c) for c in columns or LOG_COLUMNS])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- documented queries


@query('SELECT sequence, topic, "partition", payload, timestamp_ms, idempotency_key FROM log ORDER BY topic, "partition", sequence LIMIT 10')
def q1_first_rows(spark, sf):
    return shown(log(spark, sf)).orderBy("topic", "partition", "sequence").limit(10)


@query("SELECT count(*) AS n FROM log")
def q2_count(spark, sf):
    return log(spark, sf).agg(F.count("*").alias("n"))


@query('SELECT topic, "partition", min(sequence) AS min_seq, max(sequence) AS max_seq, count(*) AS n, max(sequence) - min(sequence) + 1 AS expected FROM log GROUP BY ALL')
def q3_continuity(spark, sf):
    return C.continuity(log(spark, sf))


@query('SELECT "partition", count(*) AS n, min(sequence) AS min_seq, max(sequence) AS max_seq FROM log GROUP BY ALL')
def q4_partition_stats(spark, sf):
    return log(spark, sf).groupBy("partition").agg(F.count("*").alias("n"), F.min("sequence").alias("min_seq"), F.max("sequence").alias("max_seq"))


@query("SELECT event_date, event_hour, count(*) AS n FROM log GROUP BY ALL")
def q5_events_by_hour(spark, sf):
    return log(spark, sf).groupBy("event_date", "event_hour").agg(F.count("*").alias("n"))


@query("SELECT min(timestamp_ms) AS min_ts, max(timestamp_ms) AS max_ts, count(*) FILTER (WHERE timestamp_ms <= 0) AS invalid FROM log")
def q6_timestamp_validity(spark, sf):
    return log(spark, sf).agg(F.min("timestamp_ms").alias("min_ts"), F.max("timestamp_ms").alias("max_ts"), F.count_if(F.col("timestamp_ms") <= 0).alias("invalid"))


@query('SELECT topic, "partition", sequence, timestamp_ms FROM log WHERE event_date = DATE \'2024-01-10\' AND event_hour BETWEEN 6 AND 11')
def q7_day_hours(spark, sf):
    return R.on_day_hours(log(spark, sf), "2024-01-10", 6, 11).select("topic", "partition", "sequence", "timestamp_ms")


@query("SELECT sequence, count(*) AS n FROM log GROUP BY ALL HAVING count(*) > 1")
def q8_shared_sequences(spark, sf):
    """Sequences of different partitions are numbered alike, so this is not empty."""
    return C.duplicates(log(spark, sf), ["sequence"])


@query(f"SELECT topic, 2 AS snapshots, sum(CASE WHEN timestamp_ms < {CUT_MS} THEN 1 ELSE 0 END)::BIGINT AS first_records, count(*) AS total_records FROM log GROUP BY topic")
def q9_snapshots(spark, sf):
    rows = []
    for t in lakes(spark, sf):
        s = t.snapshots()
        rows.append((t.topic, len(s), int(s[0]["summary"]["total-records"]), int(s[-1]["summary"]["total-records"])))
    return spark.createDataFrame(rows, "topic string, snapshots int, first_records long, total_records long")


@query("SELECT event_date, count(*) AS n FROM log WHERE event_date >= DATE '2024-01-15' GROUP BY ALL")
def q10_events_since(spark, sf):
    return log(spark, sf).where(F.col("event_date") >= F.lit("2024-01-15").cast("date")).groupBy("event_date").agg(F.count("*").alias("n"))


@query(f'SELECT topic, "partition", count(*) AS n, max(sequence) AS high FROM log WHERE timestamp_ms < {CUT_MS} GROUP BY ALL')
def q11_time_travel(spark, sf):
    """By the time of the first snapshot."""
    return union([t.read(as_of_ms=CUT_MS).groupBy("topic", "partition").agg(F.count("*").alias("n"), F.max("sequence").alias("high")) for t in lakes(spark, sf)])


@query('SELECT topic, "partition", idempotency_key, count(*) AS n FROM src GROUP BY ALL HAVING count(*) > 1')
def q12_duplicate_keys(spark, sf):
    """Over the requests, which repeat keys; the log itself has none."""
    return C.duplicates(requests(spark, sf), ["topic", "partition", "idempotency_key"])


_THINNED = '(SELECT * FROM log WHERE sequence % 7 <> 0)'


@query(f'SELECT topic, "partition", after, sequence, sequence - after - 1 AS missing FROM (SELECT topic, "partition", sequence, lag(sequence) OVER (PARTITION BY topic, "partition" ORDER BY sequence) AS after FROM {_THINNED}) WHERE sequence - after > 1')
def q13_gaps(spark, sf):
    """With every seventh sequence taken out, so there are gaps to find."""
    return C.gaps(log(spark, sf).where("sequence % 7 != 0"), width=100)


@query('SELECT topic, "partition", count(*) AS n FROM log GROUP BY ALL')
def q14_counts(spark, sf):
    return log(spark, sf).groupBy("topic", "partition").agg(F.count("*").alias("n"))


@query("SELECT topic, count(*) AS claimed, count(*) AS actual, true AS equal FROM log GROUP BY topic")
def q15_snapshot_totals(spark, sf):
    out = [t.read().agg(F.lit(t.topic).alias("topic"), F.lit(int(t.snapshot()["summary"]["total-records"])).cast("long").alias("claimed"), F.count("*").alias("actual")) for t in lakes(spark, sf)]
    return union(out).withColumn("equal", F.col("claimed") == F.col("actual"))


@query("SELECT * FROM (VALUES ('sequence', 'bigint'), ('topic', 'string'), ('partition', 'int'), ('payload', 'binary'), ('timestamp_ms', 'bigint'), ('idempotency_key', 'string'), ('event_date', 'date'), ('event_hour', 'int')) AS t(name, type)", raw=True)
def q16_schema(spark, sf):
    fields = lakes(spark, sf)[0].read().schema.fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "name string, type string")


# -- ingest


def _bodies(spark, sf):
    r = requests(spark, sf)
    return r.select(
        "event_id", "topic",
        F.to_json(F.struct(
            F.col("payload").cast("string").alias("payload"), F.when(F.col("partition") > 0, F.col("partition")).alias("partition"),
            F.when(F.col("event_id") % 5 != 0, F.col("timestamp_ms")).alias("timestamp_ms"), F.when(F.col("event_id") % 3 == 0, F.col("idempotency_key")).alias("idempotency_key"),
        )).alias("body"),
    )


_NOW = 1_706_745_600_000
_WRITES = f'SELECT event_id, topic, "partition", payload, CASE WHEN event_id % 5 = 0 THEN {_NOW} ELSE timestamp_ms END AS timestamp_ms, CASE WHEN event_id % 3 = 0 THEN idempotency_key END AS idempotency_key FROM src'


@query(_WRITES)
def s1_json_writes(spark, sf):
    """Bodies without a partition 0 and without some times and keys."""
    return shown(ingest.json_writes(_bodies(spark, sf), F.lit(_NOW)), "event_id", "topic", "partition", "payload", "timestamp_ms", "idempotency_key")


@query('SELECT event_id // 100 AS request, CAST(event_id % 100 AS INTEGER) AS item, topic, "partition", payload, timestamp_ms FROM src')
def s3_bulk_json(spark, sf):
    """Requests of a hundred records; the place in a request orders them. The record's topic stands in for its key."""
    r = requests(spark, sf).withColumn("request", F.floor(F.col("event_id") / 100))
    record = F.struct(F.col("payload").cast("string").alias("payload"), "partition", "timestamp_ms", F.col("topic").alias("idempotency_key"))
    bodies = r.groupBy("request").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))), lambda x: x.r).alias("records"))).alias("body"))
    return shown(ingest.json_bulk(bodies).withColumnRenamed("idempotency_key", "topic"), "request", "item", "topic", "partition", "payload", "timestamp_ms")


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def event_message(payload: bytes, timestamp_ms: int, key: str | None) -> bytes:
    """The wire form of a single event; for tests and fixtures."""
    out = b"\x0a" + _varint(len(payload)) + payload
    if timestamp_ms:
        out += b"\x10" + _varint(timestamp_ms)
    if key:
        out += b"\x1a" + _varint(len(key.encode())) + key.encode()
    return out + b"\x22" + _varint(6) + b"\x0a\x01h\x12\x01v"


@query('SELECT event_id, "partition", payload, CASE WHEN event_id % 5 = 0 THEN %d ELSE timestamp_ms END AS timestamp_ms, CASE WHEN event_id %% 3 = 0 THEN idempotency_key END AS idempotency_key FROM src'.replace("event_id % 5", "event_id %% 5") % _NOW)
def s2_protobuf_writes(spark, sf):
    """Events encoded on the way in, with zero times and empty keys, the partition in its header."""
    encode = F.udf(lambda p, t, k: bytearray(event_message(bytes(p), t or 0, k)), "binary")
    r = requests(spark, sf).select(
        F.col("event_id").alias("request_id"), F.col("partition").cast("string").alias("x_partition"),
        encode("payload", F.when(F.col("event_id") % 5 != 0, F.col("timestamp_ms")), F.when(F.col("event_id") % 3 == 0, F.col("idempotency_key"))).alias("body"),
    )
    out = ingest.protobuf_writes(r, bulk=False, now_ms=F.lit(_NOW)).withColumnRenamed("request_id", "event_id")
    return shown(out, "event_id", "partition", "payload", "timestamp_ms", "idempotency_key")


@query("SELECT event_id // 50 AS request_id, CAST(event_id % 50 AS INTEGER) AS item, \"partition\", payload, timestamp_ms, idempotency_key FROM src")
def s4_bulk_protobuf(spark, sf):
    """Batches of fifty records; `struct` packs nothing here, the records are length-delimited."""

    def encode(records) -> bytearray:
        out = b""
        for r in records:
            body = b"\x0a" + _varint(len(r.payload)) + bytes(r.payload) + b"\x10" + _varint(r.partition) + b"\x18" + _varint(r.timestamp_ms) + b"\x22" + _varint(len(r.idempotency_key.encode())) + r.idempotency_key.encode()
            out += b"\x0a" + _varint(len(body)) + body
        return bytearray(out)

    assert struct.calcsize("<q") == 8
    r = requests(spark, sf)
    rows = r.groupBy(F.floor(F.col("event_id") / 50).alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "payload", "partition", "timestamp_ms", "idempotency_key"))).alias("records"))
    bodies = rows.select("request_id", F.lit(None).cast("string").alias("x_partition"), F.udf(encode, "binary")("records").alias("body"))
    return shown(ingest.protobuf_writes(bodies, bulk=True), "request_id", "item", "partition", "payload", "timestamp_ms", "idempotency_key")


@query("SELECT event_id, CASE WHEN timestamp_ms % 2 = 0 THEN 7 ELSE timestamp_ms END AS timestamp_ms, nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE idempotency_key END, '') AS idempotency_key FROM src")
def s5_zero_as_missing(spark, sf):
    r = requests(spark, sf)
    r = r.withColumns({"timestamp_ms": F.when(F.col("timestamp_ms") % 2 == 0, 0).otherwise(F.col("timestamp_ms")), "idempotency_key": F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("idempotency_key"))})
    return ingest.zero_as_missing(r, F.lit(7)).select("event_id", "timestamp_ms", "idempotency_key")


_NAMES = ["events", "a", "A-b_9", "9x", "", "x" * 128, "x" * 129, "é", "a.b", "a b", "-a", "a\n"]


@query("SELECT name, regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_-]{0,127}') AS valid FROM (SELECT DISTINCT event_type AS name FROM events UNION ALL SELECT unnest(['events', 'a', 'A-b_9', '9x', '', repeat('x', 128), repeat('x', 129), 'é', 'a.b', 'a b', '-a', 'a' || chr(10)]))", raw=True)
def s6_table_names(spark, sf):
    names = requests(spark, sf).select(F.col("topic").alias("name")).distinct().unionByName(spark.createDataFrame([(n,) for n in _NAMES], "name string"))
    return names.select("name", valid_table_name(F.col("name")).alias("valid"))


@query('SELECT sequence, topic, "partition", event_id FROM log')
def s7_batched_writes(spark, sf):
    """The log written in three batches, each against the keys and marks of those before, equals the log of one batch."""
    r, done = requests(spark, sf), None
    for i in range(3):
        new = L.write_batch(r.where(_third(i)), "event_id", done, None if done is None else L.high_marks(done))
        done = new if done is None else done.unionByName(new)
    return done.select("sequence", "topic", "partition", "event_id")


def _third(i: int) -> Column:
    """Three spans of time."""
    at = [0, T0, CUT_MS, 2**62]
    return (F.col("timestamp_ms") >= at[i]) & (F.col("timestamp_ms") < at[i + 1])


# -- reads


@query("SELECT sequence, timestamp_ms, payload FROM log WHERE topic = 'click' AND \"partition\" = 0 AND sequence >= 10 ORDER BY sequence LIMIT 100")
def r1_offset_range(spark, sf):
    return shown(R.offset_range(log(spark, sf), "click", 0, 10, 100), "sequence", "timestamp_ms", "payload")


@query(f"SELECT sequence, \"partition\", timestamp_ms, payload FROM log WHERE topic = 'click' AND timestamp_ms >= {T0} ORDER BY timestamp_ms, \"partition\", sequence LIMIT 200")
def r2_merged_read(spark, sf):
    return shown(R.merged(log(spark, sf), "click", T0, 200), "sequence", "partition", "timestamp_ms", "payload")


@query(f", c AS (SELECT *, row_number() OVER (PARTITION BY \"partition\" ORDER BY sequence) AS r FROM log WHERE topic = 'view') SELECT sequence, \"partition\", timestamp_ms FROM c WHERE r <= 1000 AND timestamp_ms >= {T0} ORDER BY timestamp_ms, \"partition\", sequence LIMIT 50")
def r2_merged_read_capped(spark, sf):
    return R.merged(log(spark, sf), "view", T0, 50, compat_cap=True).select("sequence", "partition", "timestamp_ms")


@query(", o AS (SELECT * FROM (VALUES ('click', 0, 20), ('click', 2, 5)) AS t(topic, p, start_offset)) SELECT sequence, log.\"partition\", timestamp_ms FROM log LEFT JOIN o ON o.topic = log.topic AND o.p = log.\"partition\" WHERE log.topic = 'click' AND sequence >= coalesce(start_offset, 0) ORDER BY timestamp_ms, log.\"partition\", sequence LIMIT 300")
def r3_start_offsets(spark, sf):
    offsets = spark.createDataFrame([("click", 0, 20), ("click", 2, 5)], "topic string, partition int, start_offset long")
    return R.merged(log(spark, sf), "click", None, 300, offsets).select("sequence", "partition", "timestamp_ms")


@query(f"SELECT sequence, timestamp_ms FROM log WHERE topic = 'error' AND \"partition\" = 1 AND timestamp_ms >= {T0} AND timestamp_ms < {T1} ORDER BY timestamp_ms, sequence LIMIT 1000")
def r4_time_range(spark, sf):
    return R.time_range(log(spark, sf), "error", 1, T0, T1, 1000).select("sequence", "timestamp_ms")


@query(f", p AS (SELECT * FROM log WHERE topic = 'purchase' AND timestamp_ms >= {T0} ORDER BY timestamp_ms, \"partition\", sequence LIMIT 26) SELECT \"partition\", sequence, timestamp_ms, (SELECT count(*) FROM p) > 25 AS has_more FROM p ORDER BY timestamp_ms, \"partition\", sequence LIMIT 25")
def r6_page(spark, sf):
    return R.page(log(spark, sf), "purchase", T0, 25).select("partition", "sequence", "timestamp_ms", "has_more")


@query(f'SELECT sequence, topic, "partition", payload, timestamp_ms, idempotency_key FROM log WHERE timestamp_ms >= {T0} AND timestamp_ms < {T1}')
def r7_lake_read(spark, sf):
    """From the snapshots, with files and directories pruned by time."""
    return union([shown(t.read(since=T0, until=T1)) for t in lakes(spark, sf)])


@query(f'SELECT topic, "partition", event_date, timestamp_ms >= {CUT_MS} AS later, min(sequence) AS sequence_min, max(sequence) AS sequence_max, count(*) AS n FROM log GROUP BY ALL')
def r9_segments(spark, sf):
    """The active files; one for each write, date and partition."""
    out = union([t.active().withColumn("topic", F.lit(t.topic)) for t in lakes(spark, sf)])
    return out.select("topic", "partition", F.col("event_date_min").alias("event_date"), (F.col("timestamp_ms_min") >= CUT_MS).alias("later"), "sequence_min", "sequence_max", "n")


@query('SELECT topic, "partition", min(sequence) AS low FROM log WHERE sequence > 3 GROUP BY ALL')
def r10_low_marks(spark, sf):
    return L.low_marks(log(spark, sf).where("sequence > 3"))


@query('SELECT topic, "partition", max(sequence) AS high FROM log GROUP BY ALL')
def r11_high_marks(spark, sf):
    return L.high_marks(log(spark, sf))


@query("SELECT DISTINCT topic, \"partition\" FROM log UNION SELECT 'archived', 9")
def r12_partitions(spark, sf):
    return L.partitions_of(log(spark, sf), spark.createDataFrame([("archived", 9)], "topic string, partition int"))


@query("SELECT DISTINCT topic FROM log")
def r13_topics(spark, sf):
    return L.topics_of(log(spark, sf))


@query("SELECT sequence FROM log WHERE topic = 'click' AND \"partition\" = 2 AND idempotency_key = (SELECT min(idempotency_key) FROM log WHERE topic = 'click' AND \"partition\" = 2)")
def r14_key_lookup(spark, sf):
    rows = log(spark, sf)
    key = rows.where("topic = 'click' and partition = 2").agg(F.min("idempotency_key")).first()[0]
    return L.lookup_key(rows, "click", 2, key)


@query('SELECT topic, "partition", sum(n)::BIGINT AS n FROM (SELECT topic, "partition", count(*) AS n FROM log GROUP BY ALL) GROUP BY ALL')
def r16_active_files(spark, sf):
    return union([t.active().groupBy("partition").agg(F.sum("n").alias("n")).select(F.lit(t.topic).alias("topic"), "partition", "n") for t in lakes(spark, sf)])


@query(f'SELECT topic, count(*) AS n, max(timestamp_ms) AS newest FROM log WHERE timestamp_ms < {CUT_MS} GROUP BY topic')
def r17_snapshot_by_id(spark, sf):
    return union([t.read(snapshot_id=t.snapshots()[0]["snapshot-id"]).groupBy("topic").agg(F.count("*").alias("n"), F.max("timestamp_ms").alias("newest")) for t in lakes(spark, sf)])


@query('SELECT sequence, topic, "partition", timestamp_ms FROM log')
def r18_hot_and_cold(spark, sf):
    """The lake's first snapshot and the rest of the hot log are the whole log."""
    tables = lakes(spark, sf)
    cold = union([t.read(as_of_ms=CUT_MS) for t in tables])
    return R.hot_and_cold(cold, log(spark, sf), L.high_marks(cold).withColumnRenamed("high", "flush")).select("sequence", "topic", "partition", "timestamp_ms")


# -- projections and predicates


@query("SELECT sequence, payload FROM log WHERE topic = 'click'")
def p1_projection(spark, sf):
    return shown(R.projected(log(spark, sf).where("topic = 'click'"), " payload, ,sequence"), "sequence", "payload")


@query("SELECT topic, \"partition\", sequence, '{\"sequence\":' || sequence || ',\"payload\":' || to_json(payload) || '}' AS record FROM log WHERE topic = 'view'")
def p2_json_rows(spark, sf):
    rows = log(spark, sf).where("topic = 'view'")
    return rows.select("topic", "partition", "sequence", R.as_json(rows, "sequence,payload").alias("record"))


@query("SELECT event_hour, count(*) AS n FROM log WHERE topic = 'signup' AND \"partition\" = 3 AND event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL")
def p8_pruned_count(spark, sf):
    """On the lake, by directory predicates alone."""
    rows = next(t for t in lakes(spark, sf) if t.topic == "signup").read(partition=3)
    return rows.where(F.col("event_date").between("2024-01-05", "2024-01-20")).groupBy("event_hour").agg(F.count("*").alias("n"))


_FLUSH = ', f AS (SELECT topic, "partition", max(sequence) // 2 AS flush FROM log GROUP BY ALL)'


def _flush(rows: DataFrame) -> DataFrame:
    return L.high_marks(rows).select("topic", "partition", F.floor(F.col("high") / 2).alias("flush"))


@query(f'{_FLUSH} SELECT topic, "partition", sequence FROM log JOIN f USING (topic, "partition") WHERE sequence > flush')
def p9_uncommitted(spark, sf):
    rows = log(spark, sf)
    return L.uncommitted(rows, _flush(rows)).select("topic", "partition", "sequence")


# -- log state


@query('SELECT sequence, topic, "partition", event_id, idempotency_key FROM log')
def l1_sequences(spark, sf):
    return L.write_batch(requests(spark, sf), "event_id").select("sequence", "topic", "partition", "event_id", "idempotency_key")


@query('SELECT s.event_id, l.sequence FROM src s JOIN log l USING (topic, "partition", idempotency_key)')
def l3_batch_offsets(spark, sf):
    r = requests(spark, sf)
    return L.offsets_of_batch(r, L.write_batch(r, "event_id"), "event_id")


@query(f', old AS (SELECT * FROM log WHERE timestamp_ms < {T0}) SELECT s.topic, s."partition", s.idempotency_key, count(*) AS n FROM src s LEFT JOIN old o ON s.topic = o.topic AND s."partition" = o."partition" AND s.idempotency_key = o.idempotency_key WHERE o.sequence IS NULL GROUP BY ALL')
def l4_new_keys(spark, sf):
    """Requests whose keys an older log doesn't have; Spark's runtime filters take the place of a membership filter."""
    return L.new_of_keys(requests(spark, sf), log(spark, sf).where(F.col("timestamp_ms") < T0)).groupBy("topic", "partition", "idempotency_key").agg(F.count("*").alias("n"))


@query(f'{_FLUSH} SELECT topic, "partition", greatest(flush, m) AS high FROM f JOIN (SELECT topic, "partition", max(sequence) FILTER (WHERE timestamp_ms < {T0}) AS m FROM log GROUP BY ALL) USING (topic, "partition")')
def l5_raise_marks(spark, sf):
    rows = log(spark, sf)
    return L.raise_marks(_flush(rows).withColumnRenamed("flush", "high"), L.high_marks(rows.where(F.col("timestamp_ms") < T0)), "high")


@query(f'{_FLUSH} SELECT topic, "partition", min(sequence) AS low, count(*) AS n, max(flush) AS width FROM log JOIN f USING (topic, "partition") WHERE sequence > flush GROUP BY ALL')
def l7_cleanup(spark, sf):
    rows = log(spark, sf)
    flush = _flush(rows)
    left = L.cleaned(rows, flush).groupBy("topic", "partition").agg(F.min("sequence").alias("low"), F.count("*").alias("n"))
    width = L.cleanup_width(flush, flush.select("topic", "partition", F.lit(0).cast("long").alias("cleanup")))
    return left.join(width, ["topic", "partition"]).select("topic", "partition", "low", "n", "width")


@query(', c AS (SELECT topic, "partition", \'g\' || (event_id % 3) AS "group", sequence AS o, event_id FROM log) SELECT "group", topic, "partition", arg_max(o, (event_id * 7919) % 104729 * 1000000 + event_id) AS committed FROM c GROUP BY ALL')
def l9_offset_commits(spark, sf):
    """Commits that come in a scrambled order: the last stands, not the greatest."""
    rows = log(spark, sf).select("topic", "partition", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("group"), F.col("sequence").alias("offset"), ((F.col("event_id") * 7919) % 104729 * 1000000 + F.col("event_id")).alias("at"))
    return L.last_commit(rows, "at")


@query(f"{_FLUSH}, h AS (SELECT topic, \"partition\", max(sequence) AS high FROM log WHERE topic <> 'view' GROUP BY ALL), g AS (SELECT * FROM f WHERE topic <> 'click') SELECT topic, \"partition\", coalesce(flush, 0) AS flush, coalesce(high, 0) AS high FROM g FULL JOIN h USING (topic, \"partition\")")
def l10_watermark_report(spark, sf):
    rows = log(spark, sf)
    return L.watermark_report(_flush(rows).where("topic != 'click'"), L.high_marks(rows.where("topic != 'view'")))


@query('SELECT topic, "partition", max(sequence) AS flush FROM log GROUP BY ALL')
def l12_committed_marks(spark, sf):
    return union([t.watermarks() for t in lakes(spark, sf)])


@query('SELECT topic, "partition", max(sequence) AS flush FROM log GROUP BY ALL')
def l13_reconciled(spark, sf):
    return L.raise_marks(_flush(log(spark, sf)), union([t.watermarks() for t in lakes(spark, sf)]), "flush")


# -- aggregates


@query('SELECT topic, "partition", event_date, count(*) AS n, min(sequence) AS sequence_min, max(sequence) AS sequence_max, min(timestamp_ms) AS timestamp_ms_min, max(timestamp_ms) AS timestamp_ms_max, min(event_hour) AS event_hour_min, max(event_hour) AS event_hour_max FROM log GROUP BY ALL')
def a1_column_bounds(spark, sf):
    return C.column_bounds(log(spark, sf), ["topic", "partition", "event_date"])


@query("SELECT topic, min(event_date) AS date_min, max(event_date) AS date_max, min(event_hour) AS hour_min, max(event_hour) AS hour_max FROM log GROUP BY topic")
def a2_partition_bounds(spark, sf):
    return log(spark, sf).groupBy("topic").agg(F.min("event_date").alias("date_min"), F.max("event_date").alias("date_max"), F.min("event_hour").alias("hour_min"), F.max("event_hour").alias("hour_max"))


@query('SELECT sum(events)::BIGINT AS events, count(*) AS segments, max(watermark) AS watermark FROM (SELECT topic, "partition", event_date, event_hour, count(*) AS events, max(sequence) AS watermark FROM log GROUP BY ALL)')
def a4_flush_totals(spark, sf):
    segments = log(spark, sf).groupBy("topic", "partition", "event_date", "event_hour").agg(F.count("*").alias("events"), F.lit(1).alias("segments"), F.max("sequence").alias("watermark"))
    return M.flush_totals(segments)


@query('SELECT topic, "partition", count(*) AS files, sum(b)::BIGINT AS bytes FROM (SELECT topic, "partition", event_date, sum(octet_length(encode(payload)) + 64) AS b FROM log GROUP BY ALL) GROUP BY ALL')
def a5_pending_sizes(spark, sf):
    files = log(spark, sf).groupBy("topic", "partition", "event_date").agg(F.sum(S.event_size(F.col("payload"))).alias("b"))
    return files.groupBy("topic", "partition").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"))


@query(f"SELECT topic, sum(CASE WHEN timestamp_ms >= {CUT_MS} THEN 1 ELSE 0 END)::BIGINT AS added, 0::BIGINT AS deleted, count(*) AS total FROM log GROUP BY topic")
def a6_summary_counts(spark, sf):
    rows = [(t.topic, *(int(t.snapshot()["summary"][k]) for k in ("added-records", "deleted-records", "total-records"))) for t in lakes(spark, sf)]
    return spark.createDataFrame(rows, "topic string, added long, deleted long, total long")


@query("SELECT count(*) AS n, round(count(*) / 3600.0, 6) AS per_second, round(sum(value) / count(*), 6) AS average_us FROM src")
def a8_rates(spark, sf):
    return M.rates(requests(spark, sf).withColumnRenamed("value", "latency_us"), 3600.0)


_CELLS = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{b}" for b in C.LATENCY_BUCKETS)


@query(f"SELECT topic, {_CELLS}, count(value) AS le_inf, round(sum(value), 2) AS total, count(value) AS n FROM src GROUP BY topic")
def a9_latency_histogram(spark, sf):
    return M.histogram(requests(spark, sf), ["topic"], "value")


@query("SELECT topic, count(DISTINCT event_id // 10) AS writes FROM src GROUP BY topic")
def a10_topic_counters(spark, sf):
    return M.topic_counters(requests(spark, sf).withColumn("request_id", F.floor(F.col("event_id") / 10)))


@query(f'{_FLUSH} SELECT topic, "partition", CASE WHEN low > 0 AND high >= low THEN high - low + 1 ELSE 0 END AS hot FROM (SELECT topic, "partition", max(sequence) AS high, min(CASE WHEN sequence > flush THEN sequence END) AS low FROM log JOIN f USING (topic, "partition") GROUP BY ALL)')
def a11_hot_count(spark, sf):
    rows = log(spark, sf)
    marks = L.high_marks(rows).join(L.low_marks(L.cleaned(rows, _flush(rows))), ["topic", "partition"], "left")
    return marks.select("topic", "partition", L.hot_count(F.col("high"), F.coalesce("low", F.lit(0))).alias("hot"))


@query(f"{_FLUSH}, h AS (SELECT topic, \"partition\", max(sequence) AS high FROM log GROUP BY ALL) SELECT topic, h.\"partition\", high, coalesce(flush, -1) AS committed, greatest(high - coalesce(flush, 0), 0) AS lag FROM h LEFT JOIN (SELECT * FROM f WHERE topic <> 'view') c USING (topic, \"partition\")")
def a12_lag(spark, sf):
    """A partition without a commit shows -1."""
    rows = log(spark, sf)
    found = L.lag(L.high_marks(rows), _flush(rows).where("topic != 'view'").withColumnRenamed("flush", "committed"))
    return found.withColumn("committed", F.coalesce("committed", F.lit(-1)))


@query(', e AS (SELECT topic, "partition", unnest(generate_series(1, max(sequence) + 5)) AS s FROM log GROUP BY topic, "partition") SELECT count(*) AS missing, count(DISTINCT e.topic) AS topics FROM e LEFT JOIN (SELECT topic, "partition", sequence FROM log WHERE sequence % 50 >= 10) l ON e.topic = l.topic AND e."partition" = l."partition" AND e.s = l.sequence WHERE l.sequence IS NULL AND e.s <= (SELECT max(sequence) + 5 FROM log l2 WHERE l2.topic = e.topic AND l2."partition" = e."partition")')
def a14_uncovered(spark, sf):
    """Files of forty sequences with gaps of ten between them, against a range five beyond the end."""
    rows = log(spark, sf)
    files = rows.where("sequence % 50 >= 10").groupBy("topic", "partition", F.floor(F.col("sequence") / 50).alias("f")).agg(F.min("sequence").alias("sequence_min"), F.max("sequence").alias("sequence_max"))
    high = L.high_marks(rows)
    found = C.uncovered(files, 1, 2**40).join(high, ["topic", "partition"]).withColumn("last", F.least("last", F.col("high") + 5))
    return found.agg(F.sum(F.col("last") - F.col("first") + 1).alias("missing"), F.countDistinct("topic").alias("topics"))


@query(', m AS (SELECT topic, "partition", event_id, (event_id * 7919) % 1009 AS v FROM src) SELECT * FROM (SELECT topic, "partition", event_id, v, max(v) OVER (PARTITION BY topic, "partition" ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM m) WHERE v < highest_before')
def w6_out_of_order(spark, sf):
    rows = requests(spark, sf).select("topic", "partition", "event_id", ((F.col("event_id") * 7919) % 1009).alias("v"))
    return C.out_of_order(rows, "event_id", "v")


# -- bounded prefixes


@query(', s AS (SELECT topic, "partition", sequence, sum(octet_length(encode(payload)) + 64) OVER (PARTITION BY topic, "partition" ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS c FROM log) SELECT topic, "partition", count(*) AS n, max(sequence) AS upto FROM s WHERE c <= 4000 OR sequence = 1 GROUP BY ALL')
def o5_size_prefix(spark, sf):
    return L.size_prefix(log(spark, sf), S.event_size(F.col("payload")), 4000).groupBy("topic", "partition").agg(F.count("*").alias("n"), F.max("sequence").alias("upto"))


@query('SELECT topic, "partition", sequence FROM log WHERE sequence <= 30')
def o6_count_prefix(spark, sf):
    return L.count_prefix(log(spark, sf), 30).select("topic", "partition", "sequence")


@query(""", sized AS (
  SELECT topic, "partition", event_date, octet_length(encode(payload)) + 100 AS size, row_number() OVER (PARTITION BY topic, "partition", event_date ORDER BY sequence) AS i FROM log
), fold AS (
  SELECT topic, "partition", event_date, i, size, 0 AS batch, CASE WHEN size >= 2000 THEN 0 ELSE size END AS held, CASE WHEN size >= 2000 THEN 1 ELSE 0 END AS next FROM sized WHERE i = 1
  UNION ALL
  SELECT s.topic, s."partition", s.event_date, s.i, s.size, f.next, CASE WHEN f.held + s.size >= 2000 THEN 0 ELSE f.held + s.size END, f.next + CASE WHEN f.held + s.size >= 2000 THEN 1 ELSE 0 END
  FROM fold f JOIN sized s ON s.topic = f.topic AND s."partition" = f."partition" AND s.event_date = f.event_date AND s.i = f.i + 1
) SELECT topic, "partition", event_date, CAST(batch AS INTEGER) AS batch, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM fold GROUP BY ALL""", recursive=True)
def o7_greedy_batches(spark, sf):
    """Sums that start again at each cut are a fold, in SQL a recursion."""
    return greedy_batches(log(spark, sf), 2000).groupBy("topic", "partition", "event_date", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query('SELECT topic, "partition", event_date, count(*) AS n, min(sequence) AS sequence_min, max(sequence) AS sequence_max FROM log GROUP BY ALL')
def k10_avro_manifests(spark, sf):
    """What the Avro manifests of the current snapshots say of the data files, their bounds decoded."""
    number = lambda bounds: next(int.from_bytes(b["value"], "little", signed=True) for b in bounds if b["key"] == FIELD_IDS["sequence"])
    rows = []
    for t in lakes(spark, sf):
        for f in live_files(t.files, t.snapshot()["manifest-list"]).values():
            rows.append((t.topic, f["partition"]["partition"], f["partition"]["event_date"], f["record_count"], number(f["lower_bounds"]), number(f["upper_bounds"])))
    files = spark.createDataFrame(rows, "topic string, partition int, day int, n long, low long, high long")
    by = ["topic", "partition", F.date_from_unix_date("day").alias("event_date")]
    return files.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("sequence_min"), F.max("high").alias("sequence_max"))


# -- set operations


@query("SELECT topic, \"partition\" FROM log WHERE timestamp_ms < %d UNION SELECT topic, \"partition\" FROM log WHERE timestamp_ms >= %d" % (T0, T1))
def u1_union(spark, sf):
    rows = log(spark, sf)
    return rows.where(F.col("timestamp_ms") < T0).select("topic", "partition").union(rows.where(F.col("timestamp_ms") >= T1).select("topic", "partition")).distinct()


@query("SELECT idempotency_key FROM src WHERE topic = 'click' EXCEPT SELECT idempotency_key FROM src WHERE topic = 'view'")
def u3_difference(spark, sf):
    r = requests(spark, sf)
    return r.where("topic = 'click'").select("idempotency_key").subtract(r.where("topic = 'view'").select("idempotency_key"))


@query("SELECT idempotency_key FROM src WHERE topic = 'click' INTERSECT SELECT idempotency_key FROM src WHERE topic = 'view'")
def u3_intersection(spark, sf):
    r = requests(spark, sf)
    return r.where("topic = 'click'").select("idempotency_key").intersect(r.where("topic = 'view'").select("idempotency_key"))


# -- functions


@query("SELECT event_id, DATE '1970-01-01' + CAST(floor(m / 86400000.0) AS INTEGER) AS event_date, CAST(((m % 86400000) + 86400000) % 86400000 // 3600000 AS INTEGER) AS event_hour, CAST(DATE '1970-01-01' + CAST(floor(m / 86400000.0) AS INTEGER) AS VARCHAR) AS text FROM (SELECT event_id, timestamp_ms - 1704067200000 - event_id * 86399999 AS m FROM src)")
def f1_partition_columns(spark, sf):
    """Times on both sides of 1970."""
    m = F.col("timestamp_ms") - F.lit(1_704_067_200_000) - F.col("event_id") * 86_399_999
    return requests(spark, sf).select("event_id", S.event_date(m).alias("event_date"), S.event_hour(m).alias("event_hour"), S.date_text(S.event_date(m)).alias("text"))


@query("SELECT event_id, printf('%016x', event_id * 1000003) AS key FROM src")
def f3_hex_keys(spark, sf):
    return requests(spark, sf).select("event_id", S.hex_key(F.col("event_id") * 1000003).alias("key"))


@query("SELECT event_id, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM src")
def f7_lifted(spark, sf):
    """In generated code, by from_json."""
    return requests(spark, sf).select("event_id", lifted(F.col("payload"), Extracted("k", "k", "Int64")).alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN -1 ELSE CAST(json_extract(payload, '$.k') AS BIGINT) END AS k, event_id AS id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'no json ' || event_id ELSE '{\"more\":{\"x\":1}}' END AS rest FROM src")
def f8_extracted(spark, sf):
    """Columns and overflow; a third of the payloads are no JSON and go whole to the overflow."""
    r = requests(spark, sf)
    ident, text = F.col("event_id"), F.col("payload").cast("string")
    body = F.when(ident % 3 == 1, F.concat(F.lit("no json "), ident.cast("string"))).when(ident % 3 == 0, text).otherwise(F.concat(F.lit('{"more":{"x":1,"k":2},'), F.substring(text, 2, 1000)))
    config = TableConfig((Extracted("k", "k", "Int64"), Extracted("gone", "more.k", "Int32")), "json")
    out = extracted(r.select("event_id", F.encode(body, "UTF-8").alias("payload")), config)
    return out.select("event_id", F.coalesce("k", F.lit(-1)).alias("k"), F.col("event_id").alias("id"), F.col("_payload_overflow").cast("string").alias("rest"))


@query("SELECT event_id, list_filter([trim(x) FOR x IN string_split(topic || '. .' || payload || '.', '.')], lambda x: x <> '') AS levels FROM src".replace("SELECT event_id, list_filter(", "SELECT event_id, array_to_string(list_filter(").replace(", lambda x: x <> '') AS levels", ", lambda x: x <> ''), '|') AS levels"))
def f11_namespaces(spark, sf):
    text = F.concat(F.col("topic"), F.lit(". ."), F.col("payload").cast("string"), F.lit("."))
    return requests(spark, sf).select("event_id", F.concat_ws("|", S.namespace_levels(text, ".")).alias("levels"))


@query("SELECT max(event_id) FILTER (WHERE event_id % 2 = 0) AS latest, count(*) FILTER (WHERE event_id % 2 = 0) AS versions FROM src")
def f12_metadata_versions(spark, sf):
    name = F.concat(F.lit("metadata/v"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".metadata.json").otherwise(".json"))
    n = S.metadata_version(name)
    return requests(spark, sf).agg(F.max(n).alias("latest"), F.count(n).alias("versions"))


@query("SELECT event_id, 'b' || event_id AS bucket, topic || '/' || \"partition\" AS key FROM src")
def f13_uris(spark, sf):
    uri = F.concat(F.lit("s3://b"), F.col("event_id").cast("string"), F.lit("/"), F.col("topic"), F.lit("/"), F.col("partition").cast("string"))
    return requests(spark, sf).select("event_id", S.bucket_and_key(uri).alias("u")).select("event_id", "u.bucket", "u.key")


@query("SELECT event_id, topic, \"partition\", event_id AS \"start\", event_id + 99 AS \"end\" FROM src")
def f14_segment_keys(spark, sf):
    key = S.segment_key(F.col("topic"), F.col("partition"), F.col("event_id"), F.col("event_id") + 99)
    return requests(spark, sf).select("event_id", S.parse_segment_key(key).alias("k")).select("event_id", "k.topic", "k.partition", "k.start", "k.end")


@query("SELECT topic, sum(octet_length(encode(payload)) + 64)::BIGINT AS flush_bytes, sum(octet_length(encode(payload)) + 100)::BIGINT AS compact_bytes FROM src GROUP BY topic")
def f15_event_sizes(spark, sf):
    return requests(spark, sf).groupBy("topic").agg(F.sum(S.event_size(F.col("payload"))).alias("flush_bytes"), F.sum(S.event_size(F.col("payload"), 100)).alias("compact_bytes"))


@query(", r AS (SELECT topic, value, row_number() OVER (PARTITION BY topic ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY topic) AS n FROM src) SELECT topic, max(value) FILTER (WHERE i = least(CAST(floor(n * 0.5) AS BIGINT), n - 1)) AS p50, max(value) FILTER (WHERE i = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)) AS p99 FROM r GROUP BY topic")
def f18_percentiles(spark, sf):
    return C.nearest_ranks(requests(spark, sf), ["topic"], "value", {"p50": 0.5, "p99": 0.99})


@query("""SELECT topic, "partition", lpad(hex(min(sequence)), 16, '0') AS low, lpad(hex(max(timestamp_ms)), 16, '0') AS high, lpad(hex(CAST("partition" AS BIGINT)), 8, '0') AS part,
  lpad(hex(min(timestamp_ms) // 86400000), 8, '0') AS day, hex(CAST(-max(sequence) AS BIGINT)) AS negative FROM log GROUP BY ALL""")
def f4_bounds(spark, sf):
    own = log(spark, sf).groupBy("topic", "partition").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.max("timestamp_ms").alias("t"), F.min("event_date").alias("d"))
    shown = lambda c, kind: F.hex(S.bound_bytes(c, kind))
    return own.select("topic", "partition", shown(F.col("lo"), "long").alias("low"), shown(F.col("t"), "long").alias("high"), shown(F.col("partition"), "int").alias("part"), shown(F.col("d"), "date").alias("day"), shown(-F.col("hi"), "long").alias("negative"))


# -- files


@query('SELECT sequence, topic, "partition", payload, timestamp_ms, idempotency_key FROM log WHERE sequence >= 40')
def k7_json_segments(spark, sf):
    """Written as JSON segments of fifty sequences and read again from an offset."""
    import uuid

    base = scratch_dir(spark)
    root = f"{base.rstrip('/')}/segments-{uuid.uuid4().hex}"
    write_segments(log(spark, sf), root, 5000)
    return shown(read_segments(spark, root, start_offset=40))


@query('SELECT sequence, topic, "partition", payload, timestamp_ms, idempotency_key, event_date, event_hour FROM log')
def k5_lake_round_trip(spark, sf):
    return union([shown(t.read(), *LOG_COLUMNS, "event_date", "event_hour") for t in lakes(spark, sf)])


@query(f'SELECT topic, event_date, "partition", count(DISTINCT timestamp_ms >= {CUT_MS}) AS files FROM log GROUP BY ALL')
def c1_candidates(spark, sf):
    """Small files by directory, one being enough here: a directory of the lake has one for each snapshot that wrote to it."""
    out = union([candidates(t.active(), CompactionPolicy(min_files=1)).withColumn("topic", F.lit(t.topic)) for t in lakes(spark, sf)])
    return out.groupBy("topic", F.col("event_date_min").alias("event_date"), "partition").agg(F.count("*").alias("files"))


@query('SELECT topic, "partition", event_date, count(*) AS n, sum(sequence)::BIGINT AS total FROM log GROUP BY ALL')
def c2_compacted(spark, sf):
    """A copy of the lake, each topic in three writes of interleaved rows, compacted: the same rows in fewer files."""
    import uuid

    from ..operators.lake import LakeTable

    base = scratch_dir(spark)
    root = f"{base.rstrip('/')}/compacted-{uuid.uuid4().hex}"

    def one(t: LakeTable) -> DataFrame:
        copy = LakeTable(spark, root, t.topic, granularity="day")
        rows = t.read()
        copy.append([copy.stage(rows.where(F.col("sequence") % 3 == i)) for i in range(3)])
        copy.compact()
        return copy.read()

    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(one, lakes(spark, sf)))
    return union(out).groupBy("topic", "partition", "event_date").agg(F.count("*").alias("n"), F.sum("sequence").alias("total"))


@query('SELECT sequence, topic, "partition", timestamp_ms FROM log')
def t2_stream_ingest(spark, sf):
    """The requests as a file stream into a hot log, one batch after the other."""
    import uuid

    from ..streaming.flush import HotLog, ingest_stream

    base = scratch_dir(spark)
    root = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    r = requests(spark, sf).withColumnRenamed("event_id", "arrival").drop("value")
    for i in range(3):
        r.where(_third(i)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    hot = HotLog(spark, f"{root}/hot")
    ingest_stream(stream, hot, f"{root}/checkpoint").awaitTermination()
    return hot.rows().select("sequence", "topic", "partition", "timestamp_ms")
