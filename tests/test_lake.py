import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from eventlake.operators import lake
from eventlake.operators import log as L
from eventlake.operators.catalog import Catalog, NoSuchNamespace
from eventlake.operators.lake import CompactionPolicy, Conflict, LakeTable, greedy_batches
from eventlake.operators.metrics import exposition
from eventlake.operators.read import with_partition_columns
from eventlake.schema import Extracted, TableConfig
from eventlake.streaming.flush import Flusher, FlushPolicy, HotLog

DAY = 1705276800000
SCHEMA = "arrival long, topic string, partition int, payload string, timestamp_ms long, idempotency_key string"


def requests(spark, n=60, topic="t", seed=0):
    dice = random.Random(seed)
    data = [(i, topic, dice.randrange(2), '{"v":%d}' % i, DAY + dice.randrange(7_200_000), f"k{i % 50}") for i in range(n)]
    return spark.createDataFrame(data, SCHEMA).withColumn("payload", F.encode("payload", "UTF-8"))


def log_rows(spark, **how):
    return L.write_batch(requests(spark, **how), "arrival")


def keys(df):
    return sorted((r.topic, r.partition, r.sequence, r.timestamp_ms) for r in df.select("topic", "partition", "sequence", "timestamp_ms").collect())


def test_round_trip_sorted_files_and_time_travel(spark, tmp_path):
    rows, times = log_rows(spark), iter((100.0, 200.0))
    table = LakeTable(spark, str(tmp_path), "t", clock=lambda: next(times))
    a, b = rows.where("sequence <= 10"), rows.where("sequence > 10")
    table.append([table.stage(a)])
    table.append([table.stage(b)])
    assert keys(table.read()) == keys(rows) and keys(table.read(as_of_ms=150_000)) == keys(a) == keys(table.read(snapshot_id=table.snapshots()[0]["snapshot-id"]))
    assert table.read(as_of_ms=50_000).count() == 0
    for r in table.active().collect():
        got = [(x.timestamp_ms, x.sequence) for x in spark.read.parquet(r.path).collect()]
        assert got == sorted(got) and len(got) == r.n
    summary = table.snapshot()["summary"]
    assert int(summary["total-records"]) == rows.count() and {r.partition: r.flush for r in table.watermarks().collect()} == {r.partition: r.high for r in L.high_marks(rows).collect()}
    since = DAY + 3_600_000
    assert keys(table.read(since=since, partition=1, start_offset=5)) == keys(rows.where(f"timestamp_ms >= {since} and partition = 1 and sequence >= 5"))


def test_commits_race_and_conflict(spark, tmp_path):
    one, two = LakeTable(spark, str(tmp_path), "t"), LakeTable(spark, str(tmp_path), "t")
    rows = log_rows(spark)
    first = one.append([one.stage(rows.where("sequence = 1"))])
    with pytest.raises(Conflict):
        stale = two.metadata()
        one.append([one.stage(rows.where("sequence = 2"))])
        two._commit(stale, "append", [], LakeTable._NONE, {})
    with pytest.raises(Conflict):
        one.replace(first["snapshot-id"], one.active(), [])
    gone = one.active()
    current = one.snapshot()["snapshot-id"]
    one.replace(current, gone.limit(1), [])
    with pytest.raises(Conflict):
        one.replace(one.snapshot()["snapshot-id"], gone, [])


def test_compaction_keeps_rows(spark, tmp_path):
    table, rows = LakeTable(spark, str(tmp_path), "t", granularity="day"), log_rows(spark)
    for i in range(4):
        table.append([table.stage(rows.where(F.col("sequence") % 4 == i))])
    assert LakeTable(spark, str(tmp_path), "other").compact()["files_in"] == 0
    before = keys(table.read())
    done = table.compact(CompactionPolicy(max_files=3))
    assert done["files_in"] == 6 and done["files_out"] == 2 and keys(table.read()) == before
    assert table.compact()["files_in"] == 0 and table.snapshot()["summary"]["operation"] == "replace"


def test_structured_table(spark, tmp_path):
    config = TableConfig((Extracted("v", "v", "Int64"),), "json")
    table, rows = LakeTable(spark, str(tmp_path), "t", config), log_rows(spark)
    for i in range(3):
        table.append([table.stage(rows.where(F.col("sequence") % 3 == i))])
    table.compact()
    got = table.read()
    assert got.columns == ["sequence", "topic", "partition", "timestamp_ms", "idempotency_key", "v", "_payload_overflow", "event_date", "event_hour"]
    assert sorted(r.v for r in got.collect()) == sorted(r.arrival for r in rows.collect())


def test_hot_log_replays_and_cleans(spark, tmp_path):
    hot = HotLog(spark, str(tmp_path / "hot"))
    data = requests(spark)
    assert hot.append(data.where("arrival < 30"), 0) and not hot.append(data.where("arrival < 30"), 0) and hot.append(data.where("arrival >= 20"), 1)
    assert keys(hot.rows()) == keys(log_rows(spark))
    hot.set_marks("flush", [("t", 0, 4), ("t", 1, 2)])
    assert hot.clean() == 6 and hot.clean() == 0 and hot.rows().agg(F.min("sequence")).first()[0] == 3
    gone = requests(spark).where("idempotency_key = 'k0'").limit(1)
    high = hot.marks("high").agg(F.sum("high")).first()[0]
    hot.append(gone, 2)  # its key went with its row
    assert hot.marks("high").agg(F.sum("high")).first()[0] == high + 1


def test_flush_survives_a_crash_before_the_commit(spark, tmp_path):
    clock = [0.0]
    hot = HotLog(spark, str(tmp_path / "hot"))
    hot.append(requests(spark), 0)
    policy = FlushPolicy(most_rows=20, snapshot_files=10**6, snapshot_age_s=60, retention_s=30)
    flusher = Flusher(hot, str(tmp_path / "lake"), policy, clock=lambda: clock[0])
    assert flusher.cycle() == 40 and flusher.table("t").read().count() == 0 and hot.marks("flush").count() == 0
    again = Flusher(hot, str(tmp_path / "lake"), policy, clock=lambda: clock[0])  # the first one is lost
    again.cycle()
    clock[0] = 61.0
    assert again.cycle() > 0 and hot.marks("flush").count() == 2
    assert again.flush_now()["new_watermark"] == hot.marks("high").agg(F.max("high")).first()[0]
    assert keys(again.table("t").read()) == keys(hot.rows())
    assert again.clean_if_due() == 0
    clock[0] = 92.0
    assert again.clean_if_due() > 0 and hot.rows().count() == 0


def test_reconcile_raises_marks(spark, tmp_path):
    hot = HotLog(spark, str(tmp_path / "hot"))
    hot.append(requests(spark), 0)
    flusher = Flusher(hot, str(tmp_path / "lake"))
    table = flusher.table("t")
    table.append([table.stage(hot.rows().where("sequence <= 7"))])  # committed, but the mark was never saved
    flusher.reconcile()
    assert {r.flush for r in hot.marks("flush").collect()} == {7}


def test_greedy_batches_match_a_loop(spark):
    rows = with_partition_columns(log_rows(spark))
    got = {(r.partition, r.event_date, r.sequence): r.batch for r in greedy_batches(rows, 400).collect()}
    held, batch, last = 0, 0, None
    for r in rows.orderBy("partition", "event_date", "sequence").collect():
        if (r.partition, r.event_date) != last:
            held, batch, last = 0, 0, (r.partition, r.event_date)
        assert got[r.partition, r.event_date, r.sequence] == batch
        held += len(r.payload) + 100
        if held >= 400:
            held, batch = 0, batch + 1


def test_catalog(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path), "t")
    table.append([table.stage(log_rows(spark))])
    catalog = Catalog(spark, str(tmp_path), "lake.events")
    space = "lake\x1fevents"
    assert catalog.namespaces() == [["lake"]] and catalog.namespaces("lake") == [["lake", "events"]] and catalog.tables(space) == ["t"]
    assert catalog.exists(space, "t") and not catalog.exists(space, "u") and catalog.table(space, "t")["metadata"]["current-snapshot-id"] == table.snapshot()["snapshot-id"]
    with pytest.raises(NoSuchNamespace):
        catalog.namespace("lake")
    assert spark.sql(f"SELECT count(*) FROM {catalog.register('t')}").first()[0] == table.read().count()


def test_exposition():
    text = exposition({"writes_total": [({}, 3)], "consumer_lag": [({"topic": 'a"b', "partition": 0}, 5)], "flush_duration_us": [({}, {**{f"le_{b}": 1 for b in (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000)}, "le_inf": 2, "total": 7.0, "n": 2})]}, "x_")
    assert "x_writes_total 3" in text and 'x_consumer_lag{topic="a\\"b",partition="0"} 5' in text and 'x_flush_duration_us_bucket{le="+Inf"} 2' in text


def test_flush_of_one_topic_counts_that_topic(spark, tmp_path):
    hot = HotLog(spark, str(tmp_path / "hot"))
    hot.append(requests(spark, topic="t").unionByName(requests(spark, n=10, topic="u")), 0)
    flusher = Flusher(hot, str(tmp_path / "lake"), FlushPolicy(snapshot_files=1), granularity="day")
    done = flusher.flush_now("u")
    assert done["events_flushed"] == flusher.table("u").read().count() == 10 and done["segments_written"] == flusher.table("u").active().count() > 0
    assert flusher.table("t").version() == 0 and {r.topic for r in hot.marks("flush").collect()} == {"u"}


def test_compaction_cuts_at_the_target_one_at_a_time(spark, tmp_path):
    table, rows = LakeTable(spark, str(tmp_path), "t", granularity="day"), log_rows(spark, n=400)
    for i in range(3):
        table.append([table.stage(rows.where(F.col("sequence") % 3 == i))])
    size = table.active().agg(F.sum("file_size")).first()[0]
    before = keys(table.read())
    assert table.compact(CompactionPolicy(target_bytes=size // 5))["files_out"] > 2 and keys(table.read()) == before
    lake._BUSY.add(table.base)
    try:
        with pytest.raises(Conflict):
            table.compact()
    finally:
        lake._BUSY.discard(table.base)


def test_later_formats_are_refused(spark, tmp_path):
    hot = HotLog(spark, str(tmp_path / "hot"))
    hot.append(requests(spark), 0)
    assert hot.state()["format_version"] == 1
    hot._save(hot.state() | {"format_version": 2})
    with pytest.raises(RuntimeError):
        hot.rows()


def test_external_registration(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    table = LakeTable(spark, str(tmp_path), "t", granularity="day")
    table.append([table.stage(log_rows(spark))])
    asked = []

    class Other(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(409 if len(asked) < 3 else 200)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Other)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    catalog = Catalog(spark, str(tmp_path), "lake.events")
    assert catalog.register_external(f"http://127.0.0.1:{server.server_port}", "t") is None
    server.shutdown()
    server.server_close()
    assert [p for p, _ in asked] == ["/v1/namespaces", "/v1/namespaces/lake%1Fevents/tables", "/v1/namespaces/lake%1Fevents/tables/t"]
    assert asked[2][1]["updates"][1]["snapshot-id"] == table.snapshot()["snapshot-id"]
    assert catalog.register_external(f"http://127.0.0.1:{server.server_port}", "t")


def test_avro_round_trip_and_layout():
    from eventlake.sources import avro

    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": {"type": "array", "items": "int"}}, {"name": "d", "type": {"type": "map", "values": "bytes"}}]}
    rows = [{"a": a, "b": b, "c": c, "d": d} for a, b, c, d in [(0, None, [], {}), (-1, "é", [1, -64, 64], {"k": b"\0"}), (2**63 - 1, "", [0], {}), (-(2**63), "x" * 300, [], {"k": b"", "l": b"z"})]]
    sync = b"s" * 16
    raw = avro.header(schema, {"k": "v"}, sync) + avro.block(4, b"".join(avro.encode(schema, r) for r in rows), sync)
    head, got = avro.read_file(raw)
    assert got == rows and head["k"] == b"v" and avro.encode("long", 64) == b"\x80\x01" and avro.encode("int", -1) == b"\x01"
    with pytest.raises(ValueError):
        avro.read_file(b"none")


@pytest.mark.parametrize("granularity", ["day", "hour"])
def test_avro_manifests_show_the_active_files(spark, tmp_path, granularity):
    from eventlake.operators.manifests import live_files, read_list

    table, rows = LakeTable(spark, str(tmp_path), "t", granularity=granularity), log_rows(spark)

    def same():
        found = live_files(table.files, table.snapshot()["manifest-list"])
        want = {r.path: r for r in table.active().collect()}
        assert found.keys() == want.keys()
        for path, r in want.items():
            low, high = ({b["key"]: int.from_bytes(b["value"], "little", signed=True) for b in found[path][f"{k}_bounds"]} for k in ("lower", "upper"))
            assert (low[1], high[1], low[5], high[5], low[3], found[path]["record_count"], found[path]["file_size_in_bytes"]) == (r.sequence_min, r.sequence_max, r.timestamp_ms_min, r.timestamp_ms_max, r.partition, r.n, r.file_size)
            assert found[path]["partition"]["partition"] == r.partition and found[path]["partition"]["event_date"] == 19737 == low[7]
            assert ("event_hour" in found[path]["partition"]) == (granularity == "hour")

    for i in range(4):
        table.append([table.stage(rows.where(F.col("sequence") % 4 == i))])
        same()
    assert len(read_list(table.files, table.snapshot()["manifest-list"])) == 4
    table.compact(CompactionPolicy(max_files=3))
    same()
    listed = read_list(table.files, table.snapshot()["manifest-list"])
    assert sum(m["deleted_files_count"] for m in listed) == int(table.snapshot()["summary"]["deleted-data-files"]) and {m["sequence_number"] for m in listed} == {5}
    assert sum(m["added_rows_count"] + m["existing_rows_count"] for m in listed) == rows.count() and min(m["min_sequence_number"] for m in listed) == 1
    table.append([table.stage(rows.where("false"))])
    same()


@pytest.mark.parametrize("n_empty", [0, 1])
def test_avro_files_open_with_the_public_library(spark, tmp_path, n_empty):
    """Read through the Avro classes among Spark's jars."""
    table = LakeTable(spark, str(tmp_path), "t", granularity="day")
    rows = log_rows(spark)
    for part in [rows, *[rows.where("false")] * n_empty]:
        table.append([table.stage(part)])
    jvm = spark.sparkContext._jvm
    records = []
    for path in [table.snapshot()["manifest-list"]]:
        reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(path), jvm.org.apache.avro.generic.GenericDatumReader())
        while reader.hasNext():
            records.append(reader.next())
    assert len(records) == 1
    manifest = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(records[0].get("manifest_path").toString()), jvm.org.apache.avro.generic.GenericDatumReader())
    paths = set()
    while manifest.hasNext():
        paths.add(manifest.next().get("data_file").get("file_path").toString())
    assert paths == {r.path for r in table.active().collect()}


def test_compactions_beside_each_other_leave_the_session_alone(spark, tmp_path, monkeypatch):
    set_, changed = type(spark.conf).set, []
    monkeypatch.setattr(type(spark.conf), "set", lambda self, key, value: (changed.append(key), set_(self, key, value)))
    tables = [LakeTable(spark, str(tmp_path), f"t{i}", granularity="day") for i in range(2)]
    for t in tables:
        rows = spark.range(90).selectExpr("id + 1 AS sequence", f"'{t.topic}' AS topic", "int(id % 2) AS partition", "binary('x') AS payload", "id * 900000 AS timestamp_ms", "string(id) AS idempotency_key")
        t.append([t.stage(rows.where(F.col("sequence") % 3 == i)) for i in range(3)])
    before = {t.topic: (t.read().count(), t.active().groupBy("event_date_min", "partition").count().count()) for t in tables}
    changed.clear()
    with ThreadPoolExecutor(2) as pool:
        done = dict(zip(before, pool.map(LakeTable.compact, tables), strict=True))
    assert not changed
    for t in tables:  # one file for each directory, the same rows
        assert (t.read().count(), t.active().count()) == before[t.topic] == (done[t.topic]["rows"], done[t.topic]["files_out"])
        assert t.snapshot()["summary"]["total-records"] == str(before[t.topic][0])
