import io
import json
import threading
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest

from eventlake.plans.suite import event_message
from eventlake.server import App, serve
from eventlake.service import Gate, Overloaded
from eventlake.streaming.combiner import Combiner
from eventlake.streaming.flush import Flusher, HotLog


@pytest.fixture
def app(spark, tmp_path):
    return App(Flusher(HotLog(spark, str(tmp_path / "hot")), str(tmp_path / "lake"), granularity="day"), "lake.events", Gate(most_bytes=1 << 20))


def call(app, method, path, body=None, **headers):
    raw = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else b""
    status, kind, out = app.handle(method, path, {k.replace("_", "-"): v for k, v in headers.items()}, raw)
    return status, json.loads(out) if kind == "application/json" and out else out


def test_writes_reads_and_flushes(app):
    assert call(app, "POST", "/tables/t", {"payload": "a", "timestamp_ms": 1000, "idempotency_key": "k"}) == (202, {"offset": 1, "partition": 0, "table": "t"})
    assert call(app, "POST", "/tables/t", {"payload": "b", "timestamp_ms": 2000, "idempotency_key": "k"})[1]["offset"] == 1
    status, bulk = call(app, "POST", "/tables/t/bulk", {"records": [{"payload": "c", "partition": 9, "timestamp_ms": 1500}, {"payload": "d", "timestamp_ms": 3000, "idempotency_key": "x"}, {"payload": "e", "timestamp_ms": 4000, "idempotency_key": "x"}]})
    assert status == 202 and [o["offset"] for o in bulk["offsets"]] == [1, 2, 2]
    assert call(app, "POST", "/tables/t", event_message(b"\xff", 5000, None), content_type="application/x-protobuf", x_partition="3")[1] == {"offset": 1, "partition": 3, "table": "t"}
    assert call(app, "POST", "/tables/t/bulk", {"records": []})[0] == 202
    want = {"records": [{"payload": "a", "timestamp_ms": 1000}, {"payload": "c", "timestamp_ms": 1500}], "count": 2, "has_more": True}
    assert call(app, "GET", "/tables/t?limit=2") == (200, want)
    assert call(app, "POST", "/tables/t/flush")[1]["events_flushed"] == 4
    assert call(app, "GET", "/tables/t?limit=2") == (200, want)
    assert call(app, "GET", "/tables/t?since=1500&fields=sequence,payload")[1]["records"] == [{"sequence": 1, "payload": "c"}, {"sequence": 2, "payload": "d"}, {"sequence": 1, "payload": "�"}]
    stream = call(app, "GET", "/tables/t", accept="application/vnd.apache.arrow.stream")[1]
    assert pa.ipc.open_stream(io.BytesIO(stream)).read_all().num_rows == 4
    assert call(app, "GET", "/tables/t/watermark")[1]["partitions"]["0"] == {"watermark": 2, "high_watermark": 2}
    assert call(app, "POST", "/tables/t/compact")[1]["files_compacted"] == 0
    assert call(app, "GET", "/v1/namespaces/lake%1Fevents/tables")[1]["identifiers"] == [{"namespace": ["lake", "events"], "name": "t"}]
    assert call(app, "HEAD", "/v1/namespaces/lake%1Fevents/tables/t")[0] == 204 and call(app, "HEAD", "/v1/namespaces/lake%1Fevents/tables/u")[0] == 404
    assert call(app, "GET", "/stats")[1]["writes"]["total"] == 4 and b'eventlake_writes_by_topic_total{topic="t"} 4' in call(app, "GET", "/metrics")[1]


def test_errors_and_offsets(app):
    assert call(app, "POST", "/tables/9t", {"payload": "a"})[0] == 400 and call(app, "POST", "/tables/t", b"{")[1]["code"] == "BAD_REQUEST"
    assert call(app, "GET", "/tables/t?fields=nope")[0] == 400 and call(app, "GET", "/tables/t", accept="text/html")[0] == 406
    assert call(app, "GET", "/tables/none") == (200, {"records": [], "count": 0, "has_more": False})
    assert call(app, "POST", "/tables/t", b"x" * (2 << 20))[0] == 503 and call(app, "GET", "/nothing")[0] == 404
    assert call(app, "GET", "/consumers/g/offset?topic=t")[1]["offset"] is None
    for offset in (2**63 - 1, 0):
        call(app, "POST", "/consumers/g/commit", {"topic": "t", "offset": offset})
    assert call(app, "GET", "/consumers/g/offset?topic=t")[1]["offset"] == 0


def test_over_http(app):
    server = serve(app, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as r:
            assert r.status == 200 and json.loads(r.read()) == {"status": "ok"}
    finally:
        server.shutdown()


def test_every_route_is_in_the_document(app):
    status, doc = call(app, "GET", "/openapi.json")
    assert status == 200 and len(doc["paths"]) > 15 and set(doc["paths"]["/tables/{table}"]) == {"get", "post"}
    assert call(app, "GET", "/health/ready")[1]["hot_storage"] == {"status": "ok"}


def test_writes_together_are_few_batches_and_number_as_one_by_one(app):
    app.combiner.window_s = 0.5
    one = lambda i: call(app, "POST", "/tables/t", {"payload": f"p{i}", "timestamp_ms": 1000 + i, "idempotency_key": f"k{i % 20}"})[1]["offset"]
    with ThreadPoolExecutor(24) as pool:
        got = list(pool.map(one, range(24)))
    assert sorted(set(got)) == list(range(1, 21)) and all(got[i] == got[i + 20] for i in range(4))
    assert len(app.hot.state()["batches"]) <= 6 and app.hot.rows().count() == 20
    assert call(app, "POST", "/tables/t", {"payload": "x", "partition": 1 << 40})[0] == 400 and call(app, "POST", "/tables/t", {"payload": "x", "idempotency_key": 5})[0] == 400
    call(app, "POST", "/consumers/g/commit", {"topic": "t", "offset": 7})
    text = call(app, "GET", "/metrics")[1].decode()
    assert "eventlake_hot_storage_events 20" in text and 'consumer_lag{group="g",topic="t",partition="0"} 13' in text and "write_combiner_queue_depth_total 0" in text
    call(app, "POST", "/tables/t/flush")
    assert "eventlake_flush_events_total 20" in call(app, "GET", "/metrics")[1].decode()


def test_a_bad_request_fails_alone_and_a_full_queue_refuses():
    begun, go, batches = threading.Event(), threading.Event(), []

    def write(requests):
        batches.append([e for _, events in requests for e in events])
        begun.set()
        go.wait(10)
        if "bad" in batches[-1]:
            raise ValueError("bad")
        return [[f"{topic}/{e}" for e in events] for topic, events in requests]

    combiner = Combiner(write, shards=1, most_rows=3, window_s=0.0, most_queued=4, most_bytes=100)
    with ThreadPoolExecutor(8) as pool:
        jobs = [pool.submit(combiner.submit, "t", ["a"], 10)]
        begun.wait(10)
        for events in (["b", "c"], ["bad"], ["d"] * 5):
            n = combiner.depths()[0]
            jobs.append(pool.submit(combiner.submit, "t", events, 10))
            while combiner.depths()[0] == n:
                pass
        with pytest.raises(Overloaded):
            combiner.submit("t", ["e"], 80)
        jobs.append(pool.submit(combiner.submit, "u", ["e"], 10))
        while combiner.depths()[0] == 3:
            pass
        with pytest.raises(Overloaded):
            combiner.submit("t", ["e"], 1)
        go.set()
        assert isinstance(jobs[2].exception(10), ValueError)
        assert [jobs[i].result(10) for i in (0, 1, 3, 4)] == [["t/a"], ["t/b", "t/c"], ["t/d"] * 5, ["u/e"]]
    assert batches == [["a"], ["b", "c", "bad"], ["b", "c"], ["bad"], ["d"] * 5, ["e"]] and combiner.depths() == [0]
