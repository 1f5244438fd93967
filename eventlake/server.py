"""A thin HTTP layer over the hot log, the lake and the catalog; standard library only.

Write requests that wait at the same time are one micro-batch. That suits tests, tools and small producers; heavy producers should
write files or a stream, which `streaming.flush.ingest_stream` appends in larger batches.
"""

from __future__ import annotations

import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import log as L
from .operators import metrics as M
from .operators import read as R
from .operators.catalog import Catalog, NoSuchTable
from .operators.checks import LATENCY_BUCKETS
from .schema import check_table_name
from .service import SUPPORTED, Gate, Overloaded, error_response, negotiate
from .sources import ingest
from .sources.files import Files
from .streaming.combiner import Combiner
from .streaming.flush import Flusher

_JSON, _ARROW = SUPPORTED
_COLUMNS = "arrival long, topic string, partition int, payload binary, timestamp_ms long, idempotency_key string"


#: Method, path and what it does, of every route.
ROUTES = (
    ("get", "/health", "liveness"), ("get", "/health/live", "liveness"), ("get", "/health/ready", "readiness of the hot log, the lake and the gate"),
    ("get", "/stats", "counters and rates"), ("get", "/metrics", "counters as exposition text"), ("get", "/openapi.json", "this document"),
    ("post", "/tables/{table}", "write one event"), ("post", "/tables/{table}/bulk", "write events"), ("get", "/tables/{table}", "read events"),
    ("get", "/tables/{table}/metadata", "where the table's metadata is"), ("get", "/tables/{table}/watermark", "flush and high marks"),
    ("post", "/tables/{table}/flush", "flush now"), ("post", "/tables/{table}/compact", "merge small files"),
    ("post", "/consumers/{group}/commit", "commit an offset"), ("get", "/consumers/{group}/offset", "the committed offset"),
    ("get", "/v1/config", "catalog configuration"), ("get", "/v1/namespaces", "namespaces"), ("get", "/v1/namespaces/{namespace}", "a namespace"),
    ("get", "/v1/namespaces/{namespace}/tables", "its tables"), ("get", "/v1/namespaces/{namespace}/tables/{table}", "a table's metadata"), ("head", "/v1/namespaces/{namespace}/tables/{table}", "whether a table exists"),
)


def openapi() -> dict:
    """The OpenAPI document of ROUTES; names in braces are path parameters."""
    paths: dict[str, dict] = {}
    for method, path, what in ROUTES:
        given = [{"name": n, "in": "path", "required": True, "schema": {"type": "string"}} for n in re.findall(r"{(\w+)}", path)]
        status = "202" if path.startswith("/tables/") and method == "post" and path.endswith(("{table}", "/bulk")) else "204" if method == "head" else "200"
        paths.setdefault(path, {})[method] = {"summary": what, "parameters": given, "responses": {status: {"description": "done"}, "default": {"description": "an error and its code"}}}
    return {"openapi": "3.0.3", "info": {"title": "eventlake", "version": "1"}, "paths": paths}


def _answers(ask) -> str:
    try:
        ask()
    except Exception:
        return "unavailable"
    return "ok"


def _checked(events: list[dict]) -> list[dict]:
    """The events, if the log's columns can hold them: one that can't must not fail the batch it would share."""
    for e in events:
        if not 0 <= e["partition"] < 1 << 31 or not -(1 << 63) <= e["timestamp_ms"] < 1 << 63 or not isinstance(e["idempotency_key"], str | None):
            raise ValueError("a partition, time or key is out of range")
    return events


class App:
    def __init__(self, flusher: Flusher, namespace: str = "eventlake", gate: Gate | None = None, combiner: Combiner | None = None):
        self.flusher, self.hot, self.spark = flusher, flusher.hot, flusher.hot.spark
        self.catalog, self.gate = Catalog(self.spark, flusher.lake_root, namespace), gate or Gate()
        self.started, self.lock = time.time(), threading.Lock()
        self.combiner = combiner or Combiner(self._append)
        self.combiner.write = self._append
        self.requests: list[tuple[str, str, float, int]] = []  # kind, topic, microseconds, records
        self.errors = 0

    def handle(self, method: str, target: str, headers: dict[str, str], body: bytes) -> tuple[int, str, bytes]:
        """Status, content type and body."""
        url = urlsplit(target)
        path, query = [unquote(p) for p in url.path.strip("/").split("/")], {k: v[-1] for k, v in parse_qs(url.query).items()}
        headers = {k.lower(): v for k, v in headers.items()}
        try:
            out = self._route(method, path, query, headers, body)
        except Exception as e:
            self.errors += 1
            status, doc = error_response(e)
            return status, _JSON, json.dumps(doc).encode()
        if out is None:
            return 404, _JSON, b'{"error": "no such path", "code": "NOT_FOUND"}'
        status, doc, *kind = out
        return (status, kind[0], doc) if kind else (status, _JSON, json.dumps(doc).encode() if doc is not None else b"")

    def _route(self, method: str, path: list[str], query: dict, headers: dict, body: bytes):
        match (method, *path):
            case ("GET", "health") | ("GET", "health", "live"):
                return 200, {"status": "ok"}
            case ("GET", "health", "ready"):
                free, hot, cold = self.gate.ready(), _answers(lambda: self.hot.marks("high").isEmpty()), _answers(lambda: self.catalog.namespaces(None) and Files(self.spark).list(self.flusher.lake_root))
                good = free and hot == cold == "ok"
                return 200 if good else 503, {"status": "ok" if good else "unavailable", "hot_storage": {"status": hot}, "cold_storage": {"status": cold}, "backpressure": {
                    "status": "ok" if free else "overloaded", "inflight_writes": self.gate.writes, "inflight_bytes": self.gate.bytes, "max_inflight_bytes": self.gate.most_bytes}}
            case ("GET", "stats"):
                return 200, self.stats()
            case ("GET", "metrics"):
                return 200, self.metrics().encode(), "text/plain; version=0.0.4"
            case ("POST", "tables", table):
                return self._write(check_table_name(table), headers, body, bulk=False)
            case ("POST", "tables", table, "bulk"):
                return self._write(check_table_name(table), headers, body, bulk=True)
            case ("GET", "tables", table):
                return self._read(check_table_name(table), query, headers)
            case ("GET", "tables", table, "metadata"):
                found = self.flusher.table(check_table_name(table))
                n = found.version()
                return 200, {"table": table, "storage_type": "iceberg", "iceberg_enabled": True, "base_path": found.base} | ({"metadata_location": f"{found.base}/metadata/v{n}.metadata.json"} if n else {})
            case ("GET", "tables", table, "watermark"):
                topic = F.col("topic") == check_table_name(table)
                report = L.watermark_report(self.hot.marks("flush").where(topic), self.hot.marks("high").where(topic)).collect()
                return 200, {"topic": table, "partitions": {str(r.partition): {"watermark": r.flush, "high_watermark": r.high} for r in report}}
            case ("POST", "tables", table, "flush"):
                with self.lock:
                    done = self.flusher.flush_now(check_table_name(table))
                return 200, {"status": "ok", "message": f"{done['events_flushed']} events are in the lake now", "events_flushed": done["events_flushed"], "segments_written": done["segments_written"]}
            case ("POST", "tables", table, "compact"):
                with self.lock:
                    done = self.flusher.table(check_table_name(table)).compact()
                return 200, {"status": "ok", "message": "small files were merged" if done["files_in"] else "no small files to merge", "files_compacted": done["files_in"]}
            case ("POST", "consumers", group, "commit"):
                r = json.loads(body)
                with self.lock:
                    self.hot.commit_offset(group, r["topic"], int(r.get("partition", 0)), int(r["offset"]))
                return 200, {"group": group, "topic": r["topic"], "partition": int(r.get("partition", 0)), "offset": int(r["offset"])}
            case ("GET", "consumers", group, "offset"):
                p = int(query.get("partition", 0))
                return 200, {"group": group, "topic": query["topic"], "partition": p, "offset": self.hot.committed_offset(group, query["topic"], p)}
            case ("GET", "openapi.json"):
                return 200, openapi()
            case ("GET", "v1", "config"):
                return 200, self.catalog.config()
            case ("GET", "v1", "namespaces"):
                return 200, {"namespaces": self.catalog.namespaces(query.get("parent"))}
            case ("GET", "v1", "namespaces", ns):
                return 200, self.catalog.namespace(ns)
            case ("GET", "v1", "namespaces", ns, "tables"):
                return 200, {"identifiers": [{"namespace": self.catalog.levels, "name": n} for n in self.catalog.tables(ns)]}
            case ("GET", "v1", "namespaces", ns, "tables", table):
                return 200, self.catalog.table(ns, table)
            case ("HEAD", "v1", "namespaces", ns, "tables", table):
                if not self.catalog.exists(ns, table):
                    raise NoSuchTable(table)
                return 204, None
        return None

    def _decode(self, headers: dict, body: bytes, bulk: bool) -> list[dict]:
        """Events of a request, with defaults put in."""
        now = int(time.time() * 1000)
        if headers.get("content-type", "").startswith("application/x-protobuf"):
            events = ingest.decoded(body, bulk)
            if events is None:
                raise ValueError("malformed message")
            try:
                given = int(headers.get("x-partition", 0))
            except ValueError:
                given = 0
            return _checked([e | {"partition": e["partition"] if bulk else given, "timestamp_ms": e["timestamp_ms"] or now, "idempotency_key": e["idempotency_key"] or None} for e in events])
        doc = json.loads(body)
        events = doc["records"] if bulk else [doc]
        if not all(isinstance(e, dict) and isinstance(e.get("payload"), str) for e in events):
            raise ValueError("a record needs a payload text")
        return _checked([{"payload": e["payload"].encode(), "partition": int(e.get("partition") or 0), "timestamp_ms": now if e.get("timestamp_ms") is None else int(e["timestamp_ms"]), "idempotency_key": e.get("idempotency_key")} for e in events])

    def _append(self, requests: list[tuple[str, list[dict]]]) -> list[list[int]]:
        """Writes requests as one batch; the sequences of each one's events."""
        rows = [(topic, e["partition"], bytearray(e["payload"]), e["timestamp_ms"], e["idempotency_key"]) for topic, events in requests for e in events]
        with self.lock:
            placed = self.hot.append_for_offsets(self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], _COLUMNS))
            got = iter([v for _, v in sorted(tuple(r) for r in placed.collect())])  # of these requests alone
        return [[next(got) for _ in events] for _, events in requests]

    def _write(self, table: str, headers: dict, body: bytes, bulk: bool):
        begin = time.time()
        if not self.gate.enter(len(body)):
            raise Overloaded("too many writes in flight")
        try:
            try:
                events = self._decode(headers, body, bulk)
            except (KeyError, TypeError, ValueError) as e:
                raise ValueError(f"bad request: {e}") from e
            if not events:
                return 202, {"offsets": [], "count": 0, "table": table}
            got = self.combiner.submit(table, events, len(body))
        finally:
            self.gate.leave(len(body))
        self.requests.append(("write", table, (time.time() - begin) * 1e6, len(events)))
        placed = [{"offset": got[i], "partition": e["partition"]} for i, e in enumerate(events)]
        return 202, {"offsets": placed, "count": len(placed), "table": table} if bulk else placed[0] | {"table": table}

    def all_rows(self, table: str) -> DataFrame:
        """The lake's rows and the hot log's that it doesn't have yet."""
        cold, hot = self.flusher.table(table).read(), self.hot.rows().where(F.col("topic") == table)
        return R.hot_and_cold(cold, hot, self.hot.marks("flush"))

    def _read(self, table: str, query: dict, headers: dict):
        begin, kind = time.time(), negotiate(headers.get("accept"))
        limit, since, fields = int(query.get("limit", 100)), query.get("since"), query.get("fields")
        rows = self.all_rows(table)
        probe = R.merged(rows, table, None if since is None else int(since), limit + 1)
        if kind == _ARROW:
            return 200, R.arrow_stream(probe.limit(limit), fields), _ARROW
        found = [json.loads(r.j) for r in probe.select(R.as_json(probe, fields).alias("j")).collect()]  # limit + 1 rows
        self.requests.append(("read", table, (time.time() - begin) * 1e6, min(limit, len(found))))
        return 200, {"records": found[:limit], "count": min(limit, len(found)), "has_more": len(found) > limit}

    def stats(self) -> dict:
        up = time.time() - self.started
        out = {"uptime_secs": up}
        for kind in ("write", "read"):
            own = [r for r in self.requests if r[0] == kind]
            out[kind + "s"] = {"total": len(own), "records": sum(r[3] for r in own), "rate_per_sec": len(own) / up if up > 0 else 0.0, "avg_latency_us": sum(r[2] for r in own) / len(own) if own else 0.0}
        return out | {"errors_total": self.errors}

    def metrics(self) -> str:
        s, up = self.stats(), {}
        for kind in ("write", "read"):
            own = [r for r in self.requests if r[0] == kind]
            cells = {f"le_{b}": sum(r[2] <= b for r in own) for b in LATENCY_BUCKETS}
            up[f"{kind}_latency_us"] = [({}, cells | {"le_inf": len(own), "total": round(sum(r[2] for r in own), 2), "n": len(own)})] if own else []
            up[f"{kind}s_by_topic_total"] = [({"topic": t}, sum(r[1] == t for r in own)) for t in sorted({r[1] for r in own})]
        high = self.hot.marks("high").collect()
        up |= {"uptime_secs": [({}, round(s["uptime_secs"], 3))], "writes_total": [({}, s["writes"]["total"])], "reads_total": [({}, s["reads"]["total"])], "reads_records_total": [({}, s["reads"]["records"])]}
        up |= {"errors_total": [({}, self.errors)], "inflight_bytes": [({}, self.gate.bytes)], "inflight_writes_available": [({}, self.gate.most_writes - self.gate.writes)], "backpressure_rejections_total": [({}, self.gate.refused)]}
        up["write_combiner_queue_depth"] = [({"shard": i}, n) for i, n in enumerate(self.combiner.depths())]
        up["write_combiner_queue_depth_total"] = [({}, sum(self.combiner.depths()))]
        up |= self.flusher.samples()
        up["high_watermark"] = [({"topic": r.topic, "partition": r.partition}, r.high) for r in high]
        return M.exposition(up)


def serve(app: App, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for the app; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, out = app.handle(self.command, self.path, dict(self.headers), body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(out)

        do_GET = do_POST = do_HEAD = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
