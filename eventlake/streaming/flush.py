"""The stream side: ingest to the hot log in micro-batches, and flushes from it to the lake.

A batch is numbered and written by the same functions as in batch jobs. Its id is part of what it commits, so
a replayed batch changes nothing.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log as L
from ..operators.lake import PREFIX, LakeTable
from ..schema import LOG
from ..sources.files import Files


#: Of the hot log's state and rows; raised when either changes.
FORMAT = 1


@dataclass(frozen=True)
class FlushPolicy:
    # Defaults of a lake's flushes and snapshots.
    most_rows: int = 100_000
    target_bytes: int = 128 << 20
    snapshot_files: int = 10
    snapshot_bytes: int = 1 << 30
    snapshot_age_s: float = 1800.0
    retention_s: float = 0.0


class HotLog:
    """Appended Parquet batches and a versioned state document with the marks of each partition."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _names(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.list(f"{self.root}/state") if n.startswith("s") and n.endswith(".json"))

    def state(self) -> dict:
        names = self._names()
        if not names:
            return {"format_version": FORMAT, "version": 0, "batches": [], "last_batch": -1, "marks": {}}
        state = json.loads(self.files.read(f"{self.root}/state/s{names[-1]}.json"))
        if state.setdefault("format_version", 1) > FORMAT:  # logs from before the field are of the first format
            raise RuntimeError(f"the hot log has format {state['format_version']}; this code reads up to {FORMAT}")
        return state

    def _save(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        if not self.files.create(f"{self.root}/state/s{state['version']}.json", json.dumps(state), uuid.uuid4().hex):
            raise RuntimeError("another writer has the hot log")

    def rows(self, state: dict | None = None) -> DataFrame:
        state = state or self.state()
        if not state["batches"]:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.root}/{b}" for b in state["batches"]])
        low = self._marks(state, "cleanup")
        return L.uncommitted(rows, low.withColumnRenamed("cleanup", "flush"))

    def _marks(self, state: dict, name: str) -> DataFrame:
        found = [(*json.loads(k), v[name]) for k, v in state["marks"].items() if v.get(name)]
        return self.spark.createDataFrame(found, f"topic string, partition int, {name} long")

    def marks(self, name: str) -> DataFrame:
        """high, flush or cleanup of each partition that has it."""
        return self._marks(self.state(), name)

    def append(self, batch: DataFrame, batch_id: int | None = None, order: str = "arrival") -> bool:
        """Adds the new rows of a batch (topic, partition, payload, timestamp_ms, idempotency_key and an integer column `order`).

        Keys that the hot log still has are not written again. False if the batch id was seen before.
        """
        state = self.state()
        if batch_id is not None and batch_id <= state["last_batch"]:
            return False
        self._append(state, batch, batch_id, order)
        return True

    def append_for_offsets(self, batch: DataFrame, order: str = "arrival") -> DataFrame:
        """Adds a batch; returns `order` and the sequence of each of its rows, new or not."""
        state = self.state()
        known = self.rows(state).where("idempotency_key is not null").select(*L.PART, "idempotency_key", "sequence")
        name = self._append(state, batch, None, order)
        return L.offsets_of_batch(batch, self.spark.read.parquet(f"{self.root}/{name}"), order, known)

    def _append(self, state: dict, batch: DataFrame, batch_id: int | None, order: str) -> str:
        known = self.rows(state).where("idempotency_key is not null").select(*L.PART, "idempotency_key")
        new = L.write_batch(batch, order, known, self._marks(state, "high"))
        name = f"batch-{uuid.uuid4().hex}"
        new.select(*LOG.fieldNames(), order).write.parquet(f"{self.root}/{name}")
        written = self.spark.read.schema(LOG).parquet(f"{self.root}/{name}")
        for topic, partition, high in L.high_marks(written).collect():  # a row for each partition
            state["marks"].setdefault(json.dumps([topic, partition]), {})["high"] = high
        self._save(state | {"batches": [*state["batches"], name], "last_batch": state["last_batch"] if batch_id is None else batch_id})
        return name

    def set_marks(self, name: str, marks: list[tuple[str, int, int]]) -> None:
        """Raises marks; they never fall."""
        state = self.state()
        for topic, partition, value in marks:
            held = state["marks"].setdefault(json.dumps([topic, partition]), {})
            held[name] = max(held.get(name, 0), value)
        self._save(state)

    def commit_offset(self, group: str, topic: str, partition: int, offset: int) -> None:
        """The last commit stands, greater or not."""
        state = self.state()
        self._save(state | {"offsets": state.get("offsets", {}) | {json.dumps([group, topic, partition]): offset}})

    def committed_offset(self, group: str, topic: str, partition: int) -> int | None:
        return self.state().get("offsets", {}).get(json.dumps([group, topic, partition]))

    def clean(self) -> int:
        """Drops rows up to the flush marks, with their keys. Returns how many sequences that covers; repeated, 0."""
        state = self.state()
        width = sum(max(0, v.get("flush", 0) - v.get("cleanup", 0)) for v in state["marks"].values())
        if not width:
            return 0
        for v in state["marks"].values():
            v["cleanup"] = max(v.get("cleanup", 0), v.get("flush", 0))
        left, name = self.rows(state), f"batch-{uuid.uuid4().hex}"
        left.write.parquet(f"{self.root}/{name}")
        self._save(state | {"batches": [name]})
        return width


@dataclass
class Flusher:
    """Moves rows above the flush marks to lake tables. Marks move only when a snapshot has the files."""

    hot: HotLog
    lake_root: str
    policy: FlushPolicy = FlushPolicy()
    clock: Callable[[], float] = time.time
    granularity: str = "hour"
    pending: dict[str, list[DataFrame]] = field(default_factory=dict)
    staged_to: dict[tuple[str, int], int] = field(default_factory=dict)
    since: dict[str, float] = field(default_factory=dict)
    clean_at: float | None = None
    writers: int = 4
    segments: int = 0
    snapshots: int = 0
    flushed: int = 0
    flushed_bytes: int = 0
    cleaned: int = 0
    last_error: Exception | None = None

    def table(self, topic: str) -> LakeTable:
        return LakeTable(self.hot.spark, self.lake_root, topic, granularity=self.granularity, clock=self.clock)

    def reconcile(self) -> None:
        """At a start: raises durable flush marks to what the lake's snapshots already have."""
        for topic in [r.topic for r in L.topics_of(self.hot.marks("high")).collect()]:
            marks = [(r.topic, r.partition, r.flush) for r in self.table(topic).watermarks().collect()]
            if marks:
                self.hot.set_marks("flush", marks)

    def _marks(self) -> DataFrame:
        spark = self.hot.spark
        staged = spark.createDataFrame([(t, p, v) for (t, p), v in self.staged_to.items()], "topic string, partition int, flush long")
        return L.raise_marks(self.hot.marks("flush"), staged, "flush")

    def cycle(self, only: str | None = None) -> int:
        """Stages one bounded batch of each partition that has unflushed rows, of one topic or all, then commits topics whose time has come. Returns the rows staged.

        Topics are staged at the same time, `writers` at most; one that fails leaves the others as they are.
        """
        rows = L.uncommitted(self.hot.rows(), self._marks())
        rows = rows if only is None else rows.where(F.col("topic") == only)
        batch = L.size_prefix(L.count_prefix(rows, self.policy.most_rows), F.octet_length("payload") + 64, self.policy.target_bytes)
        todo = batch.groupBy(*L.PART).agg(F.max("sequence").alias("to"), F.count("*").alias("n")).collect()
        topics = sorted({r.topic for r in todo})
        with ThreadPoolExecutor(max(1, min(self.writers, len(topics)))) as pool:
            jobs = [(t, pool.submit(inheritable_thread_target(self.hot.spark)(self.table(t).stage), batch.where(F.col("topic") == t))) for t in topics]
        failed = None
        for topic, job in jobs:
            if job.exception() is not None:
                failed = failed or job.exception()
                continue
            self.pending.setdefault(topic, []).append(job.result())
            self.since.setdefault(topic, self.clock())
            self.staged_to.update({(r.topic, r.partition): r.to for r in todo if r.topic == topic})
            self.flushed += sum(r.n for r in todo if r.topic == topic)
        for topic in list(self.pending):
            if only in (None, topic) and self.due(topic):
                self.commit(topic)
        if failed is not None:
            raise failed
        return sum(r.n for r in todo)

    def run(self, interval_s: float, stop: threading.Event) -> None:
        """Cycles at an interval until `stop` is set; a failed cycle is tried again at the next, from the durable marks."""
        while not stop.wait(interval_s):
            try:
                self.cycle()
                self.clean_if_due()
            except Exception as e:
                self.last_error = e
                for topic in list(self.pending):
                    self.roll_back(topic)

    def pending_size(self, topic: str) -> tuple[int, int]:
        sizes = [m.agg(F.count("*"), F.coalesce(F.sum("file_size"), F.lit(0))).first() for m in self.pending.get(topic, [])]
        return sum(s[0] for s in sizes), sum(s[1] for s in sizes)

    def due(self, topic: str) -> bool:
        files, size = self.pending_size(topic)
        return files >= self.policy.snapshot_files or size >= self.policy.snapshot_bytes or self.clock() - self.since[topic] >= self.policy.snapshot_age_s

    def commit(self, topic: str) -> None:
        marks = [(t, p, v) for (t, p), v in self.staged_to.items() if t == topic]
        if not marks:
            raise RuntimeError(f"pending files of {topic} without a mark")
        self.table(topic).append(self.pending[topic], {f"{PREFIX}high_watermark.{p}": v for _, p, v in marks})
        self.hot.set_marks("flush", marks)
        files, size = self.pending_size(topic)
        self.segments, self.snapshots, self.flushed_bytes = self.segments + files, self.snapshots + 1, self.flushed_bytes + size
        del self.pending[topic], self.since[topic]
        self.staged_to = {k: v for k, v in self.staged_to.items() if k[0] != topic}
        self.clean_at = self.clock() + self.policy.retention_s if self.clean_at is None else self.clean_at

    def roll_back(self, topic: str) -> None:
        """Forgets staged files of a topic after a failure; its rows are staged again from the durable marks."""
        self.pending.pop(topic, None)
        self.since.pop(topic, None)
        self.staged_to = {k: v for k, v in self.staged_to.items() if k[0] != topic}

    def flush_now(self, topic: str | None = None) -> dict:
        """Stages and commits everything, of one topic or all, whatever the thresholds: rows, segments and the greatest mark."""
        rows, before = 0, self.segments
        while n := self.cycle(topic):
            rows += n
        for t in [t for t in self.pending if topic in (None, t)]:
            self.commit(t)
        files = self.segments - before
        marks = self.hot.marks("flush")
        high = (marks if topic is None else marks.where(F.col("topic") == topic)).agg(F.max("flush")).first()[0] or 0
        return {"events_flushed": rows, "segments_written": files, "new_watermark": high}

    def clean_if_due(self, force: bool = False) -> int:
        """Cleans the hot log once the retention since the commit has passed; at once at start and end."""
        if not force and (self.clean_at is None or self.clock() < self.clean_at):
            return 0
        self.clean_at = None
        n = self.hot.clean()
        self.cleaned += n
        return n

    def samples(self) -> dict[str, list[tuple[dict, object]]]:
        """Samples of the flush, lake, consumer and hot-log metrics; rows staged again after a failure count again."""
        state, sizes = self.hot.state(), {t: self.pending_size(t) for t in list(self.pending)}
        one = {"flush_total": self.snapshots, "flush_events_total": self.flushed, "flush_bytes_total": self.flushed_bytes, "cleanup_events_deleted_total": self.cleaned, "parquet_files_written_total": self.segments, "iceberg_snapshots_committed_total": self.snapshots}
        out: dict[str, list[tuple[dict, object]]] = {name: [({}, n)] for name, n in one.items()}
        out["pending_snapshot_files"] = [({"topic": t}, n) for t, (n, _) in sorted(sizes.items())]
        out["pending_snapshot_bytes"] = [({"topic": t}, n) for t, (_, n) in sorted(sizes.items())]
        out["hot_storage_events"] = [({}, sum(v.get("high", 0) - v.get("cleanup", 0) for v in state["marks"].values()))]
        commits = [(*json.loads(k), n) for k, n in sorted(state.get("offsets", {}).items())]
        high = {tuple(json.loads(k)): v.get("high", 0) for k, v in state["marks"].items()}
        named = [({"group": g, "topic": t, "partition": p}, n, max(0, high.get((t, p), 0) - n)) for g, t, p, n in commits]
        out["committed_offset"] = [(labels, n) for labels, n, _ in named]
        out["consumer_lag"] = [(labels, n) for labels, _, n in named]
        return out


def ingest_stream(events: DataFrame, hot: HotLog, checkpoint: str, **trigger):
    """Appends a streaming DataFrame (topic, partition, payload, timestamp_ms, idempotency_key, arrival) to the hot log."""
    save = lambda df, i: hot.append(df, i) and None
    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
