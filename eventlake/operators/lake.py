"""Lake tables: sorted, date- and hour-partitioned Parquet below versioned snapshots.

Layout: {root}/{topic}/data/write={id}/event_date=../event_hour=../partition=../*.parquet, and
{root}/{topic}/metadata/v{N}.metadata.json with manifests beside it: as Parquet, which our reads use, and as Avro
with a list for each snapshot, which other engines read. A version is committed by
creating the next v{N} under its own name, which fails if another writer has it. Files that no snapshot
names are never read, so a job that dies between writing and committing leaves nothing visible.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import extracted
from ..functions.scalar import event_size, metadata_version
from ..schema import FIELD_IDS, FIRST_EXTRACTED_ID, OVERFLOW, OVERFLOW_ID, TableConfig, check_table_name, lake_schema
from ..sources.files import Files
from . import manifests
from .read import in_time, with_partition_columns

#: Our own prefix for entries of a snapshot's summary.
PREFIX = "eventlake."
# Manifest entry states.
EXISTING, ADDED, DELETED = 0, 1, 2
_KEYS = ["event_date", "event_hour", "partition"]
_MANIFEST = (
    "path string, status int, file_size bigint, n bigint, sequence_min bigint, sequence_max bigint, partition int, timestamp_ms_min bigint, timestamp_ms_max bigint, "
    "event_date_min date, event_date_max date, event_hour_min int, event_hour_max int, ord bigint"
)
#: What a manifest's Parquet files hold: given, so that no job has to find it.
_STORED = _MANIFEST.removesuffix(", ord bigint")
_MB = 1 << 20
# The table format's names of column types.
_TYPES = {"bigint": "long", "int": "int", "string": "string", "binary": "binary", "date": "date", "double": "double", "boolean": "boolean"}
#: Tables that this process compacts now.
_BUSY: set[str] = set()
_LOCK = threading.Lock()


class Conflict(Exception):
    """Another writer committed first, or a file to delete isn't active."""


@dataclass(frozen=True)
class CompactionPolicy:
    # Files below min_bytes are candidates; min_files make a group, max_files are taken of it, target_bytes end an output.
    min_bytes: int = 64 * _MB
    target_bytes: int = 512 * _MB
    max_files: int = 10
    min_files: int = 3


class LakeTable:
    def __init__(self, spark: SparkSession, root: str, topic: str, config: TableConfig | None = None, granularity: str = "hour", mode: str = "quarantine", clock: Callable[[], float] = time.time):
        """granularity "day" keeps event_hour in the files and partitions by date only, for small tables."""
        self.spark, self.topic, self.config, self.mode, self.clock = spark, check_table_name(topic), config, mode, clock
        self.base = f"{root.rstrip('/')}/{topic}"
        self.files = Files(spark)
        self.by = [k for k in _KEYS if granularity == "hour" or k != "event_hour"]
        self.schema = lake_schema(config)
        self.structured = "payload" not in self.schema.fieldNames()

    # -- writing

    def stage(self, rows: DataFrame) -> DataFrame:
        """Writes rows of the log as data files and returns their manifest entries; nothing can see them yet.

        Rows are rebalanced by directory, so a hot hour is split over tasks, and sorted by time and sequence within a file.
        """
        rows = with_partition_columns(rows.select("sequence", "topic", "partition", "payload", "timestamp_ms", "idempotency_key"))
        if self.structured:
            rows = extracted(rows, self.config, self.mode)
        write = f"{self.base}/data/write={uuid.uuid4().hex}"
        rows = rows.select(*[c for c in self.schema.fieldNames()]).hint("rebalance", *self.by)
        rows.sortWithinPartitions(*self.by, "timestamp_ms", "sequence").write.option("compression", "zstd").partitionBy(*self.by).parquet(write)
        return self._stats(write)

    def _stats(self, write: str) -> DataFrame:
        """A manifest entry for each file of a write, kept as Parquet."""
        data = self.spark.read.schema(self.schema).option("basePath", f"{self.base}/data").parquet(write)
        both = lambda c: [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
        stats = data.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), "partition").agg(
            F.count("*").alias("n"), *[x for c in ("sequence", "timestamp_ms", "event_date", "event_hour") for x in both(c)],
        )
        path = f"{self.base}/metadata/manifest-{uuid.uuid4().hex}.parquet"
        ordered = [c.split()[0] for c in _MANIFEST.split(", ")][:-1]
        stats.withColumn("status", F.lit(ADDED)).select(*ordered).write.parquet(path)
        out = self.spark.read.schema(_STORED).parquet(path)
        out.manifest_path = path
        out.avro = self._avro(out.withColumns({"snapshot_id": F.lit(None).cast("long"), "number": F.lit(None).cast("long")}), self.metadata())
        return out

    def _avro(self, entries: DataFrame, doc: dict) -> list[dict]:
        return manifests.write_manifests(self.files, f"{self.base}/metadata", entries, self.by, doc["schemas"][0], doc["partition-specs"][0]["fields"])

    # -- versions

    def version(self) -> int:
        names = self.files.list(f"{self.base}/metadata")
        return max((int(n[1:].split(".")[0]) for n in names if n.startswith("v") and n.endswith(".metadata.json") and n[1:].split(".")[0].isdigit()), default=0)

    def metadata(self) -> dict:
        n = self.version()
        if n:
            return json.loads(self.files.read(f"{self.base}/metadata/v{n}.metadata.json"))
        ids = {f.name: FIELD_IDS.get(f.name, OVERFLOW_ID if f.name == OVERFLOW else None) for f in self.schema}
        new = [f.name for f in self.schema if ids[f.name] is None]
        ids |= {name: FIRST_EXTRACTED_ID + i for i, name in enumerate(new)}
        fields = [{"id": ids[f.name], "name": f.name, "required": not f.nullable, "type": _TYPES[f.dataType.simpleString()]} for f in self.schema]
        spec = [{"name": k, "transform": "identity", "source-id": FIELD_IDS[k], "field-id": manifests.PARTITION_IDS[k]} for k in self.by]
        order = [{"source-id": FIELD_IDS[k], "transform": "identity", "direction": "asc", "null-order": "nulls-last"} for k in ("timestamp_ms", "sequence")]
        names = [{"field-id": f["id"], "names": [f["name"]]} for f in fields]  # the files carry no ids
        return {
            "format-version": 2, "table-uuid": str(uuid.uuid4()), "location": self.base, "last-sequence-number": 0, "current-snapshot-id": -1, "snapshots": [], "snapshot-log": [],
            "schemas": [{"type": "struct", "schema-id": int(self.structured), "fields": fields}], "current-schema-id": int(self.structured), "last-column-id": max(f["id"] for f in fields),
            "partition-specs": [{"spec-id": 0, "fields": spec}], "default-spec-id": 0, "last-partition-id": max(manifests.PARTITION_IDS.values()),
            "sort-orders": [{"order-id": 1, "fields": order}], "default-sort-order-id": 1, "properties": {"schema.name-mapping.default": json.dumps(names)}, "last-updated-ms": 0,
        }

    def _commit(self, doc: dict, operation: str, tables: list[str], change: dict, extra: dict, avro: list[dict] | None = None, rewritten: bool = False) -> dict:
        """`tables` are Parquet manifests that join the parent's; `avro` the same as records of a list, which replace the parent's records if `rewritten`."""
        parent = next((s for s in doc["snapshots"] if s["snapshot-id"] == doc["current-snapshot-id"]), None)
        old = parent["summary"] if parent else {}
        total = lambda k: max(0, int(old.get(f"total-{k}", 0)) + change[f"added-{k}"] - change[f"deleted-{k}"])
        summary = {"operation": operation, **{k: str(v) for k, v in change.items()}, "total-data-files": str(total("data-files")), "total-records": str(total("records"))}
        summary |= {k: str(v) for k, v in extra.items() if k.startswith(PREFIX) and k not in summary}
        number, now = doc["last-sequence-number"] + 1, int(self.clock() * 1000)
        taken = {s["snapshot-id"] for s in doc["snapshots"]}
        sid = next(i for i in range(time.time_ns() & (2**63 - 1), 2**63) if i not in taken)
        old_list = parent.get("manifest-list") if parent and not rewritten else None
        listed = manifests.write_list(self.files, f"{self.base}/metadata", sid, parent and parent["snapshot-id"], number, manifests.read_list(self.files, old_list) if old_list else [], avro or [])
        snapshot = {
            "snapshot-id": sid, **({"parent-snapshot-id": parent["snapshot-id"]} if parent else {}), "sequence-number": number, "timestamp-ms": now, "summary": summary,
            "manifest-list": listed, "manifests": [*(parent["manifests"] if parent else []), *tables], "schema-id": doc["current-schema-id"],
        }
        doc = doc | {"last-sequence-number": number, "current-snapshot-id": sid, "snapshots": [*doc["snapshots"], snapshot], "snapshot-log": [*doc["snapshot-log"], {"snapshot-id": sid, "timestamp-ms": now}], "last-updated-ms": now}
        n = self.version()
        if n != number - 1 or not self.files.create(f"{self.base}/metadata/v{number}.metadata.json", json.dumps(doc), uuid.uuid4().hex):
            raise Conflict(f"v{number} of {self.topic} is taken")
        return snapshot

    @staticmethod
    def _sizes(entries: DataFrame, kind: str) -> dict:
        r = entries.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("file_size"), F.lit(0))).first()
        return {f"{kind}-data-files": r[0], f"{kind}-records": r[1], f"{kind}-files-size": r[2]}

    _NONE = {"added-data-files": 0, "added-records": 0, "added-files-size": 0, "deleted-data-files": 0, "deleted-records": 0, "deleted-files-size": 0}

    def append(self, staged: list[DataFrame], extra: dict | None = None, tries: int = 5) -> dict:
        """One snapshot over all staged files. Watermarks and other summary entries go with it, so they become durable together. A lost race is tried again on the new version."""
        entries = staged[0]
        for more in staged[1:]:
            entries = entries.unionByName(more)
        change, marks = dict(self._NONE), {}
        for p, high, *sizes in entries.groupBy("partition").agg(F.max("sequence_max"), F.count("*"), F.sum("n"), F.sum("file_size")).collect():  # a row for each partition of the topic
            marks[f"{PREFIX}watermark.{p}"] = high
            for k, v in zip(("added-data-files", "added-records", "added-files-size"), sizes, strict=True):
                change[k] += v
        for i in range(tries):
            try:
                return self._commit(self.metadata(), "append", [m.manifest_path for m in staged], change, marks | (extra or {}), [r for m in staged for r in m.avro])
            except Conflict:
                if i == tries - 1:
                    raise

    def replace(self, base_snapshot: int, deleted: DataFrame, staged: list[DataFrame]) -> dict:
        """Files for files, against the snapshot they were chosen from; a conflict if that isn't current or a deleted file isn't active."""
        doc = self.metadata()
        if doc["current-snapshot-id"] != base_snapshot:
            raise Conflict(f"snapshot {base_snapshot} isn't current")
        path = f"{self.base}/metadata/manifest-{uuid.uuid4().hex}.parquet"
        deleted.withColumn("status", F.lit(DELETED)).select(*[c for c in deleted.columns if c != "ord"]).write.parquet(path)
        deleted = self.spark.read.schema(_STORED).parquet(path)  # chosen once, not again for each use
        if not deleted.join(self.active(), "path", "left_anti").isEmpty():
            raise Conflict("a file to delete isn't active")
        change = self._NONE | self._sizes(deleted, "deleted")
        for m in staged:
            for k, v in self._sizes(m, "added").items():
                change[k] += v
        avro = self._avro(self._carried(doc, deleted), doc)
        return self._commit(doc, "replace", [path, *[m.manifest_path for m in staged]], change, {}, avro + [r for m in staged for r in m.avro], True)

    def _carried(self, doc: dict, deleted: DataFrame) -> DataFrame:
        """The active files, each with the snapshot and number that added it, as existing or deleted entries: an Avro manifest can't undo an entry of another."""
        by_place: list[tuple[int, int]] = []  # of each manifest in the list's order, the snapshot that brought it
        for s in doc["snapshots"]:
            by_place += [(s["snapshot-id"], s["sequence-number"])] * (len(dict.fromkeys(s["manifests"])) - len(by_place))
        if not by_place:
            return self.active().withColumns({"snapshot_id": F.lit(None).cast("long"), "number": F.lit(None).cast("long")})
        at = lambda i: F.array(*[F.lit(p[i]).cast("long") for p in by_place])[F.col("ord").cast("int")]
        gone = deleted.select("path").withColumn("_gone", F.lit(True))
        files = self.active().drop("status").join(gone, "path", "left").withColumn("status", F.when(F.col("_gone"), DELETED).otherwise(EXISTING))
        return files.withColumns({"number": at(1), "snapshot_id": F.when(~F.coalesce("_gone", F.lit(False)), at(0))})

    # -- snapshots and reads

    def snapshots(self) -> list[dict]:
        return self.metadata()["snapshots"]

    def snapshot(self, snapshot_id: int | None = None, as_of_ms: int | None = None) -> dict | None:
        """The current one; or by id; or the last that was committed at or before a time."""
        doc = self.metadata()
        if snapshot_id is None and as_of_ms is None:
            snapshot_id = doc["current-snapshot-id"]
        if as_of_ms is not None:
            ids = [e["snapshot-id"] for e in doc["snapshot-log"] if e["timestamp-ms"] <= as_of_ms]
            snapshot_id = ids[-1] if ids else None
        return next((s for s in doc["snapshots"] if s["snapshot-id"] == snapshot_id), None)

    def entries(self, snapshot: dict | None) -> DataFrame:
        """Manifest entries in the list's order."""
        paths = list(dict.fromkeys(snapshot["manifests"])) if snapshot else []
        if not paths:
            return self.spark.createDataFrame([], _MANIFEST)
        order = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p.rsplit("/", 1)[1]), F.lit(i))])
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return self.spark.read.schema(_STORED).parquet(*paths).withColumn("ord", order[name].cast("long"))

    def active(self, snapshot_id: int | None = None, as_of_ms: int | None = None) -> DataFrame:
        """The files of a snapshot: of each path the last entry, unless that deletes it."""
        entries = self.entries(self.snapshot(snapshot_id, as_of_ms))
        last = entries.groupBy("path").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "path"]), "ord").alias("e"))
        return last.select("path", "e.*").where(F.col("status") != DELETED)

    def read(self, snapshot_id: int | None = None, as_of_ms: int | None = None, partition: int | None = None, start_offset: int = 0, since: int | None = None, until: int | None = None) -> DataFrame:
        """Rows of a snapshot. Files whose bounds exclude them aren't opened; dates and partitions prune directories."""
        files = self.active(snapshot_id, as_of_ms).where(F.col("sequence_max") >= start_offset)
        files = files if partition is None else files.where(F.col("partition") == partition)
        files = files if since is None else files.where(F.col("timestamp_ms_max") >= since)
        files = files if until is None else files.where(F.col("timestamp_ms_min") < until)
        paths = [r.path for r in files.select("path").collect()]  # file names, as any planner keeps them
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.base}/data").parquet(*paths).select(*self.schema.fieldNames())
        rows = rows if start_offset <= 0 else rows.where(F.col("sequence") >= start_offset)
        rows = rows if partition is None else rows.where(F.col("partition") == partition)
        return in_time(rows, since, until)

    def watermarks(self) -> DataFrame:
        """topic, partition, flush: the greatest sequence that the current snapshot's files hold."""
        return self.active().groupBy("partition").agg(F.max("sequence_max").alias("flush")).select(F.lit(self.topic).alias("topic"), "partition", "flush")

    # -- compaction

    def candidates(self, policy: CompactionPolicy = CompactionPolicy()) -> DataFrame:
        """Active small files of directories that have enough of them, with the directory as `place`; at most max_files of each."""
        return candidates(self.active(), policy)

    def compact(self, policy: CompactionPolicy = CompactionPolicy()) -> dict:
        """Rewrites small files as sorted files of about target_bytes, and commits the replacement. The row set stays the same. Nothing to do is no error.

        One compaction of a table runs at a time in a process; others get Conflict, as does one whose snapshot is no longer current.
        Replaced files stay for the snapshots that name them.
        """
        with _LOCK:
            if self.base in _BUSY:
                raise Conflict(f"{self.topic} is being compacted")
            _BUSY.add(self.base)
        try:
            return self._compact(policy)
        finally:
            _BUSY.discard(self.base)

    def _compact(self, policy: CompactionPolicy) -> dict:
        base = self.snapshot()
        none = {"files_in": 0, "files_out": 0, "rows": 0, "bytes_saved": 0}
        if base is None:
            return none
        chosen = self.candidates(policy).drop("place")
        picked = chosen.select("path", "n", "file_size").collect()  # max_files of each directory
        if not picked:
            return none
        records, size = sum(r.n for r in picked), sum(r.file_size for r in picked)
        write = f"{self.base}/data/write={uuid.uuid4().hex}"
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.base}/data").parquet(*[r.path for r in picked]).select(*self.schema.fieldNames())
        most_rows = max(1, policy.target_bytes * records // max(1, size))
        # A directory's rows meet in one task, max_files of min_bytes at most, which cuts them at the target; no setting of the session changes, since others plan with it meanwhile.
        rows.repartition(*self.by).sortWithinPartitions(*self.by, "timestamp_ms", "sequence").write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).partitionBy(*self.by).parquet(write)
        made = self._stats(write)
        try:
            change = self.replace(base["snapshot-id"], chosen, [made])["summary"]
        except Conflict:
            self.files.delete(write)
            raise
        return {"files_in": len(picked), "files_out": int(change["added-data-files"]), "rows": int(change["added-records"]), "bytes_saved": size - int(change["added-files-size"])}


def candidates(files: DataFrame, policy: CompactionPolicy = CompactionPolicy()) -> DataFrame:
    from pyspark.sql import Window

    small = files.where(F.col("file_size") < policy.min_bytes).withColumn("place", F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "^.*/write=[0-9a-f]+/", ""))
    by = Window.partitionBy("place")
    ranked = small.withColumn("_n", F.count("*").over(by)).withColumn("_row", F.row_number().over(by.orderBy("path")))
    return ranked.where((F.col("_n") >= policy.min_files) & (F.col("_row") <= policy.max_files)).drop("_n", "_row")


def tables(spark: SparkSession, root: str) -> DataFrame:
    """Names below `root` with at least one metadata version, sorted, and the latest version."""
    files, found = Files(spark), []
    for name in files.list(root):
        versions = [n for n in files.list(f"{root}/{name}/metadata") if n.endswith(".metadata.json")]
        found += [(name, v) for v in versions]
    df = spark.createDataFrame(found, "name string, file string").withColumn("version", metadata_version(F.col("file"))).where("version is not null")
    return df.groupBy("name").agg(F.max("version").alias("version")).orderBy("name")


def greedy_batches(rows: DataFrame, target: int, extra: int = 100) -> DataFrame:
    """Rows with `batch`: cut after the payload sizes plus `extra` each reach `target`. The sum starts again at each cut, so this is a fold over the sequence, one task for each (topic, partition, event_date)."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence")
        held = batch = 0
        out = []
        for size in pdf["size"]:
            out.append(batch)
            held += size
            if held >= target:
                held, batch = 0, batch + 1
        return pdf.assign(batch=out)[["topic", "partition", "event_date", "sequence", "size", "batch"]]

    sized = rows.select("topic", "partition", "event_date", "sequence", event_size(F.col("payload"), extra).alias("size"))
    return sized.groupBy("topic", "partition", "event_date").applyInPandas(fold, "topic string, partition int, event_date date, sequence long, size long, batch int")
