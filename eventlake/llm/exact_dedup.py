"""Exact deduplication as a stateful stream.

Each ingest appends rows to a content store in the shared folder and runs the stream over what is new.
The stream keeps one state entry for each digest, without expiry, in RocksDB on the executors' disks
(checkpointed to the shared folder): the number of texts, the stable identifier of the row that stays,
and the locator of its content. Only digests enter the state; partial aggregation sends one row for each
task and digest, so a group that holds a third of all rows is no hot key. On hits (digests seen more than
once) the full normalised bytes are compared; texts that share a digest but not their bytes are told
apart by the bytes themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANK_CHARS, shared_path, table

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "spark.sql.streaming.stateStore."
#: State on disk; without preallocated files, of which each of many small stores would hold megabytes.
_CONF = {_STATE + "providerClass": _ROCKS, _STATE + "rocksdb.allowFAllocate": "false"}


def normalised(text: Column) -> Column:
    """The text without any blank; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANK_CHARS, "")


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def _rank(n_points: Column, doc_id: Column, rid: Column) -> Column:
    """Sorts highest the longest original, then the smallest doc_id (a missing one last), then the first row stored."""
    return F.struct(n_points.alias("n_points"), doc_id.isNotNull().alias("has_id"), F.bitwise_not(doc_id).alias("not_id"), F.bitwise_not(rid).alias("not_rid"))


class StreamingDeduper:
    """Keeps its store, checkpoint and state below `root`; a new object on the same root carries on where the last one ended."""

    def __init__(self, spark: SparkSession, root: str | None = None, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 512):
        self.spark, self.digest, self.files_per_batch = spark, digest, files_per_batch
        self.root = root or shared_path(spark, "dedup")
        self.schema = None

    def ingest(self, docs: DataFrame) -> None:
        """Appends `docs` (doc_id, text and any other columns) to the store and brings the state up to date."""
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        store = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            self.digest(normalised(F.col("text"))).alias("digest"),
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
            F.lit(uuid.uuid4().int >> 65).alias("ingest"),
            F.monotonically_increasing_id().alias("rid"),
            row.alias("row"),
        )
        store.write.mode("append").parquet(f"{self.root}/store")
        self.schema = store.schema
        self._advance()

    def _advance(self) -> None:
        new = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.root}/store")
        keeper = F.struct(_rank(F.col("n_points"), F.col("doc_id"), F.col("rid")).alias("rank"), F.col("doc_id"), F.col("ingest"), F.col("rid"), F.col("_metadata.file_path").alias("file"))
        state = new.groupBy("digest").agg(F.count("*").alias("n"), F.max(keeper).alias("keeper"))
        before = {k: self.spark.conf.get(k, None) for k in _CONF}
        for k, v in _CONF.items():
            self.spark.conf.set(k, v)
        try:
            out = f"{self.root}/state"
            save = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")  # noqa: E731  a replayed batch overwrites itself
            state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def store(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/store")

    def state(self) -> DataFrame:
        """digest, n, keep_id, keep_ingest, keep_rid, file: the latest entry of each digest."""
        last = self.spark.read.parquet(f"{self.root}/state").groupBy("digest").agg(F.max(F.struct("batch", "n", "keeper")).alias("s"))
        return last.select("digest", F.col("s.n").alias("n"), F.col("s.keeper.doc_id").alias("keep_id"), F.col("s.keeper.ingest").alias("keep_ingest"), F.col("s.keeper.rid").alias("keep_rid"), F.col("s.keeper.file").alias("file"))

    def unequal(self) -> DataFrame:
        """The digests of more than one normalised text, found by comparing the full bytes of all hits."""
        hits = self.state().where("n > 1").select("digest")
        # grouped by a copy of the key: so the join's skewed partitions may be split, and partial results are shuffled again
        body = self.store().select("digest", "row.text").join(hits, "digest", "left_semi").select(F.concat("digest", F.lit("")).alias("of"), normalised(F.col("text")).alias("body"))
        return body.groupBy("of").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a != b").select(F.col("of").alias("digest"))

    def groups(self) -> DataFrame:
        """A row for each stored row: ingest, rid (together the row's identity), doc_id, digest, keep_id, kept, group_size."""
        own = ["ingest", "rid", "doc_id"]
        shown = lambda df, n: df.select(*own, "digest", "keep_id", ((F.col("ingest") == F.col("keep_ingest")) & (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.col(n).alias("group_size"))
        rows, state = self.store().select(*own, "digest"), self.state()
        bad = self.unequal()
        if bad.isEmpty():
            return shown(rows.join(state, "digest"), "n")
        good = shown(rows.join(bad, "digest", "left_anti").join(state, "digest"), "n")
        split = self.store().join(bad, "digest", "left_semi").select(*own, "digest", "n_points", normalised(F.col("row.text")).alias("body"))
        keeper = F.struct(_rank(F.col("n_points"), F.col("doc_id"), F.col("rid")).alias("rank"), *own)
        best = split.groupBy("digest", "body").agg(F.count("*").alias("group_size"), F.max(keeper).alias("k"))
        best = best.select("digest", "body", "group_size", F.col("k.doc_id").alias("keep_id"), F.col("k.ingest").alias("keep_ingest"), F.col("k.rid").alias("keep_rid"))
        return good.unionByName(shown(split.join(best, ["digest", "body"]), "group_size"))

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns that were ingested."""
        stay = self.groups().where("kept").select("ingest", "rid")
        return self.store().select("ingest", "rid", "row").join(stay, ["ingest", "rid"], "left_semi").select("row.*")


def dedup_groups(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting blanks. Of equal ones the row with the most code points
    stays, then the smallest doc_id, a missing doc_id after any other. Null text counts as empty; all
    empty and all-blank texts are one group. Of repeated rows (same doc_id and text) exactly one is kept.
    Texts of any length are read whole. An empty table gives an empty result; other columns don't matter.
    """
    run = StreamingDeduper(spark, **how)
    run.ingest(docs)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    return run.groups().select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def dedup_rows(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; cases as in dedup_groups."""
    run = StreamingDeduper(spark, **how)
    run.ingest(docs)
    return docs.limit(0) if docs.isEmpty() else run.kept()


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS sha
  FROM documents
), k AS (
  SELECT doc_id, sha, n_points,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY sha) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM k
"""
