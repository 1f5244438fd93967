"""Tables, the shared folder, and Arrow helpers that several operators use."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word separators, as a regular expression class body and as characters.
BLANKS = "\\x20\\x09-\\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: A missing doc_id is carried as this number, and shown as null again.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="eventlake-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/eventlake-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def release() -> None:
    """Gives freed memory of this process back to the system; the driver keeps no more than it needs after a collected sample or sketch."""
    gc.collect()
    shrink()


def shrink() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shrinking(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`batches`, after which the Python worker gives its freed memory back: Spark keeps idle workers for a minute, beside those of the next stage."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(it)
        shrink()

    return run


def trim(spark: SparkSession) -> None:
    """Gives native memory that the driver's JVM has freed (by compilers, buffers, ended threads) back to the system; its C library keeps what it once held, and a long run of many plans goes on adding to that."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    # by the interface's method: the server's own class is hidden in its module
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # a JVM without that command
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that start within send Python `rows` rows at a time: texts of megabytes make the usual ten thousand too many for the memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lost executors can read it again, and no later plan recomputes it."""
    with small_batches(spark):
        df.write.parquet(path := shared_path(spark, name))
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables from written() that nothing will read again, so that what is superseded takes no disk."""
    for df in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucketed(spark: SparkSession, df: DataFrame, column: str, name: str) -> DataFrame:
    """`df`, grouped by `column` alone just before, written to the shared folder in buckets of it, so that joins on it don't shuffle it again.

    The groups are dealt as buckets are, so each bucket is written by one task. The catalog entry is dropped at once; the files stay.
    """
    n, label = int(spark.conf.get("spark.sql.shuffle.partitions")), f"eventlake_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, column).sortBy(column).option("path", shared_path(spark, name)).saveAsTable(label, format="parquet")
    out = spark.table(label)
    out.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {label}")
    return out


def send(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcasts `value`, of a size that the caller has bounded, and its class with it; the result loads it on an executor."""
    raw = cloudpickle.dumps(value)
    size, held = len(raw), spark.sparkContext.broadcast(pa.compress(raw, "zstd", asbytes=True))
    return lambda: cloudpickle.loads(pa.decompress(held.value, size, "zstd"))


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id):
    """Whether crc32 of the id's text leaves 0 modulo 5; a missing id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most_bytes` of text each (one longer text stands alone), to bound the working memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most_bytes:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)
