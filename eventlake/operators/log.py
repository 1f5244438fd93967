"""The log's state: sequences, idempotent writes, marks, offsets, cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ["topic", "partition"]


def unused(rows: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `rows` has it."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def first_of_key(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with the same (topic, partition, idempotency_key) the first; rows without a key all.

    Spark limits the ranks before the shuffle too, so a key that many rows share costs one row for each task. The key comes
    first, since sorts compare by a prefix of their first column.
    """
    place = unused(rows, "place")
    by = Window.partitionBy("idempotency_key", *PART).orderBy(F.col(order).asc_nulls_last())
    keyed = rows.where("idempotency_key is not null").withColumn(place, F.rank().over(by)).where(F.col(place) == 1).drop(place)
    return keyed.unionByName(rows.where("idempotency_key is null"))


def new_of_keys(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` without those whose key `known` (topic, partition, idempotency_key, sequence) has."""
    return rows.join(known, [*PART, "idempotency_key"], "left_anti")


def with_sequence(rows: DataFrame, order: str, high: DataFrame | None = None, width: int = 65_536) -> DataFrame:
    """`rows` with `sequence`: 1, 2, ... within (topic, partition) in the order of the integer column `order`, after `high` (topic, partition, high).

    Numbered in two steps, so that a partition with a third of all rows isn't sorted in one task: within ranges of
    `width` order values, and from the sums of the ranges before, which are one small row for each.
    """
    cut, row, before = (unused(rows, n) for n in ("range", "row", "before"))
    ranged = rows.select("*", F.floor(F.col(order) / width).alias(cut))
    sizes = ranged.groupBy(*PART, cut).agg(F.count("*").alias(before))
    sizes = sizes.select(*PART, cut, _sum_before(before, cut).alias(before))
    if high is not None:
        sizes = sizes.join(high.select(*PART, "high"), PART, "left").select(*PART, cut, (F.col(before) + F.coalesce("high", F.lit(0))).alias(before))
    within = F.row_number().over(Window.partitionBy(*PART, cut).orderBy(order))
    out = ranged.withColumn(row, within).join(sizes, [*PART, cut]).withColumn("sequence", F.col(before) + F.col(row))
    return out.drop(cut, row, before)


def _sum_before(column: str, cut: str) -> Column:
    """The sum of the ranges before, over one small row for each range."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*PART).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def write_batch(rows: DataFrame, order: str, known: DataFrame | None = None, high: DataFrame | None = None) -> DataFrame:
    """The rows that a batch adds to the log, numbered: the first of each key that isn't known."""
    new = rows if known is None else new_of_keys(rows, known)
    return with_sequence(first_of_key(new, order), order, high)


def offsets_of_batch(rows: DataFrame, added: DataFrame, order: str, known: DataFrame | None = None) -> DataFrame:
    """`order` and `sequence` for each input row: its own, or that of the row its key already had."""
    keys = added.where("idempotency_key is not null").select(*PART, "idempotency_key", "sequence")
    keys = keys if known is None else keys.unionByName(known.select(*PART, "idempotency_key", "sequence"))
    keyed = rows.where("idempotency_key is not null").join(keys, [*PART, "idempotency_key"]).select(order, "sequence")
    return keyed.unionByName(added.where("idempotency_key is null").select(order, "sequence"))


def high_marks(log: DataFrame) -> DataFrame:
    return log.groupBy(*PART).agg(F.max("sequence").alias("high"))


def low_marks(log: DataFrame) -> DataFrame:
    return log.groupBy(*PART).agg(F.min("sequence").alias("low"))


def raise_marks(marks: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """The greater of two marks of each partition."""
    return marks.select(*PART, name).unionByName(more.select(*PART, name)).groupBy(*PART).agg(F.max(name).alias(name))


def partitions_of(log: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Partitions with rows, and those of which only a mark is left."""
    found = log.select(*PART)
    return (found if marks is None else found.unionByName(marks.select(*PART))).distinct()


def topics_of(log: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    found = log.select("topic")
    return (found if marks is None else found.unionByName(marks.select("topic"))).distinct()


def lookup_key(log: DataFrame, topic: str, partition: int, key: str) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("idempotency_key") == key)).select("sequence")


def last_commit(commits: DataFrame, order: str) -> DataFrame:
    """group, topic, partition, committed: the last commit of each, not the greatest."""
    return commits.groupBy("group", *PART).agg(F.max_by("offset", order).alias("committed"))


def lag(high: DataFrame, committed: DataFrame) -> DataFrame:
    """For each partition with a high mark: high - committed, at least 0."""
    both = high.join(committed, PART, "left")
    return both.select(*PART, "high", "committed", F.greatest(F.col("high") - F.coalesce("committed", F.lit(0)), F.lit(0)).cast("long").alias("lag"))


def watermark_report(flush: DataFrame, high: DataFrame) -> DataFrame:
    both = flush.join(high, PART, "full_outer")
    return both.select(*PART, F.coalesce("flush", F.lit(0)).cast("long").alias("flush"), F.coalesce("high", F.lit(0)).cast("long").alias("high"))


def uncommitted(log: DataFrame, flush: DataFrame) -> DataFrame:
    """Rows above their partition's flush mark; without a mark all."""
    return log.join(flush.select(*PART, "flush"), PART, "left").where(F.col("sequence") > F.coalesce("flush", F.lit(0))).drop("flush")


def cleaned(log: DataFrame, up_to: DataFrame) -> DataFrame:
    """The log without rows up to each partition's mark `flush`; their keys go with them."""
    return uncommitted(log, up_to)


def cleanup_width(up_to: DataFrame, cleaned_to: DataFrame) -> DataFrame:
    """How many sequences a cleanup covers, from the marks alone; 0 when repeated."""
    both = up_to.join(cleaned_to.select(*PART, "cleanup"), PART, "left")
    return both.select(*PART, F.greatest(F.col("flush") - F.coalesce("cleanup", F.lit(0)), F.lit(0)).cast("long").alias("width"))


def hot_count(high: Column, low: Column) -> Column:
    """Rows that the hot log holds by its marks; 0 when it is empty."""
    return F.when((low > 0) & (high >= low), high - low + 1).otherwise(0).cast("long")


def size_prefix(rows: DataFrame, size: Column, target: int, order: str = "sequence", width: int = 65_536) -> DataFrame:
    """Of each partition the longest prefix, by the integer column `order`, whose sizes add up to `target` at most, one row at least.

    Sums run within ranges of `width` order values, after the sums of the ranges before; ranges that begin beyond the
    target are dropped, so no partition is sorted in one task. A null size counts as 0.
    """
    cut, held, before, upto, row, first = (unused(rows, n) for n in ("range", "held", "before", "upto", "row", "first"))
    ranged = rows.select("*", F.floor(F.col(order) / width).alias(cut), F.coalesce(size, F.lit(0)).cast("long").alias(held))
    sums = ranged.groupBy(*PART, cut).agg(F.sum(held).alias(before))
    sums = sums.select(*PART, cut, _sum_before(before, cut).alias(before), F.row_number().over(Window.partitionBy(*PART).orderBy(cut)).alias(first))
    w = Window.partitionBy(*PART, cut).orderBy(order)
    near = ranged.join(sums.where((F.col(before) <= target) | (F.col(first) == 1)), [*PART, cut])
    near = near.select("*", F.sum(held).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(upto), F.row_number().over(w).alias(row))
    fits = (F.col(before) + F.col(upto) <= target) | ((F.col(first) == 1) & (F.col(row) == 1))
    return near.where(fits).select(*rows.columns)


def count_prefix(rows: DataFrame, most: int, order: str = "sequence", width: int = 65_536) -> DataFrame:
    """Of each partition the first `most` rows by the integer column `order`, numbered within ranges as size_prefix does."""
    cut, before, row = (unused(rows, n) for n in ("range", "before", "row"))
    ranged = rows.select("*", F.floor(F.col(order) / width).alias(cut))
    sums = ranged.groupBy(*PART, cut).agg(F.count("*").alias(before)).select(*PART, cut, _sum_before(before, cut).alias(before))
    near = ranged.join(sums.where(F.col(before) < most), [*PART, cut])
    near = near.withColumn(row, F.row_number().over(Window.partitionBy(*PART, cut).orderBy(order)))
    return near.where(F.col(before) + F.col(row) <= most).select(*rows.columns)
