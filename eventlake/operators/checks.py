"""Counts, statistics and consistency checks over a log or lake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import unused

PART = ["topic", "partition"]
# The bounds of the latency buckets in microseconds.
LATENCY_BUCKETS = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000)


def continuity(log: DataFrame) -> DataFrame:
    return log.groupBy(*PART).agg(
        F.min("sequence").alias("min_seq"), F.max("sequence").alias("max_seq"), F.count("*").alias("n"), (F.max("sequence") - F.min("sequence") + 1).alias("expected"),
    )


def column_bounds(rows: DataFrame, by: list) -> DataFrame:
    """Row count, and least and greatest of the five columns that files keep bounds of."""
    cols = [c for c in ("sequence", "partition", "timestamp_ms", "event_date", "event_hour") if c not in by]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in cols for k, f in (("min", F.min), ("max", F.max))])


def duplicates(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def gaps(log: DataFrame, width: int = 65_536) -> DataFrame:
    """Where a sequence isn't its predecessor's plus one: topic, partition, after, sequence, missing.

    Neighbours are compared within ranges of `width` sequences, and ranges by their ends, so no partition is sorted in one task.
    """
    ranged = log.select(*PART, "sequence", F.floor(F.col("sequence") / width).alias("r"))
    inner = ranged.withColumn("after", F.lag("sequence").over(Window.partitionBy(*PART, "r").orderBy("sequence")))
    ends = ranged.groupBy(*PART, "r").agg(F.min("sequence").alias("sequence"), F.max("sequence").alias("last"))
    outer = ends.withColumn("after", F.lag("last").over(Window.partitionBy(*PART).orderBy("r")))
    both = inner.select(*PART, "after", "sequence").unionByName(outer.select(*PART, "after", "sequence"))
    return both.where("sequence - after > 1").withColumn("missing", F.col("sequence") - F.col("after") - 1)


def out_of_order(rows: DataFrame, place: str, value: str, width: int = 65_536) -> DataFrame:
    """Rows whose value is below one at an earlier place of their partition, with `highest_before`.

    The maximum runs within ranges of `width` of the integer column `place` and is carried from range to range, one row for each, so no partition is sorted in one task.
    """
    cut, carried = unused(rows, "range"), unused(rows, "carried")
    ranged = rows.select("*", F.floor(F.col(place) / width).alias(cut))
    tops = ranged.groupBy(*PART, cut).agg(F.max(value).alias(carried))
    tops = tops.select(*PART, cut, F.max(carried).over(Window.partitionBy(*PART).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)).alias(carried))
    inside = F.max(value).over(Window.partitionBy(*PART, cut).orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    near = ranged.withColumn("highest_before", inside).join(tops, [*PART, cut]).withColumn("highest_before", F.greatest("highest_before", carried))
    return near.where(F.col(value) < F.col("highest_before")).select(*rows.columns, "highest_before")


def nearest_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, float], pieces: int = 64) -> DataFrame:
    """sorted[int(n * p)], the last at most, of each group's values that aren't null: a column for each of `ranks`; null without values.

    Groups are cut at sketched quantiles, ranges are counted, and only the range that holds a rank is sorted: exact, and no group is gathered in one task.
    """
    marks = [i / pieces for i in range(1, pieces)]
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, marks, F.lit(1000)).alias("cuts"), F.count(value).alias("n"))
    place = F.size(F.filter("cuts", lambda c: c <= F.col("v")))
    ranged = rows.select(*by, F.col(value).alias("v")).where("v is not null").join(cuts, by).select(*by, "v", place.alias("piece"))
    sizes = ranged.groupBy(*by, "piece").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "piece", "held", before.alias("before"))
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).alias("k")) for name, p in ranks.items()])
    wanted = cuts.where("n > 0").select(*by, F.inline(each)).join(sizes, by).where("before <= k and k < before + held")
    wanted = wanted.select(*by, "piece", "name", (F.col("k") - F.col("before") + 1).alias("row"))
    numbered = ranged.join(wanted.select(*by, "piece").distinct(), [*by, "piece"], "left_semi")
    numbered = numbered.withColumn("row", F.row_number().over(Window.partitionBy(*by, "piece").orderBy("v")))
    found = numbered.join(wanted, [*by, "piece", "row"]).groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return cuts.select(*by).join(found, by, "left")


def uncovered(files: DataFrame, low: int, high: int) -> DataFrame:
    """topic, partition, first, last: ranges of [low, high] that no file's [sequence_min, sequence_max] covers. Cuts ranges only; no sequence is listed."""
    w = Window.partitionBy(*PART).orderBy("sequence_min", "sequence_max")
    end = F.max("sequence_max").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ordered = files.select(*PART, "sequence_min", "sequence_max", F.coalesce(end, F.lit(low - 1)).alias("covered"))
    between = ordered.select(*PART, F.greatest(F.col("covered") + 1, F.lit(low)).alias("first"), F.least(F.col("sequence_min") - 1, F.lit(high)).alias("last"))
    after = files.groupBy(*PART).agg(F.max("sequence_max").alias("m")).select(*PART, F.greatest(F.col("m") + 1, F.lit(low)).alias("first"), F.lit(high).cast("long").alias("last"))
    return between.unionByName(after).where("first <= last")


def latency_histogram(latency: Column, buckets: tuple[int, ...] = LATENCY_BUCKETS) -> list[Column]:
    """Aggregates: cumulative counts by bucket, then +Inf, sum and count."""
    cells = [F.sum(F.when(latency <= b, 1).otherwise(0)).alias(f"le_{b}") for b in buckets]
    return [*cells, F.count(latency).alias("le_inf"), F.round(F.sum(latency), 2).alias("total"), F.count(latency).alias("n")]
