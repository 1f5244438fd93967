"""Counters, rates and histograms as DataFrames, and their text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio
from .checks import LATENCY_BUCKETS, latency_histogram


def topic_counters(writes: DataFrame) -> DataFrame:
    """Writes by topic from a request log (topic, request_id): a bulk request counts once."""
    return writes.groupBy("topic").agg(F.countDistinct("request_id").alias("writes"))


def rates(requests: DataFrame, uptime_s: float) -> DataFrame:
    """Count, rate and average latency of requests (latency_us); 0.0 where there is nothing to divide by."""
    out = requests.agg(F.count("*").alias("n"), F.coalesce(F.sum("latency_us"), F.lit(0.0)).alias("total"))
    return out.select("n", F.round(safe_ratio(F.col("n"), F.lit(uptime_s)), 6).alias("per_second"), F.round(safe_ratio(F.col("total"), F.col("n")), 6).alias("average_us"))


def histogram(requests: DataFrame, by: list[str], latency: str = "latency_us") -> DataFrame:
    return requests.groupBy(*by).agg(*latency_histogram(F.col(latency)))


def flush_totals(flushes: DataFrame) -> DataFrame:
    """Events and segments summed, and the greatest mark, over all topics."""
    return flushes.agg(F.sum("events").alias("events"), F.sum("segments").alias("segments"), F.max("watermark").alias("watermark"))


# Names and kinds of the metrics, in the order they are shown.
FAMILIES = {
    "uptime_secs": "gauge", "writes_total": "counter", "writes_bytes_total": "counter", "writes_rate_per_sec": "gauge", "writes_avg_latency_us": "gauge", "reads_total": "counter",
    "reads_records_total": "counter", "reads_rate_per_sec": "gauge", "reads_avg_latency_us": "gauge", "errors_total": "counter", "inflight_bytes": "gauge", "inflight_writes_available": "gauge",
    "flush_total": "counter", "flush_events_total": "counter", "flush_bytes_total": "counter", "watermark_persist_errors_total": "counter", "cleanup_events_deleted_total": "counter",
    "flush_duration_us": "histogram", "parquet_files_written_total": "counter", "iceberg_snapshots_committed_total": "counter", "s3_errors_total": "counter", "pending_snapshot_files": "gauge",
    "pending_snapshot_bytes": "gauge", "high_watermark": "gauge", "committed_offset": "gauge", "consumer_lag": "gauge", "hot_storage_events": "gauge", "write_combiner_queue_depth": "gauge",
    "write_combiner_queue_depth_total": "gauge", "write_latency_us": "histogram", "read_latency_us": "histogram", "writes_by_topic_total": "counter", "reads_by_topic_total": "counter", "backpressure_rejections_total": "counter",
}


def _labels(labels: dict) -> str:
    esc = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return "{" + ",".join(f'{k}="{esc(v)}"' for k, v in labels.items()) + "}" if labels else ""


def exposition(samples: dict[str, list[tuple[dict, object]]], prefix: str = "eventlake_") -> str:
    """Prometheus text. samples: for each family (labels, value); a histogram's value is a row of latency_histogram."""
    out = []
    for name, kind in FAMILIES.items():
        if not samples.get(name):
            continue
        out.append(f"# TYPE {prefix}{name} {kind}")
        for labels, value in samples[name]:
            if kind != "histogram":
                out.append(f"{prefix}{name}{_labels(labels)} {value}")
                continue
            for b in LATENCY_BUCKETS:
                out.append(f"{prefix}{name}_bucket{_labels(labels | {'le': b})} {value[f'le_{b}']}")
            out += [f"{prefix}{name}_bucket{_labels(labels | {'le': '+Inf'})} {value['le_inf']}", f"{prefix}{name}_sum{_labels(labels)} {value['total']}", f"{prefix}{name}_count{_labels(labels)} {value['n']}"]
    return "\n".join([*out, ""])
