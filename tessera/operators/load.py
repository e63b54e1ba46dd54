"""Load reports: probes in, stages and verdicts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise(probes: DataFrame) -> DataFrame:
    """probes (stage, ok, latency_ms, ts): counts, rates and nearest-rank percentiles of each stage."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)")
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    rows = probes.groupBy("stage").agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("successes"), seconds.alias("seconds"), F.avg("latency_ms").alias("avg"), F.max("latency_ms").alias("max"),
        rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
    )
    return rows.select(
        "stage", "requests", "successes", F.round(1 - F.col("successes") / F.col("requests"), 6).alias("error_rate"), F.round("seconds", 3).alias("duration_s"),
        F.round(F.col("requests") / F.nullif("seconds", F.lit(0.0)), 3).alias("rps"), F.round("avg", 3).alias("avg_ms"), F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"),
        F.col("p99").alias("p99_ms"), F.col("max").alias("max_ms"),
    )


def status_histogram(probes: DataFrame) -> DataFrame:
    return probes.groupBy("stage", "status").agg(F.count("*").alias("n"))


def gate(summary: DataFrame) -> DataFrame:
    """Whether a stage is accepted (failures < 1 %, p95 < 500 ms, p99 < 1 s) and whether the ladder stops (5 %, 3 s)."""
    fail = F.col("error_rate")
    return summary.select("stage", ((fail < 0.01) & (F.col("p95_ms") < 500) & (F.col("p99_ms") < 1000)).alias("accepted"), ((fail >= 0.05) | (F.col("p99_ms") >= 3000)).alias("stop"))


def usage(prior: DataFrame, uses: DataFrame, units: DataFrame) -> DataFrame:
    """prior (memory_uuid, use_count, last_used_at) after uses (memory_uuid, used_at) of records that aren't trashed."""
    fresh = uses.join(units.where("status <> 'trashed'").select(F.col("uuid").alias("memory_uuid")), "memory_uuid", "left_semi")
    both = prior.select("memory_uuid", "use_count", "last_used_at").union(fresh.select("memory_uuid", F.lit(1).cast("long"), "used_at"))
    return both.groupBy("memory_uuid").agg(F.sum("use_count").alias("use_count"), F.max("last_used_at").alias("last_used_at"))
