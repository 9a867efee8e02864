"""Structured Streaming forms of the telemetry, exceedance, fragility and rainfall operators.

Each takes and returns a streaming (or batch) DataFrame; the caller attaches the sink and a checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.impact import ASSET_CLASS, failure_probability


def stream_failed_fraction(stream: DataFrame, units: DataFrame, window: str = "15 minutes", late: str = "16 minutes", time: str = "timestamp_observed") -> DataFrame:
    """Failed share per control unit and event-time window; deliveries up to `late` behind still count, repeats once."""
    s = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["asset_id", time])
    j = s.join(units, "asset_id")
    return j.groupBy(F.window(time, window).alias("w"), "control_unit_id").agg(
        F.avg((F.col("state") == "failed").cast("double")).alias("failed_fraction"), F.count(F.lit(1)).alias("observations")).select(
        "control_unit_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failed_fraction", "observations")


def stream_exceedance_sessions(stream: DataFrame, u: float, gap: str, by: str = "series_id", late: str = "1 hour", time: str = "time", value: str = "value") -> DataFrame:
    """Runs of exceedances closed by a gap, with peak, peak time and size."""
    s = stream.where(F.col(value) > u).withWatermark(time, late)
    return s.groupBy(F.session_window(time, gap).alias("w"), by).agg(
        F.max(value).alias("peak"), F.max_by(time, F.struct(F.col(value), -F.unix_micros(F.col(time).cast("timestamp")))).alias("peak_time"), F.count(F.lit(1)).alias("exceedances")).select(
        by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "peak", "peak_time", "exceedances")


def stream_impacts(stream: DataFrame, assets: DataFrame, curves: DataFrame, mapping: dict[str, str] = ASSET_CLASS, at: float = 0.5) -> DataFrame:
    """Depth readings scored against static assets and curves, row by row, without state."""
    j = stream.join(assets.select("asset_id", "asset_type"), "asset_id")
    p = failure_probability(j, curves, mapping)
    return p.withColumn("affected", F.coalesce(F.col("failure_probability") >= at, F.lit(False)))


def stream_duration_depth(stream: DataFrame, hours: int, stride_hours: int, by: list[str], late: str = "1 hour", time: str = "time", value: str = "value") -> DataFrame:
    """Sliding rainfall totals per cell; only windows in which every hour has a reading, however many each has."""
    s = stream.withWatermark(time, late)
    g = s.groupBy(F.window(time, f"{hours} hours", f"{stride_hours} hours").alias("w"), *by).agg(F.sum(value).alias("depth"),
        F.size(F.collect_set(F.when(F.col(value).isNotNull(), F.date_trunc("hour", F.col(time))))).alias("n"))
    return g.where(F.col("n") == hours).select(*by, F.col("w.start").alias("storm_date"), F.col("w.end").alias("window_end"), "depth")
