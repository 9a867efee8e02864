"""Streaming operators run over the `events` file as finite streams, to the end, written and read back as Parquet.

The SQL is the batch aggregate over the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.kit.common import ensure_checkpoint_dir
from tidemark.streaming import live as L
from tidemark.streaming.closing import run_to_end

from .base import query
from .impact import CURVE_SQL, KIND_SQL, P_SQL, curves, kinds


def run(t, build, name: str, time: str | None = None, rank: str | None = None) -> DataFrame:
    """`build` over the stream of events, next to the checkpoints; `time` and `rank` as in run_to_end, of the raw columns."""
    ensure_checkpoint_dir(t.spark)
    home = f"{t.spark.sparkContext.getCheckpointDir()}/stream-{name}-{uuid.uuid4().hex}"
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return run_to_end(raw, t.events, build, home, time, rank)


def timed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("time", F.col("ts").cast("timestamp"))


def micros(out: DataFrame, *cols: str) -> DataFrame:
    return out.withColumns({c: F.unix_micros(c) for c in cols})


@query("stream_failed_fraction", """WITH one AS (SELECT DISTINCT ON (user_id, ts) user_id, ts, event_type FROM events)
SELECT 'cu' || c_nationkey AS control_unit_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 AS window_end,
 avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS failed_fraction, count(*) AS observations FROM one JOIN customer ON c_custkey = user_id GROUP BY ALL""", failed_fraction=9)
def stream_failed_fraction(t):
    u = t.customer.select(F.col("c_custkey").alias("asset_id"), F.concat(F.lit("cu"), F.col("c_nationkey")).alias("control_unit_id"))

    def build(raw):
        s = timed(raw).select(F.col("user_id").alias("asset_id"), F.col("time").alias("timestamp_observed"), F.when(F.col("event_type") == "error", "failed").otherwise("available").alias("state"))
        return L.stream_failed_fraction(s, u, "1 hour")

    return micros(run(t, build, "failed", "ts"), "window_start", "window_end")


@query("stream_exceedance_sessions", """WITH x AS (SELECT event_type AS series_id, epoch_us(ts) AS us, value FROM events WHERE value > 100.0),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY series_id ORDER BY us) <= 7200000000 THEN 0 ELSE 1 END AS b FROM x),
g AS (SELECT *, sum(b) OVER (PARTITION BY series_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT series_id, min(us) AS session_start, max(us) + 7200000000 AS session_end, max(value) AS peak, arg_max(us, (value, -us)) AS peak_time, count(*) AS exceedances FROM g GROUP BY series_id, g""", peak=6)
def stream_exceedance_sessions(t):
    build = lambda raw: L.stream_exceedance_sessions(timed(raw).select(F.col("event_type").alias("series_id"), "time", "value"), 100.0, "2 hours")
    return micros(run(t, build, "sessions", "ts", "value"), "session_start", "session_end", "peak_time")


SCORED_SQL = f"""WITH {CURVE_SQL}, dp AS (SELECT event_id, user_id AS asset_id, value / 60 AS d FROM events),
im AS (SELECT event_id, dp.asset_id, {KIND_SQL} AS asset_type, d, {P_SQL} AS p FROM dp JOIN customer ON c_custkey = asset_id LEFT JOIN cv ON cv.asset_type = {KIND_SQL})
SELECT event_id, asset_id, asset_type, d AS sampled_depth_m, p AS failure_probability, coalesce(p >= 0.5, false) AS affected, p IS NULL AS unmapped_class FROM im"""


@query("stream_impacts", SCORED_SQL, sampled_depth_m=5, failure_probability=6)
def stream_impacts(t):
    build = lambda raw: L.stream_impacts(raw.select("event_id", F.col("user_id").alias("asset_id"), (F.col("value") / 60).alias("sampled_depth_m")), kinds(t), curves(t))
    return run(t, build, "impacts").select(
        "event_id", "asset_id", "asset_type", "sampled_depth_m", "failure_probability", "affected", "unmapped_class")


@query("stream_duration_depth", """WITH x AS (SELECT event_type AS cell, epoch_us(date_trunc('hour', ts)) // 3600000000 AS h, value FROM events),
w AS (SELECT cell, h, value, (h // 2 - unnest([0, 1, 2])) * 2 AS s FROM x)
SELECT cell, s * 3600000000 AS storm_date, (s + 6) * 3600000000 AS window_end, sum(value) AS depth FROM w WHERE h < s + 6
GROUP BY cell, s HAVING count(DISTINCT CASE WHEN value IS NOT NULL THEN h END) = 6""", depth=4)
def stream_duration_depth(t):
    build = lambda raw: L.stream_duration_depth(raw.select(F.col("event_type").alias("cell"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time"), "value"), 6, 2, ["cell"])
    return micros(run(t, build, "depth", "ts"), "storm_date", "window_end")
