"""Gridded rainfall and timing operators on `lineitem`, `events` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fields as G
from tidemark.operators import peaks as P

from .base import CELLS_SQL, DAILY_SQL, SERIES_SQL, query, us

DAY = 86400.0

DEPTH_SQL = f"""{CELLS_SQL},
r AS (SELECT "row", col, t, sum(v) OVER w AS depth, count(v) OVER w AS n, min(t) OVER () AS t0 FROM cells
  WINDOW w AS (PARTITION BY "row", col ORDER BY t RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW)),
depth AS (SELECT "row", col, t AS storm_end, depth FROM r WHERE n = 3 AND (t - t0) / 86400 - 2 >= 0 AND CAST((t - t0) / 86400 - 2 AS BIGINT) % {{stride}} = 0)"""
DEPTH = DEPTH_SQL.format(stride=2)
DEPTH1 = DEPTH_SQL.format(stride=1)


@query("duration_depth", f"""WITH {DEPTH}
SELECT storm_end, avg(depth) AS mean, max(depth) AS "max", min(depth) AS "min", storm_end - 172800.0 AS storm_date FROM depth GROUP BY storm_end""", mean=6)
def duration_depth(t):
    return G.duration_depth(t.cells(), 3, 2, None, "t", "v", step_s=DAY)


OFFSETS = "(0, 0), (0, 1), (1, 0), (1, 1)"


@query("footprint_max", f"""WITH {DEPTH1},
o AS (SELECT * FROM (VALUES {OFFSETS}) AS o(dr, dc)),
c AS (SELECT DISTINCT "row", col FROM cells WHERE "row" + 1 <= 3 AND col + 1 <= 3),
m AS (SELECT d.storm_end, c."row", c.col, avg(depth) AS m, max(depth) AS x, min(depth) AS n
  FROM c, o JOIN depth d ON d."row" = c."row" + o.dr AND d.col = c.col + o.dc GROUP BY ALL)
SELECT storm_end, m AS mean, x AS "max", n AS "min", "row" AS centre_row, col AS centre_col FROM m
QUALIFY row_number() OVER (PARTITION BY storm_end ORDER BY round(m, 9) DESC, "row", col) = 1""", mean=6)
def footprint_max(t):
    off = t.spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "dr int, dc int")
    cells = t.cells()
    depth = G.duration_sums(cells, 3, 1, None, "t", "v", step_s=DAY)
    return G.footprint_max(depth, off, G.allowed_centres(cells, off))


@query("storm_catalogue")
def storm_catalogue(t):
    """Footprint maxima, declustered and written as member rows."""
    off = t.spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "dr int, dc int")
    cells = t.cells()
    best = G.footprint_max(G.duration_sums(cells, 3, 1, None, "t", "v", step_s=DAY), off, G.allowed_centres(cells, off))
    ranked = P.rank_storms(best.withColumn("storm_date", F.col("storm_end") - 2 * DAY), 100.0, 240)
    return G.rainfall_members(ranked, 72)


@query("window_peak", f"""WITH {SERIES_SQL},
w AS (SELECT o_orderkey AS wid, CAST(epoch(o_orderdate) AS DOUBLE) + 915148800.0 AS a FROM orders)
SELECT w.wid, arg_max(t, struct_pack(v := v, nt := -t)) AS peak_time, max(v) AS peak_value
FROM w JOIN series s ON s.t BETWEEN w.a AND w.a + 259200.0 GROUP BY w.wid""", peak_time=3)
def window_peak(t):
    w = t.orders.select(F.col("o_orderkey").alias("wid"), (us(F.col("o_orderdate")) + 915148800.0).alias("a"))
    return G.window_peak(t.series(), w.withColumn("z", F.col("a") + 259200.0), "wid", "a", "z", None, "t", "v")


@query("field_centroid", f"""WITH {CELLS_SQL}
SELECT t, sum(v * (col - 70.5)) / sum(v) AS centroid_x, sum(v * ("row" + 41.25)) / sum(v) AS centroid_y FROM cells GROUP BY t""",
       centroid_x=6, centroid_y=6)
def field_centroid(t):
    c = t.cells().withColumn("lon", F.col("col") - 70.5).withColumn("lat", F.col("row") + 41.25)
    return G.field_centroid(c, "t", value="v")


RANKED_SQL = """ranked AS (SELECT o_orderkey AS por_rank, CAST(epoch(o_orderdate) AS DOUBLE) AS storm_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey % 100) / 10.0 END AS tlon, (o_custkey % 90) / 10.0 AS hlon,
  (o_custkey % 80) / 10.0 AS tlat, (o_custkey % 70) / 10.0 AS hlat FROM orders)"""


def ranked(t):
    c = F.col("o_custkey")
    return t.orders.select(
        F.col("o_orderkey").alias("por_rank"), us(F.col("o_orderdate")).alias("storm_date"),
        F.when(F.col("o_orderkey") % 7 != 0, (c % 100) / 10.0).alias("target_footprint_center_lon"),
        ((c % 90) / 10.0).alias("historical_footprint_center_lon"), ((c % 80) / 10.0).alias("target_footprint_center_lat"),
        ((c % 70) / 10.0).alias("historical_footprint_center_lat"))


@query("rainfall_members", f"""WITH {RANKED_SQL}
SELECT 'rainfall_study_72h_rank' || CASE WHEN por_rank < 10000 THEN lpad(CAST(por_rank AS VARCHAR), 4, '0') ELSE CAST(por_rank AS VARCHAR) END AS member_id,
 strftime(make_timestamp(CAST(storm_date * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS storm_start,
 strftime(make_timestamp(CAST((storm_date + 71 * 3600) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS storm_end,
 72 AS duration_hours, coalesce(tlon - hlon, 0.0) AS transposition_offset_lon, tlat - hlat AS transposition_offset_lat FROM ranked""",
       transposition_offset_lon=6, transposition_offset_lat=6)
def rainfall_members(t):
    m = G.rainfall_members(ranked(t), 72)
    return m.select("member_id", "storm_start", "storm_end", "duration_hours", "transposition_offset_lon", "transposition_offset_lat")


@query("transpose_cells", f"""WITH {RANKED_SQL}, {CELLS_SQL},
off AS (SELECT CAST(por_rank % 16 AS BIGINT) AS m, max(coalesce(tlon - hlon, 0.0)) AS dx, max(tlat - hlat) AS dy FROM ranked GROUP BY 1)
SELECT "row", col, t, col + dx AS lon, "row" + dy AS lat FROM cells JOIN off ON off.m = "row" * 4 + col""", lon=6, lat=6)
def transpose_cells(t):
    m = G.rainfall_members(ranked(t), 72).groupBy((F.col("por_rank") % 16).alias("member_id")).agg(
        F.max("transposition_offset_lon").alias("transposition_offset_lon"), F.max("transposition_offset_lat").alias("transposition_offset_lat"))
    c = t.cells().withColumn("member_id", F.col("row") * 4 + F.col("col")).withColumn("lon", F.col("col")).withColumn("lat", F.col("row"))
    return G.transpose_cells(c, m).select("row", "col", "t", "lon", "lat")


@query("loading_pattern", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_quantity / nullif(CAST(l_suppkey % 60 AS DOUBLE), 0), 0), 1) AS loading_position FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 60 = 0 THEN NULL ELSE loading_position END AS loading_position, CASE WHEN l_suppkey % 60 = 0 THEN 'unresolved'
 WHEN loading_position < 1.0 / 3 THEN 'front_loaded' WHEN loading_position < 2.0 / 3 THEN 'center_loaded' ELSE 'back_loaded' END AS loading_pattern FROM p""",
       loading_position=6)
def loading_pattern(t):
    d = t.lineitem.withColumn("hours", F.col("l_suppkey") % 60)
    return G.loading_pattern(d, "l_quantity", "hours").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "loading_position", "loading_pattern")


SEASON_SQL = ("CASE WHEN {m} IN (6, 7, 8, 9) THEN 'warm_convective' WHEN {m} IN (12, 1, 2, 3) THEN 'cool_frontal' ELSE 'transition' END")


@query("season_counts", f"""SELECT {SEASON_SQL.format(m='month(l_shipdate)')} AS season, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS members
FROM lineitem GROUP BY ALL""")
def season_counts(t):
    return G.season_counts(t.lineitem, "l_shipdate")


@query("enrich_timing", """WITH m AS (SELECT o_orderkey AS member_id, CAST(epoch(o_orderdate) AS DOUBLE) AS s,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(epoch(o_orderdate) AS DOUBLE) + (o_custkey % 72) * 3600 END AS p,
  CASE WHEN o_orderkey % 5 = 0 THEN 48.0 END AS d FROM orders)
SELECT member_id, coalesce(p, s + coalesce(d, 72.0) / 2 * 3600) AS rainfall_peak_time,
  CASE WHEN p IS NOT NULL THEN 'member_table' ELSE 'legacy_midpoint_inferred' END AS rainfall_peak_time_source,
  coalesce(d, 72.0) AS duration_hours, (coalesce(p, s + coalesce(d, 72.0) / 2 * 3600) - s) / 3600 AS rainfall_peak_offset_from_start_hours FROM m""",
       rainfall_peak_offset_from_start_hours=6)
def enrich_timing(t):
    s = us(F.col("o_orderdate"))
    m = t.orders.select(F.col("o_orderkey").alias("member_id"), s.alias("storm_start"),
                        F.when(F.col("o_orderkey") % 3 == 0, s + (F.col("o_custkey") % 72) * 3600).alias("rainfall_peak_time"),
                        F.when(F.col("o_orderkey") % 5 == 0, 48.0).alias("duration_hours"))
    return G.enrich_timing(m).drop("storm_start")


@query("unwrap_degrees", f"""WITH {SERIES_SQL},
d AS (SELECT k, t, v * 7 - 360 * floor(v * 7 / 360) AS a FROM series),
s AS (SELECT *, a - lag(a) OVER (PARTITION BY k ORDER BY t) AS step FROM d),
n AS (SELECT *, coalesce(-ceil((step - 180) / 360), 0) AS turn FROM s)
SELECT k, t, a AS direction, a + 360 * sum(turn) OVER (PARTITION BY k ORDER BY t) AS unwrapped FROM n""", t=3, direction=6, unwrapped=6)
def unwrap_degrees(t):
    d = t.series().select("k", "t", (F.col("v") * 7 - 360 * F.floor(F.col("v") * 7 / 360)).alias("direction"))
    return G.unwrap_degrees(d, "k", "t")


@query("direction_jumps", f"""WITH {DAILY_SQL},
d AS (SELECT k, t, avg(v - 360 * floor(v / 360)) AS a FROM daily GROUP BY k, t),
s AS (SELECT k, abs(a - lag(a) OVER (PARTITION BY k ORDER BY t)) AS j FROM d)
SELECT k, max(j) AS max_jump_degrees, max(j) > 180 AS wrap_flag FROM s GROUP BY k""", max_jump_degrees=3)
def direction_jumps(t):
    d = t.daily().select("k", "t", (F.col("v") - 360 * F.floor(F.col("v") / 360)).alias("direction"))
    return G.direction_jumps(d, 180.0, "k", "t")


WET_SQL = f"""{CELLS_SQL}, tot AS (SELECT "row" % 2 AS k, t, sum(v) AS v FROM cells GROUP BY ALL),
ws AS (SELECT k, t, sum(v) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN CURRENT ROW AND 518400 FOLLOWING) AS s,
  min(t) OVER (PARTITION BY k) AS a, max(t) OVER (PARTITION BY k) AS z FROM tot),
wet AS (SELECT k, t AS window_start, s AS window_total FROM ws WHERE t + 518400 <= z OR t = a
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, t) = 1)"""


@query("wettest_window", f"WITH {WET_SQL} SELECT * FROM wet")
def wettest_window(t):
    c = t.cells().withColumn("k", F.col("row") % 2)
    return G.wettest_window(c, 7, "k", "t", "v", DAY)


@query("stage_rainfall", f"""WITH {WET_SQL},
g AS (SELECT DISTINCT "row" % 2 AS k, "row", col FROM cells),
i AS (SELECT unnest(range(0, 7)) AS i)
SELECT g.k, g."row", g.col, 1000.0 * 86400 + i.i * 86400.0 AS t, coalesce(c.v, 0) * (1.25 + g.k) AS precip
FROM g JOIN wet USING (k) CROSS JOIN i LEFT JOIN cells c ON c."row" = g."row" AND c.col = g.col AND c.t = wet.window_start + i.i * 86400.0""", precip=4)
def stage_rainfall(t):
    c = t.cells().withColumn("k", F.col("row") % 2)
    w = c.select("k").distinct().select("k", F.lit(1000.0 * 86400).alias("start"), (F.col("k") + 1.25).alias("scale"))
    return G.stage_rainfall(c, w, 7, "k", "start", "scale", "t", "v", step_s=DAY)
