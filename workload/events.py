"""Event catalogue operators on `orders`, `part`, `lineitem` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import events as V
from tidemark.operators import extremes as X

from .base import query, us
from .extremes import BAND_SQL

U_SQL = "((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def orders_time(t):
    return t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("time"),
                           (F.col("o_totalprice") / 1000).alias("sample_rp_years"), F.col("o_custkey"), F.col("o_orderpriority"))


def part_members(t):
    """Library of members: part price as value, a day derived from the key as time."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") * 37 % 2400).cast("int"))
    return t.part.select(F.col("p_partkey").alias("member_id"), day.cast("timestamp").alias("member_time"), F.col("p_retailprice").alias("value"), "p_size")


MEMBERS_SQL = "m AS (SELECT p_partkey AS member_id, CAST(DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) AS TIMESTAMP) AS member_time, p_retailprice AS value, p_size FROM part)"
DIST_SQL = "least(abs(dayofyear({a}) - dayofyear({b})), 366 - abs(dayofyear({a}) - dayofyear({b})))"

TRACKS_SQL = """tr AS (SELECT o_orderdate + INTERVAL 400 DAY AS time, 25.0 + o_custkey % 200 / 10.0 AS lat, -80.0 + o_orderkey % 160 / 10.0 AS lon FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("classify_storms", f"""WITH {TRACKS_SQL},
n AS (SELECT time FROM tr WHERE 2 * 6371.0 * asin(sqrt(sin((radians(lat) - radians(41.5)) / 2) ** 2 + cos(radians(41.5)) * cos(radians(lat)) * sin(radians(lon + 70.5) / 2) ** 2)) <= 350),
h AS (SELECT DISTINCT o_orderkey FROM orders JOIN n ON time BETWEEN o_orderdate - INTERVAL 2 DAY AND o_orderdate + INTERVAL 1 DAY)
SELECT o_orderkey AS event_id, CASE WHEN o_orderdate < (SELECT min(time) FROM tr) OR o_orderdate > (SELECT max(time) FROM tr) THEN 'unresolved'
 WHEN h.o_orderkey IS NOT NULL THEN 'tc' WHEN month(o_orderdate) IN (10, 11, 12, 1, 2, 3, 4) THEN 'nor_easter' ELSE 'other_non_tropical' END AS storm_type
FROM orders LEFT JOIN h USING (o_orderkey)""")
def classify_storms(t):
    tr = t.orders.where("o_orderpriority = '1-URGENT'").select(
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 400 days")).alias("time"),
        (25.0 + F.col("o_custkey") % 200 / 10.0).alias("lat"), (-80.0 + F.col("o_orderkey") % 160 / 10.0).alias("lon"))
    return V.classify_storms(orders_time(t), tr, (-70.5, 41.5)).select("event_id", "storm_type")


@query("realize_driver")
def realize_driver(t):
    c = orders_time(t).withColumn("target", F.when(F.col("event_id") % 97 != 0, 850.0 + F.col("sample_rp_years")))
    return V.realize_driver(c, part_members(t), "rainfall", "target", "value", 3)


@query("realize_driver_reweighted")
def realize_driver_reweighted(t):
    c = orders_time(t).withColumn("target", 850.0 + F.col("sample_rp_years"))
    return V.realize_driver(c, part_members(t), "rainfall", "target", "value", 3, reuse_penalty=0.15, rounds=2)


@query("draw_lags", f"""WITH p AS (SELECT value AS lag, row_number() OVER (ORDER BY value) AS i FROM events), n AS (SELECT count(*) AS n FROM events),
o AS (SELECT o_orderkey, CAST(floor({U_SQL.format(key="'4|lag|' || o_orderkey")} * n) AS BIGINT) + 1 AS i FROM orders, n)
SELECT o_orderkey AS event_id, lag AS lag_hours FROM o JOIN p USING (i)""")
def draw_lags(t):
    return V.draw_lags(orders_time(t), t.events.select(F.col("value").alias("lag_hours")), 4)


def paired(t):
    """One co-occurrence row per order: order value and time against its largest line item."""
    li = t.lineitem.groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", "l_shipdate")).alias("m"))
    return t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp").alias("event_time"), F.col("o_orderstatus").alias("storm_type"),
        F.col("o_totalprice").alias("coastal_water_level"), F.col("o_orderdate").cast("timestamp").alias("coastal_water_level_time"),
        F.col("m.l_extendedprice").alias("rainfall"), (F.col("m.l_shipdate").cast("timestamp") - F.expr("interval 60 days")).alias("rainfall_time"))


PAIRED_SQL = """li AS (SELECT l_orderkey, arg_max(l_shipdate, (l_extendedprice, l_shipdate)) AS s, max(l_extendedprice) AS r FROM lineitem GROUP BY l_orderkey),
paired AS (SELECT o_orderkey, o_orderstatus AS storm_type, o_totalprice AS coastal_water_level, o_orderdate AS ct, r AS rainfall, s - INTERVAL 60 DAY AS rt FROM orders JOIN li ON l_orderkey = o_orderkey)"""


@query("lag_pool", f"WITH {PAIRED_SQL} SELECT o_orderkey, rainfall, coastal_water_level, (epoch(rt) - epoch(ct)) / 3600.0 AS observed_lag_hours FROM paired")
def lag_pool(t):
    return V.lag_pool(paired(t)).select("o_orderkey", "rainfall", "coastal_water_level", "observed_lag_hours")


@query("lag_analogs")
def lag_analogs(t):
    p = V.cut(V.lag_pool(paired(t)))
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.avg("l_extendedprice").alias("rainfall"), (F.sum("l_extendedprice") / 2).alias("coastal_water_level"),
        F.min(F.col("l_shipdate").cast("timestamp")).alias("event_time"), F.max("l_linestatus").alias("storm_type"))
    return V.apply_lag_offsets(V.lag_analogs(c, p, 8))


@query("pair_permuted", f"""WITH {MEMBERS_SQL},
e AS (SELECT o_orderkey AS event_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), n AS (SELECT count(*) AS n FROM m),
c AS (SELECT DISTINCT i // n AS c FROM e, n),
d AS (SELECT c, member_id, row_number() OVER (PARTITION BY c ORDER BY {U_SQL.format(key="'6|_deal|' || c || '|' || member_id")}) AS r FROM c, m)
SELECT e.event_id, d.member_id FROM e, n JOIN d ON d.c = e.i // n.n AND d.r = e.i % n.n + 1""")
def pair_permuted(t):
    return V.pair_permuted(orders_time(t), part_members(t), 6)


@query("pair_seasonal", f"""WITH {MEMBERS_SQL}, ds AS (SELECT DISTINCT dayofyear(o_orderdate) AS dy FROM orders),
x AS (SELECT ds.dy, m.member_id, row_number() OVER (PARTITION BY ds.dy ORDER BY dayofyear(member_time), member_id) AS r, count(*) OVER (PARTITION BY ds.dy) AS n
  FROM ds JOIN m ON least(abs(ds.dy - dayofyear(member_time)), 366 - abs(ds.dy - dayofyear(member_time))) <= 45),
o AS (SELECT o_orderkey, dayofyear(o_orderdate) AS dy, CAST(floor({U_SQL.format(key="'2|season|' || o_orderkey")} * c.n) AS BIGINT) + 1 AS r FROM orders JOIN (SELECT dy, max(n) AS n FROM x GROUP BY dy) c ON c.dy = dayofyear(o_orderdate))
SELECT o_orderkey AS event_id, x.member_id FROM o JOIN x USING (dy, r)""")
def pair_seasonal(t):
    return V.pair_seasonal(orders_time(t), part_members(t), 45, 2)


@query("pair_antecedent", f"""WITH {MEMBERS_SQL}, u AS (SELECT member_time, min(member_id) AS member_id FROM m GROUP BY 1),
e AS (SELECT o_orderkey AS event_id, o_orderdate - INTERVAL 24 HOUR AS tt FROM orders),
b AS (SELECT e.*, u.member_id AS bm, u.member_time AS bt FROM e ASOF LEFT JOIN u ON e.tt >= u.member_time),
f AS (SELECT b.*, u.member_id AS fm, u.member_time AS ft FROM b ASOF LEFT JOIN u ON b.tt <= u.member_time)
SELECT event_id, coalesce(bm, fm) AS member_id, CAST(epoch(coalesce(bt, ft)) AS DOUBLE) AS member_seconds, bm IS NULL AS fallback FROM f""")
def pair_antecedent(t):
    return V.pair_antecedent(orders_time(t), part_members(t), 24.0)


@query("pair_wet", f"""WITH {MEMBERS_SQL}, ds AS (SELECT DISTINCT dayofyear(o_orderdate) AS dy FROM orders),
x AS (SELECT dy, member_id, p_size FROM ds JOIN m ON least(abs(dy - dayofyear(member_time)), 366 - abs(dy - dayofyear(member_time))) <= 30
  QUALIFY row_number() OVER (PARTITION BY dy ORDER BY p_size DESC, member_id) = 1)
SELECT o_orderkey AS event_id, member_id, CAST(p_size AS DOUBLE) AS soil_moisture_mean FROM orders JOIN x ON dy = dayofyear(o_orderdate)""")
def pair_wet(t):
    return V.pair_wet(orders_time(t), part_members(t).withColumnRenamed("p_size", "soil_moisture_mean"), 30)


@query("member_library", """SELECT l_returnflag AS k, 'rain_' || strftime(l_shipdate, '%Y%m%dT%H%M%S') AS member_id, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS "time", avg(l_quantity) AS value
FROM lineitem GROUP BY l_returnflag, l_shipdate""", value=6)
def member_library(t):
    r = t.lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("value"))
    return V.member_library(r, "rain", "k")


@query("nearest_member", f"""WITH {MEMBERS_SQL}, e AS (SELECT o_orderkey AS event_id, o_orderdate AS t, 800 + o_totalprice / 1500 AS x FROM orders),
c AS (SELECT event_id, member_id, abs(value - x) AS dv, abs(epoch(member_time) - epoch(t)) / 3600.0 AS dt, abs(epoch(member_time) - epoch(t)) <= 86400 AS inw FROM e, m),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY inw DESC, dv, dt, member_id) AS rn FROM c)
SELECT event_id, member_id, dv AS value_distance, dt AS time_distance_hours, inw AS in_window FROM r WHERE rn = 1""", value_distance=6)
def nearest_member(t):
    e = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("event_time"), (800 + F.col("o_totalprice") / 1500).alias("value"))
    return V.nearest_member(e, part_members(t).withColumnRenamed("value", "member_value"), window_h=24.0)


@query("historical_tail")
def historical_tail(t):
    """Observed pairs of 10 years and more, one per storm, joined to their nearest member."""
    from tidemark.plans.catalogues import historical_tail as tail

    return tail(paired(t), part_members(t).withColumnRenamed("value", "member_value"), ["rainfall", "coastal_water_level"], 2.0, 10.0, 120.0)


SCORE_SQL = f"""cat AS (SELECT o_orderkey AS event_id, o_totalprice / 1000 AS rp, {BAND_SQL.format(rp='(o_totalprice / 1000)')} AS severity_band,
  o_custkey % 40 = 0 AS near_islanding_threshold FROM orders),
bm AS (SELECT * FROM (VALUES (2.0, '50pct_annual_chance'), (10.0, '10pct_annual_chance'), (50.0, '2pct_annual_chance'), (100.0, '1pct_annual_chance'), (500.0, '0p2pct_annual_chance')) AS b(b, lab)),
nr AS (SELECT b, lab, event_id FROM bm, cat QUALIFY row_number() OVER (PARTITION BY b ORDER BY abs(ln(rp) - ln(CAST(b AS DOUBLE))), event_id) = 1),
mk AS (SELECT event_id, count(*) AS n, list('nearest_' || lab || '_driver') AS why FROM nr GROUP BY event_id),
sc AS (SELECT cat.*, coalesce(n, 0) AS nb, CAST(100 * coalesce(n, 0) + CASE WHEN severity_band IN ('significant', 'rare', 'extreme', 'beyond_design') THEN 35 ELSE 0 END
  + CASE WHEN near_islanding_threshold THEN 45 ELSE 0 END AS DOUBLE) AS selection_score,
  list_sort(list_concat(list_concat(coalesce(why, []), CASE WHEN severity_band IN ('significant', 'rare', 'extreme', 'beyond_design') THEN ['tail_or_benchmark_driver'] ELSE [] END),
   CASE WHEN near_islanding_threshold THEN ['near_islanding_threshold'] ELSE [] END)) AS why FROM cat LEFT JOIN mk USING (event_id))"""


def scored(t):
    c = X.assign_band(orders_time(t), "sample_rp_years").withColumn("near_islanding_threshold", F.col("o_custkey") % 40 == 0)
    return V.score_training(c, [2.0, 10.0, 50.0, 100.0, 500.0])


@query("score_training", f"""WITH {SCORE_SQL} SELECT event_id, selection_score, CASE WHEN len(why) = 0 THEN 'probability_catalog_representative' ELSE array_to_string(why, ';') END AS selection_reason FROM sc""")
def score_training(t):
    return scored(t).select("event_id", "selection_score", F.array_join("selection_reasons", ";").alias("selection_reason"))


TRAIN = {"mild": 0.05, "common": 0.15, "significant": 0.3, "rare": 0.2, "extreme": 0.3}


@query("select_training", f"""WITH {SCORE_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY selection_score DESC, rp DESC, event_id) AS rk FROM sc),
g AS (SELECT * FROM (VALUES ('mild', 25), ('common', 75), ('significant', 150), ('rare', 100), ('extreme', 150)) AS g(severity_band, goal)),
md AS (SELECT severity_band, count(*) AS m FROM r WHERE nb > 0 GROUP BY 1),
f AS (SELECT r.*, row_number() OVER (PARTITION BY severity_band ORDER BY rk) AS ib FROM r WHERE nb = 0),
q AS (SELECT g.severity_band, goal - coalesce(m, 0) AS quota FROM g LEFT JOIN md USING (severity_band)),
a AS (SELECT event_id, rk FROM r WHERE nb > 0 UNION ALL SELECT f.event_id, rk FROM f JOIN q USING (severity_band) WHERE ib <= quota)
SELECT event_id, true AS picked FROM a UNION ALL
SELECT event_id, true FROM (SELECT event_id, row_number() OVER (ORDER BY rk) AS k FROM f WHERE event_id NOT IN (SELECT event_id FROM a)) WHERE k <= 500 - (SELECT count(*) FROM a)""")
def select_training(t):
    return V.select_training(scored(t), 500, TRAIN).select("event_id", F.lit(True).alias("picked"))


@query("compound_pairing")
def compound_pairing(t):
    rain = part_members(t).select("member_id", "member_time", (F.col("member_time") + F.expr("interval 30 hours")).alias("rainfall_peak_time"),
                                  F.col("value").alias("rainfall_metric"), F.lit(72.0).alias("duration_hours"))
    c = orders_time(t).withColumnRenamed("time", "event_time").withColumn("lag", (F.col("o_custkey") % 120 - 60).cast("double"))
    return V.compound_pairing(c, rain, 5, 50, 72.0, 45, {"empirical_analog_lag": 0.6, "rainfall_before_coastal": 0.2, "rainfall_after_coastal": 0.2}, lag="lag",
                              reuse_penalty=0.15, soil=part_members(t).withColumnRenamed("p_size", "soil_moisture_mean"))


DRIVERS_SQL = """dr AS (SELECT l_orderkey AS event_id, CASE WHEN l_linenumber = 1 THEN 'rainfall' WHEN l_linenumber = 2 THEN 'streamflow' ELSE 'soil' END AS driver,
  l_partkey AS member_id, l_extendedprice / 10000 AS scale_factor, l_quantity - 25 AS lag_hours FROM lineitem)"""


def drivers(t):
    d = F.when(F.col("l_linenumber") == 1, "rainfall").when(F.col("l_linenumber") == 2, "streamflow").otherwise("soil")
    return t.lineitem.select(F.col("l_orderkey").alias("event_id"), d.alias("driver"), F.col("l_partkey").alias("member_id"),
                             (F.col("l_extendedprice") / 10000).alias("scale_factor"), (F.col("l_quantity") - 25).alias("lag_hours"))


@query("to_wide", f"""WITH {DRIVERS_SQL}, f AS (SELECT event_id, driver, member_id, scale_factor FROM dr QUALIFY row_number() OVER (PARTITION BY event_id, driver ORDER BY member_id, scale_factor) = 1)
SELECT o_orderkey AS event_id, max(member_id) FILTER (driver = 'rainfall') AS rainfall_member_id, max(scale_factor) FILTER (driver = 'rainfall') AS rainfall_scale_factor,
 max(member_id) FILTER (driver = 'soil') AS soil_member_id, max(scale_factor) FILTER (driver = 'soil') AS soil_scale_factor FROM orders LEFT JOIN f ON f.event_id = o_orderkey GROUP BY o_orderkey""",
       rainfall_scale_factor=6, soil_scale_factor=6)
def to_wide(t):
    return V.to_wide(t.orders.select(F.col("o_orderkey").alias("event_id")), drivers(t), ["rainfall", "soil"], ["member_id", "scale_factor"])


@query("validate_catalog", """WITH c AS (SELECT CAST(o_orderkey // 2 * 2 + CASE WHEN o_orderkey % 100 = 1 THEN 0 ELSE o_orderkey % 2 END AS VARCHAR) AS event_id,
  CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'here' END AS loc, o_totalprice - 5000 AS w, CASE WHEN o_custkey % 60 = 0 THEN NULL ELSE o_totalprice END AS rp,
  CASE WHEN o_custkey % 70 = 0 THEN 'edge' ELSE 'body' END AS reg, CASE WHEN o_custkey % 80 = 0 THEN NULL ELSE 'f.nc' END AS cf, o_orderstatus AS st FROM orders),
i AS (SELECT 'missing_value' AS code, event_id, 'study_location' AS "column", NULL AS forcing FROM c WHERE loc = ''
 UNION ALL SELECT 'invalid_sampling_weight', event_id, 'sampling_weight', NULL FROM c WHERE w <= 0
 UNION ALL SELECT 'invalid_return_period', event_id, 'sample_rp_years', NULL FROM c WHERE rp IS NULL OR rp <= 0
 UNION ALL SELECT 'invalid_sampling_region', event_id, 'sampling_region', NULL FROM c WHERE reg = 'edge'
 UNION ALL SELECT 'incomplete_forcing', event_id, 'coastal_member_file', 'coastal' FROM c WHERE cf IS NULL
 UNION ALL SELECT 'incomplete_forcing', event_id, x, 'rainfall' FROM c, (VALUES ('rainfall_member_file'), ('rainfall_member_id'), ('rainfall_pairing_seed')) v(x) WHERE st = 'P'
 UNION ALL SELECT 'incomplete_seasonal_pairing', event_id, x, 'rainfall' FROM c, (VALUES ('rainfall_member_time'), ('rainfall_pairing_window_days')) v(x) WHERE st = 'P'
 UNION ALL SELECT 'duplicate_event_id', event_id, 'event_id', NULL FROM c WHERE event_id IN (SELECT event_id FROM c GROUP BY 1 HAVING count(*) > 1))
SELECT 'error' AS severity, * FROM i""")
def validate_catalog(t):
    k = F.col("o_orderkey")
    c = t.orders.select((F.floor(k / 2) * 2 + F.when(k % 100 == 1, 0).otherwise(k % 2)).cast("string").alias("event_id"),
                        F.when(F.col("o_custkey") % 50 == 0, "").otherwise("here").alias("study_location"), F.lit("storm").alias("event_family"), F.lit("base").alias("scenario_name"),
                        (F.col("o_totalprice") - 5000).alias("sampling_weight"), F.when(F.col("o_custkey") % 60 != 0, F.col("o_totalprice")).alias("sample_rp_years"),
                        F.when(F.col("o_custkey") % 70 == 0, "edge").otherwise("body").alias("sampling_region"), F.lit("gauge").alias("coastal_source"),
                        F.when(F.col("o_custkey") % 80 != 0, "f.nc").alias("coastal_member_file"), F.lit("m1").alias("coastal_member_id"),
                        F.when(F.col("o_orderstatus") == "P", "grid").alias("rainfall_source"),
                        F.when(F.col("o_orderstatus") == "P", "seasonal_window_permutation").alias("rainfall_pairing_policy"))
    return V.validate_catalog(c)


@query("severity_distribution", f"""SELECT {BAND_SQL.format(rp='(o_totalprice / 1000)')} AS severity_band, count(*) AS "count", sum(o_totalprice) AS probability_weight, avg(o_custkey) AS mean_sampling_weight
FROM orders GROUP BY 1""", probability_weight=1, mean_sampling_weight=6)
def severity_distribution(t):
    c = X.assign_band(orders_time(t), "sample_rp_years").withColumn("probability_weight", F.col("sample_rp_years") * 1000).withColumn("sampling_weight", F.col("o_custkey"))
    return V.severity_distribution(c)


@query("weight_check", "SELECT sum(c_acctbal) AS weight_sum, bool_and(c_acctbal >= 0) AS nonnegative, count(c_acctbal) AS finite_count, count(*) AS row_count FROM customer", weight_sum=2)
def weight_check(t):
    return V.weight_check(t.customer, "c_acctbal")


@query("reuse_summary", f"""WITH {DRIVERS_SQL}, c AS (SELECT driver, member_id, count(*) AS c FROM dr GROUP BY ALL)
SELECT driver, CAST(sum(c) AS BIGINT) AS rows, count(member_id) AS unique_members, max(c) / sum(c) AS max_member_reuse_fraction FROM c GROUP BY driver""", max_member_reuse_fraction=9)
def reuse_summary(t):
    return V.reuse_summary(drivers(t))


@query("scale_quantiles", f"WITH {DRIVERS_SQL} SELECT driver, quantile_cont(scale_factor, 0.05) AS q05, quantile_cont(scale_factor, 0.5) AS q50, quantile_cont(scale_factor, 0.95) AS q95 FROM dr GROUP BY driver", q05=6, q50=6, q95=6)
def scale_quantiles(t):
    return V.scale_quantiles(drivers(t))


@query("timing_summary", f"WITH {DRIVERS_SQL} SELECT (SELECT count(o_orderdate) FROM orders) AS events_with_reference_time, (SELECT count(*) FROM orders) AS event_rows, min(lag_hours) AS driver_lag_hours_min, max(lag_hours) AS driver_lag_hours_max FROM dr")
def timing_summary(t):
    return V.timing_summary(t.orders.select(F.col("o_orderdate").alias("event_reference_time")), drivers(t))


@query("lag_diagnostics", f"""WITH {DRIVERS_SQL}, c AS (SELECT driver, member_id, CAST(count(*) AS DOUBLE) AS c FROM dr GROUP BY ALL),
r AS (SELECT driver, count(*) AS unique_analogs, max(c) / sum(c) AS top_analog_share, sum(c) ** 2 / sum(c ** 2) AS effective_sample_size FROM c GROUP BY driver)
SELECT driver, quantile_cont(lag_hours, 0.5) AS lag_median, quantile_cont(lag_hours, 0.05) AS lag_p05, quantile_cont(lag_hours, 0.95) AS lag_p95, any_value(unique_analogs) AS unique_analogs,
 any_value(top_analog_share) AS top_analog_share, any_value(effective_sample_size) AS effective_sample_size FROM dr JOIN r USING (driver) GROUP BY driver""",
       lag_median=6, lag_p05=6, lag_p95=6, top_analog_share=9, effective_sample_size=5)
def lag_diagnostics(t):
    return V.lag_diagnostics(drivers(t), "lag_hours", "member_id", "driver")


@query("select_events_by_id", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def select_events_by_id(t):
    ids = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"))
    return V.select_events(orders_time(t), ids).select("event_id")


@query("select_events_top", "SELECT o_orderkey AS event_id, o_totalprice / 1000 AS sample_rp_years FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", sample_rp_years=6)
def select_events_top(t):
    return V.select_events(orders_time(t), None, 100).select("event_id", "sample_rp_years")


@query("nearest_scale", "SELECT o_orderkey AS event_id, abs(o_totalprice / 250000 - 1) AS historical_proximity FROM orders ORDER BY abs(o_totalprice / 250000 - 1), o_orderkey LIMIT 5", historical_proximity=9)
def nearest_scale(t):
    c = t.orders.select(F.col("o_orderkey").alias("event_id"), (F.col("o_totalprice") / 250000).alias("rainfall_scale_factor"))
    return V.nearest_scale(c, 5).select("event_id", "historical_proximity")


@query("forcing_window", """WITH g AS (SELECT l_orderkey AS event_id, min(-l_quantity) - 6 AS a, max(l_quantity * l_linenumber) + 12 AS z FROM lineitem GROUP BY 1),
p AS (SELECT event_id, a - greatest((48 - (z - a)) / 2, 0) AS a, z + greatest((48 - (z - a)) / 2, 0) AS z FROM g)
SELECT event_id, CASE WHEN z - a > 120 THEN least(greatest(-60, a), z - 120) ELSE a END AS run_start_hours, CASE WHEN z - a > 120 THEN least(greatest(-60, a), z - 120) + 120 ELSE z END AS run_stop_hours FROM p""")
def forcing_window(t):
    w = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.lit(0.0).alias("reference_time"), (-F.col("l_quantity")).alias("start_offset_hours"),
                          (F.col("l_quantity") * F.col("l_linenumber")).alias("end_offset_hours"))
    return V.forcing_window(w, 6, 12, 48, 120).drop("reference_time")


@query("handoff_readiness", """WITH s AS (SELECT DISTINCT l_orderkey AS event_id, CAST(l_suppkey AS VARCHAR) AS site_no FROM lineitem), rv AS (SELECT CAST(s_suppkey AS VARCHAR) AS site_no FROM supplier WHERE s_acctbal > 5000),
o AS (SELECT event_id, count(*) AS n, count(rv.site_no) AS c, coalesce(string_agg(rv.site_no, ',' ORDER BY rv.site_no), '') AS l FROM s LEFT JOIN rv USING (site_no) GROUP BY event_id)
SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN coalesce(c, 0) = 0 THEN 'incompatible' ELSE 'blocked' END AS status,
 coalesce(n, 0) AS member_site_count, coalesce(c, 0) AS overlap_count, coalesce(l, '') AS reviewed_overlap FROM orders LEFT JOIN o ON o.event_id = o_orderkey""")
def handoff_readiness(t):
    e = t.orders.select(F.col("o_orderkey").alias("event_id"), "o_orderstatus")
    s = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").cast("string").alias("site_no"))
    rv = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("site_no"))
    return V.handoff_readiness(e, e.where("o_orderstatus = 'F'"), s, rv)


@query("audit_inventory", """WITH e AS (SELECT o_orderkey AS event_id FROM orders), a AS (SELECT DISTINCT l_orderkey + 5 AS event_id FROM lineitem)
SELECT coalesce(e.event_id, a.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'missing' ELSE 'extra' END AS issue FROM e FULL JOIN a ON e.event_id = a.event_id WHERE e.event_id IS NULL OR a.event_id IS NULL""")
def audit_inventory(t):
    return V.audit_inventory(t.orders.select(F.col("o_orderkey").alias("event_id")), t.lineitem.select((F.col("l_orderkey") + 5).alias("event_id")), ["event_id"])


@query("missing_files", """SELECT o_orderkey AS event_id, f AS file_name FROM orders, (VALUES ('1'), ('2'), ('3')) v(f) WHERE NOT EXISTS
 (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND CAST(l_linenumber AS VARCHAR) = f)""")
def missing_files(t):
    have = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("string").alias("file_name"))
    return V.missing_files(t.orders.select(F.col("o_orderkey").alias("event_id")), ["1", "2", "3"], have)


@query("overlay", """SELECT o_orderkey AS event_id, coalesce(s.p, o_orderpriority) AS o_orderpriority, s.n AS item_count FROM orders
LEFT JOIN (SELECT l_orderkey, CASE WHEN count(*) > 3 THEN 'many' END AS p, count(*) AS n FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey""")
def overlay(t):
    o = t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.when(F.count(F.lit(1)) > 3, "many").alias("o_orderpriority"), F.count(F.lit(1)).alias("item_count"))
    return V.overlay(orders_time(t).select("event_id", "o_orderpriority"), o)


@query("lag_contract", """WITH c AS (SELECT o_orderkey AS event_id, CASE WHEN o_custkey % 30 = 0 THEN NULL ELSE o_custkey % 100 - 80.0 END AS s, o_custkey % 90 - 40.0 AS p, o_custkey % 120 + 10.0 AS z, o_orderkey % 200 - 100.0 AS g, o_orderpriority AS pr FROM orders)
SELECT event_id, 'missing_offset' AS violation FROM c WHERE pr <> '5-LOW' AND s IS NULL
UNION ALL SELECT event_id, 'out_of_order' FROM c WHERE pr <> '5-LOW' AND NOT coalesce(s <= p AND p <= z, false)
UNION ALL SELECT event_id, 'unbounded_lag' FROM c WHERE pr <> '5-LOW' AND (abs(g) > 72 OR abs(p) > 72)""")
def lag_contract(t):
    k = F.col("o_custkey")
    c = t.orders.select(F.col("o_orderkey").alias("event_id"), F.lit("synthetic_tail").alias("event_origin"), F.lit("copula_joint").alias("forcing_pairing_policy"),
                        F.when(F.col("o_orderpriority") != "5-LOW", "m").alias("rainfall_member_id"), F.when(k % 30 != 0, k % 100 - 80.0).alias("rainfall_start_offset_hours"),
                        (k % 90 - 40.0).alias("rainfall_peak_offset_hours"), (k % 120 + 10.0).alias("rainfall_end_offset_hours"),
                        (F.col("o_orderkey") % 200 - 100.0).alias("rainfall_pairing_lag_hours"))
    return V.lag_contract(c, 72.0)


@query("compound_lag", """SELECT o_orderkey AS event_id, coalesce(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 90 - 40.0 END, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey % 200 - 100.0 END,
 CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey % 48 - 24.0 END) AS compound_lag_hours FROM orders""", compound_lag_hours=3)
def compound_lag(t):
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    c = t.orders.select(n.alias("event_id"), F.when(F.col("o_orderpriority") == "5-LOW", "historical_compound").otherwise("synthetic_body").alias("event_origin"),
                        F.when(k % 3 > 0, k % 90 - 40.0).alias("rainfall_peak_offset_hours"), F.when(k % 4 > 0, n % 200 - 100.0).alias("rainfall_pairing_lag_hours"),
                        (n % 48 - 24.0).alias("rainfall_realization_lag_hours"))
    return V.compound_lag(c).select("event_id", "compound_lag_hours")
