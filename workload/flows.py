"""Discharge operators on `orders`, `lineitem` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import flows as H

from .base import DAILY_SQL, DISCHARGE_SQL, SERIES_SQL, query, us

DAY = 86400.0

INTERP_SQL = """lo AS (SELECT c.*, o.t AS t0, o.v AS v0 FROM {clock} c ASOF LEFT JOIN {known} o ON c.k = o.k AND c.t >= o.t),
hi AS (SELECT c.k, c.t, o.t AS t1, o.v AS v1 FROM {clock} c ASOF LEFT JOIN {known} o ON c.k = o.k AND c.t <= o.t),
nb AS (SELECT lo.*, hi.t1, hi.v1 FROM lo JOIN hi ON lo.k = hi.k AND lo.t = hi.t),
line AS (SELECT k, t, CASE WHEN t0 = t THEN v0 WHEN t0 IS NULL OR t1 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v,
  coalesce(CASE WHEN t0 = t THEN v0 WHEN t0 IS NULL OR t1 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1) AS filled FROM nb)"""


@query("normalise_meteo", f"""WITH {SERIES_SQL},
clock AS (SELECT DISTINCT s.k, CAST(epoch(CAST(e.ts AS DATE)) AS DOUBLE) AS t FROM events e, (SELECT DISTINCT k FROM series) s),
{INTERP_SQL.format(clock='clock', known='series')}
SELECT k, t, CASE WHEN coalesce(v, m) > 150 THEN coalesce(v, m) - 273.15 ELSE coalesce(v, m) END AS v
FROM line, (SELECT quantile_cont(v, 0.5) AS m FROM series)""", v=5)
def normalise_meteo(t):
    clock = t.events.select((F.unix_date(F.to_date("ts")).cast("double") * DAY).alias("t")).distinct()
    return H.normalise_meteo(t.series(), clock, "k", "temperature", "t", "v")


@query("transfer_hydrograph", f"""WITH {DAILY_SQL},
e AS (SELECT c_custkey AS event_id, p.k, 850000000.0 + (c_custkey % 1000) * 86400 AS analog, 1.7e9 AS ref, 1.7e9 - 172800 AS a, 1.7e9 + 259200 AS z,
  1000.0 + c_acctbal AS target FROM customer c JOIN (SELECT DISTINCT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT k FROM daily)) p ON p.i = c_custkey % 5),
shape AS (SELECT event_id AS k, d.t - analog + ref AS t, max(d.v) AS v FROM e JOIN daily d ON d.k = e.k AND d.t BETWEEN analog - ref + a AND analog - ref + z GROUP BY 1, 2),
clock AS (SELECT event_id AS k, a + i.i * 3600.0 AS t FROM e, (SELECT unnest(range(0, 121)) AS i) i WHERE event_id IN (SELECT k FROM shape)),
{INTERP_SQL.format(clock='clock', known='shape')},
pk AS (SELECT k, max(filled) AS p FROM line GROUP BY k)
SELECT l.k AS event_id, l.t AS time, target / p AS scale_factor, filled * (target / p) * 0.028316846592 AS q_cms
FROM line l JOIN pk USING (k) JOIN e ON e.event_id = l.k""", scale_factor=9, q_cms=4)
def transfer_hydrograph(t):
    names = t.daily().select("k").distinct().withColumn("i", F.array_position(F.array_sort(F.array(
        *[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])), F.col("k")) - 1)
    e = t.customer.select(F.col("c_custkey").alias("event_id"), (F.col("c_custkey") % 5).alias("i"),
                          (850000000.0 + (F.col("c_custkey") % 1000) * 86400).alias("analog_time"), F.lit(1.7e9).alias("reference_time"),
                          F.lit(1.7e9 - 172800).alias("start"), F.lit(1.7e9 + 259200).alias("end"),
                          (1000.0 + F.col("c_acctbal")).alias("target_peak_cfs")).join(F.broadcast(names), "i").drop("i")
    return H.transfer_hydrograph(t.daily().withColumnRenamed("k", "site_no"), e.withColumnRenamed("k", "site_no"), "site_no", "t", "v")


@query("align_observations", f"""WITH {SERIES_SQL},
b AS (SELECT k, 1704067200.0 + floor((t - 1704067200.0) / 3600) * 3600 AS t, avg(v) AS v FROM series GROUP BY 1, 2),
clock AS (SELECT s.k, 1704067200.0 + i.i * 1800.0 AS t FROM (SELECT DISTINCT k FROM series) s, (SELECT unnest(range(0, 1488)) AS i) i),
{INTERP_SQL.format(clock='clock', known='b')}
SELECT k, t, v FROM line WHERE v IS NOT NULL""", v=8)
def align_observations(t):
    s = t.series()
    half_hours = t.spark.range(1488).select((1704067200.0 + F.col("id") * 1800.0).alias("t"))
    clock = s.select("k").distinct().join(F.broadcast(half_hours))
    return H.align_observations(s, clock, 3600.0, 1704067200.0, "k", "t", "v")


SIM_OBS_SQL = """so AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) AS INTEGER) AS event_id, CAST(o_orderdate AS DATE) AS d,
  sum(o_totalprice) AS s, max(o_totalprice) AS o FROM orders GROUP BY ALL),
sc AS (SELECT k, event_id, count(*) AS n, 1 - sum((s - o) ** 2) / (var_pop(o) * count(*)) AS nse,
  1 - sqrt((corr(s, o) - 1) ** 2 + (stddev_pop(s) / stddev_pop(o) - 1) ** 2 + (avg(s) / avg(o) - 1) ** 2) AS kge,
  (max(s) - max(o)) / max(o) AS peak_bias_fraction, (sum(s) - sum(o)) / sum(o) AS volume_bias_fraction FROM so GROUP BY k, event_id)"""


def scores(t):
    d = F.to_date("o_orderdate")
    g = t.orders.groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("event_id"), d.alias("time")).agg(
        F.sum("o_totalprice").alias("s"), F.max("o_totalprice").alias("o"))
    return H.hydrograph_scores(g.withColumn("value", F.col("s")), g.withColumn("value", F.col("o")), ["k", "event_id"])


@query("hydrograph_scores", f"WITH {SIM_OBS_SQL} SELECT * FROM sc", nse=6, kge=6, peak_bias_fraction=6, volume_bias_fraction=6)
def hydrograph_scores(t):
    return scores(t)


@query("calibration_k", f"""WITH {SIM_OBS_SQL}
SELECT k, count(DISTINCT event_id) AS event_count, count(*) AS row_count, quantile_cont(1 / (1 + peak_bias_fraction), 0.5) AS k_calibration,
 CASE WHEN count(DISTINCT event_id) >= 2 THEN 'ready_to_ship' ELSE 'insufficient_validation_events' END AS status
FROM sc WHERE n >= 12 AND peak_bias_fraction > -0.95 GROUP BY k""", k_calibration=6)
def calibration_k(t):
    return H.calibration_k(scores(t), "k")


@query("record_resolution", f"""WITH {SERIES_SQL}, g AS (SELECT k, (t - lag(t) OVER (PARTITION BY k ORDER BY t)) / 3600 AS h FROM series)
SELECT k, quantile_cont(h, 0.5) AS median_step_hours FROM g GROUP BY k""", median_step_hours=7)
def record_resolution(t):
    return H.record_resolution(t.series(), "k", "t")


@query("record_sources", "SELECT source, count(*) AS rows FROM documents GROUP BY source")
def record_sources(t):
    return H.record_sources(t.documents)


@query("basin_lag", f"""WITH {DAILY_SQL},
flow AS (SELECT t, sum(v) AS q FROM daily GROUP BY t),
soil AS (SELECT CAST(epoch(CAST(l_shipdate AS DATE)) AS DOUBLE) AS st, avg(l_discount) AS sv FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey * 10 + l_linenumber AS x, CAST(epoch(l_shipdate) AS DOUBLE) AS p, CAST(epoch(l_shipdate) AS DOUBLE) - 3600 * l_quantity AS s, l_partkey FROM lineitem),
mm AS (SELECT x AS member_id, min(p) AS p, min(s) AS s FROM m GROUP BY x),
b AS (SELECT member_id, p, s, q, t FROM mm JOIN flow ON t BETWEEN p AND p + 604800 QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY q DESC, t) = 1),
a AS (SELECT b.*, soil.st, soil.sv FROM b ASOF LEFT JOIN soil ON b.s >= soil.st)
SELECT member_id, p AS rainfall_peak, t AS discharge_peak, (t - p) / 3600 AS basin_lag_hours, q AS observed_peak_discharge_cfs,
 CASE WHEN s - st <= 86400 THEN sv END AS antecedent_soil_moisture, CAST(month(make_timestamp(CAST(p * 1000000 AS BIGINT))) AS INTEGER) AS month,
 CASE WHEN month(make_timestamp(CAST(p * 1000000 AS BIGINT))) IN (6, 7, 8, 9) THEN 'warm_convective' WHEN month(make_timestamp(CAST(p * 1000000 AS BIGINT))) IN (12, 1, 2, 3) THEN 'cool_frontal' ELSE 'transition' END AS season FROM a""",
       observed_peak_discharge_cfs=2, antecedent_soil_moisture=6)
def basin_lag(t):
    flow = t.daily().groupBy(F.col("t").alias("time")).agg(F.sum("v").alias("discharge_cfs"))
    soil = t.lineitem.groupBy((F.unix_date(F.to_date("l_shipdate")).cast("double") * DAY).alias("time")).agg(F.avg("l_discount").alias("value"))
    m = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member_id")).agg(
        F.min(us(F.col("l_shipdate"))).alias("rainfall_peak_time"), F.min(us(F.col("l_shipdate")) - 3600 * F.col("l_quantity")).alias("storm_start"))
    return H.basin_lag(m, flow, soil)


@query("merge_discharge", """WITH p AS (SELECT l_suppkey AS source_id, CAST(epoch(CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, l_linenumber AS priority, max(l_extendedprice) AS q FROM lineitem GROUP BY ALL)
SELECT source_id, t, q FROM p QUALIFY row_number() OVER (PARTITION BY source_id, t ORDER BY priority DESC) = 1""", q=2)
def merge_discharge(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("source_id"), (F.unix_date(F.to_date("l_shipdate")).cast("double") * DAY).alias("t"),
                           F.col("l_linenumber").alias("priority")).agg(F.max("l_extendedprice").alias("q"))
    return H.merge_discharge(p, "source_id", "priority", "t")


@query("area_weights", """SELECT s_suppkey, s_nationkey, CASE WHEN sum(greatest(s_acctbal, 0)) OVER w > 0 THEN greatest(s_acctbal, 0) / sum(greatest(s_acctbal, 0)) OVER w
 ELSE 1.0 / count(*) OVER w END AS weight FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""", weight=8)
def area_weights(t):
    p = t.supplier.withColumn("uparea", F.greatest(F.col("s_acctbal"), F.lit(0.0)))
    return H.area_weights(p, "s_nationkey").select("s_suppkey", "s_nationkey", "weight")


@query("event_peak_discharge", f"""WITH {DISCHARGE_SQL},
b AS (SELECT event_id, t, sum(q) AS tot, max(q) AS mx FROM q GROUP BY ALL)
SELECT c.event_id, max(tot) AS peak_discharge_m3s, max(mx) AS max_source_peak_discharge_m3s,
 (SELECT count(DISTINCT source_id) FROM q WHERE q.event_id = c.event_id) AS handoff_source_count
FROM (SELECT DISTINCT l_returnflag AS event_id FROM lineitem UNION SELECT DISTINCT l_linestatus FROM lineitem) c LEFT JOIN b USING (event_id) GROUP BY c.event_id""".replace(
    "(SELECT count(DISTINCT source_id) FROM q WHERE q.event_id = c.event_id)", "max(n)").replace("LEFT JOIN b USING (event_id)",
    "LEFT JOIN b USING (event_id) LEFT JOIN (SELECT event_id, count(DISTINCT source_id) AS n FROM q GROUP BY event_id) s USING (event_id)"),
       peak_discharge_m3s=1, max_source_peak_discharge_m3s=2)
def event_peak_discharge(t):
    li = t.lineitem
    c = li.select(F.col("l_returnflag").alias("event_id")).union(li.select("l_linestatus")).distinct()
    return H.event_peak_discharge(c, t.discharge(), time="t")


@query("amplify", f"""WITH {DISCHARGE_SQL}, s AS (SELECT event_id, max(tot) AS p FROM (SELECT event_id, t, sum(q) AS tot FROM q GROUP BY ALL) GROUP BY event_id),
k AS (SELECT event_id, CASE WHEN event_id = 'A' THEN NULL ELSE 900000.0 END AS target, p FROM s)
SELECT q.event_id, q.source_id, q.t, CASE WHEN target IS NULL THEN 1.0 ELSE target / p END AS k_factor,
 CASE WHEN target IS NULL THEN 'no_target' WHEN target / p BETWEEN 0.25 AND 4 THEN 'applied' ELSE 'applied_out_of_band' END AS status,
 q.q * CASE WHEN target IS NULL THEN 1.0 ELSE target / p END AS q_scaled FROM q JOIN k USING (event_id)""", k_factor=8, q_scaled=3)
def amplify(t):
    q = t.discharge()
    peak = H.event_peak_discharge(q.select("event_id").distinct(), q, time="t")
    tg = peak.select("event_id", F.when(F.col("event_id") != "A", 900000.0).alias("target_cms"), F.col("peak_discharge_m3s").alias("simulated_peak_cms"))
    return H.amplify(q, tg).drop("q")


@query("baseflow_check", f"""WITH {DISCHARGE_SQL}, b AS (SELECT quantile_cont(o_totalprice, 0.5) * 0.028316846592 AS b FROM orders),
a AS (SELECT s_suppkey % 12 AS source_id, sum(s_acctbal) AS uparea FROM supplier GROUP BY 1)
SELECT source_id, b * uparea / 400000.0 AS observed_baseflow_cms, min(q) AS simulated_baseflow_cms,
 CASE WHEN min(q) >= 0.25 * b * uparea / 400000.0 THEN 'passed' ELSE 'failed' END AS status
FROM q JOIN a USING (source_id), b WHERE uparea > 0 GROUP BY source_id, b, uparea""", observed_baseflow_cms=4, simulated_baseflow_cms=2)
def baseflow_check(t):
    a = t.supplier.groupBy((F.col("s_suppkey") % 12).alias("source_id")).agg(F.sum("s_acctbal").alias("uparea"))
    return H.baseflow_check(t.discharge(), t.orders.select(F.col("o_totalprice").alias("discharge_cfs")), a, 400000.0)


@query("boundary_qa", f"""WITH {DISCHARGE_SQL},
sp AS (SELECT event_id, max(tot) AS p, min(t) AS a, max(t) AS z FROM (SELECT event_id, t, sum(q) AS tot FROM q GROUP BY ALL) GROUP BY event_id),
f AS (SELECT DISTINCT event_id, source_id FROM q), w AS (SELECT DISTINCT l_returnflag AS event_id, l_partkey % 13 + 1 AS source_id FROM lineitem),
i AS (SELECT coalesce(f.event_id, w.event_id) AS event_id, count_if(f.source_id IS NULL) AS missing_sources, count_if(w.source_id IS NULL) AS stale_sources
  FROM f FULL JOIN w ON f.event_id = w.event_id AND f.source_id = w.source_id GROUP BY 1)
SELECT event_id, p AS peak_m3s, CAST(missing_sources AS BIGINT) AS missing_sources, CAST(stale_sources AS BIGINT) AS stale_sources, CASE WHEN p > 0 THEN 'passed' ELSE 'failed' END AS event_peak,
 CASE WHEN missing_sources = 0 AND stale_sources = 0 THEN 'passed' ELSE 'failed' END AS source_ids,
 CASE WHEN a <= 790000000 AND z >= 1000000000 THEN 'passed' ELSE 'failed' END AS time_coverage FROM sp JOIN i USING (event_id)""", peak_m3s=1)
def boundary_qa(t):
    want = t.lineitem.select(F.col("l_returnflag").alias("event_id"), (F.col("l_partkey") % 13 + 1).alias("source_id")).distinct()
    return H.boundary_qa(t.discharge(), want, (790000000.0, 1000000000.0), time="t")


@query("shape_duplicates", f"""WITH {DISCHARGE_SQL},
d AS (SELECT event_id, t, sum(q) AS q FROM q GROUP BY ALL),
x AS (SELECT d.event_id, d.t, s.i AS source_id, d.q * (1 + s.i) + CASE WHEN s.i % 3 = 2 THEN s.i * 100000 * sin(d.t / 86400.0 * s.i) ELSE 0.0 END AS q FROM d, (SELECT unnest(range(0, 9)) AS i) s)
SELECT a.event_id, a.source_id, b.source_id AS other_source, corr(a.q, b.q) AS correlation FROM x a JOIN x b ON a.event_id = b.event_id AND a.t = b.t AND a.source_id < b.source_id
GROUP BY ALL HAVING corr(a.q, b.q) >= 0.9999""", correlation=5)
def shape_duplicates(t):
    d = t.discharge().groupBy("event_id", "t").agg(F.sum("q").alias("q"))
    i = F.col("source_id")
    x = d.withColumn("source_id", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>"))).withColumn(
        "q", F.col("q") * (1 + i) + F.when(i % 3 == 2, i * 100000 * F.sin(F.col("t") / DAY * i)).otherwise(0.0))
    return H.shape_duplicates(x, time="t")


@query("initial_depth", f"""WITH {DISCHARGE_SQL}, f AS (SELECT event_id, min(t) AS t0 FROM q GROUP BY event_id),
p AS (SELECT q.event_id, q.source_id, avg(q.q) AS m FROM q JOIN f USING (event_id) WHERE t <= t0 + 2400 * 3600 GROUP BY ALL)
SELECT event_id, count(*) AS source_count, avg(m) AS mean_q, sqrt(avg(m) / 20000.0) * 1.5 AS raw_depth_m, least(greatest(sqrt(avg(m) / 20000.0) * 1.5, 0.2), 2.0) AS initial_depth_m FROM p GROUP BY event_id""",
       mean_q=3, raw_depth_m=6, initial_depth_m=6)
def initial_depth(t):
    return H.initial_depth(t.discharge(), 2400, 20000.0, 1.5, 0.2, 2.0, "event_id", time="t")


@query("lookback_summary", f"""WITH {SERIES_SQL}
SELECT o_orderkey AS event_id, avg(v) AS mean_value, min(v) AS min_value, max(v) AS max_value, count(v) AS row_count
FROM orders JOIN series ON t BETWEEN CAST(epoch(o_orderdate) AS DOUBLE) + 915148800.0 - 86400 AND CAST(epoch(o_orderdate) AS DOUBLE) + 915148800.0 GROUP BY o_orderkey""", mean_value=6)
def lookback_summary(t):
    e = t.orders.select(F.col("o_orderkey").alias("event_id"), (us(F.col("o_orderdate")) + 915148800.0).alias("time"))
    return H.lookback_summary(e, t.series(), 24.0, None, "event_id", "time", "t", "v")
