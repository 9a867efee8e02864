"""Source and table normalisers on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import tables as B

from .base import query, us
from .outcomes import XY, points


@query("scan_driver_records", """SELECT 'rain' AS driver, epoch_us(l_shipdate) AS us, max(l_extendedprice) AS value FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_shipdate
UNION ALL SELECT 'surge', epoch_us(ts), value FROM events WHERE event_type IN ('A', 'R', 'click')""")
def scan_driver_records(t):
    specs = {"rain": {"path": f"{t.folder}/lineitem.parquet", "time_column": "l_shipdate", "value_column": "l_extendedprice", "group_column": "l_returnflag", "aggregate": "max"},
             "surge": {"path": f"{t.folder}/events.parquet", "time_column": "ts", "value_column": "value", "group_column": "event_type"}}
    return R.scan_driver_records(t.spark, specs, ["A", "R", "click"]).select("driver", F.unix_micros("time").alias("us"), "value")


@query("flatten_tracks")
def flatten_tracks(t):
    """Track text rendered from orders (one storm per customer), parsed back to points."""
    o = t.orders.select("o_custkey", "o_orderkey", F.concat_ws(", ", F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 24 * 100).cast("string"), 4, "0"), F.lit(""), F.lit("HU"),
                                                 F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit(".5N")), F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(".0W")), (F.col("o_orderkey") % 120).cast("string")).alias("value"))
    head = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("o_custkey", F.lit(-1).cast("bigint").alias("o_orderkey"), F.concat(
        F.lit("AL"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(", NAME, "), F.col("n")).alias("value"))
    return R.flatten_tracks(o.unionByName(head), "o_custkey", "o_orderkey")


@query("merge_incremental", """WITH c AS (SELECT l_suppkey AS site_no, l_orderkey AS x FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 = 0), f AS (SELECT l_suppkey AS site_no, l_orderkey AS x FROM lineitem WHERE l_returnflag = 'R'), w AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT * FROM c WHERE site_no IN (SELECT s_suppkey FROM w) UNION ALL SELECT * FROM f WHERE site_no IN (SELECT s_suppkey FROM w) AND site_no NOT IN (SELECT site_no FROM c)""")
def merge_incremental(t):
    li = t.lineitem.select(F.col("l_suppkey").alias("site_no"), F.col("l_orderkey").alias("x"), "l_returnflag")
    c = li.where("l_returnflag = 'A' and site_no % 3 = 0").drop("l_returnflag")
    return R.merge_incremental(c, li.where("l_returnflag = 'R'").drop("l_returnflag"), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("site_no")))


GS_SQL = """g AS (SELECT o_custkey AS site_no, CASE WHEN o_orderstatus = 'P' THEN 'inactive' ELSE 'Active' END AS status, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) AS b, o_orderkey % 400 AS n, o_orderkey AS rid FROM orders)"""


def gauge_series(t):
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("site_no"), k.alias("row_id"), F.col("c_name").alias("site_name"), F.when(F.col("o_orderstatus") == "P", "inactive").otherwise("Active").alias("status"),
                           F.col("c_acctbal").alias("drainage_area_sqmi"), (k * 1.0).alias("latitude"), (k * 2.0).alias("longitude"), d.alias("period_start"), F.date_add(d, (k % 900).cast("int")).alias("period_end"), (k % 400).alias("count_nu"), F.lit("00060").alias("parameter_cd"))


@query("rollup_gauges", f"""WITH {GS_SQL}, r AS (SELECT site_no, min(a) AS a, max(b) AS b, sum(n) AS n, min(rid) AS rid FROM g WHERE lower(status) = 'active' GROUP BY 1)
SELECT site_no, c_name AS site_name, strftime(a, '%Y-%m-%d') AS period_start, round(greatest(b - a, 0) / 365.25, 2) AS record_years, round(least(n / CAST(b - a + 1 AS DOUBLE), 1), 3) AS completeness_score, CAST(rid AS DOUBLE) AS latitude FROM r JOIN customer ON c_custkey = site_no""")
def rollup_gauges(t):
    return B.rollup_gauges(gauge_series(t)).select("site_no", "site_name", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "record_years", "completeness_score", "latitude")


@query("assign_gauge_roles", """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS site_no, c_mktsegment AS nm, c_acctbal / 100 AS yrs, c_custkey FROM customer), h AS (SELECT CAST(s_suppkey * 7 AS VARCHAR) AS site_no FROM supplier)
SELECT site_no, CASE WHEN c_custkey % 1000 = 5 THEN 'override' WHEN nm LIKE '%BUILD%' THEN 'north' WHEN nm LIKE '%MACH%' OR site_no IN ('3', '4') THEN 'south' ELSE 'review_required' END AS basin,
 CASE WHEN c_custkey % 1000 = 5 THEN 'validation' WHEN site_no IN (SELECT site_no FROM h) THEN 'frequency,calibration,validation,handoff' WHEN nm LIKE '%FURN%' THEN 'validation' WHEN yrs >= 50 THEN 'frequency,validation' ELSE 'calibration,validation' END AS roles,
 CASE WHEN c_custkey % 1000 = 5 THEN 'rejected' ELSE 'accepted_with_warning' END AS review_status FROM c""")
def assign_gauge_roles(t):
    g = t.customer.select(F.col("c_custkey").cast("string").alias("site_no"), F.col("c_mktsegment").alias("site_name"), (F.col("c_acctbal") / 100).alias("record_years"))
    rules = t.spark.createDataFrame([(1, [], "build", "north"), (2, ["3", "4"], "mach", "south")], "rule_order int, site_nos array<string>, contains string, basin string")
    h = t.supplier.select((F.col("s_suppkey") * 7).cast("string").alias("site_no"), F.concat(F.lit("h"), F.col("s_suppkey")).alias("handoff_id"))
    o = t.customer.where("c_custkey % 1000 = 5").select(F.col("c_custkey").cast("string").alias("site_no"), F.lit("rejected").alias("review_status"), F.lit("validation").alias("roles"), F.lit("override").alias("basin"))
    return B.assign_gauge_roles(g, rules, h, o, ["furn"]).select("site_no", "basin", "roles", "review_status")


@query("assign_region", """SELECT c_custkey AS site_no, CASE WHEN x > y AND x < 10000 AND y >= 0 AND y < 10000 AND (x - y) > 0 THEN 'lower' WHEN y > x AND y < 10000 AND x >= 0 AND x < 10000 THEN 'upper' END AS region_id
FROM (SELECT c_custkey, c_custkey * 7919 % 10007 + 0.25 AS x, c_custkey * 104729 % 10009 + 0.5 AS y FROM customer)""")
def assign_region(t):
    p = points(t.customer, "c_custkey", "site_no", "longitude", "latitude").withColumn("longitude", F.col("longitude") + 0.25).withColumn("latitude", F.col("latitude") + 0.5)
    v = "array<struct<x:double,y:double>>"
    poly = t.spark.createDataFrame([(1, "lower", [(0.0, 0.0), (10000.0, 0.0), (10000.0, 10000.0)]), (2, "upper", [(0.0, 0.0), (10000.0, 10000.0), (0.0, 10000.0)])], f"level int, region_id string, vertices {v}")
    return B.assign_region(p, poly).drop("level")


@query("accepted_gauges", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def accepted_gauges(t):
    g = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("inactive").alias("status"),
                        F.when(F.col("o_orderpriority") == "1-URGENT", "Accepted").when(F.col("o_orderpriority") == "2-HIGH", "accepted_with_warning").otherwise("rejected").alias("review_status"))
    return B.accepted_gauges(g).select("o_orderkey")


@query("drop_overlapping_sites", f"""WITH s AS (SELECT c_custkey, c_mktsegment, {XY.format(k='c_custkey', x='x', y='y')} FROM customer), p AS (SELECT {XY.format(k='(p_partkey * 3 + 1)', x='px', y='py')} FROM part)
SELECT c_custkey AS site_no FROM s WHERE c_mktsegment <> 'MACHINERY' AND NOT EXISTS (SELECT 1 FROM p WHERE sqrt((x - px) ** 2 + (y - py) ** 2) <= 150)""")
def drop_overlapping_sites(t):
    s = points(t.customer, "c_custkey", "site_no", "x", "y", F.col("c_mktsegment").alias("agency"))
    p = points(t.part.withColumn("k", F.col("p_partkey") * 3 + 1), "k", "pk")
    return B.drop_overlapping_sites(s, p, 150.0, ["machinery"]).select("site_no")


@query("quadrant_coverage", f"""WITH s AS (SELECT s_name, {XY.format(k='s_suppkey', x='x', y='y')} FROM supplier)
SELECT count(*) AS flow_sites_in_region, CAST(count_if(x < 5000 AND y > 5000) AS BIGINT) AS northwest_flow_sites, string_agg(s_name, ', ' ORDER BY s_name) FILTER (x < 5000 AND y > 5000) AS northwest_site_names FROM s""")
def quadrant_coverage(t):
    return B.quadrant_coverage(points(t.supplier, "s_suppkey", "k", "x", "y", F.col("s_name").alias("site_name")), (0.0, 0.0, 10000.0, 10000.0))


SOIL_SQL = "sl AS (SELECT CAST(epoch(l_shipdate) AS DOUBLE) AS \"time\", l_suppkey AS point_id, l_linenumber AS layer, avg(l_quantity) / 40 AS m FROM lineitem GROUP BY ALL)"


def soil(t):
    return t.lineitem.groupBy(us(F.col("l_shipdate")).alias("time"), F.col("l_suppkey").alias("point_id"), F.col("l_linenumber").alias("soil_layers_stag")).agg((F.avg("l_quantity") / 40).alias("SOIL_M"))


@query("derive_top_saturation", f"""WITH {SOIL_SQL}, tp AS (SELECT "time", point_id, least(greatest(avg(m), 0), 1) AS s FROM sl WHERE layer IN (1, 2) GROUP BY ALL)
SELECT sl."time", sl.point_id, layer AS soil_layers_stag, s AS "SOILSAT_TOP" FROM sl LEFT JOIN tp ON tp."time" = sl."time" AND tp.point_id = sl.point_id""", SOILSAT_TOP=7)
def derive_top_saturation(t):
    return B.derive_top_saturation(soil(t), (1, 2)).drop("SOIL_M")


@query("aggregate_soil_points", f"""WITH {SOIL_SQL} SELECT "time", avg(m) AS soil_moisture_mean, min(m) AS soil_moisture_min, max(m) AS soil_moisture_max, count(DISTINCT point_id) AS point_count, count(DISTINCT layer) AS layer_count FROM sl GROUP BY "time" """,
       soil_moisture_mean=9, soil_moisture_min=9, soil_moisture_max=9)
def aggregate_soil_points(t):
    return B.aggregate_soil_points(soil(t), "time", "SOIL_M")


@query("sample_grid", f"""WITH p AS (SELECT s_suppkey AS point_id, {XY.format(k='(s_suppkey * 17 + 3)', x='x', y='y')} FROM supplier), c AS (SELECT c_custkey AS cell, {XY.format(k='c_custkey', x='cx', y='cy')} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')),
n AS (SELECT point_id, cell, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS distance FROM p, c QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, cell) = 1)
SELECT point_id, cell, distance, CAST(epoch(o_orderdate) AS DOUBLE) AS "time", CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS value FROM n JOIN orders ON o_custkey = cell""", distance=5)
def sample_grid(t):
    p = points(t.supplier.withColumn("k", F.col("s_suppkey") * 17 + 3), "k", "pk", "x", "y", F.col("s_suppkey").alias("point_id")).drop("pk")
    c = points(t.orders, "o_custkey", "cell", "cx", "cy", us(F.col("o_orderdate")).alias("time"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))
    return B.sample_grid(p, c, 200.0)


RES_SQL = """r AS (SELECT o_custkey % 100 AS slug, CAST(o_orderdate AS DATE) AS d, o_totalprice / 100 AS surface_area, o_totalprice * (o_orderkey % 9) / 10 AS reservoir_storage, CAST(o_orderkey % 100 AS DOUBLE) AS percent_full FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
su AS (SELECT slug, count(*) AS condition_rows, quantile_cont(surface_area, 0.5) AS sa, quantile_cont(reservoir_storage, 0.5) AS rs, quantile_cont(percent_full, 0.5) AS percent_full FROM r GROUP BY slug)"""


def reservoirs(t):
    h = t.orders.select((F.col("o_custkey") % 100).alias("slug"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 100).alias("surface_area"),
                        (F.col("o_totalprice") * (F.col("o_orderkey") % 9) / 10).alias("reservoir_storage"), (F.col("o_orderkey") % 100).cast("double").alias("percent_full"))
    return B.summarize_reservoirs(h, "median", "1996-01-01", "2000-12-31")


@query("summarize_reservoirs", f"WITH {RES_SQL} SELECT slug, condition_rows, percent_full, sa * 4046.8564224 AS \"Area_avg\", rs * 1233.48183754752 AS \"Vol_avg\", (rs * 1233.48183754752) / (sa * 4046.8564224) AS \"Depth_avg\" FROM su", percent_full=3, Area_avg=1, Vol_avg=1, Depth_avg=6)
def summarize_reservoirs(t):
    return reservoirs(t).select("slug", "condition_rows", "percent_full", "Area_avg", "Vol_avg", "Depth_avg")


@query("apply_reservoir_summary", f"""WITH {RES_SQL}, w AS (SELECT s_suppkey AS waterbody_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Lake ' ELSE '' END || s_name AS nm, s_suppkey * 2 AS slug FROM supplier)
SELECT waterbody_id, CASE WHEN su.slug IS NULL THEN 7.0 ELSE CASE WHEN sa > 0 THEN sa * 4046.8564224 ELSE 7.0 END END AS "Area_avg", CASE WHEN su.slug IS NULL THEN 2.0 ELSE least(greatest((rs * 1233.48183754752) / (sa * 4046.8564224), 0.25), 200.0) END AS "Depth_avg",
 CASE WHEN su.slug IS NULL THEN 'review_required_missing_condition_bootstrap' ELSE 'review_required_storage_no_control_outflow_fallback' END AS review_status FROM w LEFT JOIN su USING (slug)""", Area_avg=1, Depth_avg=6)
def apply_reservoir_summary(t):
    k = F.col("s_suppkey")
    w = t.supplier.select(k.alias("waterbody_id"), F.concat(F.when(k % 3 == 0, "Lake ").otherwise(""), F.col("s_name")).alias("waterbody_name"), F.lit(7.0).alias("Area_avg"), F.lit(14.0).alias("Vol_avg"), F.lit(2.0).alias("Depth_avg"))
    names = t.supplier.select(F.col("s_name").alias("name"), (k * 2).alias("slug"))
    return B.apply_reservoir_summary(w, reservoirs(t), names).select("waterbody_id", "Area_avg", "Depth_avg", "review_status")


@query("check_coverage", "SELECT epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS rows, min(ts) <= TIMESTAMP '2024-01-02' AND max(ts) >= TIMESTAMP '2024-01-20' AS covers FROM events")
def check_coverage(t):
    c = R.check_coverage(t.events, "ts", "2024-01-02", "2024-01-20", ["value"])
    return c.select(F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "rows", "covers")


@query("window_readiness", """WITH w AS (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS a, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS b FROM lineitem GROUP BY 1)
SELECT o_orderkey AS event_id, CASE WHEN n IS NULL THEN 'missing' WHEN a > 0 AND b > 0 THEN 'ready' ELSE 'incomplete' END AS window_status FROM orders LEFT JOIN w ON l_orderkey = o_orderkey""")
def window_readiness(t):
    w = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") != "N", F.col("l_tax")).otherwise(F.lit(float("nan"))).alias("precip"), F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("temp"))
    return B.window_readiness(t.orders.select(F.col("o_orderkey").alias("event_id")), w, ["precip", "temp"])


@query("normalise_members", """WITH d AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_orderdate END AS tm, CASE WHEN o_custkey % 3 = 0 THEN 'p' || o_custkey END AS pt, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
SELECT o_orderkey AS row_id, 'soil' AS source, CASE WHEN pt IS NOT NULL AND tm IS NOT NULL THEN pt || '_' || strftime(tm, '%Y%m%dT%H%M%S') WHEN tm IS NOT NULL THEN 'soil_' || strftime(tm, '%Y%m%dT%H%M%S') ELSE 'soil_' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END END AS member_id FROM d""")
def normalise_members(t):
    k = F.col("o_custkey")
    d = t.orders.select(F.col("o_orderkey").alias("row_id"), F.when(k % 4 != 0, F.col("o_orderdate").cast("timestamp")).alias("time"), F.when(k % 3 == 0, F.concat(F.lit("p"), k)).alias("point_id"))
    return B.normalise_members(d, "soil").select("row_id", "source", "member_id")


@query("gauge_roles", """SELECT role, count(*) AS gauges FROM (SELECT trim(unnest(string_split(CASE WHEN c_custkey % 2 = 0 THEN 'frequency, ' || c_mktsegment ELSE c_mktsegment || ',' END, ','))) AS role FROM customer) WHERE role <> '' GROUP BY role""")
def gauge_roles(t):
    return B.gauge_roles(t.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("frequency, "), F.col("c_mktsegment"))).otherwise(F.concat(F.col("c_mktsegment"), F.lit(","))).alias("roles")))


@query("gauges_by_domain", f"""WITH g AS (SELECT c_custkey, {XY.format(k='c_custkey', x='x', y='y')} FROM customer) SELECT n_nationkey AS domain_id, c_custkey AS site_no FROM g, nation WHERE x BETWEEN n_nationkey % 5 * 2000 AND n_nationkey % 5 * 2000 + 1500 AND y BETWEEN n_nationkey // 5 * 2000 AND n_nationkey // 5 * 2000 + 1500""")
def gauges_by_domain(t):
    n = F.col("n_nationkey")
    g = points(t.customer, "c_custkey", "site_no", "longitude", "latitude").withColumn("domain_id", F.lit(-1))
    boxes = t.nation.select(n.alias("domain_id"), (n % 5 * 2000.0).alias("xmin"), (F.floor(n / 5) * 2000.0).alias("ymin"), (n % 5 * 2000.0 + 1500).alias("xmax"), (F.floor(n / 5) * 2000.0 + 1500).alias("ymax"))
    return B.gauges_by_domain(g, boxes)


@query("source_readiness", """WITH m AS (SELECT CAST(n_nationkey AS VARCHAR) AS source, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey * 1.0 END AS a, 30.0 - n_nationkey % 4 AS z FROM nation), k AS (SELECT CAST(s_nationkey AS VARCHAR) AS source FROM supplier WHERE s_acctbal > 5000)
SELECT source, 'window_not_declared' AS issue, CAST(NULL AS DOUBLE) AS share FROM m WHERE a IS NULL UNION ALL SELECT source, 'window_not_covered', NULL FROM m WHERE a > 20 OR z < 28 UNION ALL SELECT source, 'no_member_rows', NULL FROM m WHERE source NOT IN (SELECT source FROM k)
UNION ALL SELECT 'catalogue', 'paired_share', avg(CASE WHEN o_orderpriority <> '5-LOW' AND o_custkey % 9 <> 0 THEN 1.0 ELSE 0 END) FROM orders""", share=8)
def source_readiness(t):
    n = F.col("n_nationkey")
    m = t.nation.select(n.cast("string").alias("source"), F.when(n % 7 != 0, n * 1.0).alias("start"), (30.0 - n % 4).alias("end"))
    c = t.orders.select(F.when(F.col("o_orderpriority") != "5-LOW", "f").otherwise("").alias("member_file"), F.when(F.col("o_custkey") % 9 != 0, "id").alias("member_id"))
    return B.source_readiness(m, 20.0, 28.0, t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("source")), c, ["member_file", "member_id"])


@query("unpivot_gauges", """WITH w AS (SELECT CAST(epoch(CAST(o_orderdate AS DATE)) AS DOUBLE) AS "time", sum(o_totalprice) FILTER (o_orderstatus = 'F') AS a, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS b, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS c FROM orders GROUP BY 1)
SELECT "time", CAST(r_regionkey AS BIGINT) AS gauge_index, r_name AS gauge, CASE r_regionkey WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS q FROM w, region WHERE r_regionkey BETWEEN 1 AND 3""", q=2)
def unpivot_gauges(t):
    s = lambda x: F.sum(F.when(F.col("o_orderstatus") == x, F.col("o_totalprice")))
    w = t.orders.groupBy((F.unix_date(F.to_date("o_orderdate")).cast("double") * 86400.0).alias("time")).agg(s("F").alias("Q_1"), s("O").alias("Q_gauges_2"), s("P").alias("river_q_3"))
    return B.unpivot_gauges(w, t.region.select(F.col("r_regionkey").cast("bigint").alias("gauge_index"), F.col("r_name").alias("gauge")))
