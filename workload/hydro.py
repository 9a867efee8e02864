"""River, soil and location operators on `customer`, `part`, `lineitem` and `supplier`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hydro as Y

from .base import query
from .outcomes import XY, points


@query("upstream", """WITH RECURSIVE n AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS p, c_mktsegment = 'BUILDING' AS o FROM customer),
w AS (SELECT k, k AS cur FROM n UNION SELECT w.k, n.p FROM w JOIN n ON n.k = w.cur WHERE n.p IS NOT NULL)
SELECT w.k AS hydroseq, cur AS outlet FROM w JOIN n ON n.k = cur WHERE n.o""")
def upstream(t):
    k = F.col("c_custkey")
    r = t.customer.select(k.alias("hydroseq"), F.when(k > 0, F.floor(k / 2)).alias("dnhydroseq"))
    return Y.upstream(r, t.customer.where("c_mktsegment = 'BUILDING'").select(k.alias("outlet")))


@query("area_match", """WITH a AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN abs(p_retailprice - p_size * 30.0) / (p_size * 30.0) * 100 END AS area_difference_pct FROM part)
SELECT p_partkey, area_difference_pct, CASE WHEN area_difference_pct IS NULL THEN 'missing_reviewed_area' WHEN area_difference_pct > 50 THEN 'review_required_area_mismatch' ELSE 'within_review_tolerance' END AS area_match_status FROM a""", area_difference_pct=6)
def area_match(t):
    d = t.part.select("p_partkey", "p_retailprice", F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 30.0).alias("reviewed"))
    return Y.area_match(d, "p_retailprice", "reviewed").select("p_partkey", "area_difference_pct", "area_match_status")


HOR_SQL = """h AS (SELECT l_partkey % 500 AS mukey, CASE l_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B/D' WHEN 2 THEN 'x' WHEN 3 THEN 'C' WHEN 4 THEN NULL ELSE 'd' END AS hydgrp, l_extendedprice / 10000 AS ksat,
  CAST((l_linenumber - 1) * 12 AS DOUBLE) AS a, (l_linenumber - 1) * 12 + l_quantity AS b, l_quantity AS q, l_discount * 10 AS om, l_tax * 50 AS ph, l_extendedprice / 1000 AS cl FROM lineitem)"""


def horizons(t):
    s = F.col("l_suppkey") % 6
    g = F.when(s == 0, "A").when(s == 1, "B/D").when(s == 2, "x").when(s == 3, "C").when(s == 5, "d")
    top = ((F.col("l_linenumber") - 1) * 12).cast("double")
    return t.lineitem.select((F.col("l_partkey") % 500).alias("mukey"), g.alias("hydgrp"), (F.col("l_extendedprice") / 10000).alias("ksat_r"), top.alias("hzdept_r"), (top + F.col("l_quantity")).alias("hzdepb_r"),
                             F.col("l_quantity").alias("dbthirdbar_r"), (F.col("l_discount") * 10).alias("om_r"), (F.col("l_tax") * 50).alias("ph1to1h2o_r"),
                             (F.col("l_extendedprice") / 1000).alias("claytotal_r"), (F.col("l_extendedprice") / 1000).alias("silttotal_r"), (F.col("l_extendedprice") / 1000).alias("sandtotal_r"))


@query("soil_infiltration", f"""WITH {HOR_SQL}, g AS (SELECT *, CASE hydgrp WHEN 'A' THEN 'A' WHEN 'B/D' THEN 'D' WHEN 'C' THEN 'C' WHEN 'd' THEN 'D' END AS g, greatest(least(b, 40) - least(a, 40), 0) AS th FROM h)
SELECT mukey, arg_min(g, (a, g)) FILTER (g IS NOT NULL) AS hsg, sum(th) FILTER (th > 0) / sum(th / ksat) FILTER (th > 0) * 3.6 AS ksat_mmhr FROM g GROUP BY mukey""", ksat_mmhr=6)
def soil_infiltration(t):
    return Y.soil_infiltration(horizons(t)).drop("hsg_code")


@query("soil_layers", f"""WITH {HOR_SQL}, m AS (SELECT mukey, max(b) AS mx FROM h GROUP BY 1), d AS (SELECT * FROM (VALUES (1, 0.0), (2, 5.0), (3, 15.0), (4, 30.0), (5, 60.0), (6, 100.0), (7, 200.0)) AS d(i, d)),
r AS (SELECT h.*, mx, i, d, CASE WHEN a <= d AND b > d THEN 0 WHEN d >= mx AND b >= d THEN 1 ELSE 2 END AS r FROM h JOIN m USING (mukey), d),
p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY mukey, i ORDER BY r, CASE WHEN r = 2 THEN abs(a - d) ELSE 0 END, a, q, om, ph, cl) = 1)
SELECT mukey, least(200.0, max(mx)) AS soilthickness, max(q) FILTER (i = 1) AS bd_sl1, max(om) FILTER (i = 3) / 1.724 AS oc_sl3, max(ph) FILTER (i = 5) AS ph_sl5, max(cl) FILTER (i = 7) AS clyppt_sl7, max(cl) FILTER (i = 4) AS sndppt_sl4 FROM p GROUP BY mukey""",
       oc_sl3=6, ph_sl5=6, clyppt_sl7=6, sndppt_sl4=6)
def soil_layers(t):
    return Y.soil_layers(horizons(t)).select("mukey", "soilthickness", "bd_sl1", "oc_sl3", "ph_sl5", "clyppt_sl7", "sndppt_sl4")


@query("enrich_rivers", """SELECT c_custkey AS river_id, coalesce(p_size * 1.5, 12.0) AS rivwth, p_retailprice / 400 AS rivdph, CASE WHEN p_partkey IS NULL THEN 'fallback' ELSE 'measured' END AS rivwth_source
FROM customer LEFT JOIN part ON p_partkey = c_custkey * 3 % 4000""", rivdph=6)
def enrich_rivers(t):
    r = t.customer.select(F.col("c_custkey").alias("river_id"), (F.col("c_custkey") * 3 % 4000).alias("comid"), F.lit(12.0).alias("default_width_m"))
    g = t.part.select(F.col("p_partkey").alias("comid"), F.col("p_partkey").alias("row_id"), (F.col("p_size") * 1.5).alias("width_m"), (F.col("p_retailprice") / 400).alias("depth_m"))
    return Y.enrich_rivers(r, g).select("river_id", "rivwth", "rivdph", "rivwth_source")


@query("transfer_attributes", """WITH r AS (SELECT c_custkey AS id, (c_nationkey % 6) * 2.0 AS o, log10(greatest(abs(c_acctbal), 1e-6)) AS a, log10(greatest(c_custkey % 37 + 1.0, 1e-6)) AS l FROM customer),
m AS (SELECT p_partkey AS id, (p_size % 6) * 2.0 AS o, log10(greatest(p_retailprice * (p_partkey % 13), 1e-6)) AS a, log10(greatest(p_partkey % 41 + 1.0, 1e-6)) AS l, p_size * 1.0 AS w, p_retailprice / 400 AS d FROM part),
n AS (SELECT r.id, m.w, m.d, row_number() OVER (PARTITION BY r.id ORDER BY sqrt((r.a - m.a) ** 2 + (r.o - m.o) ** 2 + (r.l - m.l) ** 2), m.id) AS rn FROM r, m)
SELECT id AS river_id, quantile_cont(w, 0.5) AS width_m, quantile_cont(d, 0.5) AS depth_m FROM n WHERE rn <= 5 GROUP BY id""", width_m=4, depth_m=5)
def transfer_attributes(t):
    k, p = F.col("c_custkey"), F.col("p_partkey")
    r = t.customer.select(k.alias("river_id"), (F.col("c_nationkey") % 6).alias("order"), F.abs("c_acctbal").alias("area"), (k % 37 + 1.0).alias("length"))
    m = t.part.select(p.alias("ref_id"), (F.col("p_size") % 6).alias("order"), (F.col("p_retailprice") * (p % 13)).alias("area"), (p % 41 + 1.0).alias("length"),
                      F.col("p_size").cast("double").alias("width_m"), (F.col("p_retailprice") / 400).alias("depth_m"))
    return Y.transfer_attributes(r, m).drop("farthest")


@query("nearest_flowline", f"""WITH p AS (SELECT s_suppkey AS point_id, {XY.format(k='(s_suppkey * 13 + 5)', x='px', y='py')} FROM supplier), s AS (SELECT c_custkey AS line_id, {XY.format(k='c_custkey', x='x1', y='y1')}, c_custkey * 7919 % 10007 + 120.0 AS x2, c_custkey * 104729 % 10009 + 70.0 AS y2 FROM customer),
t AS (SELECT *, least(greatest(((px - x1) * 120.0 + (py - y1) * 70.0) / (120.0 * 120.0 + 70.0 * 70.0), 0), 1) AS t FROM p, s), d AS (SELECT point_id, line_id, sqrt((px - x1 - t * 120.0) ** 2 + (py - y1 - t * 70.0) ** 2) AS distance FROM t)
SELECT point_id, line_id, distance FROM d WHERE distance <= 250 QUALIFY rank() OVER (PARTITION BY point_id ORDER BY round(distance, 9)) = 1""", distance=5)
def nearest_flowline(t):
    p = points(t.supplier.withColumn("k", F.col("s_suppkey") * 13 + 5), "k", "pk", "x", "y", F.col("s_suppkey").alias("point_id")).drop("pk")
    s = points(t.customer, "c_custkey", "line_id", "x1", "y1").withColumn("x2", F.col("x1") + 120.0).withColumn("y2", F.col("y1") + 70.0)
    return Y.nearest_flowline(p, s, 250.0)


@query("waterbodies", f"""WITH w AS (SELECT p_partkey AS id, p_size / 10.0 AS km2, {XY.format(k='p_partkey', x='x', y='y')} FROM part WHERE p_type LIKE 'E%' AND p_size / 10.0 >= 1), r AS (SELECT c_custkey AS rid, {XY.format(k='c_custkey', x='rx', y='ry')}, c_acctbal AS q FROM customer),
n AS (SELECT id, q FROM w JOIN r ON sqrt((x - rx) ** 2 + (y - ry) ** 2) <= 400 QUALIFY row_number() OVER (PARTITION BY id ORDER BY (x - rx) ** 2 + (y - ry) ** 2, rid) = 1)
SELECT id AS nhdplusid, row_number() OVER (ORDER BY km2 DESC, id) AS waterbody_id, km2 * 1e6 AS "Area_avg", km2 * 1e6 * 3 AS "Vol_avg", greatest(coalesce(q, 1.0), 1.0) AS "Dis_avg" FROM w LEFT JOIN n USING (id)""", Area_avg=1, Vol_avg=1, Dis_avg=3)
def waterbodies(t):
    w = points(t.part.where("p_type like 'E%'"), "p_partkey", "nhdplusid", "x", "y", (F.col("p_size") / 10.0).alias("areasqkm"), F.lit(390).alias("ftype"))
    r = points(t.customer, "c_custkey", "river_id", "x", "y", F.col("c_acctbal").alias("qbankfull"))
    return Y.waterbodies(w, r, limit=400.0).select("nhdplusid", "waterbody_id", "Area_avg", "Vol_avg", "Dis_avg")


@query("river_formulas", """SELECT p_partkey, greatest(10, 5 + 2.5 * sqrt(a)) AS rivwth, greatest(1, 2 * pow(a, 0.8)) AS qbankfull FROM (SELECT p_partkey, greatest(coalesce(CASE WHEN p_size > 5 THEN p_size - 8.0 END, 100.0), 1.0) AS a FROM part)""", rivwth=6, qbankfull=6)
def river_formulas(t):
    return Y.river_formulas(t.part.select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size") - 8.0).alias("totdasqkm"))).drop("totdasqkm")


def crossing_sql(c, p, q, r0, r1, lo, hi, vertical):
    xy = f"{c} AS px, {r0} + t * ({r1} - {r0}) AS py" if vertical else f"{r0} + t * ({r1} - {r0}) AS px, {c} AS py"
    return f"""SELECT box_id, line_id, uparea, round(px, 6) + 0.0 AS x, round(py, 6) + 0.0 AS y FROM (SELECT *, {xy} FROM (SELECT *, ({c} - s.{p}) / nullif(s.{q} - s.{p}, 0) AS t FROM seg))
      WHERE t BETWEEN 0 AND 1 AND {"py" if vertical else "px"} BETWEEN {lo} AND {hi}"""


INFLOW_SQL = f"""WITH l AS (SELECT c_custkey AS line_id, abs(c_acctbal) AS uparea, CAST(c_custkey * 7919 % 10007 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 10009 AS DOUBLE) AS y FROM customer WHERE abs(c_acctbal) >= 1000),
b AS (SELECT n_nationkey AS box_id, n_nationkey % 5 * 2000.0 AS xmin, n_nationkey // 5 * 2000.0 AS ymin, n_nationkey % 5 * 2000.0 + 1500 AS xmax, n_nationkey // 5 * 2000.0 + 1500 AS ymax FROM nation),
e AS (SELECT * FROM l JOIN b ON x + 500 BETWEEN xmin AND xmax AND y + 900 BETWEEN ymin AND ymax),
seg AS (SELECT box_id, line_id, uparea, xmin, xmax, ymin, ymax, unnest([struct_pack(ax := x, ay := y, bx := x + 300, "by" := y + 50), struct_pack(ax := x + 300, ay := y + 50, bx := x + 450, "by" := y + 400),
  struct_pack(ax := x + 450, ay := y + 400, bx := x + 500, "by" := y + 900)]) AS s FROM e),
hit AS ({crossing_sql("xmin", "ax", "bx", "s.ay", 's."by"', "ymin", "ymax", True)} UNION {crossing_sql("xmax", "ax", "bx", "s.ay", 's."by"', "ymin", "ymax", True)}
  UNION {crossing_sql("ymin", "ay", '"by"', "s.ax", "s.bx", "xmin", "xmax", False)} UNION {crossing_sql("ymax", "ay", '"by"', "s.ax", "s.bx", "xmin", "xmax", False)})
SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY uparea DESC, line_id, x, y) AS crossing_rank FROM hit"""


@query("inflow_crossings", INFLOW_SQL, x=6, y=6)
def inflow_crossings(t):
    """Customer polylines of four vertices against one box per nation."""
    k = F.col("c_custkey")
    x, y = (k * 7919 % 10007).cast("double"), (k * 104729 % 10009).cast("double")
    v = F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (300, 50), (450, 400), (500, 900))])
    lines = t.customer.select(k.alias("line_id"), v.alias("vertices"), F.abs("c_acctbal").alias("uparea"))
    n = F.col("n_nationkey")
    boxes = t.nation.select(n.alias("box_id"), (n % 5 * 2000.0).alias("xmin"), (F.floor(n / 5) * 2000.0).alias("ymin"), (n % 5 * 2000.0 + 1500).alias("xmax"), (F.floor(n / 5) * 2000.0 + 1500).alias("ymax"))
    return Y.inflow_crossings(lines, boxes, 1000.0)


@query("gauge_distance_qa", """WITH s AS (SELECT s_suppkey AS h, s_suppkey * 10.0 AS x, s_nationkey * 10.0 AS y, CASE WHEN s_nationkey % 2 = 0 THEN 900.0 ELSE 300.0 END AS l FROM supplier WHERE s_suppkey % 2 = 0 OR s_nationkey > 8),
g AS (SELECT s_suppkey AS h, s_suppkey * 10.0 + s_acctbal / 10 AS x, s_nationkey * 10.0 AS y FROM supplier WHERE s_nationkey < 20)
SELECT coalesce(s.h, g.h) AS handoff_id, CASE WHEN s.h IS NOT NULL AND g.h IS NOT NULL THEN sqrt((s.x - g.x) ** 2 + (s.y - g.y) ** 2) END AS distance_m, l AS limit_m, CASE WHEN g.h IS NULL THEN 'missing' WHEN s.h IS NULL THEN 'stale' WHEN sqrt((s.x - g.x) ** 2) > l THEN 'too_far' ELSE 'passed' END AS status FROM s FULL JOIN g ON s.h = g.h""", distance_m=5, limit_m=1)
def gauge_distance_qa(t):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = t.supplier.where((k % 2 == 0) | (n > 8)).select(k.alias("handoff_id"), (k * 10.0).alias("x"), (n * 10.0).alias("y"), F.when(n % 2 == 0, "reservoir_boundary_inflow").otherwise("river").alias("placement"))
    g = t.supplier.where(n < 20).select(k.alias("handoff_id"), (k * 10.0 + F.col("s_acctbal") / 10).alias("x"), (n * 10.0).alias("y"))
    return Y.gauge_distance_qa(s, g, 300.0, 900.0)


@query("condition_cells", "SELECT p_partkey, p_retailprice * 1.5 > 1550 AS capped, least(p_retailprice * 1.5, 1550.0) AS ksat_conditioned, least(greatest(p_size / 40.0, 0), 1) * 120 AS storage FROM part", ksat_conditioned=4, storage=5)
def condition_cells(t):
    c = t.part.select("p_partkey", F.col("p_retailprice").alias("ksat"), (F.col("p_size") / 40.0).alias("theta"))
    return Y.condition_cells(c, 1.5, 1550.0, 120.0).drop("ksat", "theta")


@query("cap_share", """SELECT p_brand, count(*) AS positive_cells, avg(CASE WHEN p_retailprice * 1.5 >= 1550 THEN 1.0 ELSE 0 END) AS cap_fraction, CASE WHEN avg(CASE WHEN p_retailprice * 1.5 >= 1550 THEN 1.0 ELSE 0 END) > 0.5 THEN 'ksat_cap_fraction_high' ELSE 'ok' END AS status FROM part GROUP BY p_brand""", cap_fraction=8)
def cap_share(t):
    c = t.part.select("p_brand", F.col("p_retailprice").alias("ksat"))
    return Y.cap_share(Y.condition_cells(c, 1.5, 1550.0), 1550.0, 0.5, "p_brand")


@query("dedupe_points", "WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, min(l_partkey / CAST(8 AS DOUBLE)) AS x, min(l_suppkey / CAST(4 AS DOUBLE)) AS y FROM lineitem GROUP BY 1) SELECT point_id, x, y FROM p QUALIFY row_number() OVER (PARTITION BY round(x, 3), round(y, 3) ORDER BY point_id) = 1")
def dedupe_points(t):
    p = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id")).agg(F.min(F.col("l_partkey") / 8.0).alias("x"), F.min(F.col("l_suppkey") / 4.0).alias("y"))
    return Y.dedupe_points(p)


@query("dedupe_points_within")
def dedupe_points_within(t):
    return Y.dedupe_points(points(t.part, "p_partkey", "point_id"), 120.0)


@query("river_qa", "SELECT 'p_retailprice' AS \"check\", 'passed' AS status UNION ALL SELECT 'rivdph', 'failed' UNION ALL SELECT 'geometry_source', CASE WHEN (SELECT bool_or(p_name LIKE '%ring%') FROM part) THEN 'passed' ELSE 'failed' END")
def river_qa(t):
    return Y.river_qa(t.part, ["p_retailprice", "rivdph"], ["p_name"], "ring")


@query("id_pairs_qa", """SELECT o_custkey AS waterbody_id, 'area_without_outlet' AS issue FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT l_partkey, 'outlet_without_area' FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)""")
def id_pairs_qa(t):
    return Y.id_pairs_qa(t.orders.select(F.col("o_custkey").alias("waterbody_id")), t.lineitem.select(F.col("l_partkey").alias("waterbody_id")))
