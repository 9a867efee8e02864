"""Asset, fragility, telemetry, facility and profile operators on the derived network and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import impact as I
from tidemark.operators import network as N

from .base import query
from .events import U_SQL
from .network import BUS, Net, bus
from .outcomes import XY, points
from .peaks import erf_sql

ASSET_SQL = """a AS (SELECT 'site:asset:transformers:t' || c_custkey AS asset_id, 'transformer' AS asset_type, c_nationkey AS f, true AS fl FROM customer WHERE c_custkey > 0 AND c_mktsegment = 'MACHINERY'
 UNION ALL SELECT 'site:asset:sources:b' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 'source', c_nationkey, true FROM customer WHERE c_acctbal > 9000
 UNION ALL SELECT 'site:asset:load_buses:b' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 'load_bus', c_nationkey, true FROM customer
 UNION ALL SELECT 'site:asset:lines:l' || c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'underground_line_proxy' WHEN 'HOUSEHOLD' THEN 'fuse_proxy' WHEN 'FURNITURE' THEN 'overhead_line' ELSE 'line' END, c_nationkey, c_mktsegment IN ('BUILDING', 'HOUSEHOLD')
 FROM customer WHERE c_custkey > 0 AND c_mktsegment <> 'MACHINERY')"""


def assets(t):
    g = Net(t)
    code = F.col("linecode")
    cls = F.when(code == "code_building", "underground").when(code == "code_household", "fuse").when(code == "code_furniture", "overhead").otherwise("line")
    lb = g.buses.select("bus", "feeder_id", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return I.build_assets(g.tx, g.sources, lb, g.lines.withColumn("line_class", cls), "site")


def feeders(t):
    return t.customer.select(F.col("c_nationkey").cast("string").alias("feeder_id")).distinct()


@query("build_assets", f"WITH {ASSET_SQL} SELECT asset_id, asset_type, CAST(f AS VARCHAR) AS feeder_id, 'valid' AS coordinate_status, fl AS is_flood_relevant FROM a")
def build_assets(t):
    return assets(t).select("asset_id", "asset_type", "feeder_id", "coordinate_status", "is_flood_relevant")


@query("control_units", f"""WITH {ASSET_SQL} SELECT 'site:control_unit:' || f AS control_unit_id, string_agg(asset_id, '|' ORDER BY asset_id) AS members, coalesce(string_agg(asset_id, '|' ORDER BY asset_id) FILTER (asset_type = 'source'), '') AS sources FROM a GROUP BY f""")
def control_units(t):
    u = I.control_units(feeders(t), assets(t), "site")
    return u.select("control_unit_id", F.array_join("member_asset_ids", "|").alias("members"), F.array_join("source_ids", "|").alias("sources"))


@query("validate_assets", f"WITH {ASSET_SQL} SELECT 'asset_without_unit' AS issue, asset_id AS id FROM a WHERE asset_type = 'transformer'")
def validate_assets(t):
    a = assets(t)
    return I.validate_assets(a, I.control_units(feeders(t), a.where("asset_type <> 'transformer'"), "site"))


def cell_points(t):
    return points(t.part, "p_partkey", "cell", "cx", "cy", (F.col("p_size") / 20.0).alias("depth_m"))


@query("sample_depth", f"""WITH p AS (SELECT c_custkey AS asset_id, {XY.format(k='c_custkey', x='x', y='y')} FROM customer), c AS (SELECT p_partkey AS cell, {XY.format(k='p_partkey', x='cx', y='cy')}, p_size / 20.0 AS d FROM part),
n AS (SELECT asset_id, cell, d, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS distance FROM p JOIN c ON sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 150 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, cell) = 1)
SELECT p.asset_id, cell, distance, d AS sampled_depth_m FROM p LEFT JOIN n USING (asset_id)""", distance=6, sampled_depth_m=5)
def sample_depth(t):
    return I.sample_depth(points(t.customer, "c_custkey", "asset_id"), cell_points(t), 150.0)


CURVES = [("substation", 0.6, 0.0, 1.2), ("transformer_mad_mount", 0.5, 0.3, 0.9), ("distribution_junction_box", 0.4, 0.1, 0.7), ("switch", 0.5, 0.2, 1.0)]
CURVE_SQL = ("cv AS (SELECT * FROM (VALUES ('source', 'substation', 0.6, 0.0, 1.2), ('transformer', 'transformer_pad_mount', 0.5, 0.3, 0.9), ('load_bus', 'distribution_junction_box', 0.4, 0.1, 0.7), ('fuse_proxy', 'switch', 0.5, 0.2, 1.0))"
             " AS c(asset_type, fragility_class, shape, loc, scale))")
P_SQL = f"""CASE WHEN cv.shape IS NULL THEN NULL WHEN d > loc THEN least(greatest(0.5 * (1 + sign(ln((d - loc) / scale)) * {erf_sql('abs(ln((d - loc) / scale) / cv.shape / 1.4142135623730951)')}), 0), 1) ELSE 0 END"""
KIND_SQL = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'transformer' WHEN 'BUILDING' THEN 'source' WHEN 'HOUSEHOLD' THEN 'fuse_proxy' WHEN 'FURNITURE' THEN 'overhead_line' ELSE 'load_bus' END"


def kinds(t):
    s = F.col("c_mktsegment")
    k = F.when(s == "MACHINERY", "transformer").when(s == "BUILDING", "source").when(s == "HOUSEHOLD", "fuse_proxy").when(s == "FURNITURE", "overhead_line").otherwise("load_bus")
    return t.customer.select(F.col("c_custkey").alias("asset_id"), k.alias("asset_type"), F.col("c_nationkey"))


def curves(t):
    return t.spark.createDataFrame(CURVES, "asset_class string, shape double, loc_m double, scale_m double")


def depths(t):
    """Depth per order year (event) and customer: largest order scaled to metres."""
    return t.orders.groupBy(F.year("o_orderdate").alias("event_id"), F.col("o_custkey").alias("asset_id")).agg((F.max("o_totalprice") / 200000).alias("sampled_depth_m"))


IMPACT_SQL = f"""{CURVE_SQL}, dp AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS event_id, o_custkey AS asset_id, max(o_totalprice) / 200000 AS d FROM orders GROUP BY ALL),
im AS (SELECT event_id, dp.asset_id, {KIND_SQL} AS asset_type, d, {P_SQL} AS p FROM dp JOIN customer ON c_custkey = asset_id LEFT JOIN cv ON cv.asset_type = {KIND_SQL})"""


def impacts(t):
    return I.asset_impacts(kinds(t), depths(t), curves(t))


@query("asset_impacts", f"WITH {IMPACT_SQL} SELECT event_id, asset_id, asset_type, p AS failure_probability, coalesce(p >= 0.5, false) AS affected, p IS NULL AS unmapped_class FROM im", failure_probability=6)
def asset_impacts(t):
    return impacts(t).select("event_id", "asset_id", "asset_type", "failure_probability", "affected", "unmapped_class")


@query("summarize_impacts", f"""WITH {IMPACT_SQL}, s AS (SELECT event_id, asset_type, p, d FROM im UNION ALL SELECT event_id, 'all', p, d FROM im)
SELECT event_id, asset_type, count(*) AS assets, CAST(count_if(coalesce(p >= 0.5, false)) AS BIGINT) AS affected, sum(coalesce(p, 0)) AS expected_failures, max(p) AS max_probability, max(d) AS max_depth_m FROM s GROUP BY ALL""", expected_failures=5, max_probability=6, max_depth_m=6)
def summarize_impacts(t):
    return I.summarize_impacts(impacts(t))


STATE_SQL = f"""{IMPACT_SQL}, dr AS (SELECT im.*, m.i AS mc_draw, s.ts FROM im, (SELECT unnest(range(0, 5)) AS i) m, (SELECT unnest([0, 3600, 7200]) AS ts) s),
stt AS (SELECT *, CASE WHEN {U_SQL.format(key="'asset_state|42|' || event_id || '|' || mc_draw || '|' || asset_id || '|' || ts")} <= coalesce(p * (ts + 3600) / 10800, 0) THEN 'failed' ELSE 'available' END AS state FROM dr)"""


def states(t):
    d = impacts(t).withColumn("timestamp", F.explode(F.array(F.lit(0), F.lit(3600), F.lit(7200)))).withColumn(
        "failure_probability", F.col("failure_probability") * (F.col("timestamp") + 3600) / 10800)
    return I.asset_states(d, 5, 42)


@query("asset_states", f"WITH {STATE_SQL} SELECT event_id, mc_draw, asset_id, ts AS timestamp, state FROM stt")
def asset_states(t):
    return states(t).select("event_id", F.col("mc_draw").cast("bigint").alias("mc_draw"), "asset_id", "timestamp", "state")


def units(t):
    return kinds(t).groupBy(F.concat(F.lit("cu"), F.col("c_nationkey")).alias("control_unit_id")).agg(F.collect_list("asset_id").alias("member_asset_ids"))


TEL_SQL = f"""{STATE_SQL}, te AS (SELECT event_id, mc_draw, ts, 'asset' AS target_type, CAST(asset_id AS VARCHAR) AS target_id, CASE WHEN state = 'failed' THEN 1.0 ELSE 0 END AS value FROM stt WHERE asset_type IN ('source', 'transformer', 'fuse_proxy')
 UNION ALL SELECT event_id, mc_draw, ts, 'control_unit', 'cu' || c_nationkey, avg(CASE WHEN state = 'failed' THEN 1.0 ELSE 0 END) FROM stt JOIN customer ON c_custkey = asset_id GROUP BY ALL)"""


def observed(t):
    s = states(t)
    return I.telemetry(s.withColumn("asset_id", F.col("asset_id").cast("string")), units(t).withColumn("member_asset_ids", F.col("member_asset_ids").cast("array<string>")), 42)


@query("telemetry", f"""WITH {TEL_SQL} SELECT event_id, mc_draw, ts AS timestamp_observed, target_type, target_id, value,
 ts + ('0x' || substr(md5('observation|42|' || event_id || '|' || mc_draw || '|' || target_id || '|' || ts), 1, 13))::BIGINT % 16 * 60 AS timestamp_delivered FROM te""", value=7)
def telemetry(t):
    return observed(t).drop("measured_quantity")


@query("failure_events", f"""WITH {STATE_SQL}, l AS (SELECT *, lag(state) OVER (PARTITION BY event_id, mc_draw, asset_id ORDER BY ts) AS pv FROM stt)
SELECT event_id, mc_draw, asset_id, min(ts) AS failed_at, CAST(min(ts) // 3600 + 1 AS INTEGER) AS timestep, CASE WHEN asset_type <> 'load_bus' THEN 'Line.' || asset_id END AS element, asset_type = 'load_bus' AS unmapped
FROM l WHERE state = 'failed' AND (pv IS NULL OR pv <> 'failed') GROUP BY event_id, mc_draw, asset_id, asset_type""")
def failure_events(t):
    el = kinds(t).where("asset_type <> 'load_bus'").select("asset_id", F.concat(F.lit("Line."), F.col("asset_id")).alias("element"))
    return I.failure_events(states(t).withColumnRenamed("asset_type", "kind"), el)


FAC_SQL = f"""fa AS (SELECT s_suppkey AS facility_id, {XY.format(k='(s_suppkey * 31 + 17)', x='x', y='y')}, s_nationkey FROM supplier), lb AS (SELECT c_custkey AS bus, {XY.format(k='c_custkey', x='bx', y='by_')}, abs(c_acctbal) / 1000 AS kw, c_nationkey FROM customer),
mt AS (SELECT facility_id, bus, kw, c_nationkey, sqrt((x - bx) ** 2 + (y - by_) ** 2) AS distance FROM fa, lb QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY (x - bx) ** 2 + (y - by_) ** 2, bus) = 1)"""


def matched(t):
    f = points(t.supplier.withColumn("fk", F.col("s_suppkey") * 31 + 17), "fk", "pk", "x", "y", F.col("s_suppkey").alias("facility_id")).drop("pk")
    lb = points(t.customer, "c_custkey", "bus", "bx", "by", (F.abs("c_acctbal") / 1000).alias("load_kw"), F.col("c_nationkey").alias("feeder_id"))
    u = t.customer.select(F.col("c_nationkey").alias("source_feeder_id"), F.concat(F.lit("cu"), F.col("c_nationkey")).alias("control_unit_id")).distinct()
    return I.match_facilities(f, lb, u)


@query("match_facilities", f"""WITH {FAC_SQL} SELECT facility_id, bus, distance, CASE WHEN distance <= 300 THEN 'assigned' ELSE 'flagged_distance' END AS match_status,
 CASE WHEN distance <= 75 THEN 'high' WHEN distance <= 300 THEN 'medium' ELSE 'low' END AS assignment_confidence, kw AS load_kw, c_nationkey AS feeder_id, 'cu' || c_nationkey AS control_unit_id FROM mt""", distance=5, load_kw=5)
def match_facilities(t):
    return matched(t)


SHAPES = ["24x7", "business_hours", "school_calendar", "extended_residential", "industrial_continuous"]
POOL = [("residential", "extended_residential"), ("residential", "night_home"), ("commercial", "business_hours"), ("commercial", "school_calendar"), ("industrial_proxy", "industrial_continuous"), ("industrial_proxy", "24x7")]


def profiled(t):
    pool = t.spark.createDataFrame(POOL, "customer_class string, archetype string")
    loads = t.customer.select(F.col("c_custkey").alias("load_name"), (F.abs("c_acctbal") / 15).alias("kw"))
    return I.assign_profiles(loads, pool, 3)


@query("assign_profiles", f"""WITH l AS (SELECT c_custkey AS load_name, abs(c_acctbal) / 15 AS kw, ('0x' || substr(md5('profile|3|' || c_custkey), 1, 13))::BIGINT % 2 AS h FROM customer),
c AS (SELECT *, CASE WHEN kw < 10 THEN 'residential' WHEN kw < 200 THEN 'commercial' ELSE 'industrial_proxy' END AS customer_class FROM l)
SELECT load_name, kw, customer_class, CASE customer_class WHEN 'residential' THEN ['extended_residential', 'night_home'][h + 1] WHEN 'commercial' THEN ['business_hours', 'school_calendar'][h + 1] ELSE ['24x7', 'industrial_continuous'][h + 1] END AS archetype,
 CASE WHEN customer_class = 'residential' THEN 'residential' WHEN kw >= 500 THEN 'large_tou' WHEN kw >= 100 THEN 'medium_tou' ELSE 'general' END AS tariff FROM c""", kw=5)
def assign_profiles(t):
    return profiled(t)


CLASSES = ["police_eoc", "fire_station", "communications_exchange", "responder_radio", "municipal_facility", "senior_center", "school",
           "school_administration", "public_housing", "healthcare_residential", "wastewater_treatment_plant", "public_works", "library", None]


@query("facility_profiles", f"""WITH f AS (SELECT 'town:facility:' || c_custkey AS facility_id,
  {[c or '' for c in CLASSES]}[c_custkey % 14 + 1] AS k FROM customer),
a AS (SELECT facility_id, nullif(k, '') AS facility_class, CASE WHEN k = 'public_housing' THEN 'resstock' ELSE 'comstock' END AS profile_source,
  CASE k WHEN 'public_housing' THEN 'MultiFamily' WHEN 'healthcare_residential' THEN 'Outpatient' WHEN 'senior_center' THEN 'MediumOffice' WHEN 'school' THEN 'PrimarySchool'
    WHEN 'wastewater_treatment_plant' THEN 'Warehouse' WHEN 'public_works' THEN 'Warehouse' ELSE 'SmallOffice' END AS source_building_type,
  CASE WHEN k IN ('police_eoc', 'fire_station', 'communications_exchange', 'responder_radio') THEN '24x7' WHEN k = 'school' THEN 'school_calendar'
    WHEN k IN ('public_housing', 'healthcare_residential') THEN 'extended_residential' WHEN k = 'wastewater_treatment_plant' THEN 'industrial_continuous' ELSE 'business_hours' END AS schedule_overlay,
  CASE WHEN k = 'public_housing' THEN 'residential' ELSE 'critical_facility' END AS customer_class, 'ASHRAE_5A' AS source_geography,
  split_part(facility_id, ':', 3) AS diversity_group_id FROM f)
SELECT *, 'town:loadshape:' || diversity_group_id || ':' || profile_source || ':' || source_building_type || ':' || schedule_overlay AS loadshape_id FROM a""")
def facility_profiles(t):
    kind = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("c_custkey") % 14 + 1).cast("int"))
    f = t.customer.select(F.concat(F.lit("town:facility:"), F.col("c_custkey")).alias("facility_id"), kind.alias("facility_class"))
    return I.facility_profiles(f, "town")


SHAPE_SQL = """CASE kind WHEN '24x7' THEN least(1, greatest(0.62, 0.8 + 0.2 * sin(pi() * (h % 24 - 1) / 24)))
 WHEN 'school_calendar' THEN CASE WHEN h // 24 % 7 >= 5 OR h // 24 % 365 BETWEEN 165 AND 244 THEN 0.05 WHEN h % 24 BETWEEN 7 AND 15 THEN 0.1 + 0.9 * sin(pi() * (h % 24 - 6.5) / 9) ELSE 0.1 END
 WHEN 'extended_residential' THEN least(1, (0.3 + 0.4 * exp(-((h % 24 - 7) ** 2) / 6.0) + 0.7 * exp(-((h % 24 - 19) ** 2) / 8.0)) * CASE WHEN h // 24 % 7 >= 5 THEN 1.1 ELSE 1.0 END)
 WHEN 'industrial_continuous' THEN greatest(0.85, least(1, 0.92 + 0.06 * sin(2 * pi() * (h % 24 - 6) / 24)))
 ELSE CASE WHEN h = 61 THEN 1.0 ELSE greatest(0, CASE WHEN h // 24 % 7 >= 5 THEN least(x, 0.3) ELSE x END) END END"""


@query("hourly_profiles", f"""WITH l AS (SELECT ['24x7', 'business_hours', 'school_calendar', 'extended_residential', 'industrial_continuous'][s_suppkey % 5 + 1] AS kind, abs(s_acctbal) / 10 AS kw FROM supplier),
hh AS (SELECT unnest(range(0, 8760)) AS h), s AS (SELECT l.*, h, CASE WHEN h % 24 BETWEEN 9 AND 17 THEN 0.18 + 0.82 * sin(pi() * (h % 24 - 8.5) / 9) ELSE 0.18 END AS x FROM l, hh)
SELECT kind AS schedule_overlay, CAST(h AS INTEGER) AS hour, sum(kw * ({SHAPE_SQL})) AS kw FROM s GROUP BY ALL""", kw=2)
def hourly_profiles(t):
    """Every supplier's full year, totalled per schedule and hour: loads of one schedule have one shape, so they are added up before the hours."""
    kind = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    a = t.supplier.select(kind.alias("schedule_overlay"), (F.abs("s_acctbal") / 10).alias("peak_kw"))
    return I.hourly_profiles(a.groupBy("schedule_overlay").agg(F.sum("peak_kw").alias("peak_kw"))).select("schedule_overlay", "hour", "kw")


WIN_SQL = f"""l AS (SELECT s_suppkey, s_nationkey, ['24x7', 'business_hours', 'school_calendar', 'extended_residential', 'industrial_continuous'][s_suppkey % 5 + 1] AS kind, abs(s_acctbal) / 10 AS kw FROM supplier),
ev AS (SELECT n_nationkey AS event_id, i AS step, (n_nationkey * 364 + 20 + i) % 8760 AS h FROM nation, (SELECT unnest(range(0, 72)) AS i)),
s AS (SELECT l.*, event_id, step, h, CASE WHEN h % 24 BETWEEN 9 AND 17 THEN 0.18 + 0.82 * sin(pi() * (h % 24 - 8.5) / 9) ELSE 0.18 END AS x FROM l, ev),
dm AS (SELECT event_id, s_suppkey AS load_asset_id, s_nationkey, step, round(kw * ({SHAPE_SQL}), 6) AS kw FROM s)"""


def demand(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    a = t.supplier.select(F.col("s_suppkey").alias("load_asset_id"), kind.alias("schedule_overlay"), (F.abs("s_acctbal") / 10).alias("peak_kw"))
    e = t.nation.select(F.col("n_nationkey").alias("event_id"), (F.col("n_nationkey") * 364 + 20).alias("start_hour"), F.lit(72).alias("steps"))
    return I.window_demand(a, e)


@query("window_demand", f"WITH {WIN_SQL} SELECT event_id, s_nationkey AS block_id, max(kw) AS peak_kw, sum(kw) AS energy_kwh FROM (SELECT event_id, s_nationkey, step, sum(kw) AS kw FROM dm GROUP BY ALL) GROUP BY ALL", peak_kw=3, energy_kwh=2)
def window_demand(t):
    return I.block_demand(demand(t), t.supplier.select(F.col("s_suppkey").alias("load_asset_id"), F.col("s_nationkey").alias("block_id")))


@query("demand_bounds", f"WITH {WIN_SQL} SELECT event_id, load_asset_id, step, kw * 0.9 AS lower_kw, kw * 1.1 AS upper_kw FROM dm", lower_kw=7, upper_kw=7)
def demand_bounds(t):
    return I.demand_bounds(demand(t), 0.1).select("event_id", "load_asset_id", F.col("step").cast("bigint").alias("step"), "lower_kw", "upper_kw")


@query("der_inventory", f"""WITH {FAC_SQL} SELECT facility_id, 'installed' AS backup_power_status, CASE WHEN distance <= 300 THEN bus END AS bus, CASE WHEN distance <= 300 THEN 'assigned' ELSE 'unassigned' END AS assignment_status,
 CASE WHEN distance <= 300 THEN '' ELSE 'flagged_distance' END AS reason FROM mt JOIN fa USING (facility_id) WHERE s_nationkey > 5""")
def der_inventory(t):
    f = t.supplier.select(F.col("s_suppkey").alias("facility_id"), F.when(F.col("s_nationkey") > 5, "installed").otherwise("unknown").alias("backup_power_status"))
    return I.der_inventory(f, matched(t))
