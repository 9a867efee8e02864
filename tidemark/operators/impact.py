"""Assets, fragility, Monte Carlo states, telemetry, facilities, load profiles and demand windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import norm_cdf
from ..functions.rand import hashed, uniform
from ..kit.common import finite
from ..kit.intervals import nearest

# Default fragility class of each asset type, and spellings treated as one class.
ASSET_CLASS = {
    "source": "substation", "transformer": "transformer_pad_mount", "load_bus": "distribution_junction_box",
    "underground_line_proxy": "distribution_underground_cables", "line_underground": "distribution_underground_cables",
    "fuse_proxy": "switch", "line_fuse": "switch", "overhead_line": "distribution_overhead_lines",
    "line_overhead": "distribution_overhead_lines", "line": "distribution_overhead_lines", "line_other": "distribution_overhead_lines",
}
CLASS_ALIAS = {"transformer_mad_mount": "transformer_pad_mount"}


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def build_assets(tx: DataFrame, sources: DataFrame, load_buses: DataFrame, lines: DataFrame, location: str) -> DataFrame:
    """One asset table: transformers, sources, load buses and line midpoints with coordinate status and flood flag."""
    def part(df, kind, table, name, lon, lat, flood, coord, exempt=F.lit("")):
        ok = finite(lon).isNotNull() & finite(lat).isNotNull()
        return df.select(F.concat_ws(":", F.lit(location), F.lit("asset"), F.lit(table), slug(name.cast("string"))).alias("asset_id"), kind.alias("asset_type"), F.lit(table).alias("source_table"),
                         name.cast("string").alias("source_name"), F.col("feeder_id").cast("string").alias("feeder_id"), finite(lon).alias("lon"), finite(lat).alias("lat"),
                         F.when(ok, "valid").otherwise("missing").alias("coordinate_status"), F.lit(coord).alias("coordinate_source"), flood.alias("is_flood_relevant"), exempt.alias("exemption"))
    yes = F.lit(True)
    c = F.col("line_class")
    kind = F.when(c == "underground", "underground_line_proxy").when(c == "fuse", "fuse_proxy").when(c == "overhead", "overhead_line").otherwise("line")
    wet = c.isin("underground", "fuse")
    why = F.when(wet, "").when(c == "overhead", "topology_only_overhead_line").otherwise("topology_only_line")
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return (part(tx, F.lit("transformer"), "transformers", F.col("transformer_name"), F.col("location_lon"), F.col("location_lat"), yes, "buscoords")
            .unionByName(part(sources, F.lit("source"), "sources", F.col("source_name"), F.col("lon"), F.col("lat"), yes, "buscoords"))
            .unionByName(part(load_buses, F.lit("load_bus"), "load_buses", F.col("bus"), F.col("lon"), F.col("lat"), yes, "buscoords"))
            .unionByName(part(lines, kind, "lines", F.col("line_name"), mid("from_lon", "to_lon"), mid("from_lat", "to_lat"), F.coalesce(wet, F.lit(False)), "line_midpoint", why)))


def control_units(feeders: DataFrame, assets: DataFrame, location: str) -> DataFrame:
    """Per feeder: sorted member and source ids."""
    ids = assets.where("feeder_id is not null and feeder_id <> ''").groupBy("feeder_id").agg(
        F.sort_array(F.collect_list("asset_id")).alias("member_asset_ids"), F.sort_array(F.collect_list(F.when(F.col("asset_type") == "source", F.col("asset_id")))).alias("source_ids"))
    none = F.array().cast("array<string>")
    return feeders.join(ids, "feeder_id", "left").select(F.concat_ws(":", F.lit(location), F.lit("control_unit"), slug(F.col("feeder_id").cast("string"))).alias("control_unit_id"),
                                                         F.col("feeder_id").alias("source_feeder_id"), F.coalesce("member_asset_ids", none).alias("member_asset_ids"), F.coalesce("source_ids", none).alias("source_ids"))


def validate_assets(assets: DataFrame, units: DataFrame) -> DataFrame:
    """Issue rows: duplicate ids, flood assets without coordinates, members that are not assets, assets in no unit."""
    row = lambda df, code: df.select(F.lit(code).alias("issue"), F.col("asset_id").alias("id"))
    dup = assets.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bad = assets.where("is_flood_relevant and coordinate_status <> 'valid'")
    mem = units.select(F.explode("member_asset_ids").alias("asset_id")).distinct()
    return row(dup, "duplicate_asset_id").unionByName(row(bad, "missing_coordinates")).unionByName(
        row(mem.join(assets, "asset_id", "left_anti"), "unknown_member")).unionByName(
        row(assets.where("feeder_id is not null and feeder_id <> ''").join(mem, "asset_id", "left_anti"), "asset_without_unit"))


def sample_depth(points: DataFrame, cells: DataFrame, limit_m: float, missing: float | None = None, pid: str = "asset_id", x: str = "x", y: str = "y",
                 cid: str = "cell", cx: str = "cx", cy: str = "cy", depth: str = "depth_m", event: str | None = None) -> DataFrame:
    """Depth at the nearest cell with any finite depth; beyond the limit null, or `missing` for state sampling.

    The place is looked up once per asset; the depth of that cell is then joined for every event.
    """
    seen = cells.where(finite(depth).isNotNull()).select(cid, cx, cy).distinct()
    near = nearest(points, seen, pid, x, y, cid, cx, cy, limit_m)
    d = cells.select(*([event] if event else []), cid, finite(depth).alias("sampled_depth_m"))
    if event:
        # Every asset has a row in every event, wet or not.
        base = points.select(pid).join(F.broadcast(cells.select(event).distinct()))
        j = base.join(near, pid, "left").join(d, [event, cid], "left")
        cols = [event, pid]
    else:
        j = points.select(pid).join(near, pid, "left").join(d, cid, "left")
        cols = [pid]
    v = F.col("sampled_depth_m")
    return j.select(*cols, cid, "distance", (F.coalesce(v, F.lit(float(missing))) if missing is not None else v).alias("sampled_depth_m"))


def failure_probability(df: DataFrame, curves: DataFrame, mapping: dict[str, str] = ASSET_CLASS, alias: dict[str, str] = CLASS_ALIAS,
                        kind: str = "asset_type", depth: str = "sampled_depth_m") -> DataFrame:
    """Shifted lognormal fragility per asset class; 0 at or below the location or without depth; unmapped classes flagged.

    `curves` is (asset_class, shape, loc_m, scale_m), a handful of rows.
    """
    lookup = lambda m, c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in m.items()]) if m else F.lit(None).cast("string")
    cl = curves.select(F.coalesce(lookup(alias, F.col("asset_class")), F.col("asset_class")).alias("fragility_class"), "shape", "loc_m", "scale_m")
    j = df.withColumn("fragility_class", lookup(mapping, F.trim(F.col(kind)))).join(F.broadcast(cl), "fragility_class", "left")
    d = finite(depth)
    z = F.log((d - F.col("loc_m")) / F.col("scale_m")) / F.col("shape")
    p = F.when(d > F.col("loc_m"), F.least(F.greatest(norm_cdf(z), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return j.withColumn("failure_probability", F.when(F.col("shape").isNotNull(), p)).withColumn("unmapped_class", F.col("shape").isNull()).drop("shape", "loc_m", "scale_m")


def asset_impacts(assets: DataFrame, depths: DataFrame, curves: DataFrame, mapping: dict[str, str] = ASSET_CLASS, at: float = 0.5) -> DataFrame:
    """Depth, failure probability and affected flag per event and asset."""
    j = depths.join(assets.select("asset_id", "asset_type"), "asset_id")
    p = failure_probability(j, curves, mapping)
    return p.withColumn("affected", F.coalesce(F.col("failure_probability") >= at, F.lit(False)))


def summarize_impacts(impacts: DataFrame, event: str = "event_id") -> DataFrame:
    """Counts, expected failures, largest probability and depth by asset type, and for all types."""
    g = impacts.rollup(event, "asset_type").agg(
        F.grouping("asset_type").alias("_g"), F.grouping(event).alias("_e"), F.count(F.lit(1)).alias("assets"), F.count_if("affected").alias("affected"),
        F.sum(F.coalesce("failure_probability", F.lit(0.0))).alias("expected_failures"), F.max("failure_probability").alias("max_probability"), F.max("sampled_depth_m").alias("max_depth_m"))
    return g.where("_e = 0").withColumn("asset_type", F.when(F.col("_g") == 1, "all").otherwise(F.col("asset_type"))).drop("_g", "_e")


def asset_states(samples: DataFrame, draws: int, root_seed: int, event: str = "event_id", time: str = "timestamp") -> DataFrame:
    """failed / available per draw, asset and time: a keyed hash uniform against the failure probability.

    Rows of other draws are made next to their asset, so draws add no shuffle.
    """
    d = samples.withColumn("mc_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = uniform("asset_state", root_seed, F.col(event), F.col("mc_draw"), F.col("asset_id"), F.col(time))
    return d.withColumn("state", F.when(u <= F.coalesce("failure_probability", F.lit(0.0)), "failed").otherwise("available"))


def telemetry(states: DataFrame, units: DataFrame, root_seed: int, event: str = "event_id", time: str = "timestamp") -> DataFrame:
    """Observations with delivery delay (0-15 min): single sources, transformers and fuses, and failed share per control unit.

    `states` has asset_type; time is a number of seconds. Unit shares are partial-aggregated before the shuffle.
    """
    failed = (F.col("state") == "failed").cast("double")
    one = states.where(F.col("asset_type").isin("source", "transformer", "fuse_proxy")).select(
        event, "mc_draw", F.col(time).alias("timestamp_observed"), F.lit("asset").alias("target_type"), F.col("asset_id").alias("target_id"), F.lit("asset_failure_state").alias("measured_quantity"), failed.alias("value"))
    mem = units.select("control_unit_id", F.explode("member_asset_ids").alias("asset_id"))
    unit = states.join(mem, "asset_id").groupBy(event, "mc_draw", F.col(time).alias("timestamp_observed"), F.col("control_unit_id").alias("target_id")).agg(F.avg(failed).alias("value")).select(
        event, "mc_draw", "timestamp_observed", F.lit("control_unit").alias("target_type"), "target_id", F.lit("failed_asset_fraction").alias("measured_quantity"), "value")
    both = one.unionByName(unit)
    delay = hashed("observation", root_seed, F.col(event), F.col("mc_draw"), F.col("target_id"), F.col("timestamp_observed")) % 16
    return both.withColumn("timestamp_delivered", F.col("timestamp_observed") + delay * 60)


def failure_events(states: DataFrame, elements: DataFrame, event: str = "event_id", time: str = "timestamp", start: str | None = None) -> DataFrame:
    """First change to failed per asset and draw with its model step and mapped element (null when unmapped)."""
    w = Window.partitionBy(event, "mc_draw", "asset_id").orderBy(time)  # one row per event time step
    s = states.withColumn("_p", F.lag("state").over(w)).where("state = 'failed' and (_p is null or _p <> 'failed')")
    first = s.groupBy(event, "mc_draw", "asset_id").agg(F.min(time).alias("failed_at"))
    t0 = states.groupBy(event).agg(F.min(time).alias("_t0"))
    j = first.join(t0, event).join(elements, "asset_id", "left")
    step = F.greatest(F.lit(1), F.floor((F.col("failed_at") - F.col("_t0")) / 3600).cast("int") + 1)
    return j.select(event, "mc_draw", "asset_id", "failed_at", step.alias("timestep"), "element", F.col("element").isNull().alias("unmapped"))


def match_facilities(fac: DataFrame, loads: DataFrame, units: DataFrame | None = None, limit_m: float = 300.0, near_m: float = 75.0,
                     fid: str = "facility_id", bus: str = "bus") -> DataFrame:
    """Nearest load bus of each facility: assigned within the limit, with confidence, bus load and control unit."""
    n = nearest(fac, loads, fid, "x", "y", bus, "bx", "by", limit_m, unbounded=True)
    j = fac.select(fid).join(n, fid, "left").join(loads.select(bus, "load_kw", "feeder_id"), bus, "left")
    conf = F.when(F.col("distance") <= near_m, "high").when(F.col("distance") <= limit_m, "medium").otherwise("low")
    out = j.select(fid, bus, "distance", F.when(F.col("distance") <= limit_m, "assigned").when(F.col("distance").isNotNull(), "flagged_distance").otherwise("no_load_bus").alias("match_status"),
                   conf.alias("assignment_confidence"), "load_kw", "feeder_id")
    return out.join(units.select(F.col("source_feeder_id").alias("feeder_id"), "control_unit_id"), "feeder_id", "left") if units is not None else out


# Class limits in kW and tariff tiers in kW.
CLASS_KW = (10.0, 200.0)
TARIFF_KW = (100.0, 500.0)


def customer_class(kw: Column) -> Column:
    return F.when(kw < CLASS_KW[0], "residential").when(kw < CLASS_KW[1], "commercial").when(kw.isNotNull(), "industrial_proxy")


def tariff(kw: Column, kind: Column) -> Column:
    return F.when(kind == "residential", "residential").when(kw >= TARIFF_KW[1], "large_tou").when(kw >= TARIFF_KW[0], "medium_tou").otherwise("general")


def assign_profiles(loads: DataFrame, pool: DataFrame, seed: int, name: str = "load_name", kw: str = "kw") -> DataFrame:
    """Customer class, tariff and a hashed archetype of the class per load. `pool` is (customer_class, archetype), a few rows."""
    opts = pool.groupBy("customer_class").agg(F.sort_array(F.collect_list("archetype")).alias("_opts"))
    j = loads.withColumn("customer_class", customer_class(finite(kw))).join(F.broadcast(opts), "customer_class", "left")
    pick = (hashed("profile", seed, F.col(name)) % F.size("_opts") + 1).cast("int")
    return j.withColumn("archetype", F.element_at("_opts", pick)).withColumn("tariff", tariff(finite(kw), F.col("customer_class"))).drop("_opts")


# Profile source, building type, schedule and customer class of each facility class, and of any other.
FACILITY_ARCHETYPES = {
    "police_eoc": ("comstock", "SmallOffice", "24x7", "critical_facility"),
    "fire_station": ("comstock", "SmallOffice", "24x7", "critical_facility"),
    "communications_exchange": ("comstock", "SmallOffice", "24x7", "critical_facility"),
    "responder_radio": ("comstock", "SmallOffice", "24x7", "critical_facility"),
    "municipal_facility": ("comstock", "SmallOffice", "business_hours", "critical_facility"),
    "senior_center": ("comstock", "MediumOffice", "business_hours", "critical_facility"),
    "school": ("comstock", "PrimarySchool", "school_calendar", "critical_facility"),
    "school_administration": ("comstock", "SmallOffice", "business_hours", "critical_facility"),
    "public_housing": ("resstock", "MultiFamily", "extended_residential", "residential"),
    "healthcare_residential": ("comstock", "Outpatient", "extended_residential", "critical_facility"),
    "wastewater_treatment_plant": ("comstock", "Warehouse", "industrial_continuous", "critical_facility"),
    "public_works": ("comstock", "Warehouse", "business_hours", "critical_facility"),
}
OTHER_ARCHETYPE = ("comstock", "SmallOffice", "business_hours", "critical_facility")
CLIMATE_ZONE = "ASHRAE_5A"
ARCHETYPE_COLUMNS = ("profile_source", "source_building_type", "schedule_overlay", "customer_class")


def facility_profiles(facilities: DataFrame, location: str, fid: str = "facility_id", kind: str = "facility_class") -> DataFrame:
    """`facilities` with the archetype of their class (the default for unknown and null ones) and a load-shape id.

    The id joins the location, the last colon-parted piece of the facility id, source, building and schedule; a null
    facility id has a null load shape.
    """
    table = F.create_map(*[x for k, v in FACILITY_ARCHETYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = facilities.withColumn("_a", F.coalesce(F.try_element_at(table, F.col(kind)), F.array(*map(F.lit, OTHER_ARCHETYPE))))
    found = found.withColumns({c: F.col("_a")[i] for i, c in enumerate(ARCHETYPE_COLUMNS)}).withColumn("source_geography", F.lit(CLIMATE_ZONE)).drop("_a")
    token = F.element_at(F.split(F.col(fid).cast("string"), ":"), -1)
    shape = F.concat(F.lit(f"{location}:loadshape:"), token, *[F.concat(F.lit(":"), F.col(c)) for c in ARCHETYPE_COLUMNS[:3]])
    return found.withColumn("diversity_group_id", token).withColumn("loadshape_id", shape)


# The five schedule shapes in `load_shape`, with their hours, levels and slopes.
def load_shape(kind: Column, hour: Column) -> Column:
    """Share of peak load at an hour of the year for the five schedule shapes (business hours when unknown)."""
    hod = hour % 24
    dow = F.floor(hour / 24) % 7
    doy = F.floor(hour / 24) % 365
    pi = math.pi
    always = F.least(F.lit(1.0), F.greatest(F.lit(0.62), 0.8 + 0.2 * F.sin(pi * (hod - 1) / 24)))
    office = F.when(hod.between(9, 17), 0.18 + 0.82 * F.sin(pi * (hod - (9 - 0.5)) / 9)).otherwise(0.18)
    office = F.greatest(F.lit(0.0), F.when(dow >= 5, F.least(office, F.lit(0.30))).otherwise(office))
    office = F.when(hour == 61, 1.0).otherwise(office)
    class_day = F.when(hod.between(7, 15), 0.10 + 0.90 * F.sin(pi * (hod - (7 - 0.5)) / 9)).otherwise(0.10)
    school = F.when((dow >= 5) | ((doy >= 165) & (doy < 245)), 0.05).otherwise(class_day)
    home = 0.30 + 0.40 * F.exp(-((hod - 7) ** 2) / 6.0) + 0.70 * F.exp(-((hod - 19) ** 2) / 8.0)
    home = F.least(F.lit(1.0), F.when(dow >= 5, home * 1.10).otherwise(home))
    plant = F.greatest(F.lit(0.85), F.least(F.lit(1.0), 0.92 + 0.06 * F.sin(2 * pi * (hod - 6) / 24)))
    return (F.when(kind == "24x7", always).when(kind == "school_calendar", school).when(kind == "extended_residential", home)
            .when(kind == "industrial_continuous", plant).otherwise(office))


HOURS_PER_YEAR = 8760


def hourly_profiles(assignments: DataFrame, kind: str = "schedule_overlay", kw: str = "peak_kw") -> DataFrame:
    """Load per hour of the year. Hours are made beside each load, so nothing is shuffled."""
    h = assignments.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(HOURS_PER_YEAR - 1))))
    return h.withColumn("kw", F.round(F.col(kw) * load_shape(F.col(kind), F.col("hour")), 6))


def window_demand(assignments: DataFrame, events: DataFrame, load: str = "load_asset_id", event: str = "event_id", start_hour: str = "start_hour", steps: str = "steps") -> DataFrame:
    """Demand of each load through each event window; hours past the year end wrap to its start.

    `events` is broadcast-sized by design (a run batch); only window hours are evaluated, not whole years.
    """
    e = events.select(event, F.posexplode(F.transform(F.sequence(F.lit(0), F.col(steps) - 1), lambda i: (F.col(start_hour) + i) % HOURS_PER_YEAR)).alias("step", "hour"))
    # A schedule's shape is worked out once an hour, not once a load.
    kinds = assignments.select(F.col("schedule_overlay").alias("_kind")).distinct()
    shapes = kinds.join(F.broadcast(e)).withColumn("_shape", load_shape(F.col("_kind"), F.col("hour")))
    # Few bytes of loads grow to many rows, so they are dealt out first, to a fixed number of partitions.
    spread = int(assignments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = assignments.repartition(spread).join(F.broadcast(shapes), F.col("schedule_overlay").eqNullSafe(F.col("_kind")))
    return j.withColumn("kw", F.round(F.col("peak_kw") * F.col("_shape"), 6)).select(event, load, "step", "hour", "kw")


def block_demand(demand: DataFrame, blocks: DataFrame, load: str = "load_asset_id", event: str = "event_id", block: str = "block_id") -> DataFrame:
    """Peak kW and energy of each block in each event."""
    j = demand.join(blocks.select(load, block), load)
    t = j.groupBy(event, block, "step").agg(F.sum("kw").alias("kw"))
    return t.groupBy(event, block).agg(F.max("kw").alias("peak_kw"), F.sum("kw").alias("energy_kwh"))


def demand_bounds(df: DataFrame, band: float, kw: str = "kw") -> DataFrame:
    return df.withColumn("lower_kw", F.col(kw) * (1 - band)).withColumn("upper_kw", F.col(kw) * (1 + band))


def der_inventory(fac: DataFrame, matches: DataFrame, fid: str = "facility_id", ok=("installed", "planned", "confirmed")) -> DataFrame:
    """Backup resources: facilities with backup power joined to their bus, assigned or with the reason not."""
    b = fac.where(F.lower("backup_power_status").isin(*ok)).select(fid, "backup_power_status")
    j = b.join(matches.select(fid, "bus", "match_status"), fid, "left")
    good = F.coalesce(F.col("match_status") == "assigned", F.lit(False))
    return j.select(fid, "backup_power_status", F.when(good, F.col("bus")).alias("bus"), F.when(good, "assigned").otherwise("unassigned").alias("assignment_status"),
                    F.when(good, "").otherwise(F.coalesce("match_status", F.lit("no_load_match"))).alias("reason"))
