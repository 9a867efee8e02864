"""Flood outcomes on cell tables (event, t, cell, zs) with a static bed table (cell, zb, active)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kit.blocks import quantiles
from ..kit.common import M_TO_FT, cut, finite, listed
from ..kit.intervals import nearest
from .peaks import solve_symmetric

# Acres per square kilometre, and the label order of severity bands.
KM2_TO_ACRES = 247.105381467
SEVERITY_ORDER = ("mild", "common", "significant", "rare", "extreme")


def masked_depth(cells: DataFrame, static: DataFrame, kind: str = "incremental", wet_m: float = 0.1, land_min_m: float | None = -0.5,
                 event: str = "event_id", cell: str = "cell", t: str = "t") -> DataFrame:
    """Flood depth in feet per (event, cell): peak level minus bed, above the first step's depth, null where not flooded."""
    lv = cells.groupBy(event, cell).agg(F.max(finite("zs")).alias("_top"), F.min(F.struct(t, finite("zs").alias("z"))).alias("_first"))
    first = cells.groupBy(event).agg(F.min(t).alias("_t0"))
    j = lv.join(first, event).join(static.select(cell, F.col("zb").cast("double").alias("_zb")), cell)
    base = F.when(F.col(f"_first.{t}") == F.col("_t0"), F.greatest(F.col("_first.z") - F.col("_zb"), F.lit(0.0)))
    depth = F.col("_top") - F.col("_zb")
    inc = depth - F.coalesce(base, F.lit(0.0))
    flooded = inc > wet_m
    if land_min_m is not None:
        flooded = flooded & (F.col("_zb") >= land_min_m)
    return j.select(event, cell, F.when(flooded, (depth if kind == "total" else inc) * M_TO_FT).alias("depth_ft"))


def event_stats(cells: DataFrame, static: DataFrame, cell_area_m2: float, dt_hours: float, land_above_m: float = 0.0, wet_m: float = 0.05,
                impact_m: float = 0.1, event: str = "event_id", cell: str = "cell", t: str = "t") -> DataFrame:
    """Flood statistics per event from three levels of aggregation: cell-step, cell, event.

    The baseline depth of a cell comes from the rows of the event's first step alone. Medians and p90 use counting, so no event's cells meet in one task.
    """
    s = static.select(cell, F.col("zb").cast("double").alias("_zb"), F.col("active").alias("_act")).withColumn(
        "_land", F.col("_act") & (F.col("_zb") > land_above_m))
    first = cells.groupBy(event).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.countDistinct(t).alias("available_time_steps"))
    # The first step's depth of a cell: one row per cell, so the cell-step rows meet it in an equi join, not in a window.
    dry = cells.join(first.select(event, F.col("_t0").alias(t)), [event, t], "left_semi").join(s.where("_land"), cell)
    base = dry.groupBy(event, cell).agg(F.max(F.greatest(finite("zs") - F.col("_zb"), F.lit(0.0))).alias("_base"))
    r = cells.join(s.where("_act"), cell).withColumn("_d", finite("zs") - F.col("_zb")).join(base, [event, cell], "left")
    inc = F.greatest(F.col("_d") - F.coalesce("_base", F.lit(0.0)), F.lit(0.0))
    r = r.withColumn("_inc", F.when(F.col("_land") & F.col("_d").isNotNull(), inc)).withColumn("_hit", F.coalesce(F.col("_inc") > impact_m, F.lit(False)))
    r = r.withColumn("_wetbase", F.coalesce(F.col("_base") > impact_m, F.lit(False)))
    per_cell = cut(r.groupBy(event, cell).agg(
        F.max("_land").alias("_land"), F.max("_wetbase").alias("_wetbase"), F.max(finite("zs")).alias("_zs"),
        F.max(F.when(~F.col("_land") & (F.col("_d") > wet_m), finite("zs"))).alias("_ocean_zs"),
        F.max(F.when(F.col("_hit"), F.col("_inc"))).alias("_peak"), F.max(F.when(F.col("_hit"), F.greatest("_d", F.lit(0.0)))).alias("_total"),
        F.count_if("_hit").alias("_n")).withColumn("_dur", F.when(F.col("_peak").isNotNull(), F.col("_n") * dt_hours)))
    per_step = r.groupBy(event, t).agg(F.count_if("_hit").alias("_h"), F.count_if(F.col("_hit") & ~F.col("_wetbase")).alias("_new"))
    by_step = per_step.groupBy(event).agg(F.max("_h").alias("_mh"), F.max("_new").alias("_mn"), F.sum("_h").alias("_sh"))
    grid = s.agg(F.count_if("_act").alias("active_cells"), F.count_if("_land").alias("land_t0_cells"), F.count_if(F.col("_act") & ~F.col("_land")).alias("ocean_t0_cells"))
    km2 = lambda n: n * (cell_area_m2 / 1e6)
    hit, new = F.col("_peak").isNotNull(), F.col("_peak").isNotNull() & ~F.col("_wetbase")
    best = F.max(F.when(hit, F.struct("_peak", (-F.col(cell)).alias("nc"))))
    a = per_cell.groupBy(event).agg(
        F.count_if(F.col("_land") & F.col("_wetbase")).alias("baseline_wet_land_t0_cells"), F.max("_zs").alias("raw_peak_domain_zs_m"),
        F.max("_ocean_zs").alias("peak_ocean_zs_m"), F.max("_peak").alias("peak_incremental_land_depth_m"), F.max("_total").alias("peak_total_land_depth_m"),
        F.avg("_total").alias("mean_total_land_depth_m"), (F.coalesce(F.sum("_total"), F.lit(0.0)) * cell_area_m2).alias("flood_volume_m3"),
        F.avg("_peak").alias("mean_peak_incremental_land_depth_m"), (-best["nc"]).alias("peak_land_cell"),
        km2(F.count_if(hit)).alias("anytime_incremental_flooded_area_km2"), km2(F.count_if(new)).alias("anytime_newly_flooded_area_km2"),
        F.max("_dur").alias("longest_incremental_flood_duration_h"), F.avg("_dur").alias("mean_incremental_flood_duration_h"),
        *[km2(F.count_if(F.col("_dur") >= h)).alias(f"area_incremental_flooded_ge_{h:02d}h_km2") for h in (6, 12, 24)])
    q = quantiles(per_cell, event, {
        "median_peak_incremental_land_depth_m": ("_peak", 0.5), "p90_peak_incremental_land_depth_m": ("_peak", 0.9),
        "median_incremental_flood_duration_h": ("_dur", 0.5), "p90_incremental_flood_duration_h": ("_dur", 0.9)})
    out = first.drop("_t0").withColumn("last_output_hour", F.col("_t1") * dt_hours).drop("_t1").join(a, event).join(q, event, "left").join(by_step, event).join(F.broadcast(grid))
    out = out.withColumn("dry_land_t0_cells", F.col("land_t0_cells") - F.col("baseline_wet_land_t0_cells"))
    out = out.withColumn("baseline_t0_flooded_area_km2", km2(F.col("baseline_wet_land_t0_cells"))).withColumn("dry_land_t0_area_km2", km2(F.col("dry_land_t0_cells")))
    out = out.withColumn("peak_incremental_flooded_area_km2", km2(F.col("_mh"))).withColumn("peak_newly_flooded_area_km2", km2(F.col("_mn"))).withColumn(
        "cumulative_incremental_flooded_area_km2h", km2(F.col("_sh")) * dt_hours).drop("_mh", "_mn", "_sh")
    return out.select("*", *[(F.col(c) * M_TO_FT).alias(c[:-2] + "_ft") for c in out.columns if c.endswith("_m")],
                      *[(F.col(c) * KM2_TO_ACRES).alias(c[:-4] + "_acres") for c in out.columns if c.endswith("_km2") and "_ge_" not in c])


def boundary_stats(levels: DataFrame, event: str = "event_id", t: str = "t", point: str = "point", level: str = "level") -> DataFrame:
    """Boundary points, mean and max of the first step, overall max per event."""
    first = levels.groupBy(event).agg(F.min(t).alias("_t0"))
    j = levels.join(first, event)
    v, at0 = finite(level), F.col(t) == F.col("_t0")
    return j.groupBy(event).agg(F.countDistinct(point).alias("n_boundary_points"), F.avg(F.when(at0, v)).alias("bzs_t0_mean_m"),
                                F.max(F.when(at0, v)).alias("bzs_t0_max_m"), F.max(v).alias("bzs_peak_max_m"))


def metric_summary(df: DataFrame, cols: list[str], by=None) -> DataFrame:
    """Count, mean, median, p90 and max of each column, one row per column."""
    by = listed(by)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), finite(c).alias("v")) for c in cols])).alias("_s")).select(
        *by, "_s.metric", "_s.v").where("v is not null")
    a = long.groupBy(*by, "metric").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    return a.join(quantiles(long, by + ["metric"], {"median": ("v", 0.5), "p90": ("v", 0.9)}), by + ["metric"])


def top_events(df: DataFrame, col: str, n: int, event: str = "event_id") -> DataFrame:
    return df.where(finite(col).isNotNull()).orderBy(F.col(col).desc(), event).limit(n)


# Return-period classes of the response tables.
RP_BREAKS = (0.0, 2.0, 10.0, 50.0, 100.0, 500.0)
RP_LABELS = ("<2 yr", "2-10 yr", "10-50 yr", "50-100 yr", "100-500 yr", ">500 yr")


def rp_class(rp: str):
    out = F.when(F.col(rp).isNull() | F.isnan(rp) | (F.col(rp) < 0), None)
    for lo, label in reversed(list(zip(RP_BREAKS, RP_LABELS))):
        out = out.when(F.col(rp) >= lo, label)
    return out


# Names of the response columns.
RESPONSE_MEDIANS = {"median_rp_years": ("sample_rp_years", 0.5), "median_peak_boundary_m": ("bzs_peak_max_m", 0.5), "median_rainfall_mm": ("rainfall_metric_mm", 0.5),
                    "median_peak_depth_m": ("peak_incremental_land_depth_m", 0.5), "p90_peak_depth_m": ("peak_incremental_land_depth_m", 0.9),
                    "median_peak_area_km2": ("peak_incremental_flooded_area_km2", 0.5), "p90_anytime_area_km2": ("anytime_incremental_flooded_area_km2", 0.9),
                    "p90_longest_duration_h": ("longest_incremental_flood_duration_h", 0.9)}


def flood_response(catalogue: DataFrame, group: str = "rp_band", band: str = "severity_band", event: str = "event_id") -> DataFrame:
    """Response per (return-period class or storm type) x severity: events, hit rate, medians and p90s."""
    c = catalogue.withColumn("rp_band", rp_class("sample_rp_years")) if group == "rp_band" else catalogue
    c = c.where(F.col(group).isNotNull() & F.col(band).isNotNull())
    a = c.groupBy(group, band).agg(F.countDistinct(event).alias("event_count"),
                                   F.avg(F.coalesce((finite("anytime_incremental_flooded_area_km2") > 0).cast("double"), F.lit(0.0))).alias("flood_hit_rate"))
    return a.join(quantiles(c, [group, band], RESPONSE_MEDIANS), [group, band])


def outcome_catalogue(runs: DataFrame, catalogue: DataFrame, stress: DataFrame, manifests: DataFrame, outcomes: DataFrame, health: DataFrame,
                      manifest_schema: str, event: str = "event_id", manifest: str = "manifest") -> DataFrame:
    """One row per run with catalogue, stress labels, manifest fields, outcomes and health attached."""
    m = manifests.select(event, F.from_json(manifest, manifest_schema).alias("_m")).select(event, "_m.*")
    out = runs
    for right, suffix in ((catalogue, ""), (stress, "_stress"), (m, "_run"), (outcomes, "_outcome"), (health, "_health")):
        ren = right.select(event, *[F.col(c).alias(c if c not in out.columns else c + suffix) for c in right.columns if c != event])
        out = out.join(ren, event, "left")
    return out


def missing_outcomes(runs: DataFrame, outcomes: DataFrame, event: str = "event_id") -> DataFrame:
    """Runs without finished outcomes; only these need computing."""
    return runs.join(outcomes.select(event), event, "left_anti")


def label_catalogue(df: DataFrame, labels=("event_origin", "storm_type")) -> DataFrame:
    """Stress labels fill gaps, missing soil is not_staged, unknown labels unresolved, plus origin group and section."""
    out = df
    for c in labels:
        s = f"{c}_stress"
        if s in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(s)) if c in out.columns else F.col(s))
    soil = F.coalesce(F.col("soil_moisture_included_in_run").cast("boolean"), F.lit(False)) if "soil_moisture_included_in_run" in out.columns else F.lit(False)
    for c in ("soil_moisture_source", "soil_moisture_member_id", "soil_moisture_member_time"):
        own = F.col(c).cast("string") if c in out.columns else F.lit("")
        out = out.withColumn(c, F.when(soil, own).otherwise("not_staged"))
    for c in ("event_origin", "storm_type", "severity_band", "driver_combo"):
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("unresolved")) if c in out.columns else F.lit("unresolved"))
    o = F.col("event_origin")
    group = (F.when(F.lower(o).contains("historical"), "historical").when(F.lower(o).contains("synthetic"), "synthetic")
             .when(o.isin("", "nan", "unresolved"), "unresolved").otherwise(o))
    return out.withColumn("event_origin_group", group).withColumn("catalogue_section", F.concat_ws(" / ", "event_origin_group", "storm_type", "severity_band"))


def order_catalogue(df: DataFrame, event: str = "event_id") -> DataFrame:
    rank = F.lit(99)
    for i, b in enumerate(SEVERITY_ORDER):
        rank = F.when(F.col("severity_band") == b, i).otherwise(rank)
    return df.orderBy("event_origin_group", "event_origin", "storm_type", rank, F.col("sample_rp_years").asc_nulls_last(),
                      F.col("peak_incremental_land_depth_m").desc_nulls_last(), event)


def section_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("event_origin_group", "storm_type", "severity_band").agg(F.count(F.lit(1)).alias("events"))


def associations(df: DataFrame, drivers: list[str], outcome: str, weight: str = "probability_weight", group: str = "storm_type", min_rows: int = 8) -> DataFrame:
    """Standardised weighted least-squares coefficient and weighted correlation per driver, for each group and for all.

    Two passes of weighted sums per group; the small correlation system of each group is solved afterwards.
    """
    cols = [outcome] + drivers
    x = df.select(F.col(group).cast("string").alias("_own"), *[finite(c).alias(c) for c in cols], F.coalesce(F.when(finite(weight) > 0, finite(weight)), F.lit(0.0)).alias("_w")).dropna(subset=cols)
    x = x.withColumn("_g", F.explode(F.array(F.lit("all"), F.coalesce("_own", F.lit("null")))))
    size = x.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_sw")).where(F.col("_n") >= min_rows)
    x = x.join(F.broadcast(size), "_g").withColumn("_w", F.when(F.col("_sw") > 0, F.col("_w")).otherwise(1.0))
    mean = x.groupBy("_g").agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"_m_{c}") for c in cols])
    z = x.join(F.broadcast(mean), "_g")
    dev = {c: F.col(c) - F.col(f"_m_{c}") for c in cols}
    cov = z.groupBy("_g").agg(F.max("_n").alias("n_events"), *[(F.sum(F.col("_w") * dev[a] * dev[b]) / F.sum("_w")).alias(f"_c_{i}_{j}")
                                                               for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i])
    r = lambda i, j: F.col(f"_c_{min(i, j)}_{max(i, j)}") / F.nullif(F.sqrt(F.col(f"_c_{i}_{i}") * F.col(f"_c_{j}_{j}")), F.lit(0.0))
    k = len(drivers)
    full = cov.select("_g", "n_events", F.array(*[F.coalesce(r(i, j), F.lit(0.0)) for i in range(1, k + 1) for j in range(i, k + 1)]).alias("_a"),
                      F.array(*[F.coalesce(r(i, 0), F.lit(0.0)) for i in range(1, k + 1)]).alias("_b"),
                      *[r(i, 0).alias(f"_r{i}") for i in range(1, k + 1)])
    full = cut(full)
    sol = solve_symmetric(full, ["_g"], k)
    j = full.join(sol, "_g")
    box = F.explode(F.array(*[F.struct(F.lit(d).alias("driver"), F.col("_coef")[i].alias("coef"), F.col(f"_r{i + 1}").alias("corr")) for i, d in enumerate(drivers)]))
    return j.select(F.col("_g").alias(group), F.lit(outcome).alias("outcome"), "n_events", box.alias("_x")).where("_x.corr is not null").select(
        group, "outcome", "_x.driver", F.col("_x.coef").alias("standardized_wls_coefficient"), F.col("_x.corr").alias("weighted_correlation"), "n_events")


def benchmark_events(df: DataFrame, rps: list[float], rank: str = "peak_incremental_land_depth_m", event: str = "event_id", rp: str = "sample_rp_years", band: float = 0.35) -> DataFrame:
    """Representative event per return period: largest rank value within the log band, else the nearest return period."""
    c = df.where(finite(rp) > 0).groupBy(event).agg(F.min(F.struct(finite(rp).alias("rp"), finite(rank).alias("rank"))).alias("_f")).select(event, "_f.rp", "_f.rank")
    goals = df.sparkSession.createDataFrame([(float(x),) for x in rps], "return_period_years double")
    j = c.join(F.broadcast(goals)).withColumn("_d", F.abs(F.log("rp") - F.log("return_period_years")))
    inside = F.coalesce((F.col("_d") <= band) & F.col("rank").isNotNull(), F.lit(False))
    pick = F.min(F.struct((~inside).alias("o"), F.when(inside, -F.col("rank")).otherwise(F.col("_d")).alias("k"), F.col(event).alias("e"), "rp", "rank"))
    return j.groupBy("return_period_years").agg(pick.alias("m")).select(
        "return_period_years", F.col("m.e").alias(event), F.col("m.rp").alias(rp), F.col("m.rank").alias("rank_value"))


def scenario_delta(depths: DataFrame, base: DataFrame, keys: list[str], depth: str = "depth_ft") -> DataFrame:
    """Scenario minus base with dry as 0; null where both are dry."""
    b = base.select(*keys, finite(depth).alias("_b"))
    s = depths.select(*keys, finite(depth).alias("_s"))
    j = s.join(b, keys, "full")
    x, y = F.coalesce("_s", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return j.select(*keys, F.when((x > 0) | (y > 0), x - y).alias("delta_ft"))


def common_events(runs: DataFrame, scenario: str = "design_scenario", event: str = "event_id") -> DataFrame:
    """Events completed in every scenario."""
    n = runs.select(scenario).distinct().agg(F.count(F.lit(1)).alias("_n"))
    per = runs.select(scenario, event).distinct().groupBy(event).agg(F.count(F.lit(1)).alias("_k"))
    return per.join(F.broadcast(n)).where("_k = _n").select(event)


def completed_runs(runs: DataFrame, scenario: str = "design_scenario", event: str = "event_id") -> DataFrame:
    return runs.select(scenario, event).distinct().groupBy(scenario).agg(F.count(F.lit(1)).alias("completed_events"))


def run_health(runs: DataFrame, cells: DataFrame, event: str = "event_id", t: str = "t") -> DataFrame:
    """Return code, step count, and the finite share and largest level of the last step."""
    last = cells.groupBy(event).agg(F.max(t).alias("_t1"), F.countDistinct(t).alias("time_steps"))
    j = cells.join(last, event).where(F.col(t) == F.col("_t1"))
    h = j.groupBy(event).agg(F.max("time_steps").alias("time_steps"), F.avg(finite("zs").isNotNull().cast("double")).alias("finite_share"), F.max(finite("zs")).alias("last_max_zs"))
    out = runs.join(h, event, "left")
    ok = (F.col("returncode") == 0) & (F.coalesce("finite_share", F.lit(0.0)) > 0)
    return out.withColumn("healthy", F.coalesce(ok, F.lit(False)))


def impact_class(points: DataFrame, cells: DataFrame, radius: float, pid: str = "point_id", px: str = "x", py: str = "y", cid: str = "cell",
                 cx: str = "cx", cy: str = "cy", depth: str = "depth_m") -> DataFrame:
    """dry / minor / moderate / severe by the depth of the nearest cell."""
    near = nearest(points, cells, pid, px, py, cid, cx, cy, radius)
    j = points.select(pid).join(near, pid, "left").join(cells.select(cid, depth), cid, "left")
    d = F.coalesce(finite(depth), F.lit(0.0))
    label = F.when(d <= 0.05, "dry").when(d <= 0.30, "minor").when(d <= 0.90, "moderate").otherwise("severe")
    return j.select(pid, cid, d.alias(depth), label.alias("impact_class"))
