"""Normalising gauge, soil, reservoir, storm-window and member tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kit.blocks import quantiles, row_numbers
from ..kit.cells import in_boxes, in_rings
from ..kit.common import clip, finite, listed, secs
from ..kit.intervals import nearest


def rollup_gauges(df: DataFrame, site: str = "site_no", parameter: str = "00060") -> DataFrame:
    """One row per active discharge site: first attributes, record span and years, completeness."""
    d = df.where((F.lower(F.coalesce("status", F.lit("active"))) == "active") & (F.col("parameter_cd") == parameter))
    g = d.groupBy(site).agg(F.min(F.struct("row_id", "site_name", "drainage_area_sqmi", "latitude", "longitude")).alias("f"), F.min("period_start").alias("period_start"),
                            F.max("period_end").alias("period_end"), F.sum(finite("count_nu")).alias("_n"))
    days = F.datediff("period_end", "period_start")
    return g.select(site, "f.site_name", "f.drainage_area_sqmi", "f.latitude", "f.longitude", "period_start", "period_end", F.round(F.greatest(days, F.lit(0)) / 365.25, 2).alias("record_years"),
                    F.round(F.least(F.col("_n") / F.greatest(days + 1, F.lit(1)), F.lit(1.0)), 3).alias("completeness_score"), F.lit("candidate").alias("review_status"))


def assign_gauge_roles(gauges: DataFrame, rules: DataFrame, handoff: DataFrame, overrides: DataFrame, validation_only: list[str], long_years: float = 50.0,
                       fallback: str = "review_required", site: str = "site_no") -> DataFrame:
    """Basin by first matching rule (listed site or name part), roles, review status and per-site overrides.

    `rules` (rule_order, site_nos array, contains, basin) is a small policy table.
    """
    name = F.upper(F.coalesce(F.col("site_name"), F.lit("")))
    hit = F.coalesce(F.array_contains("site_nos", F.col(site)), F.lit(False)) | (F.coalesce(F.col("contains"), F.lit("")) != "") & name.contains(F.upper("contains"))
    first = gauges.join(F.broadcast(rules), hit).groupBy(site).agg(F.min(F.struct("rule_order", "basin")).alias("r")).select(site, F.col("r.basin").alias("_basin"))
    j = gauges.join(first, site, "left").join(handoff.select(site, "handoff_id"), site, "left").join(
        overrides.select(site, F.col("review_status").alias("_st"), F.col("roles").alias("_roles"), F.col("basin").alias("_ob")), site, "left")
    pattern = F.lit(False)
    for p in validation_only:
        pattern = pattern | name.contains(p.upper())
    roles = (F.when(F.col("handoff_id").isNotNull(), "frequency,calibration,validation,handoff").when(pattern, "validation")
             .when(finite("record_years") >= long_years, "frequency,validation").otherwise("calibration,validation"))
    return j.select(site, "site_name", F.coalesce("_ob", "_basin", F.lit(fallback)).alias("basin"), F.coalesce("_roles", roles).alias("roles"),
                    F.coalesce("_st", F.lit("accepted_with_warning")).alias("review_status"), "handoff_id")


def assign_region(points: DataFrame, polygons: DataFrame, pid: str = "site_no", x: str = "longitude", y: str = "latitude") -> DataFrame:
    """First region (by level, then id) holding each point, even-odd. Points and regions meet on quadtree cells."""
    hit = in_rings(points.select(pid, x, y), polygons.select("region_id", "level", "vertices"), x, y).groupBy(pid).agg(F.min(F.struct("level", "region_id")).alias("r"))
    return points.select(pid).join(hit, pid, "left").select(pid, F.col("r.region_id").alias("region_id"), F.col("r.level").alias("level"))


def accepted_gauges(df: DataFrame) -> DataFrame:
    """Active gauges whose review is accepted or accepted_with_warning; no review column is an error."""
    if "review_status" not in df.columns:
        raise ValueError("reviewed gauge table has no review_status column")
    low = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = df.where(low("review_status").isin("accepted", "accepted_with_warning"))
    return out.where(low("status") == "active") if "status" in df.columns else out


def drop_overlapping_sites(sites: DataFrame, primary: DataFrame, d: float = 150.0, excluded=(), site: str = "site_no", x: str = "x", y: str = "y") -> DataFrame:
    """Sites farther than d from every primary site and not of an excluded agency."""
    keep = sites.where(~F.coalesce(F.upper("agency").isin([e.upper() for e in excluded]), F.lit(False))) if excluded else sites
    p = primary.select(F.col(x).alias("_ox"), F.col(y).alias("_oy"), F.lit(0).alias("_o"))
    # The nearest primary site decides, so a site meets few of those within d.
    near = nearest(keep.select(site, x, y), p, site, x, y, "_o", "_ox", "_oy", max(float(d), 1e-9)).where(F.col("distance") <= float(d)).select(site)
    return keep.join(near, site, "left_anti")


def quadrant_coverage(sites: DataFrame, bounds: tuple[float, float, float, float], x: str = "x", y: str = "y", name: str = "site_name") -> DataFrame:
    """Sites in all and north-west of the region's midpoint, with their names."""
    mx, my = (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2
    nw = (F.col(x) < mx) & (F.col(y) > my)
    return sites.agg(F.count(F.lit(1)).alias("flow_sites_in_region"), F.count_if(nw).alias("northwest_flow_sites"),
                     F.array_join(F.sort_array(F.collect_list(F.when(nw, F.col(name)))), ", ").alias("northwest_site_names"))


def derive_top_saturation(df: DataFrame, layers=(0, 1), layer: str = "soil_layers_stag", value: str = "SOIL_M", out: str = "SOILSAT_TOP") -> DataFrame:
    """Mean of the chosen layers per remaining keys, clipped to 0..1 and joined back; plain clip without layers."""
    if layer not in df.columns:
        return df.withColumn(out, clip(finite(value), 0.0, 1.0))
    keys = [c for c in df.columns if c not in (layer, value)]
    top = df.where(F.col(layer).isin(*layers)).groupBy(*keys).agg(F.avg(finite(value)).alias("_m"))
    return df.join(top, keys, "left").withColumn(out, clip(F.col("_m"), 0.0, 1.0)).drop("_m")


def aggregate_soil_points(df: DataFrame, by="time", value: str = "SOILSAT_TOP", point: str = "point_id", layer: str = "soil_layers_stag") -> DataFrame:
    v = finite(value)
    return df.groupBy(*listed(by)).agg(F.avg(v).alias("soil_moisture_mean"), F.min(v).alias("soil_moisture_min"), F.max(v).alias("soil_moisture_max"),
                                       F.countDistinct(point).alias("point_count"), F.countDistinct(layer).alias("layer_count"))


def sample_grid(points: DataFrame, cells: DataFrame, radius: float, finite_only: bool = True, pid: str = "point_id", cid: str = "cell", time: str = "time", value: str = "value") -> DataFrame:
    """Series of the nearest grid cell of each point, optionally among cells with any finite value. `cells` has cx, cy."""
    place = cells.groupBy(cid, "cx", "cy").agg(F.count(finite(value)).alias("_n"))
    near = nearest(points, place.where("_n > 0") if finite_only else place, pid, "x", "y", cid, "cx", "cy", radius, unbounded=True)
    return near.join(cells.select(cid, time, value), cid).select(pid, cid, "distance", time, value)


# Acres and acre-feet to square and cubic metres.
ACRE_M2 = 4046.8564224
ACFT_M3 = 1233.48183754752
RESERVOIR_COLUMNS = ["water_level", "surface_area", "reservoir_storage", "conservation_storage", "percent_full", "conservation_capacity"]


def summarize_reservoirs(history: DataFrame, statistic: str = "median", start=None, end=None, slug: str = "slug", date: str = "date") -> DataFrame:
    """One row per reservoir: the statistic of six columns, area and volume in metres, depth = volume / area."""
    h = history
    if start is not None:
        h = h.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        h = h.where(F.col(date) <= F.lit(end).cast("date"))
    cols = [c for c in RESERVOIR_COLUMNS if c in h.columns]
    span = h.groupBy(slug).agg(F.min(date).alias("period_start"), F.max(date).alias("period_end"), F.count(F.lit(1)).alias("condition_rows"))
    if statistic == "median":
        s = quantiles(h, slug, {c: (c, 0.5) for c in cols})
    else:
        fn = {"mean": lambda c: F.avg(finite(c)), "min": lambda c: F.min(finite(c)), "max": lambda c: F.max(finite(c)),
              "last": lambda c: F.max(F.when(finite(c).isNotNull(), F.struct(F.col(date).alias("d"), finite(c).alias("v"))))["v"]}[statistic]
        s = h.groupBy(slug).agg(*[fn(c).alias(c) for c in cols])
    out = span.join(s, slug, "left").withColumn("Area_avg", F.col("surface_area") * ACRE_M2).withColumn("Vol_avg", F.col("reservoir_storage") * ACFT_M3)
    return out.withColumn("Depth_avg", F.col("Vol_avg") / F.when(F.col("Area_avg") > 0, F.col("Area_avg")))


def normal_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def apply_reservoir_summary(reservoirs: DataFrame, summary: DataFrame, names: DataFrame, min_depth: float = 0.25, max_depth: float = 200.0, rid: str = "waterbody_id", name: str = "waterbody_name") -> DataFrame:
    """Measured area, volume and clipped depth on reservoirs matched by name, then by name without "lake "; review status set.

    `names` maps known names to slugs.
    """
    n = names.select(normal_name(F.col("name")).alias("_k"), "slug").groupBy("_k").agg(F.min("slug").alias("_s1"))
    m = n.groupBy(F.regexp_replace("_k", "lake ", "").alias("_c")).agg(F.min("_s1").alias("_s2"))
    r = reservoirs.withColumn("_k", normal_name(F.col(name)))
    r = r.withColumn("_c", F.regexp_replace("_k", "lake ", "")).join(F.broadcast(n), "_k", "left").join(F.broadcast(m), "_c", "left").withColumn("slug", F.coalesce("_s1", "_s2"))
    s = summary.select("slug", F.col("Area_avg").alias("_a"), F.col("Vol_avg").alias("_v"), clip(F.col("Depth_avg"), min_depth, max_depth).alias("_d"), F.lit(True).alias("_hit"))
    j = r.join(s, "slug", "left")
    over = lambda new, old: F.coalesce(F.when(F.col(new) > 0, F.col(new)), F.col(old)).alias(old)
    return j.select(rid, name, "slug", over("_a", "Area_avg"), over("_v", "Vol_avg"), over("_d", "Depth_avg"),
                    F.when(F.col("_hit"), "review_required_storage_no_control_outflow_fallback").otherwise("review_required_missing_condition_bootstrap").alias("review_status"))


def window_readiness(ranked: DataFrame, windows: DataFrame, variables: list[str], event: str = "event_id") -> DataFrame:
    """ready / missing / incomplete per storm: its window must exist with finite values of every variable."""
    c = windows.groupBy(event).agg(*[F.count(finite(v)).alias(f"_{v}") for v in variables], F.lit(True).alias("_has"))
    ok = F.lit(True)
    for v in variables:
        ok = ok & (F.col(f"_{v}") > 0)
    return ranked.select(event).join(c, event, "left").select(event, F.when(F.col("_has").isNull(), "missing").when(ok, "ready").otherwise("incomplete").alias("window_status"))


def normalise_members(df: DataFrame, forcing: str, time: str = "time", order: str = "row_id") -> DataFrame:
    """Source, file and id filled: point_time, else driver_time, else driver_0001 by row order."""
    stamp = F.date_format(F.timestamp_micros((secs(df, time) * 1e6).cast("bigint")), "yyyyMMdd'T'HHmmss")
    d = row_numbers(df, None, order, name="_i")
    pt = F.concat_ws("_", "point_id", stamp) if "point_id" in df.columns else F.lit(None).cast("string")
    made = (F.when(F.col("point_id").isNotNull() & stamp.isNotNull(), pt) if "point_id" in df.columns else F.when(F.lit(False), "")).when(
        stamp.isNotNull(), F.concat(F.lit(forcing + "_"), stamp)).otherwise(F.format_string(forcing + "_%04d", F.col("_i")))
    own = lambda c, alt: F.coalesce(F.col(c).cast("string"), alt) if c in df.columns else alt
    return d.withColumn("source", own("source", F.lit(forcing))).withColumn("member_id", own("member_id", made)).withColumn("member_file", own("member_file", F.lit(""))).drop("_i")


def gauge_roles(gauges: DataFrame, roles: str = "roles") -> DataFrame:
    """Count of gauges per role of a comma list."""
    r = gauges.select(F.explode(F.split(roles, ",")).alias("role")).select(F.trim("role").alias("role")).where("role <> ''")
    return r.groupBy("role").agg(F.count(F.lit(1)).alias("gauges"))


def gauges_by_domain(gauges: DataFrame, boxes: DataFrame, site: str = "site_no", x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Gauges per domain by declared id; by box containment only when no id matches at all."""
    by_id = gauges.join(boxes.select("domain_id"), "domain_id").select("domain_id", site)
    found = by_id.limit(1).agg(F.count(F.lit(1)).alias("_f"))
    inbox = in_boxes(gauges.drop("domain_id"), boxes, x, y, "xmin", "xmax", "ymin", "ymax")
    alt = inbox.join(F.broadcast(found)).where("_f = 0").select("domain_id", site)
    return by_id.unionByName(alt)


def source_readiness(manifests: DataFrame, start: float, end: float, members: DataFrame, catalog: DataFrame, pairing: list[str], source: str = "source") -> DataFrame:
    """Issue rows per source: no declared window, window not covered, no member rows; plus the share of fully paired catalogue rows."""
    n = members.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    j = manifests.join(n, source, "left")
    a, z = finite("start"), finite("end")
    bad = F.filter(F.array(F.when(a.isNull() | z.isNull(), F.lit("window_not_declared")), F.when((a > start) | (z < end), F.lit("window_not_covered")),
                           F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit("no_member_rows"))), lambda x: x.isNotNull())
    rows = j.select(source, F.explode(bad).alias("issue"), F.lit(None).cast("double").alias("share"))
    full = F.lit(True)
    for c in pairing:
        full = full & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    share = catalog.agg(F.avg(full.cast("double")).alias("share")).select(F.lit("catalogue").alias(source), F.lit("paired_share").alias("issue"), "share")
    return rows.unionByName(share)


def unpivot_gauges(wide: DataFrame, gauges: DataFrame, time: str = "time") -> DataFrame:
    """Columns ending in _<index> to rows, joined to gauge ids and places."""
    cols = [c for c in wide.columns if c != time and (c.startswith("Q") or c.startswith("river_q"))]
    long = wide.unpivot([time], cols, "column", "q").withColumn("gauge_index", F.regexp_extract("column", r"_(\d+)$", 1).try_cast("bigint"))
    return long.join(gauges, "gauge_index").select(time, "gauge_index", *[c for c in gauges.columns if c != "gauge_index"], finite("q").alias("q"))
