"""Discharge operators: interpolation, hydrograph transfer and scores, amplification, boundary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kit.blocks import quantiles, running
from ..kit.common import CFS_TO_CMS, HOUR, clip, finite, from_secs, listed, over, secs
from ..kit.intervals import asof, interval_join, range_fold
from .fields import season


def interpolate(known: DataFrame, clock: DataFrame, by, t: str = "t", v: str = "v", fill_ends: bool = False) -> DataFrame:
    """Values of `known` at the instants of `clock`, linear in time; ends held flat only with fill_ends."""
    by = listed(by)
    k = known.select(*by, F.col(t).alias("_t"), F.col(v).alias("_v")).where("_v is not null")
    k = k.groupBy(*by, "_t").agg(F.avg("_v").alias("_v"))
    box = F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))
    both = k.withColumn("_q", F.lit(0)).unionByName(
        clock.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_q")).distinct(), allowMissingColumns=True)
    # Known rows sort first at equal instants for `last`; an equal instant is its own neighbour either way.
    near = running(both, by, "_t", {"_lo": ("last", box), "_hi": ("next", box)}, tie="_q").where("_q = 1")
    lo, hi = F.col("_lo"), F.col("_hi")
    gap = hi["_t"] - lo["_t"]
    mid = F.when(lo["_t"] == F.col("_t"), lo["_v"]).otherwise(
        lo["_v"] + (hi["_v"] - lo["_v"]) * (F.col("_t") - lo["_t"]) / F.when(gap > 0, gap))
    val = F.when(lo.isNull(), hi["_v"] if fill_ends else F.lit(None)).when(
        hi.isNull() & (lo["_t"] < F.col("_t")), lo["_v"] if fill_ends else F.lit(None)).otherwise(mid)
    return near.select(*by, F.col("_t").alias(t), val.alias(v))


def _beside_ticks(known: DataFrame, clock: DataFrame, by: list[str]) -> DataFrame:
    """Rows of `known` that a tick of the clock (t) may lie next to: all others leave before anything is sorted.

    Time is cut into as many cells as there are ticks. Before the first tick of a cell, from its last one on, and in a cell without a
    tick only the first and the last instant count; rows between two ticks of one cell all stay.
    """
    known = known.where("v is not null")
    grid = clock.agg(F.min("t").alias("_t0"), F.coalesce(over((F.max("t") - F.min("t")) / over(F.count_distinct("t") - 1)), F.lit(1.0)).alias("_w"))
    celled = lambda df: df.join(F.broadcast(grid)).withColumn("_cell", F.floor((F.col("t") - F.col("_t0")) / F.col("_w") + 0.5)).drop("_t0", "_w")
    marks = celled(clock).groupBy("_cell").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    side = F.when(F.col("_a").isNull() | (F.col("t") <= F.col("_a")), 0).when(F.col("t") >= F.col("_b"), 2).otherwise(1)
    put = celled(known).join(F.broadcast(marks), "_cell", "left").withColumn("_side", side)
    ends = put.groupBy(*by, "_cell", "_side", F.when(F.col("_side") == 1, F.col("t")).alias("_own")).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    return known.join(ends.select(*by, F.explode(F.array("_lo", "_hi")).alias("t")).distinct(), [*by, "t"], "left_semi")


def normalise_meteo(cells: DataFrame, clock: DataFrame, by, kind: str, time: str = "time", value: str = "value") -> DataFrame:
    """A field on the model clock: linear in time, gaps filled with the field median (0 for radiation), units fixed.

    kind: temperature (K over 150 to C), pressure (Pa over 2000 to hPa), radiation (floored at 0).
    """
    by = listed(by)
    known = cells.select(*by, secs(cells, time).alias("t"), finite(value).alias("v"))
    at = clock.select(secs(clock, time).alias("t"))
    ticks = known.select(*by).distinct().join(F.broadcast(at))
    got = interpolate(_beside_ticks(known, at, by), ticks, by)
    if kind == "radiation":
        v = F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0))
    else:
        got = got.join(F.broadcast(quantiles(known, None, {"_med": ("v", 0.5)})))
        v = F.coalesce("v", "_med")
    if kind == "temperature":
        v = F.when(v > 150.0, v - 273.15).otherwise(v)
    if kind == "pressure":
        v = F.when(v > 2000.0, v / 100.0).otherwise(v)
    return got.select(*by, from_secs(cells, time, F.col("t")).alias(time), v.alias(value))


def hourly_clock(events: DataFrame, start: str, end: str, step_s: float = HOUR) -> DataFrame:
    """events with one row per step in [start, end] (seconds): column t."""
    n = F.floor((F.col(end) - F.col(start)) / step_s).cast("int")
    return events.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.col(start) + i * step_s)))


def transfer_hydrograph(records: DataFrame, events: DataFrame, site: str = "site_no", time: str = "time",
                        flow: str = "discharge_cfs", event: str = "event_id") -> DataFrame:
    """Observed hydrograph around an analog instant, moved to the event and scaled to its peak (m3/s).

    `events` has event, site, analog_time, reference_time, start, end (seconds) and target_peak_cfs.
    Mean per site and instant, largest over sites, hourly with ends held. An event holds the records of its window, and its hours
    are made beside them, so no hour is shuffled.
    """
    r = records.select(F.col(site), secs(records, time).alias("_t"), finite(flow).alias("_q")).where("_q is not null")
    r = r.groupBy(site, "_t").agg(F.avg("_q").alias("_q"))
    shift = F.col("analog_time") - F.col("reference_time")
    e = events.withColumn("_lo", shift + F.col("start")).withColumn("_hi", shift + F.col("end"))
    # Events that ask for the same stretch of a record share its list.
    keys = [site, "_lo", "_hi"]
    asked = e.select(*keys).distinct()
    lists = interval_join(asked, r, "_lo", "_hi", "_t", [site], 72 * HOUR).groupBy(*keys).agg(F.collect_list(F.struct("_t", "_q")).alias("_w"))
    moved = e.join(lists, keys, "left").withColumn("_w", F.transform("_w", lambda x: F.struct(
        (x["_t"] - F.col("analog_time") + F.col("reference_time")).alias("t"), x["_q"].alias("v"))))
    one = moved.groupBy(event).agg(F.min("start").alias("_start"), F.max("end").alias("_end"), F.max("target_peak_cfs").alias("_target"),
                                   F.array_sort(F.flatten(F.collect_list("_w"))).alias("_w")).where(F.size("_w") > 0)
    # In order of instant and value, the last of equal instants is the largest over sites.
    w = F.col("_w")
    one = one.withColumn("_w", F.filter(w, lambda x, i: F.coalesce(F.get(w, i + 1)["t"] != x["t"], F.lit(True))))
    # A stretch between two instants has the ticks from the first on: numbers _a to _z.
    n = F.floor((F.col("_end") - F.col("_start")) / HOUR).cast("int")
    tick = lambda t: F.least(F.greatest(F.ceil((t - F.col("_start")) / HOUR), F.lit(0)), n + 1).cast("int")
    at = lambda s, i: F.when(s["hi"].isNull(), s["lo"]["v"]).when(s["lo"].isNull(), s["hi"]["v"]).otherwise(
        s["lo"]["v"] + (s["hi"]["v"] - s["lo"]["v"]) * (F.col("_start") + i * HOUR - s["lo"]["t"]) / (s["hi"]["t"] - s["lo"]["t"]))
    parts = F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: F.struct(
        F.when(i > 0, tick(F.get(w, i - 1)["t"])).otherwise(0).alias("a"), F.when(i < F.size(w), tick(F.get(w, i)["t"])).otherwise(n + 1).alias("z"),
        F.get(w, i - 1).alias("lo"), F.get(w, i).alias("hi")))
    one = one.withColumn("_parts", F.filter(parts, lambda s: s["a"] < s["z"]))
    # Linear in between, so the largest value stands at the first or last tick of a stretch.
    top = F.array_max(F.transform("_parts", lambda s: F.greatest(at(s, s["a"]), at(s, s["z"] - 1))))
    scaled = one.withColumn("_peak", top).where("_peak > 0").withColumn("scale_factor", F.col("_target") / F.col("_peak"))
    stretch = scaled.select(event, "_start", "scale_factor", F.explode("_parts").alias("_s"))
    s = F.col("_s")
    ticks = stretch.withColumn("_i", F.explode(F.sequence(s["a"], s["z"] - 1)))
    return ticks.select(event, (F.col("_start") + F.col("_i") * HOUR).alias("time"), "scale_factor",
                        (at(s, F.col("_i")) * F.col("scale_factor") * CFS_TO_CMS).alias("q_cms"))


def align_observations(records: DataFrame, clock: DataFrame, step_s: float, origin: float, by, time: str = "time",
                       value: str = "value") -> DataFrame:
    """Mean per model step from the origin, then linear to the model instants; nothing outside the record."""
    by = listed(by)
    s = records.select(*by, secs(records, time).alias("_t"), finite(value).alias("_v")).where("_v is not null")
    s = s.groupBy(*by, "_t").agg(F.avg("_v").alias("_v"))
    step = F.lit(origin) + F.floor((F.col("_t") - origin) / step_s) * step_s
    binned = s.groupBy(*by, step.alias("t")).agg(F.avg("_v").alias("v"))
    out = interpolate(binned, clock.select(*by, secs(clock, time).alias("t")), by).where("v is not null")
    return out.select(*by, from_secs(clock, time, F.col("t")).alias(time), F.col("v").alias(value))


def kge(sim, obs) -> Column:
    """Kling-Gupta efficiency as an aggregate column (population deviations)."""
    r = F.covar_pop(sim, obs) / F.nullif(F.stddev_pop(sim) * F.stddev_pop(obs), F.lit(0.0))
    a = F.stddev_pop(sim) / F.nullif(F.stddev_pop(obs), F.lit(0.0))
    b = F.avg(sim) / F.nullif(F.avg(obs), F.lit(0.0))
    return 1.0 - F.sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2)


def nse(sim, obs) -> Column:
    """Nash-Sutcliffe efficiency as an aggregate column."""
    ss = F.var_pop(obs) * F.count(obs)
    return 1.0 - F.sum((F.col(sim) - F.col(obs)) ** 2) / F.nullif(ss, F.lit(0.0))


def hydrograph_scores(sim: DataFrame, obs: DataFrame, by, time: str = "time") -> DataFrame:
    """n, NSE, KGE, peak and volume bias per key over instants both sides have."""
    by = listed(by)
    a = sim.select(*by, time, finite("value").alias("_s"))
    b = obs.select(*by, time, finite("value").alias("_o"))
    j = a.join(b, by + [time]).where("_s is not null and _o is not null")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), nse("_s", "_o").alias("nse"), kge("_s", "_o").alias("kge"),
        ((F.max("_s") - F.max("_o")) / F.nullif(F.max("_o"), F.lit(0.0))).alias("peak_bias_fraction"),
        ((F.sum("_s") - F.sum("_o")) / F.nullif(F.sum("_o"), F.lit(0.0))).alias("volume_bias_fraction"))


def calibration_k(scores: DataFrame, by=None, event: str = "event_id", min_steps: int = 12, min_events: int = 2) -> DataFrame:
    """Median 1/(1 + peak bias) over usable rows; ready when enough events support it."""
    by = listed(by)
    ok = scores.where((F.col("n") >= min_steps) & (F.col("peak_bias_fraction") > -0.95)).withColumn(
        "_k", 1.0 / (1.0 + F.col("peak_bias_fraction")))
    med = quantiles(ok, by, {"k_calibration": ("_k", 0.5)})
    cnt = ok.groupBy(*by).agg(F.countDistinct(event).alias("event_count"), F.count(F.lit(1)).alias("row_count"))
    out = cnt.join(med, by) if by else cnt.join(F.broadcast(med))
    ready = F.col("k_calibration").isNotNull() & (F.col("event_count") >= min_events)
    return out.withColumn("status", F.when(ready, "ready_to_ship").otherwise("insufficient_validation_events"))


def record_resolution(df: DataFrame, by, time: str = "time") -> DataFrame:
    """Median step in hours per site."""
    by = listed(by)
    s = df.select(*by, secs(df, time).alias("_t")).where("_t is not null")
    d = running(s, by, "_t", {"_p": ("lag", "_t")}).withColumn("_h", (F.col("_t") - F.col("_p")) / HOUR)
    return quantiles(d, by, {"median_step_hours": ("_h", 0.5)})


def record_sources(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"))


def basin_lag(members: DataFrame, flow: DataFrame, soil: DataFrame | None, member: str = "member_id",
              peak: str = "rainfall_peak_time", start: str = "storm_start", max_h: float = 168.0, soil_h: float = 24.0) -> DataFrame:
    """Discharge peak within max_h after the rain peak, its lag, the last soil value before onset, month and season.

    `flow` is (time, discharge_cfs) at the reference gauge, `soil` is (time, value).
    """
    m = members.select(member, secs(members, peak).alias("_p"), secs(members, start).alias("_s")).where("_p is not null")
    q = flow.select(secs(flow, "time").alias("_t"), finite("discharge_cfs").alias("_q")).where("_q is not null")
    w = m.withColumn("_hi", F.col("_p") + max_h * HOUR)
    best = interval_join(w, q, "_p", "_hi", "_t", width=max_h * HOUR).groupBy(member, "_p", "_s").agg(
        F.max(F.struct(F.col("_q").alias("q"), (-F.col("_t")).alias("nt"))).alias("m"))
    out = best.select(member, "_p", F.coalesce("_s", "_p").alias("_a"), (-F.col("m.nt")).alias("_dt"), F.col("m.q").alias("observed_peak_discharge_cfs"))
    if soil is not None:
        s = soil.select(secs(soil, "time").alias("_st"), finite("value").alias("_sv")).where("_sv is not null")
        out = asof(out, s.withColumn("_when", F.col("_st")), "_a", "_st", ["_when", "_sv"])
        out = out.withColumn("antecedent_soil_moisture", F.when(F.col("_a") - F.col("_when") <= soil_h * HOUR, F.col("_sv")))
    else:
        out = out.withColumn("antecedent_soil_moisture", F.lit(None).cast("double"))
    month = F.month(F.timestamp_seconds("_p"))
    return out.select(member, F.col("_p").alias("rainfall_peak"), F.col("_dt").alias("discharge_peak"),
                      ((F.col("_dt") - F.col("_p")) / HOUR).alias("basin_lag_hours"), "observed_peak_discharge_cfs",
                      "antecedent_soil_moisture", month.alias("month"), season(month).alias("season"))


def merge_discharge(parts: DataFrame, by, priority: str = "priority", time: str = "time") -> DataFrame:
    """One value per source and instant; the part with the highest priority wins."""
    by = listed(by)
    rest = [c for c in parts.columns if c not in by + [time]]
    best = parts.groupBy(*by, time).agg(F.max(F.struct(priority, *[c for c in rest if c != priority])).alias("m"))
    return best.select(*by, time, *[F.col(f"m.{c}").alias(c) for c in rest if c != priority])


def area_weights(points: DataFrame, by=None, area: str = "uparea") -> DataFrame:
    """Share of drainage area per source; equal shares when no area is known."""
    by = listed(by)
    v = F.coalesce(finite(area), F.lit(0.0))
    tot = points.groupBy(*by).agg(F.sum(v).alias("_a"), F.count(F.lit(1)).alias("_n"))
    j = points.join(tot, by) if by else points.join(F.broadcast(tot))
    return j.withColumn("weight", F.when(F.col("_a") > 0, v / F.col("_a")).otherwise(1.0 / F.col("_n"))).drop("_a", "_n")


def event_peak_discharge(catalog: DataFrame, q: DataFrame, event: str = "event_id", source: str = "source_id", time: str = "time",
                         flow: str = "q") -> DataFrame:
    """Catalogue rows with the peak of summed discharge, the largest source peak and the source count."""
    by_t = q.groupBy(event, time).agg(F.sum(finite(flow)).alias("_tot"), F.max(finite(flow)).alias("_max"))
    peak = by_t.groupBy(event).agg(F.max("_tot").alias("peak_discharge_m3s"), F.max("_max").alias("max_source_peak_discharge_m3s"))
    n = q.select(event, source).distinct().groupBy(event).agg(F.count(F.lit(1)).alias("handoff_source_count"))
    return catalog.join(peak.join(n, event), event, "left")


def amplify(q: DataFrame, targets: DataFrame, band: tuple[float, float] = (0.25, 4.0), k_constant: float | None = None,
            event: str = "event_id", flow: str = "q") -> DataFrame:
    """One factor per event and the scaled series: a constant, or target / simulated peak, with its status.

    `targets` has event, target_cms and simulated_peak_cms; both may be null.
    """
    t, s = finite("target_cms"), finite("simulated_peak_cms")
    if k_constant is not None:
        inside = band[0] <= k_constant <= band[1]
        k = F.lit(float(k_constant))
        status = F.lit("calibration_constant" if inside else "calibration_constant_out_of_band")
    else:
        raw = F.when((t > 0) & (s > 0), t / s)
        k = F.coalesce(raw, F.lit(1.0))
        status = (F.when(F.coalesce(t, F.lit(0.0)) == 0, "no_target").when(raw.isNull(), "no_simulated_peak")
                  .when(raw.between(*band), "applied").otherwise("applied_out_of_band"))
    f = targets.select(event, k.alias("k_factor"), status.alias("status"))
    return q.join(f, event).withColumn("q_scaled", F.col(flow) * F.col("k_factor"))


def baseflow_check(q: DataFrame, obs: DataFrame, areas: DataFrame, reference_area: float, statistic: str = "median",
                   fraction: float = 0.25, source: str = "source_id", flow: str = "q", obs_flow: str = "discharge_cfs") -> DataFrame:
    """Smallest simulated flow of each source against observed baseflow scaled by drainage area."""
    if statistic == "annual_mean":
        base = obs.agg(F.avg(finite(obs_flow)).alias("_b"))
    else:
        base = quantiles(obs, None, {"_b": (obs_flow, 0.10 if statistic == "q90" else 0.5)})
    low = q.groupBy(source).agg(F.min(finite(flow)).alias("simulated_baseflow_cms"))
    j = areas.where(F.col("uparea") > 0).join(low, source).join(F.broadcast(base))
    exp = F.col("_b") * CFS_TO_CMS * F.col("uparea") / float(reference_area)
    return j.select(source, exp.alias("observed_baseflow_cms"), "simulated_baseflow_cms",
                    F.when(F.col("simulated_baseflow_cms") >= fraction * exp, "passed").otherwise("failed").alias("status"))


def boundary_qa(q: DataFrame, expected: DataFrame, window: tuple[float, float], event: str = "event_id", source: str = "source_id",
                time: str = "time", flow: str = "q") -> DataFrame:
    """Per event: positive peak, expected sources present and none stale, window covered."""
    t = secs(q, time)
    by_t = q.groupBy(event, t.alias("_t")).agg(F.sum(finite(flow)).alias("_tot"))
    span = by_t.groupBy(event).agg(F.max("_tot").alias("peak_m3s"), F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    found = q.select(event, source).distinct().withColumn("_f", F.lit(1))
    want = expected.select(event, source).distinct().withColumn("_w", F.lit(1))
    ids = found.join(want, [event, source], "full").groupBy(event).agg(
        F.count_if(F.col("_f").isNull()).alias("missing_sources"), F.count_if(F.col("_w").isNull()).alias("stale_sources"))
    ok = lambda c: F.when(c, "passed").otherwise("failed")
    return span.join(ids, event).select(
        event, "peak_m3s", "missing_sources", "stale_sources",
        ok(F.col("peak_m3s") > 0).alias("event_peak"),
        ok((F.col("missing_sources") == 0) & (F.col("stale_sources") == 0)).alias("source_ids"),
        ok((F.col("_a") <= window[0]) & (F.col("_z") >= window[1])).alias("time_coverage"))


def shape_duplicates(q: DataFrame, limit: float = 0.9999, event: str = "event_id", source: str = "source_id", time: str = "time",
                     flow: str = "q", grid: float = 0.05) -> DataFrame:
    """Source pairs of an event whose min-max scaled hydrographs correlate at `limit` or more.

    Two standardised shapes with correlation r differ by sqrt(2 (1 - r)) in norm, so any fixed projection of
    near-duplicates differs by no more. Pairs are formed only inside one event, between sources whose
    projection on a hashed direction falls in the same or the next bucket of that width, then checked exactly.
    """
    s = q.groupBy(event, source, time).agg(F.avg(finite(flow)).alias("_v")).where("_v is not null")
    st = s.groupBy(event, source).agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_d"), F.count(F.lit(1)).alias("_n"))
    z = s.join(st.where("_d > 0"), [event, source]).withColumn("_z", (F.col("_v") - F.col("_m")) / (F.col("_d") * F.sqrt("_n")))
    # A unit direction per event: hashed weights normalised over its instants.
    g = (F.pmod(F.xxhash64(F.col(time).cast("string")), F.lit(2001)) - 1000) / 1000.0
    norm = s.select(event, time).distinct().groupBy(event).agg(F.sqrt(F.sum(g * g)).alias("_gn"))
    proj = z.groupBy(event, source, "_n").agg(F.sum(F.col("_z") * g).alias("_p")).join(norm, event).withColumn(
        "_p", F.col("_p") / F.greatest("_gn", F.lit(1e-12)))
    width = max(float(grid), (2.0 * (1.0 - limit)) ** 0.5 * 1.01)
    b = proj.withColumn("_b", F.floor(F.col("_p") / width)).select(event, source, "_n", "_p", "_b")
    right = b.select(event, F.col(source).alias("_o"), F.col("_n").alias("_on"), F.col("_p").alias("_op"),
                     F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    near = b.join(right, [event, "_b"]).where((F.col(source) < F.col("_o")) & (F.col("_n") == F.col("_on")) & (
        F.abs(F.col("_p") - F.col("_op")) <= width)).select(event, source, "_o")
    mine = z.select(event, source, time, "_z")
    theirs = z.select(event, F.col(source).alias("_o"), time, F.col("_z").alias("_oz"))
    dot = near.join(mine, [event, source]).join(theirs, [event, "_o", time]).groupBy(event, source, "_o").agg(
        F.sum(F.col("_z") * F.col("_oz")).alias("correlation"))
    # Flat hydrographs of one length have one shape: each is paired with the first of them.
    flat = st.where("_d = 0").select(event, source, "_n")
    first = flat.groupBy(event, "_n").agg(F.min(source).alias("_a"))
    flats = flat.join(first, [event, "_n"]).where(F.col(source) > F.col("_a")).select(
        event, F.col("_a").alias(source), F.col(source).alias("_o"), F.lit(1.0).alias("correlation"))
    return dot.where(F.col("correlation") >= limit).unionByName(flats).withColumnRenamed("_o", "other_source")


def initial_depth(q: DataFrame, hours: float, reference_q: float, reference_depth: float, lo: float, hi: float, by,
                  source: str = "source_id", time: str = "time", flow: str = "q") -> DataFrame:
    """Channel depth proxy: mean of source means over the first hours, square-root scaled and clipped."""
    by = listed(by)
    s = q.select(*by, source, secs(q, time).alias("_t"), finite(flow).alias("_q"))
    first = s.groupBy(*by).agg(F.min("_t").alias("_t0"))
    head = s.join(first, by).where(F.col("_t") <= F.col("_t0") + hours * HOUR)
    per = head.groupBy(*by, source).agg(F.avg("_q").alias("_m"))
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("source_count"), F.greatest(F.avg("_m"), F.lit(0.0)).alias("mean_q"))
    raw = F.sqrt(F.col("mean_q") / max(reference_q, 1e-6)) * max(reference_depth, 0.0)
    return out.withColumn("raw_depth_m", raw).withColumn("initial_depth_m", clip(raw, lo, hi))


def lookback_summary(events: DataFrame, series: DataFrame, hours: float = 24.0, by=None, event: str = "event_id",
                     at: str = "time", time: str = "time", value: str = "value") -> DataFrame:
    """Mean, min, max and rows of the series in the hours before each event (both ends included).

    Events at one instant share a window, and windows are put together from runs of instants with known totals.
    """
    by = listed(by)
    e = events.select(*by, event, secs(events, at).alias("_hi")).withColumn("_lo", F.col("_hi") - hours * HOUR)
    s = series.select(*by, secs(series, time).alias("_t"), finite(value).alias("_v")).where("_t is not null")
    first = {"_sum": F.sum("_v"), "min_value": F.min("_v"), "max_value": F.max("_v"), "row_count": F.count("_v")}
    again = {"_sum": F.sum("_sum"), "min_value": F.min("min_value"), "max_value": F.max("max_value"), "row_count": F.sum("row_count")}
    got = range_fold(e, s, "_lo", "_hi", "_t", first, again, by)
    # An event that stands several times has one row, over the rows of all its windows.
    return e.join(got, [*by, "_lo", "_hi"]).groupBy(*by, event).agg(
        (F.sum("_sum") / over(F.sum("row_count"))).alias("mean_value"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.sum("row_count").alias("row_count"))
