"""Peaks, event counts, trends and component splits of driver time series.

Series are long frames: key columns `by`, a time column (timestamp or seconds) and a value column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mathx import erf
from ..kit.blocks import quantiles, row_numbers, running
from ..kit.common import DAY, HOUR, YEAR, cut, finite, from_secs, listed, over, secs
from ..kit.dominance import count_exceeding
from ..kit.intervals import interval_join
from ..kit.sessions import anchored_events, greedy_peaks, sessions

# Groups up to this size may be paired row by row; larger ones use counting.
PAIR_ROWS = 2_000


def _clean(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    return df.select(*by, secs(df, time).alias("_t"), finite(value).alias("_v")).where(
        "_t is not null and _v is not null")


def _back(out: DataFrame, like: DataFrame, by: list[str], time: str, value: str, *more: str) -> DataFrame:
    return out.select(*by, from_secs(like, time, F.col("_t")).alias(time), F.col("_v").alias(value), *more)


def _keyed(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Attach per-group facts; a single ungrouped fact row goes along as a broadcast."""
    return left.join(right, by) if by else left.join(F.broadcast(right))


def annual_mean(df: DataFrame, by=None, time: str = "time", value: str = "value",
                min_count: int = int(0.75 * 365.25 * 24)) -> DataFrame:
    """Yearly mean and count of finite values, years with too few dropped."""
    by = listed(by)
    return df.groupBy(*by, F.year(F.col(time)).alias("year")).agg(
        F.avg(finite(value)).alias("mean"), F.count(finite(value)).alias("count")).where(F.col("count") >= min_count)


def theil_sen(df: DataFrame, x: str, y: str, by=None, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Median of pairwise slopes and the least-squares slope per group: (by, slope, ols_slope, n).

    Small groups (annual means) are paired. If any group is larger, the median is found by bisection
    on the slope, each step counting smaller slopes as exceedances instead of forming pairs.
    """
    by = listed(by)
    pts = cut(df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).dropna(subset=["_x", "_y"]))
    ols = pts.groupBy(*by).agg(F.regr_slope("_y", "_x").alias("ols_slope"), F.count(F.lit(1)).alias("n"))
    biggest = ols.agg(F.max("n")).first()[0] or 0
    if biggest <= pair_rows:
        # Equal x carries no slope; partners meet on the group key, at most pair_rows each.
        a = pts.select(*by, F.collect_list(F.struct("_x", "_y")).over(Window.partitionBy(*by) if by else Window.partitionBy(
            F.lit(1))).alias("_all"), "_x", "_y")
        p = a.withColumn("_o", F.explode("_all")).where(F.col("_o._x") > F.col("_x")).select(
            *by, ((F.col("_o._y") - F.col("_y")) / (F.col("_o._x") - F.col("_x"))).alias("_s"))
        med = quantiles(p, by, {"slope": ("_s", 0.5)})
    else:
        med = _slope_by_counting(pts, by)
    return (ols.join(med, by, "left") if by else ols.join(F.broadcast(med))).select(*by, "slope", "ols_slope", "n")


def _slope_by_counting(pts: DataFrame, by: list[str], steps: int = 70) -> DataFrame:
    key = by or ["_g"]
    p = pts if by else pts.withColumn("_g", F.lit(1))
    p = cut(p.withColumn("_id", F.monotonically_increasing_id()))
    xs = p.select(*key, "_x").distinct()
    dx = running(xs, key, "_x", {"_px": ("lag", "_x")}).groupBy(*key).agg(F.min(F.col("_x") - F.col("_px")).alias("_dx"))
    tot = count_exceeding(p.select("_id", *key, "_x"), p.select(*key, "_x"), "_id", ["_x"], key).groupBy(*key).agg(
        F.sum("n_exceeding").alias("_pairs"))
    span = p.groupBy(*key).agg((F.max("_y") - F.min("_y")).alias("_r"))
    both = dx.join(span, key).join(tot, key).where("_pairs > 0").select(
        *key, "_pairs", F.explode(F.array(F.lit(0), F.lit(1))).alias("_half"), (F.col("_r") / F.col("_dx") + 1e-9).alias("_b"))
    # Bracket of the lower and upper middle slope (0-based ranks floor and ceil of (pairs - 1) / 2).
    br = cut(both.select(*key, "_half", F.floor((F.col("_pairs") - 1 + F.col("_half")) / 2).alias("_k"),
                         (-F.col("_b")).alias("_lo"), F.col("_b").alias("_hi")))
    for _ in range(steps):
        mid = br.withColumn("_m", (F.col("_lo") + F.col("_hi")) / 2)
        z = p.join(mid.select(*key, "_half", "_m"), key).select(
            "_id", *key, "_half", "_x", (F.col("_m") * F.col("_x") - F.col("_y")).alias("_nz"))
        less = count_exceeding(z, z.drop("_id"), "_id", ["_x", "_nz"], key + ["_half"]).groupBy(*key, "_half").agg(
            F.sum("n_exceeding").alias("_c"))
        low = F.col("_c") <= F.col("_k")
        br = cut(mid.join(less, key + ["_half"]).select(*key, "_half", "_k", F.when(low, F.col("_m")).otherwise(F.col("_lo")).alias("_lo"),
                                                     F.when(low, F.col("_hi")).otherwise(F.col("_m")).alias("_hi")))
    return br.groupBy(*by).agg(F.avg((F.col("_lo") + F.col("_hi")) / 2).alias("slope"))


def detrend(df: DataFrame, slope, ref: float, time: str = "time", value: str = "value", out: str = "detrended") -> DataFrame:
    """value - slope * (decimal year - ref); `slope` is a number or a column."""
    year = F.year(F.col(time)) + (F.dayofyear(F.col(time)) - 1.0) / 365.25
    return df.withColumn(out, F.col(value) - (slope if not isinstance(slope, (int, float)) else F.lit(float(slope))) * (year - ref))


def mann_kendall(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Kendall tau-b and its normal-approximation p per group, with a verdict; counts, not pairs."""
    by = listed(by)
    p = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).dropna(subset=["_x", "_y"])
    # Equal rows are weighted, not repeated.
    p = cut(p.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("_k")).withColumn("_id", F.monotonically_increasing_id()))
    beyond = count_exceeding(p.select("_id", *by, "_x", "_y"), p, "_id", ["_x", "_y"], by, weight="_k")
    con = beyond.join(p.select("_id", "_k"), "_id").groupBy(*by).agg(F.sum(F.col("_k") * F.col("n_exceeding")).alias("_con"))

    def ties(cols, name):
        c = p.groupBy(*by, *cols).agg(F.sum("_k").alias("c"))
        return c.groupBy(*by).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(name),
                                  F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias(name + "v"))

    base = p.groupBy(*by).agg(F.sum("_k").alias("n"))
    for part in (con, ties(["_x"], "_tx"), ties(["_y"], "_ty"), ties(["_x", "_y"], "_txy")):
        base = base.join(part, by) if by else base.join(F.broadcast(part))
    # A pair either rises, falls, or ties in one or both.
    base = base.withColumn("_dis", F.col("n") * (F.col("n") - 1) / 2 - F.col("_con") - F.col("_tx") - F.col("_ty") + F.col("_txy"))
    n = F.col("n")
    n0 = n * (n - 1) / 2
    s = F.col("_con") - F.col("_dis")
    tau = s / over(F.sqrt((n0 - F.col("_tx")) * (n0 - F.col("_ty"))))
    var = (n * (n - 1) * (2 * n + 5) - F.col("_txv") - F.col("_tyv")) / 18.0
    pval = 1.0 - erf(F.abs(s) / over(F.sqrt(var)) / F.sqrt(F.lit(2.0)))
    verdict = F.when(pval.isNull() | (pval >= 0.05), "no detectable trend").when(s > 0, "rising trend").otherwise("falling trend")
    return base.select(*by, n.cast("bigint").alias("n"), tau.alias("tau"), pval.alias("p_value"), verdict.alias("verdict"))


def pot_peaks(df: DataFrame, by=None, time: str = "time", value: str = "value", threshold: float | None = None,
              q: float = 0.98, sep_h: float = 120.0) -> DataFrame:
    """Declustered peaks over a threshold (value > threshold), largest first, at least sep_h apart."""
    by = listed(by)
    s = _clean(df, by, time, value)
    if threshold is None:
        over = _keyed(s, quantiles(s, by, {"_thr": ("_v", q)}), by).where("_v > _thr").drop("_thr")
    else:
        over = s.where(F.col("_v") > float(threshold))
    return _back(greedy_peaks(over, by, "_t", "_v", sep_h * HOUR), df, by, time, value)


def calibrate_threshold(df: DataFrame, rate: float, by=None, time: str = "time", value: str = "value",
                        sep_h: float = 120.0, search_q: float = 0.90) -> DataFrame:
    """The peaks a target yearly rate asks for: (by, time, value, threshold, record_years).

    Greedy order is value order, so the first n kept peaks are the n largest of all kept peaks.
    """
    by = listed(by)
    s = _clean(df, by, time, value)
    span = s.groupBy(*by).agg(((F.max("_t") - F.min("_t")) / YEAR).alias("record_years"))
    over = _keyed(s, quantiles(s, by, {"_thr": ("_v", search_q)}), by).where("_v > _thr").drop("_thr")
    kept = greedy_peaks(over, by, "_t", "_v", sep_h * HOUR).withColumn("_down", -F.col("_v"))
    ranked = _keyed(row_numbers(kept, by, "_down", "_t", "_rk"), span, by)
    want = F.greatest(F.lit(1.0), F.rint(F.lit(float(rate)) * F.col("record_years")))
    top = ranked.where(F.col("_rk") <= want)
    thr = top.groupBy(*by).agg(F.min("_v").alias("threshold"))
    return _back(_keyed(top, thr, by), df, by, time, value, "threshold", "record_years")


def rank_storms(df: DataFrame, u: float, tau_h: float, by=None, top_n: int | None = None,
                time: str = "storm_date", value: str = "mean") -> DataFrame:
    """Storms with value >= u, declustered; rank over the record and within each calendar year."""
    by = listed(by)
    s = _clean(df, by, time, value).where(F.col("_v") >= float(u))
    kept = greedy_peaks(s, by, "_t", "_v", tau_h * HOUR).withColumn("_down", -F.col("_v"))
    ranked = row_numbers(kept, by, "_down", "_t", "por_rank")
    if top_n is not None:
        ranked = ranked.where(F.col("por_rank") <= int(top_n))
    yearly = ranked.withColumn("year", F.year(F.timestamp_seconds("_t")))
    # One row per kept storm and at least tau apart, so a year is a small group.
    w = Window.partitionBy(*by, "year").orderBy("por_rank")
    yearly = yearly.withColumn("annual_rank", F.row_number().over(w).cast("bigint"))
    return _back(yearly, df, by, time, value, "por_rank", "annual_rank")


def distinct_event_rate(peaks: DataFrame, sep_h: float, years: float, by=None, time: str = "time") -> DataFrame:
    """Storms per year over the union of peak times; one ends sep_h after its first counted peak."""
    by = listed(by)
    t = peaks.select(*by, secs(peaks, time).alias("_t")).where("_t is not null")
    n = anchored_events(t, by, "_t", sep_h * HOUR, "distinct_events")
    return n.withColumn("events_per_year", F.col("distinct_events") / F.lit(float(years)))


def dedupe_events(df: DataFrame, sep_h: float, rank_col: str, by=None, time: str = "event_time") -> DataFrame:
    """One row per chain of rows closer than sep_h to the row before: highest rank_col, earliest on ties."""
    by = listed(by)
    tagged = sessions(df.withColumn("_t", secs(df, time)), by, "_t", sep_h * HOUR, "_s")
    # A reduction, not a window: the winner of a long chain is found with map-side combine.
    best = tagged.groupBy(*by, "_s").agg(F.max(F.struct(
        F.col(rank_col).alias("r"), (-F.col("_t")).alias("nt"), F.struct(*df.columns).alias("row"))).alias("m"))
    return best.select("m.row.*")


def local_peaks(df: DataFrame, min_dist: int, by=None, time: str = "time", value: str = "value") -> DataFrame:
    """Local maxima (plateaus by their midpoint) at least min_dist samples apart, highest first."""
    by = listed(by)
    s = _clean(df, by, time, value)
    idx = cut(row_numbers(s, by, "_t", name="_i"))
    # Plateaus: runs of equal value. A run is a peak when both neighbours exist and are lower.
    step = cut(running(idx, by, "_i", {"_prev": ("lag", "_v"), "_next": ("lead", "_v")}))
    starts = step.where("_prev is null or _prev <> _v").select(*by, "_i", "_v", "_prev", F.lit(0).alias("_end"))
    ends = step.where("_next is null or _next <> _v").select(*by, "_i", "_v", "_next", F.lit(1).alias("_end"))
    marks = starts.unionByName(ends, allowMissingColumns=True)
    paired = running(marks, by, "_i", {"_s": ("last", F.when(F.col("_end") == 0, F.struct(
        F.col("_i").alias("i"), F.col("_prev").alias("p"))))}, tie="_end").where("_end = 1")
    tops = paired.where((F.col("_s.p") < F.col("_v")) & (F.col("_next") < F.col("_v"))).select(
        *by, F.floor((F.col("_s.i") + F.col("_i")) / 2).cast("double").alias("_i"), "_v")
    kept = greedy_peaks(cut(tops), by, "_i", "_v", float(max(1, min_dist)))
    at = idx.select(*by, F.col("_i").cast("double").alias("_i"), "_t")
    return _back(kept.join(at, by + ["_i"]), df, by, time, value)


def paired_peaks(series: DataFrame, driver: str = "driver", time: str = "time", value: str = "value",
                 drivers: list[str] | None = None, sep_h: float = 120.0, pair_h: float = 72.0, q: float = 0.98,
                 rate: float | None = None, dropna: bool = True) -> DataFrame:
    """Peaks of each driver with the largest value of every other driver within pair_h (earliest on ties).

    One row per (conditioned_on, event_time) with `<driver>` and `<driver>_time` columns.
    """
    names = drivers or [r[0] for r in series.select(driver).distinct().orderBy(driver).collect()]
    if rate is not None:
        peaks = calibrate_threshold(series, rate, [driver], time, value, sep_h)
    else:
        peaks = pot_peaks(series, [driver], time, value, None, q, sep_h)
    p = peaks.select(F.col(driver).alias("conditioned_on"), secs(peaks, time).alias("_e"), F.col(value).alias("_pv"))
    p = cut(p.withColumn("_lo", F.col("_e") - pair_h * HOUR).withColumn("_hi", F.col("_e") + pair_h * HOUR))
    s = _clean(series, [driver], time, value)
    near = interval_join(p, s, "_lo", "_hi", "_t", width=2 * pair_h * HOUR).where(F.col(driver) != F.col("conditioned_on"))
    best = near.groupBy("conditioned_on", "_e", driver).agg(
        F.max(F.struct(F.col("_v").alias("v"), (-F.col("_t")).alias("nt"))).alias("m"))
    own = p.select("conditioned_on", "_e", F.col("conditioned_on").alias(driver),
                   F.struct(F.col("_pv").alias("v"), (-F.col("_e")).alias("nt")).alias("m"))
    rows = best.unionByName(own)
    wide = rows.groupBy("conditioned_on", "_e").agg(
        *[F.max(F.when(F.col(driver) == n, F.col("m"))).alias(f"_m{i}") for i, n in enumerate(names)])
    out = wide.select(from_secs(series, time, F.col("_e")).alias("event_time"), "conditioned_on",
                      *[F.col(f"_m{i}.v").alias(n) for i, n in enumerate(names)],
                      *[from_secs(series, time, -F.col(f"_m{i}.nt")).alias(f"{n}_time") for i, n in enumerate(names)])
    return out.dropna(subset=names) if dropna else out


# Speeds of main tidal constituents, degrees per hour.
TIDE_SPEEDS = {
    "M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K2": 30.0821373,
    "K1": 15.0410686, "O1": 13.9430356, "P1": 14.9589314, "Q1": 13.3986609,
}


def split_components(df: DataFrame, by=None, time: str = "time", value: str = "value", half_days: float = 15.0,
                     min_obs: int = 200, speeds: dict[str, float] | None = None) -> DataFrame:
    """wl = msl + tide + ntr: centred moving mean, least-squares harmonics of the rest, and the residual.

    The moving mean uses time cells with copies for both neighbours, so a long record splits into many
    tasks. The harmonic fit is one aggregation of products per series; only the small normal equations
    of each series are solved, inside a grouped task.
    """
    by = listed(by)
    speeds = speeds or TIDE_SPEEDS
    s = _clean(df, by, time, value).groupBy(*by, "_t").agg(F.avg("_v").alias("_v"))
    msl = rolling_range(s, by, "_t", -half_days * DAY, half_days * DAY,
                        {"msl": F.avg("_v"), "_n": F.count("_v")}).where(F.col("_n") >= min_obs).drop("_n")
    waves = [F.lit(1.0)]
    for w in speeds.values():
        arg = F.radians(F.col("_t") / HOUR * float(w))
        waves += [F.cos(arg), F.sin(arg)]
    basis = cut(msl.withColumn("_y", F.col("_v") - F.col("msl")).withColumn("_w", F.array(*waves)))
    m = len(waves)
    terms = [F.sum(F.col("_w")[i] * F.col("_w")[j]).alias(f"_a{i}_{j}") for i in range(m) for j in range(i, m)]
    rhs = [F.sum(F.col("_w")[i] * F.col("_y")).alias(f"_b{i}") for i in range(m)]
    key = by or ["_g"]
    b = basis if by else basis.withColumn("_g", F.lit(1))
    moments = b.groupBy(*key).agg(F.array(*terms).alias("_a"), F.array(*rhs).alias("_b"))
    coef = solve_symmetric(moments, key, m)
    fitted = b.join(F.broadcast(coef) if not by else coef, key)
    tide = F.aggregate(F.zip_with("_w", "_coef", lambda a, c: a * c), F.lit(0.0), lambda acc, x: acc + x)
    out = fitted.withColumn("tide", tide).withColumn("ntr", F.col("_y") - F.col("tide"))
    return out.select(*by, from_secs(df, time, F.col("_t")).alias(time), F.col("_v").alias("wl"), "msl", "tide", "ntr")


def solve_symmetric(moments: DataFrame, key: list[str], m: int) -> DataFrame:
    """Solve the packed symmetric system (_a upper triangle, _b) of each row into `_coef`; one small row per series."""
    schema = moments.select(*key).schema.add("_coef", T.ArrayType(T.DoubleType()))

    def solve(batches):
        import numpy as np
        import pandas as pd

        rows, cols = np.triu_indices(m)
        for pdf in batches:
            out = []
            for a, b in zip(pdf["_a"], pdf["_b"]):
                full = np.zeros((m, m))
                full[rows, cols] = a
                full[cols, rows] = a
                out.append(np.linalg.lstsq(full, np.asarray(b, dtype=float), rcond=None)[0].tolist())
            yield pd.concat([pdf[key].reset_index(drop=True), pd.Series(out, name="_coef", dtype=object)], axis=1)

    return moments.mapInPandas(solve, schema)


def rolling_range(df: DataFrame, by, t: str, lo: float, hi: float, aggs: dict) -> DataFrame:
    """Add window aggregates over rows with time in [t + lo, t + hi], cut into time cells.

    A row is copied to the cells whose rows it can serve (at most two for the cell width used).
    """
    by = listed(by)
    width = max((hi - lo) * 2.0, 1e-6)
    own = F.floor(F.col(t) / width)
    spread = F.explode(F.sequence(F.floor((F.col(t) - hi) / width), F.floor((F.col(t) - lo) / width)))
    halo = df.withColumn("_own", own).withColumn("_c", spread)
    # Microsecond integers keep the range bounds exact.
    w = Window.partitionBy(*by, "_c").orderBy("_us").rangeBetween(int(round(lo * 1e6)), int(round(hi * 1e6)))
    halo = halo.withColumn("_us", F.round(F.col(t) * 1e6).cast("bigint"))
    out = halo.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.where("_c = _own").drop("_c", "_own", "_us")


def recombine_level(components: DataFrame, events: DataFrame, by=None, time: str = "time", event: str = "event_id",
                    peak: str = "peak_time", scale: str = "ntr_scale", shift: str = "msl_shift",
                    half_h: float = 72.0) -> DataFrame:
    """msl + shift + tide + K * ntr within half_h of each event's peak, first row per duplicate instant."""
    by = listed(by)
    c = components.groupBy(*by, secs(components, time).alias("_t")).agg(
        *[F.min(F.struct("msl", "tide", "ntr")).alias("_c")])
    e = events.select(*by, event, secs(events, peak).alias("_p"), F.col(scale).alias("_k"), F.col(shift).alias("_s"))
    e = e.withColumn("_lo", F.col("_p") - half_h * HOUR).withColumn("_hi", F.col("_p") + half_h * HOUR)
    j = interval_join(e, c, "_lo", "_hi", "_t", by, width=2 * half_h * HOUR)
    level = F.col("_c.msl") + F.col("_s") + F.col("_c.tide") + F.col("_k") * F.col("_c.ntr")
    return j.select(*by, event, from_secs(components, time, F.col("_t")).alias(time),
                    ((F.col("_t") - F.col("_p")) / HOUR).alias("relative_hour"), level.alias("water_level"))
