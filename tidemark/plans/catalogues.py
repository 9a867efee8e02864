"""Catalogue builds composed from the operators: one lazy chain from records to events, members and lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kit.common import cut
from ..operators import events as V
from ..operators import extremes as X
from ..operators import peaks as P


def historical_tail(paired: DataFrame, members: DataFrame, drivers: list[str], rate: float, min_rp: float = 10.0, dedupe_h: float = 120.0,
                    value: str | None = None) -> DataFrame:
    """Observed joint-tail storms: return period from counts, one row per storm chain, nearest observed member."""
    # Equal observations count as often as they occur; the numbers hold from the checkpoint on.
    p = cut(paired.dropna(subset=drivers + ["event_time"]).withColumn("_row", F.monotonically_increasing_id()))
    # Only rows that few others exceed reach `min_rp`; a hair more than those are counted, and the return period decides.
    rp = X.and_return_period(X.and_survival(p, p, "_row", drivers, most=p.count() / (rate * min_rp) * (1 + 1e-9)), rate)
    tail = X.assign_band(p.join(rp, "_row"), "and_return_period_years").where(
        (F.col("and_return_period_years") >= min_rp) & (F.col("and_return_period_years") < float("inf")))
    kept = cut(P.dedupe_events(tail, dedupe_h, "and_return_period_years", None, "event_time"))
    near = V.nearest_member(kept.select("_row", "event_time", F.col(value or drivers[0]).alias("value")), members, "_row")
    eid = F.concat(F.lit("historical_"), F.date_format("event_time", "yyyyMMdd'T'HHmmss"))
    return kept.join(near, "_row").select(eid.alias("event_id"), "event_time", *drivers, "and_survival", F.col("and_return_period_years").alias("sample_rp_years"),
                                          "severity_band", "member_id", "value_distance", "in_window")


def build_joint(series: DataFrame, drivers: list[str], libraries: dict[str, DataFrame], n_pool: int, n_events: int, fractions: dict[str, float],
                rate_per_year: float, seed: int, driver: str = "driver", time: str = "time", value: str = "value", sep_h: float = 120.0,
                pair_h: float = 72.0, q: float = 0.98) -> dict[str, DataFrame]:
    """Joint catalogue: paired peaks -> rank pool -> joint return period -> banded selection -> analogs and lags.

    `libraries` maps a driver to members (member_id, value). Returns `events` and `drivers`.
    """
    spark = series.sparkSession
    pairs = cut(P.paired_peaks(series, driver, time, value, drivers, sep_h, pair_h, q).withColumn("_pid", F.xxhash64("event_time", "conditioned_on")))
    ucols = [f"{d}_u" for d in drivers]
    pool = cut(X.simulate_joint_pool(spark, n_pool, pairs, drivers, seed, "_pid"))
    ref = X.pseudo_obs(pairs, drivers, "_pid").select(*ucols)
    rp = X.and_return_period(X.and_survival(pool, ref, "id", ucols), rate_per_year)
    # Beyond the observed ranks the count is zero; the independence product is the finite stand-in.
    prod = F.lit(1.0)
    for u in ucols:
        prod = prod * (1.0 - F.col(u))
    banded = pool.join(rp, "id").withColumn("sample_rp_years", F.when(F.col("and_survival") > 0, F.col("and_return_period_years")).otherwise(1.0 / (rate_per_year * prod)))
    picked = cut(X.select_catalog(X.assign_band(banded, "sample_rp_years"), n_events, fractions, seed))
    events = cut(picked.withColumn("event_id", F.concat_ws("_", F.lit("joint"), F.col("id"), F.row_number().over(_per_id()))))
    parts = []
    for i, d in enumerate(drivers):
        mag = X.empirical_ppf(events.select("event_id", F.col(f"{d}_u").alias("u")), pairs.select(F.col(d).alias("v")), None, "u", "v", "x")
        parts.append(V.realize_driver(mag, libraries[d], d, "x", "value", seed + i))
    long = parts[0]
    for x in parts[1:]:
        long = long.unionByName(x)
    keep = ["event_id", "sample_rp_years", "severity_band", "and_survival", "sampling_weight", "probability_weight", *ucols]
    return {"events": events.select(*keep), "drivers": long}


def _per_id():
    from pyspark.sql import Window

    # Copies of one pool row only come from drawing with replacement, so a group is at most the catalogue size.
    return Window.partitionBy("id").orderBy("probability_weight")


def build_inland(peaks: DataFrame, members: DataFrame, n_pool: int, n_events: int, fractions: dict[str, float], rate: float, seed: int,
                 value: str = "value", driver: str = "rainfall") -> dict[str, DataFrame]:
    """One-driver catalogue: tail fit -> uniform pool -> banded selection -> scaled analogs -> timing."""
    fit = cut(X.fit_tail(peaks, None, value).select("dist", "shape", "loc", "scale"))
    pool = X.simulate_pool(peaks.sparkSession, n_pool, fit, rate, seed)
    picked = cut(X.select_catalog(pool, n_events, fractions, seed))
    events = cut(picked.withColumn("event_id", F.concat_ws("_", F.lit("inland"), F.col("id"), F.row_number().over(_per_id()))))
    long = V.realize_driver(events, members, driver, "value", "value", seed)
    return {"events": events.select("event_id", "value", F.col("return_period_years").alias("sample_rp_years"), "severity_band", "sampling_weight", "probability_weight"),
            "drivers": long}


def build_bundle(built: dict[str, DataFrame], lags: DataFrame, seed: int) -> dict[str, DataFrame]:
    """Reference bundle: events, drivers with lags, and the audit tables."""
    drv = built["drivers"].join(V.draw_lags(built["events"], lags, seed + 1), "event_id")
    ev = built["events"]
    return {"events": ev, "drivers": drv, "severity": V.severity_distribution(ev), "weights": V.weight_check(ev),
            "reuse": V.reuse_summary(drv), "scales": V.scale_quantiles(drv)}
