"""Storm-type mixtures in any number of drivers: fitted populations, joint survival, candidate pools by rate share.

A law is a table of one row per storm type. Types are a short list of names, so the law is joined to a pool as one array;
no other table of this module is broadcast. Conditioning chains of normal laws are evaluated in Arrow batches: as nested
columns each link would repeat the ones before it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mathx
from ..functions.rand import uniform
from ..kit.common import CLIP_EPS, clip, over, settle
from .extremes import assign_band, fit_tail, pseudo_obs, tail_cdf, tail_ppf

#: One prime per driver: base of its digit reversal, and root of its node sequence.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19)
DIGIT_BITS = 40
NODES = 256
CHUNK = 20_000
#: Rows times nodes that a task holds at once.
CELLS = 500_000
#: Diagonal of a factor at columns that others determine.
LEAST = 1e-6


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Normal law of an array, by the formula of the column form."""
    a = np.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + mathx.ERF_P * a)
    e = 1.0 - np.polyval([*reversed(mathx.ERF_A), 0.0], t) * np.exp(-a * a)
    return 0.5 * (1.0 + np.sign(x) * e)


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Normal quantile of an array inside (0, 1), by the formula of the column form."""
    mid = p - 0.5
    r = mid * mid
    q = np.sqrt(-2.0 * np.log(np.minimum(p, 1.0 - p)))
    tail = np.polyval(mathx.ACK_C, q) / np.polyval([*mathx.ACK_D, 1.0], q)
    centre = np.polyval(mathx.ACK_A, r) * mid / np.polyval([*mathx.ACK_B, 1.0], r)
    return np.where(np.abs(mid) <= 0.5 - 0.02425, centre, -np.sign(mid) * tail)


def digit_reversal(k: np.ndarray, base: int) -> np.ndarray:
    """Digits of k >= 0 in `base`, mirrored behind the point, half a last place up; 40 bits of k count."""
    places = math.ceil(DIGIT_BITS / math.log2(base))
    left, total = k.astype(np.int64), np.full(len(k), 0.5 / float(base) ** places)
    for i in range(places):
        left, digit = np.divmod(left, base)
        total += digit / float(base) ** (i + 1)
    return total


def _lower(flat: np.ndarray, d: int) -> np.ndarray:
    """Factors in row order of the triangle, as matrices."""
    low = np.zeros((len(flat), d, d))
    low[:, *np.tril_indices(d)] = flat
    return low


def joint_survival(u: np.ndarray, factor: np.ndarray, nodes: int) -> np.ndarray:
    """Rows' P(all drivers larger): the first driver exactly, each further one given the node's values of those before it."""
    n, d = u.shape
    if d == 1:
        return 1.0 - u[:, 0]
    low, h = _lower(factor, d), normal_ppf(np.clip(1.0 - u, 1e-12, 1 - 1e-12))
    k = np.arange(1, nodes + 1)
    seen = np.repeat((1.0 - u[:, :1]), nodes, axis=1)
    chance, y = seen.copy(), []
    for i in range(1, d):
        spot = k * math.sqrt(PRIMES[i - 1])
        tent = np.abs(2.0 * (spot - np.floor(spot)) - 1.0)
        y.append(normal_ppf(np.clip(tent * chance, 1e-12, 1 - 1e-12)))
        drift = sum(low[:, i, j, None] * y[j] for j in range(i))
        chance = normal_cdf((h[:, i, None] - drift) / low[:, i, i, None])
        seen = seen * chance
    return seen.mean(axis=1)


def survival_column(u: Column, factor: Column, nodes: int) -> Column:
    """joint_survival of arrays `u` and `factor`; null where either is null or holds a null."""

    @F.pandas_udf("double")
    def survive(u: pd.Series, factor: pd.Series) -> pd.Series:
        out = np.full(len(u), np.nan)
        live = np.array([a is not None and b is not None and not np.isnan(np.asarray(a, float)).any() for a, b in zip(u, factor)], bool)
        at = np.flatnonzero(live)
        for part in np.array_split(at, max(1, math.ceil(len(at) * nodes / CELLS))):
            if len(part):
                out[part] = joint_survival(np.stack(u.iloc[part]).astype(float), np.stack(factor.iloc[part]).astype(float), nodes)
        return pd.Series(out).astype(object).where(live, None)

    return survive(u, factor)


def point_column(k: Column, shift: Column, factor: Column) -> Column:
    """Point k of the copula: digit reversals turned on the circle by `shift`, as normal scores through the factor."""

    @F.pandas_udf("array<double>")
    def point(k: pd.Series, shift: pd.Series, factor: pd.Series) -> pd.Series:
        if not len(k):
            return pd.Series([], dtype=object)
        turn = np.stack(shift)
        d = turn.shape[1]
        w = np.stack([digit_reversal(k.to_numpy(), PRIMES[i]) for i in range(d)], axis=1) + turn
        g = normal_ppf(np.clip(w - np.floor(w), CLIP_EPS, 1 - CLIP_EPS))
        return pd.Series(list(normal_cdf(np.einsum("nij,nj->ni", _lower(np.stack(factor), d), g))))

    return point(k, shift, factor)


def gaussian_factor(df: DataFrame, u_cols: list[str], by=None) -> DataFrame:
    """Per group the factor of the normal-score correlations of `u_cols`, as array `factor` in row order of the triangle.

    A pair without a correlation (constant column, one row) counts as independent.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    d = len(u_cols)
    z = df.select(*by, *[mathx.norm_ppf(clip(F.col(c), CLIP_EPS, 1 - CLIP_EPS)).alias(f"_z{i}") for i, c in enumerate(u_cols)])
    pairs = [(i, j) for i in range(d) for j in range(i)]
    # Correlation by its parts: the built-in one divides by zero on a constant column.
    both = {(i, j): F.col(f"_z{i}").isNotNull() & F.col(f"_z{j}").isNotNull() for i, j in pairs}
    spread = {(i, j): F.var_pop(F.when(both[i, j], F.col(f"_z{i}"))) * F.var_pop(F.when(both[i, j], F.col(f"_z{j}"))) for i, j in pairs}
    out = z.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[
        F.coalesce(F.covar_pop(f"_z{i}", f"_z{j}") / over(F.sqrt(spread[i, j])), F.lit(0.0)).alias(f"_c{i}_{j}") for i, j in pairs])
    # The factor is built row by row, each entry a column of its own, so that no expression repeats the ones before it.
    for i in range(d):
        for j in range(i):
            dot = sum((F.col(f"_l{i}_{m}") * F.col(f"_l{j}_{m}") for m in range(j)), F.lit(0.0))
            out = out.withColumn(f"_l{i}_{j}", (F.col(f"_c{i}_{j}") - dot) / F.col(f"_l{j}_{j}"))
        rest = sum((F.col(f"_l{i}_{m}") * F.col(f"_l{i}_{m}") for m in range(i)), F.lit(0.0))
        out = out.withColumn(f"_l{i}_{i}", F.sqrt(F.greatest(1.0 - rest, F.lit(LEAST))))
    return out.select(*by, F.array(*[F.col(f"_l{i}_{j}") for i in range(d) for j in range(i + 1)]).alias("factor"))


def gaussian_joint_survival(df: DataFrame, eid: str, u_cols: list[str], factor: DataFrame, by=None, out: str = "and_survival",
                            nodes: int = NODES) -> DataFrame:
    """P(all drivers larger) under a Gaussian copula in any number of drivers, per row: (eid, by, out).

    `factor` comes from gaussian_factor. A row with a null value, or of a group without a factor, has a null survival.
    Repeated rows stay. The normal law is good to 1e-7, 256 nodes to some 1e-3 of the result.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    f = factor.select(*by, F.col("factor").alias("_factor"))
    x = df.select(eid, *by, F.array(*[clip(F.col(c).cast("double"), 0.0, 1.0) for c in u_cols]).alias("_u"))
    x = x.join(f, by, "left") if by else x.join(F.broadcast(f))
    return x.select(eid, *by, clip(survival_column(F.col("_u"), F.col("_factor"), nodes), 0.0, 1.0).alias(out))


def fit_mixture_law(paired: DataFrame, cols: list[str], base_rate: float, key: str, kind: str = "storm_type",
                    kinds: dict[str, str] | None = None, min_fit: int = 8, min_population: int = 20) -> DataFrame:
    """One row per storm type: n_events, rate, fitted, low_confidence, margins (a tail per driver), factor.

    A type's rate is its share of all rows times `base_rate`. Rows of no type or of type "unresolved" count in the total
    only, rows with a null driver in the rate only. Types with fewer than `min_fit` complete rows are reported unfitted.
    """
    typed = paired.where(F.col(kind).isNotNull() & (F.col(kind) != "unresolved"))
    known = typed.dropna(subset=cols)
    total = paired.agg(F.count(F.lit(1)).alias("_all"))
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    law = typed.groupBy(kind).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(whole).alias("_full")).join(F.broadcast(total))
    law = law.withColumn("rate", F.lit(float(base_rate)) * F.col("n_events") / F.col("_all"))
    for i, c in enumerate(cols):
        tail = fit_tail(known, kind, c, (kinds or {}).get(c, "pot"))
        law = law.join(tail.select(kind, F.struct("dist", "shape", "loc", "scale").alias(f"_m{i}")), kind, "left")
    u = pseudo_obs(known.select(kind, key, *cols), cols, key, kind)
    law = law.join(gaussian_factor(u, [f"{c}_u" for c in cols], kind), kind, "left")
    fitted = F.col("_full") >= min_fit
    for i in range(len(cols)):
        fitted = fitted & F.coalesce(F.col(f"_m{i}.scale") > 0, F.lit(False))
    return law.withColumn("fitted", fitted).select(
        kind, "n_events", "rate", "fitted", (~F.col("fitted") | (F.col("_full") < min_population)).alias("low_confidence"),
        F.when(F.col("fitted"), F.array(*[F.col(f"_m{i}") for i in range(len(cols))])).alias("margins"),
        F.when(F.col("fitted"), F.col("factor")).alias("factor"))


def _per_margin(rows: DataFrame, margin: Column, name: str, value) -> DataFrame:
    """Add `name`: value() under the tail in `margin`, which the tail functions read from columns of fixed names."""
    here = rows.withColumns({p: margin[p] for p in ("dist", "shape", "loc", "scale")})
    return here.withColumn(name, value()).drop("dist", "shape", "loc", "scale")


def combined_frequency(events: DataFrame, law: DataFrame, eid: str, cols: list[str], nodes: int = NODES) -> DataFrame:
    """(eid, frequency_per_year, return_period_years): rates of all fitted types times their joint survival, summed.

    Ids are unique. An event with a null driver has null results; one that no type can exceed has frequency 0 and an infinite period.
    """
    d = len(cols)
    types = law.where("fitted").agg(F.collect_list(F.struct("rate", "margins", "factor")).alias("_law"))  # bounded by the types
    x = events.select(F.col(eid).alias("_id"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    x = x.join(F.broadcast(types)).select("_id", *[f"_x{i}" for i in range(d)], F.explode("_law").alias("_p"))
    for i in range(d):
        x = _per_margin(x, F.col("_p.margins")[i], f"_u{i}", lambda i=i: tail_cdf(F.col(f"_x{i}")))
    u = F.array(*[F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_u{i}")) for i in range(d)])
    s = x.select("_id", F.col("_p.rate").alias("_rate"), survival_column(u, F.col("_p.factor"), nodes).alias("_s"))
    # A null survival makes the event's sum null.
    f = s.groupBy("_id").agg(F.when(F.count("_s") == F.count(F.lit(1)), F.sum(F.col("_rate") * F.col("_s"))).alias("frequency_per_year"))
    freq = F.col("frequency_per_year")
    return f.select(F.col("_id").alias(eid), "frequency_per_year", F.when(freq > 0, 1.0 / freq).when(
        freq.isNotNull(), F.lit(float("inf"))).alias("return_period_years"))


def simulate_mixture_pool(law: DataFrame, cols: list[str], n: int, seed: int, kind: str = "storm_type", nodes: int = NODES) -> DataFrame:
    """Candidate pool of a mixture: (id, kind, cols, <col>_u, frequency_per_year, return_period_years, severity_band).

    Each fitted type gets max(1, round(n x rate share)) rows from its own copula and tails, at points of a low-discrepancy
    sequence per driver; a row's frequency counts all types. A law without fitted types gives an empty pool.
    """
    d = len(cols)
    if d > len(PRIMES):
        raise ValueError(f"at most {len(PRIMES)} drivers")
    live = law.where("fitted")
    total = live.agg(F.sum("rate").alias("_sum"))
    share = live.join(F.broadcast(total)).withColumn("_n", F.greatest(F.lit(1), F.round(F.lit(float(n)) * F.col("rate") / over(F.col("_sum"))).cast("bigint")))
    # Rows are numbered in chunks that are dealt out first, so no type is made in one task.
    chunks = share.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / CHUNK)))).repartition(kind, "_c")
    k = F.explode(F.sequence(F.col("_c") * CHUNK + 1, F.least(F.col("_n"), (F.col("_c") + 1) * CHUNK)))
    shift = F.array(*[uniform(seed, "mixture", F.col(kind), i) for i in range(d)])
    rows = chunks.withColumn("_shift", shift).select(kind, "margins", "factor", "_shift", k.alias("_k"))
    rows = rows.select(kind, "margins", "_k", point_column(F.col("_k"), F.col("_shift"), F.col("factor")).alias("_v"))
    rows = rows.select(kind, "margins", "_k", *[clip(F.col("_v")[i], CLIP_EPS, 1 - CLIP_EPS).alias(f"_v{i}") for i in range(d)])
    for i in range(d):
        rows = _per_margin(rows, F.col("margins")[i], f"_x{i}", lambda i=i: tail_ppf(F.col(f"_v{i}")))
    pool = rows.select(F.concat_ws("-", kind, "_k").alias("id"), kind, *[F.col(f"_x{i}").alias(c) for i, c in enumerate(cols)],
                       *[F.col(f"_v{i}").alias(f"{c}_u") for i, c in enumerate(cols)])
    # Written, for the pool comes from a few rows: the planner would take it for small and tell it whole to all tasks.
    pool = settle(pool)
    return assign_band(pool.join(combined_frequency(pool, law, "id", cols, nodes), "id"), "return_period_years")
