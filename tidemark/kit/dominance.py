"""Counting points that exceed in every dimension, without comparing all pairs.

Two dimensions are cut into strips along their quantiles. A reference row that exceeds an event lies in the event's strip of the
first dimension, or in a higher one and in the event's strip of the second, or in higher ones of both. The first two are
counted strip by strip, the last from one count a pair of strips: every row is shuffled twice, whatever their number.

Before the last two, in more dimensions, the first ones are ranked; a reference row is copied to the O(log n) dyadic rank ranges that
hold it, an event to the ranges that tile the ranks above it: O((n + m) log n) rows per dimension instead of n * m.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import running
from .common import cut, listed

#: Rows of a strip that are aimed at, and limits of the number of cuts.
STRIP_ROWS, CUTS = 40_000, (8, 1000)


def count_exceeding(events: DataFrame, refs: DataFrame, eid: str, cols: list[str], by=None,
                    name: str = "n_exceeding", weight: str | None = None, strict: bool = True, most: float | None = None) -> DataFrame:
    """(eid, by, name): weighted number of refs with ref > event in every column, per group; >= in one or two columns unless `strict`.

    With `most` only events of at most that number are returned, and events without all columns are not; in two columns places
    whose higher strips hold more are left before anything is counted in them.
    """
    by = listed(by)
    if not strict and len(cols) > 2:
        raise ValueError("at most two columns with equal values counted")
    w = F.sum(weight) if weight else F.count(F.lit(1))
    r = refs.dropna(subset=cols).groupBy(*by, *[F.col(c).cast("double").alias(c) for c in cols]).agg(
        w.cast("double").alias("_w")).withColumn("_e", F.lit(None).cast(events.schema[eid].dataType))
    e = events.dropna(subset=cols).select(*by, F.col(eid).alias("_e"), *[F.col(c).cast("double").alias(c) for c in cols],
                                          F.lit(0.0).alias("_w"))
    both = cut(r.unionByName(e))
    if len(cols) == 2:
        got = _two(both, by, *cols, strict, most)
    else:
        groups = by
        for i, c in enumerate(cols[:-1]):
            both = cut(_dyadic(both, groups, c, i))
            groups = groups + [f"_l{i}", f"_k{i}"]
        # Descending order with events first on ties, so only strictly larger refs are counted.
        first, second = (0, 1) if strict else (1, 0)
        flipped = both.withColumn("_down", -F.col(cols[-1])).withColumn("_tag", F.when(F.col("_e").isNull(), second).otherwise(first))
        got = running(flipped, groups, "_down", {"_c": ("sum", "_w")}, tie="_tag").where("_e is not null")
    counts = got.groupBy("_e", *by).agg(F.sum("_c").alias("_c"))
    if most is not None and len(cols) == 2:
        out = counts.where(F.col("_c") <= most)  # every event that is left has its place among them
    else:
        base = (events if most is None else events.dropna(subset=cols)).select(F.col(eid).alias("_e"), *by)
        out = base.join(counts, ["_e"] + by, "left")
        out = out if most is None else out.where(F.coalesce("_c", F.lit(0.0)) <= most)
    return out.select(F.col("_e").alias(eid), *by, F.coalesce("_c", F.lit(0.0)).cast("bigint" if not weight else "double").alias(name))


def _two(both: DataFrame, by: list[str], x: str, y: str, strict: bool, most: float | None = None) -> DataFrame:
    """(_e, by, _c): parts of the count of each event in two dimensions, to be summed; with `most`, of events in places that may have so few."""
    n = int(min(max(both.count() // STRIP_ROWS, CUTS[0]), CUTS[1]))
    # The bounds of the strips, at most CUTS numbers an axis, go to the tasks with the function that looks them up.
    steps = [i / n for i in range(1, n)]
    bounds = both.agg(*[F.percentile_approx(c, steps, 4 * n).alias(a) for a, c in (("x", x), ("y", y))]).first()
    p = both.withColumn("_bx", _strip(F.col(x), bounds["x"])).withColumn("_by", _strip(F.col(y), bounds["y"]))
    # Odd strips hold one value, however many rows: in them no ref is larger than an event, and each is as large.
    level = lambda b: 2 * F.col(b) - F.when(F.col("_e").isNotNull() & (F.col(b) % 2 == 1), 0 if strict else 1).otherwise(0)
    p = cut(p.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), "_w", "_e", F.col("_bx").alias("_sx"), F.col("_by").alias("_sy"), level("_bx").alias("_px"), level("_by").alias("_py")))
    # Refs in higher strips of both: one row a pair of places, summed along one axis and then along the other.
    filled = p.groupBy(*by, "_px", "_py").agg(F.sum(F.when(F.col("_e").isNull(), F.col("_w")).otherwise(0.0)).alias("_w"))
    axis = lambda c, as_: filled.select(*by, F.col(c).alias(as_)).distinct()
    square = (axis("_px", "_px").join(axis("_py", "_py"), by) if by else axis("_px", "_px").crossJoin(axis("_py", "_py"))).join(filled, [*by, "_px", "_py"], "left")
    up = lambda one, along: Window.partitionBy(*by, one).orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most CUTS twice over
    square = square.withColumn("_w", F.sum("_w").over(up("_px", "_py"))).withColumn("_c", F.sum("_w").over(up("_py", "_px")))
    square = square.select(*by, "_px", "_py", F.coalesce("_c", F.lit(0.0)).alias("_c"))
    if most is not None:
        # Counts fall along both axes, so what is left lies above an edge, and so does each row that is larger than one of it.
        square = cut(square.where(F.col("_c") <= most))
        edge = square.groupBy(*by, "_px").agg(F.min("_py").alias("_least"))
        p = cut(p.join(edge if by else F.broadcast(edge), [*by, "_px"]).where(F.col("_py") >= F.col("_least")).drop("_least"))
    else:
        square = square.where("_c > 0")
    within = _in_strips(p.where("_sx % 2 = 0"), by, "_sx", F.col("_x"), F.col("_y"), strict, strict)
    beside = _in_strips(p.where("_sy % 2 = 0"), by, "_sy", F.col("_px").cast("double"), F.col("_y"), True, strict)
    far = p.where("_e is not null").join(square, [*by, "_px", "_py"]).select("_e", *by, "_c")
    return within.unionByName(beside).unionByName(far)


def _strip(value: Column, bounds: list[float] | None) -> Column:
    """Number of the strip of each value; one that equals a bound has an odd strip of its own."""
    b = np.unique(np.array(bounds or [0.0], float))

    @F.pandas_udf("bigint")
    def strip(v: pd.Series) -> pd.Series:
        v = v.to_numpy(float)
        i = np.searchsorted(b, v, "right")
        return pd.Series(2 * i - (b[np.maximum(i, 1) - 1] == v))

    return strip(value)


def _in_strips(p: DataFrame, by: list[str], strip: str, a: Column, b: Column, strict_a: bool, strict_b: bool) -> DataFrame:
    """(_e, by, _c) for events with refs in their strip that exceed in a and b; a strip has about STRIP_ROWS rows."""
    # Without nulls, which turn whole numbers into doubles in pandas: ids beyond 2^53 would no longer be told apart.
    known = F.coalesce("_e", F.lit(0).cast("long")) if p.schema["_e"].dataType.simpleString() == "bigint" else F.col("_e")
    kept = p.select(*by, strip, known.alias("_e"), "_w", F.col("_e").isNotNull().alias("_is"), a.alias("_a"), b.alias("_b"))
    keys = [*by, strip]
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def count(t: pd.DataFrame) -> pd.DataFrame:
        event = t["_is"].to_numpy(bool)
        c = exceeding(t["_a"].to_numpy(float), t["_b"].to_numpy(float), t["_w"].to_numpy(float), event, strict_a, strict_b)
        out = t.loc[event & (c > 0), ["_e", *by]]
        return out.assign(_c=c[event & (c > 0)])

    return kept.groupBy(*keys).applyInPandas(count, ", ".join(f"`{c}` {types[c]}" for c in ["_e", *by]) + ", _c double")


def exceeding(a: np.ndarray, b: np.ndarray, w: np.ndarray, event: np.ndarray, strict_a: bool, strict_b: bool) -> np.ndarray:
    """Per event the weight of the other rows larger in a and b (or equal, unless strict).

    Rows have a place by falling b. From the whole range of places to single ones, each range in order of falling a hands
    the running weight of its first half to the events of its second.
    """
    n = len(a)
    out = np.zeros(n)
    if n == 0 or event.all() or not event.any():
        return out
    first = lambda strict: ~event if strict else event  # who comes later among equals
    place = np.empty(n, np.int64)
    place[np.lexsort((first(strict_b), -b))] = np.arange(n)
    rows = np.lexsort((first(strict_a), -a))
    w = np.where(event, 0.0, w)
    spot = np.arange(n)
    for bit in range(int(n - 1).bit_length() - 1, -1, -1):
        late = (place[rows] >> bit & 1).astype(bool)
        begin = spot >> (bit + 1) << (bit + 1)
        run = np.concatenate(([0.0], np.cumsum(np.where(late, 0.0, w[rows]))))
        take = late & event[rows]
        out[rows[take]] += (run[1:] - run[begin])[take]
        # Halves part, each in its order.
        lates = np.concatenate(([0], np.cumsum(late)))
        behind = lates[:-1] - lates[begin]
        to = np.where(late, begin + (1 << bit) + behind, spot - behind)
        moved = np.empty_like(rows)
        moved[to] = rows
        rows = moved
    return out


def _dyadic(df: DataFrame, by: list[str], c: str, i: int) -> DataFrame:
    """Replace column c by dyadic range columns; refs and events meet exactly when ref > event in c."""
    vals = df.where("_e is null").groupBy(*by, c).agg(F.lit(1).cast("bigint").alias("_one"))
    rank = cut(running(vals, by, c, {"_rk": ("sum", "_one"), "_top": ("total", "_one")}).select(
        *by, F.col(c).alias("_v"), F.col("_rk"), F.col("_top")))
    marks = rank.select(*by, F.col("_v").alias("_x"), F.lit(0).alias("_tag"), "_rk", "_top")
    rest = [x for x in df.columns if x != c]
    probe = df.where("_e is not null").select(*rest, F.col(c).alias("_x"), F.lit(1).alias("_tag"))
    at = running(probe.unionByName(marks, allowMissingColumns=True), by, "_x",
                 {"_below": ("max", F.coalesce("_rk", F.lit(0)))}, tie="_tag").where("_tag = 1")
    if by:
        tops = rank.groupBy(*by).agg(F.max("_top").alias("_n"))
        at = at.join(tops, by)
    else:
        at = at.join(F.broadcast(rank.agg(F.max("_top").alias("_n"))))  # one row
    levels = lambda n: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double") + 1)).cast("int"))
    # Ranks are 1-based. Event tiles of [below + 1, n]: at level l the block ceil((below + 1) / 2^l) when odd.
    tile = F.transform(levels(F.col("_n")), lambda l: F.struct(
        l.alias("l"), F.floor((F.col("_below") + F.pow(F.lit(2.0), l)) / F.pow(F.lit(2.0), l)).alias("k")))
    ev = at.withColumn("_t", F.explode(F.filter(tile, lambda s: s["k"] % 2 == 1))).select(
        *rest, F.col("_t.l").alias(f"_l{i}"), F.col("_t.k").alias(f"_k{i}"))
    refs = df.where("_e is null").withColumnRenamed(c, "_v").join(rank, by + ["_v"])
    home = F.transform(levels(F.col("_top")), lambda l: F.struct(
        l.alias("l"), F.floor(F.col("_rk") / F.pow(F.lit(2.0), l)).alias("k")))
    rf = refs.withColumn("_t", F.explode(F.filter(home, lambda s: s["k"] % 2 == 1))).select(
        *rest, F.col("_t.l").alias(f"_l{i}"), F.col("_t.k").alias(f"_k{i}"))
    return ev.unionByName(rf)
