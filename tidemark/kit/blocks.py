"""Ordered computations (rank, running sum, previous row, quantile) without one-task groups.

A plain `Window.partitionBy(key).orderBy(t)` sends a whole key to one task. Here every row first
gets an *ordered block* from approximate quantiles of the order column. Windows then run per
(key, block), and a small table with one row per (key, block) carries totals from block to block.
Results are exact: the approximate quantiles only decide where blocks are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finite, listed

# Ordered cuts: a few on a small session, more where the session plans for many shuffle partitions.
FEW, MANY, LEAF = 32, 256, 16


def cut_count(spark) -> int:
    return FEW if int(spark.conf.get("spark.sql.shuffle.partitions")) <= 2 * FEW else MANY


def _at_most(value: Column, bounds: Column, lo: int, hi: int, step: int) -> Column:
    """Number of bounds <= value as a search tree over bounds[lo:hi], in units of `step` bounds."""
    if lo == hi:
        return F.lit(lo * step)
    mid = (lo + hi) // 2
    bound = F.get(bounds, F.lit(mid * step + step - 1))
    return F.when(value >= bound, _at_most(value, bounds, mid + 1, hi, step)).otherwise(_at_most(value, bounds, lo, mid, step))


def _code(value: Column, bounds: Column, n: int) -> Column:
    """Ordered block number; a value equal to a bound has a block of its own."""
    if n <= 2 * FEW:
        idx = _at_most(value, bounds, 0, n - 1, 1)
    else:
        # Coarse tree first, then only one leaf of bounds is looked at.
        base = _at_most(value, bounds, 0, (n - 1) // LEAF, LEAF)
        idx = base + F.size(F.filter(F.slice(bounds, base + 1, F.lit(LEAF)), lambda b: b <= value))
    own = F.coalesce(F.get(bounds, idx - 1) == value, F.lit(False))
    return (2 * idx - own.cast("int")).cast("bigint")


def with_block(df: DataFrame, order: str, tie: str | None = None, n: int | None = None, name: str = "_blk") -> DataFrame:
    """Add the ordered block of each row. Hot order values are cut further along `tie`."""
    n = n or cut_count(df.sparkSession)
    steps = [i / n for i in range(1, n)]
    cols = [F.percentile_approx(F.col(order).cast("double"), steps, 4 * n).alias("v")]
    if tie is not None:
        cols.append(F.percentile_approx(F.col(tie).cast("double"), steps, 4 * n).alias("t"))
    # The cuts are one row of at most 2n numbers, so every row can carry them.
    one = df.agg(F.struct(*cols).alias("_cuts")).select("_cuts.*").toDF(*[f"_cut{i}" for i in range(len(cols))])
    df = df.join(F.broadcast(one)).withColumn(
        "_blkv", F.col(order).cast("double")).withColumn("_blkc", _code(F.col("_blkv"), F.col("_cut0"), n))
    code = F.col("_blkc")
    if tie is not None:
        # Odd numbers are values equal to a bound, the only ones that can be hot.
        inner = F.when(F.col("_blkc") % 2 == 1, _code(F.col(tie).cast("double"), F.col("_cut1"), n)).otherwise(F.lit(0))
        code = code * F.lit(2 * n + 2) + inner
    return df.withColumn(name, F.coalesce(code, F.lit(-1)).cast("bigint")).drop("_cut0", "_cut1", "_blkv", "_blkc")


def running(df: DataFrame, by, order: str, outs: dict[str, tuple[str, Column | str]],
            tie: str | None = None, n: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Add ordered columns per key. `tie` is numeric; `then` only orders rows equal on (order, tie). `outs` maps a new name to (kind, column):

    sum (inclusive running sum), total (sum over the key), last / next (nearest non-null at or
    before / at or after the row), lag / lead (value of the row before / after), max (running).
    Rows equal on (order, tie) have no fixed order among themselves.
    """
    by = listed(by)
    blocked = with_block(df, order, tie, n)
    keys = by + ["_blk"]
    place = [F.col(order)] + ([F.col(tie)] if tie else []) + [F.col(c) for c in then]

    partial, carry, final = [], [], []
    over_blocks = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = over_blocks.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    after = over_blocks.orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
    inside = Window.partitionBy(*keys).orderBy(*place)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Backwards, since a frame that ends at the last row is read anew for every row: a block's square.
    onward = Window.partitionBy(*keys).orderBy(*[c.desc() for c in place]).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    for i, (name, (kind, col)) in enumerate(outs.items()):
        c = F.col(col) if isinstance(col, str) else col
        a, p = f"_a{i}", f"_p{i}"
        boxed = F.struct(*place, c.alias("v"))
        if kind in ("sum", "total"):
            partial.append(F.sum(c).alias(a))
            if kind == "sum":
                carry.append(F.sum(a).over(before).alias(p))
                final.append((name, F.coalesce(F.col(p), F.lit(0)) + F.coalesce(F.sum(c).over(upto), F.lit(0))))
            else:
                carry.append(F.sum(a).over(over_blocks).alias(p))
                final.append((name, F.col(p)))
        elif kind == "max":
            partial.append(F.max(c).alias(a))
            carry.append(F.max(a).over(before).alias(p))
            final.append((name, F.greatest(F.col(p), F.max(c).over(upto))))
        elif kind == "last":
            partial.append(F.max(F.when(c.isNotNull(), boxed)).alias(a))
            carry.append(F.last(a, True).over(before).alias(p))
            final.append((name, F.coalesce(F.last(c, True).over(upto), F.col(p)["v"])))
        elif kind == "next":
            partial.append(F.min(F.when(c.isNotNull(), boxed)).alias(a))
            carry.append(F.first(a, True).over(after).alias(p))
            final.append((name, F.coalesce(F.last(c, True).over(onward), F.col(p)["v"])))
        elif kind == "lag":
            partial.append(F.max(boxed).alias(a))
            carry.append(F.last(a, True).over(before).alias(p))
            final.append((name, F.when(F.row_number().over(inside) == 1, F.col(p)["v"])
                          .otherwise(F.lag(c).over(inside))))
        elif kind == "lead":
            partial.append(F.min(boxed).alias(a))
            carry.append(F.first(a, True).over(after).alias(p))
            nxt = F.lead(F.struct(c.alias("v"))).over(inside)
            final.append((name, F.when(nxt.isNull(), F.col(p)["v"]).otherwise(nxt["v"])))
        else:
            raise ValueError(f"unknown running kind {kind!r}")

    table = blocked.groupBy(*keys).agg(*partial).select(*keys, *carry)
    joined = blocked.join(table, keys)
    keep = [F.col(c) for c in df.columns if c not in outs]
    return joined.select(*keep, *[c.alias(nm) for nm, c in final])


def row_numbers(df: DataFrame, by, order: str, tie: str | None = None, name: str = "rank",
                total: str | None = None, n: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """1-based rank by ascending (order, tie) per key, as `row_number` would give."""
    outs = {name: ("sum", F.lit(1).cast("bigint"))}
    if total:
        outs[total] = ("total", F.lit(1).cast("bigint"))
    return running(df, by, order, outs, tie, n, then)


def quantiles(df: DataFrame, by, wants: dict[str, tuple[str, float]], n: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key; `wants` maps output name to (column, q).

    Values are first reduced to counts, so copies cost nothing, then located by running counts.
    """
    by = listed(by)
    cols = sorted({c for c, _ in wants.values()})
    idx = {c: i for i, c in enumerate(cols)}
    boxed = F.explode(F.array(*[F.struct(F.lit(idx[c]).alias("_m"), finite(c).alias("_v")) for c in cols]))
    long = df.select(*by, boxed.alias("_s")).select(*by, "_s._m", "_s._v").where("_v is not null")
    hist = long.groupBy(*by, "_m", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cum = running(hist, by + ["_m"], "_v", {"_hi": ("sum", "_n"), "_all": ("total", "_n")}, n=n)
    aggs = []
    for name, (c, q) in wants.items():
        pos = (F.col("_all") - 1) * F.lit(float(q))
        mine = F.col("_m") == idx[c]

        def at(index):
            return F.max(F.when(mine & (F.col("_hi") - F.col("_n") <= index) & (index < F.col("_hi")), F.col("_v")))

        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        part = F.max(F.when(mine, pos - F.floor(pos)))
        aggs.append((lo + (hi - lo) * part).alias(name))
    return cum.groupBy(*by).agg(*aggs) if by else cum.agg(*aggs)
