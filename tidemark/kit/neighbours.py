"""Exact k nearest members in several dimensions through a tree of boxes over a space-filling order.

Members are sorted by the interleaved bits of their quantile numbers (a Morton key), cut into leaves of equal size, and leaves are
gathered eight at a time into nodes with the box of their members. All targets go down the tree in step: at each
level a target keeps the nodes whose box may hold one of its k nearest, for the nodes that lie wholly within some distance already
hold k members. Depth grows with the logarithm of the members, and a target meets the members of a few leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import row_numbers
from .common import settle

#: Members of a leaf, children of a node, bits of a quantile number.
LEAF, FAN, BITS = 16, 8, 6
#: Rows of a tree level or of the members that are told to all tasks; larger ones are joined by node.
TOLD_ROWS = 100_000


def morton(members: DataFrame, columns: list[str]) -> Column:
    """Interleaved bits of the quantile numbers of the columns; the quantiles are a few dozen numbers a column."""
    steps = [i / 2**BITS for i in range(1, 2**BITS)]
    cuts = members.agg(*[F.percentile_approx(c, steps, 4 * 2**BITS).alias(c) for c in columns]).first()
    key = F.lit(0).cast("long")
    for d, c in enumerate(columns):
        bounds = F.array(*[F.lit(float(v)) for v in cuts[c] or [0.0]])
        code = F.size(F.filter(bounds, _at_most(c)))
        for i in range(BITS):
            key = key + F.shiftleft(F.shiftright(code, i).bitwiseAND(1).cast("long"), i * len(columns) + d)
    return key


def _at_most(column: str):
    return lambda b: b <= F.col(column)


def _around(t: Column, length: float) -> tuple[Column, Column]:
    """Least and most way round from t to a box's stretch of the circle; a box with a null has a member at no way."""
    lo, hi = F.col("_ring_lo"), F.col("_ring_hi")
    way = lambda x: F.least(F.abs(t - x), F.lit(length) - F.abs(t - x))
    across = t.between(lo - length / 2, hi - length / 2) | t.between(lo + length / 2, hi + length / 2)
    least = F.when(F.col("_ring_free") | t.between(lo, hi), F.lit(0.0)).otherwise(F.least(way(lo), way(hi)))
    most = F.when(across, F.lit(length / 2)).otherwise(F.greatest(way(lo), way(hi)))
    return F.coalesce(least, F.lit(0.0)), F.coalesce(most, F.lit(0.0))


def nearest_members(targets: DataFrame, members: DataFrame, tid: str, mid: str, scale: dict[str, float], distance: Column, k: int,
                    beside: tuple[str, ...] = (), slack: float = 0.0, told_rows: int = TOLD_ROWS, ring: tuple[str, float, float] | None = None) -> DataFrame:
    """The k members nearest to each target, exact: columns of both, `distance` and `near_rank`.

    Target columns are `t_<dim>`, member columns `m_<dim>`. `distance` must lie between the Euclidean distance of the
    dimensions, each times its scale, and the root of its square plus `slack`; it may also look at the member columns `beside`.
    `ring` names one more dimension that runs in a circle, its scale and its length: the square of the way round, times the scale, is
    part of the square of `distance`, nothing where either side is null. Boxes hold it too, so unlike slack it keeps targets from far leaves.
    Ties go to the smaller member id. Members without all coordinates have no distance. A target without all coordinates
    has none either: it takes the k members of smallest id at distance 0.
    """
    dims = list(scale)
    whole = lambda p: F.coalesce(sum((F.abs(F.col(f"{p}_{d}")) for d in dims), F.lit(0.0)) < float("inf"), F.lit(False))
    around = [f"m_{ring[0]}"] if ring else []
    probes = settle(targets.withColumn("_whole", whole("t")))
    # More than k members on one spot cannot all be chosen; the rest leave before anything is sorted.
    spot = Window.partitionBy(*[f"m_{d}" for d in dims], *beside, *around).orderBy(mid)
    few = members.where(whole("m")).withColumn("_same", F.row_number().over(spot)).where(F.col("_same") <= k).drop("_same")
    few = settle(few)
    ordered = row_numbers(few.withColumn("_z", morton(few, [f"m_{d}" for d in dims] + around)), None, "_z", f"m_{dims[0]}", "_rank", then=(mid,))
    leaves = settle(ordered.withColumn("_node", F.floor((F.col("_rank") - 1) / LEAF)).drop("_rank", "_z"))

    box = [f(c).alias(f"{n}_{d}") for d in dims for f, n, c in ((F.min, "_lo", f"m_{d}"), (F.max, "_hi", f"m_{d}"))]
    again = [f(c).alias(c) for d in dims for f, c in ((F.min, f"_lo_{d}"), (F.max, f"_hi_{d}"))]
    for c in around:
        box += [F.min(c).alias("_ring_lo"), F.max(c).alias("_ring_hi"), F.max(F.col(c).isNull()).alias("_ring_free")]
        again += [F.min("_ring_lo").alias("_ring_lo"), F.max("_ring_hi").alias("_ring_hi"), F.max("_ring_free").alias("_ring_free")]
    levels = [settle(leaves.groupBy("_node").agg(*box, F.count(F.lit(1)).alias("_count")))]
    sizes = [levels[0].count()]
    while sizes[-1] > 1:
        levels.append(settle(levels[-1].groupBy(F.floor(F.col("_node") / FAN).alias("_node")).agg(*again, F.sum("_count").alias("_count"))))
        sizes.append(levels[-1].count())

    told = lambda df, n: F.broadcast(df) if n <= told_rows else df
    mine = Window.partitionBy(tid)
    # Few bytes of targets grow to many rows on the way down: a fixed number of partitions is not put together before that.
    spread = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    front = probes.where("_whole").repartition(spread, tid).withColumn("_node", F.lit(0).cast("long"))
    for level, n in list(zip(levels, sizes, strict=True))[-2::-1]:
        children = level.withColumnRenamed("_node", "_child").withColumn("_node", F.floor(F.col("_child") / FAN))
        seen = front.join(told(children, n), "_node")
        low, high = F.lit(0.0), F.lit(float(slack))
        for d, s in scale.items():
            t, lo, hi = F.col(f"t_{d}"), F.col(f"_lo_{d}"), F.col(f"_hi_{d}")
            low = low + (F.greatest(lo - t, t - hi, F.lit(0.0)) * s) ** 2
            high = high + (F.greatest(F.abs(t - lo), F.abs(t - hi)) * s) ** 2
        if ring:
            least, most = _around(F.col(f"t_{ring[0]}"), ring[2])
            low, high = low + (least * ring[1]) ** 2, high + (most * ring[1]) ** 2
        seen = seen.withColumn("_low", low).withColumn("_high", high)
        held = F.sum("_count").over(mine.orderBy("_high").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # the nodes a target still looks at
        seen = seen.withColumn("_held", held).withColumn("_reach", F.min(F.when(F.col("_held") >= k, F.col("_high"))).over(mine))
        may = F.col("_reach").isNull() | (F.col("_low") <= F.col("_reach") * (1 + 1e-9))
        front = seen.where(may).select(*probes.columns, F.col("_child").alias("_node"))
    near = front.join(told(leaves, sizes[0] * LEAF), "_node").drop("_node", "_whole").withColumn("distance", distance).where("distance is not null")
    near = near.withColumn("near_rank", F.row_number().over(mine.orderBy("distance", mid))).where(F.col("near_rank") <= k)
    first = members.orderBy(mid).limit(k).withColumn("near_rank", F.row_number().over(Window.orderBy(mid))).withColumn("_whole", F.lit(False))  # k rows
    lost = probes.where("not _whole").join(F.broadcast(first), "_whole").drop("_whole").withColumn("distance", F.lit(0.0))
    return near.unionByName(lost)
