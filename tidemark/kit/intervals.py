"""Time-interval, as-of, nearest-point and nearest-neighbour joins on equi-join buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import row_numbers, running
from .common import cut, listed

#: Other spots that a spot may share its grid square with on average, and halvings of a side to get there.
CROWD, HALVINGS = 8, 40
#: Targets that one copy of a page of members serves, on average.
PAGE_TARGETS = 2_000
#: Runs of one level that make a run of the next.
PEAK_FAN = 4


def interval_join(left: DataFrame, right: DataFrame, lo: str, hi: str, t: str, by=None,
                  width: float = 86400.0, how: str = "inner", lo_open=False, hi_open=False) -> DataFrame:
    """Rows of `right` whose `t` lies in [lo, hi] of a `left` row (numeric seconds).

    Both sides meet on (key, time bucket); the exact bounds are a residual predicate.
    """
    by = listed(by)
    lb = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    rb = right.withColumn("_b", F.floor(F.col(t) / width))
    dup = [c for c in right.columns if c in left.columns and c not in by]
    if dup:
        raise ValueError(f"rename columns shared by both sides: {dup}")
    low = F.col(t) > F.col(lo) if lo_open else F.col(t) >= F.col(lo)
    high = F.col(t) < F.col(hi) if hi_open else F.col(t) <= F.col(hi)
    inner = lb.join(rb, by + ["_b"]).where(low & high).drop("_b")
    if how == "inner":
        return inner
    raise ValueError("interval_join is inner; left-join the aggregate back on the left key")


def range_peak(windows: DataFrame, series: DataFrame, lo: str, hi: str, t: str, v: str, by=None) -> DataFrame:
    """Largest `v` of `series` with `t` in [lo, hi] and the earliest instant that has it, per (by, lo, hi): columns `t`, `v`."""
    best = F.max(F.struct(F.col(v).alias("v"), (-F.col(t)).alias("nt")))
    got = range_fold(windows, series, lo, hi, t, {"_m": best}, {"_m": F.max("_m")}, by)
    return got.select(*listed(by), lo, hi, (-F.col("_m.nt")).alias(t), F.col("_m.v").alias(v))


def range_fold(windows: DataFrame, series: DataFrame, lo: str, hi: str, t: str, first: dict[str, Column], again: dict[str, Column], by=None) -> DataFrame:
    """Aggregates of `series` with `t` in [lo, hi] per (by, lo, hi): `first` over rows, `again` over columns of the same names.

    Instants are numbered, runs of PEAK_FAN of them have a value, runs of those one more, and so on. A window is put
    together from the longest runs inside it, so it meets a few rows a level and never its instants.
    """
    by = listed(by)
    again = [c.alias(n) for n, c in again.items()]
    inst = series.groupBy(*by, t).agg(*[c.alias(n) for n, c in first.items()])
    ranked = cut(row_numbers(inst, by, t, name="_i"))
    asked = windows.select(*by, lo, hi).where(F.col(lo) <= F.col(hi)).distinct()
    marks = ranked.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_tag"), "_i")
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("_t"), F.lit(g).alias("_tag")) for c, g in ((lo, 0), (hi, 2))]))
    probe = asked.withColumn("_e", ends).select(*by, lo, hi, "_e._t", "_e._tag")
    placed = running(probe.unionByName(marks, allowMissingColumns=True), by, "_t", {"_at": ("max", F.coalesce("_i", F.lit(0)))}, tie="_tag")
    at = lambda g: F.max(F.when(F.col("_tag") == g, F.col("_at")))
    spans = placed.where("_tag != 1").groupBy(*by, lo, hi).agg(at(0).alias("_a"), at(2).alias("_z")).where("_a < _z")

    level = cut(ranked.select(*by, (F.col("_i") - 1).alias("_node"), *first))
    runs, depth, size = [level.withColumn("_level", F.lit(0))], 1, level.agg(F.max("_node")).first()[0] or 0
    while size >= PEAK_FAN:
        level = cut(level.groupBy(*by, F.floor(F.col("_node") / PEAK_FAN).alias("_node")).agg(*again))
        runs.append(level.withColumn("_level", F.lit(depth)))
        depth, size = depth + 1, size // PEAK_FAN
    table = runs[0]
    for r in runs[1:]:
        table = table.unionByName(r)

    parts = []
    for i in range(depth):
        first, last = F.ceil(F.col("_a") / PEAK_FAN**i), F.floor(F.col("_z") / PEAK_FAN**i)
        if i + 1 < depth:
            # What the next level's whole runs hold is left to it.
            a, z = F.ceil(F.col("_a") / PEAK_FAN ** (i + 1)), F.floor(F.col("_z") / PEAK_FAN ** (i + 1))
            left, right = F.when(a < z, a * PEAK_FAN).otherwise(last), F.when(a < z, z * PEAK_FAN).otherwise(last)
        else:
            left = right = last
        upto = lambda x, y: F.when(x < y, F.sequence(x.cast("bigint"), (y - 1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        parts.append(F.struct(F.lit(i).alias("_level"), F.concat(upto(first, left), upto(right, last)).alias("_nodes")))
    need = spans.select(*by, lo, hi, F.explode(F.array(*parts)).alias("_e")).select(*by, lo, hi, "_e._level", F.explode("_e._nodes").alias("_node"))
    return need.join(table, by + ["_level", "_node"]).groupBy(*by, lo, hi).agg(*again)


def asof(left: DataFrame, right: DataFrame, lt: str, rt: str, values: list[str], by=None,
         direction: str = "backward") -> DataFrame:
    """Each left row with `values` of the last right row at or before it (or next at or after).

    One tagged union and a blocked running `last`/`next`; equal right instants keep the largest values.
    """
    by = listed(by)
    tag_r, tag_l = (0, 1) if direction == "backward" else (1, 0)
    one = right.groupBy(*by, F.col(rt).cast("double").alias("_t")).agg(
        F.max(F.struct(*values)).alias("_r"))
    left_t = left.select(*by, F.col(lt).cast("double").alias("_t"), F.lit(tag_l).alias("_tag"),
                         F.struct(*left.columns).alias("_l"))
    right_t = one.select(*by, "_t", F.lit(tag_r).alias("_tag"), "_r")
    both = left_t.unionByName(right_t, allowMissingColumns=True)
    kind = "last" if direction == "backward" else "next"
    done = running(both, by, "_t", {"_near": (kind, "_r")}, tie="_tag").where("_l is not null")
    return done.select("_l.*", *[F.col("_near")[v].alias(v) for v in values])


def nearest(points: DataFrame, cells: DataFrame, pid: str, px: str, py: str, cid: str, cx: str, cy: str,
            radius: float, unbounded: bool = False) -> DataFrame:
    """Nearest cell of each point: (pid, cid, distance); ties take the smallest cid.

    Points look at the 3x3 grid squares around them, first squares that hold about one cell each. What lies within one
    side is proven; the other points try again with sides twice as long, up to `radius`, or with `unbounded` until every
    point has its cell. So a point meets a few cells however many lie within the radius. Points and cells without finite
    coordinates take no part.
    """
    # Cells on the same spot are one candidate; copies collapse before any join.
    spots = cells.groupBy(F.col(cx).cast("double").alias("_cx"), F.col(cy).cast("double").alias("_cy")).agg(
        F.min(cid).alias(cid))
    spots = cut(spots.where(F.abs("_cx") + F.abs("_cy") < float("inf")))
    left = points.select(pid, F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py")).where(
        F.abs("_px") + F.abs("_py") < float("inf"))
    size, out = _first_side(spots, float(radius)), None
    while True:
        last = not unbounded and size >= radius
        hits = _ring(left, spots, pid, cid, size).where(F.col("distance") <= size)
        hits = hits if last else cut(hits)
        out = hits if out is None else out.unionByName(hits)
        if last:
            return out
        left = cut(left.join(hits.select(pid), pid, "left_anti"))
        if left.isEmpty() or spots.isEmpty():
            return out
        size = size * 2.0 if unbounded else min(size * 2.0, float(radius))


def _first_side(spots: DataFrame, radius: float) -> float:
    """A side, at most `radius`, of squares with few spots: a spot shares its square with CROWD others at most, on average."""
    b = spots.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{m}{c}") for c in ("_cx", "_cy") for f, m in ((F.min, "lo"), (F.max, "hi"))]).first()
    wide = max(b["hi_cx"] - b["lo_cx"], b["hi_cy"] - b["lo_cy"]) if b["n"] else 0.0
    thin = min(b["hi_cx"] - b["lo_cx"], b["hi_cy"] - b["lo_cy"]) if b["n"] else 0.0
    if wide <= 0:
        return radius
    # One spot a square over the box of all spots; a box like a line has as many squares as spots along it.
    side = min(radius, max((wide * thin / b["n"]) ** 0.5, wide / b["n"]))
    for _ in range(HALVINGS):
        squares = spots.groupBy(F.floor(F.col("_cx") / side), F.floor(F.col("_cy") / side)).agg(F.count(F.lit(1)).cast("double").alias("k"))
        if squares.agg(F.sum(F.col("k") * F.col("k"))).first()[0] <= (CROWD + 1) * b["n"]:
            break
        side /= 2.0
    return side


def _ring(pts: DataFrame, spots: DataFrame, pid: str, cid: str, size: float) -> DataFrame:
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = pts.withColumn("_o", F.explode(around)).withColumn(
        "_gx", F.floor(F.col("_px") / size) + F.col("_o.i")).withColumn(
        "_gy", F.floor(F.col("_py") / size) + F.col("_o.j")).drop("_o")
    c = spots.withColumn("_gx", F.floor(F.col("_cx") / size)).withColumn("_gy", F.floor(F.col("_cy") / size))
    dist = F.sqrt((F.col("_px") - F.col("_cx")) ** 2 + (F.col("_py") - F.col("_cy")) ** 2)
    best = p.join(c, ["_gx", "_gy"]).groupBy(pid).agg(F.min(F.struct(dist.alias("d"), F.col(cid).alias("c"))).alias("m"))
    return best.select(pid, F.col("m.c").alias(cid), F.col("m.d").alias("distance"))


def within_distance(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str,
                    d: float, strict: bool = False) -> DataFrame:
    """All (left, right) rows at most d apart; meet on grid squares of size d."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    size = max(float(d), 1e-9)
    lo = left.withColumn("_o", F.explode(around)).withColumn(
        "_gx", F.floor(F.col(lx) / size) + F.col("_o.i")).withColumn(
        "_gy", F.floor(F.col(ly) / size) + F.col("_o.j")).drop("_o")
    ro = right.withColumn("_gx", F.floor(F.col(rx) / size)).withColumn("_gy", F.floor(F.col(ry) / size))
    dist = F.sqrt((F.col(lx) - F.col(rx)) ** 2 + (F.col(ly) - F.col(ry)) ** 2)
    near = F.col("distance") < d if strict else F.col("distance") <= d
    return lo.join(ro, ["_gx", "_gy"]).withColumn("distance", dist).where(near).drop("_gx", "_gy")


def near_lists_1d(targets: DataFrame, members: DataFrame, tid: str, tv: str, mid: str, mv: str, k: int, beside: tuple[str, ...] = ()) -> DataFrame:
    """The k members nearest in value to each target, exact, as one row a target: its columns and `_near`, an array of (gap, mid, mv, *beside).

    Members are ranked by value and cut into pages of 2k with k ranks of margin on both sides. A target joins the one page
    its place falls on and looks at the 2k ranks around it there, so only targets and pages are shuffled. Pages that many
    targets ask for are told to several tasks. Ties in distance go to the smaller id among those candidates.
    """
    ranked, page = by_rank(members, mid, mv, beside), 2 * k
    marks = ranked.select(F.col(mv).alias("_t"), F.lit(0).alias("_tag"), F.col("_rk"))
    probe = targets.withColumn("_t", F.col(tv).cast("double")).withColumn("_tag", F.lit(1))
    placed = cut(running(probe.unionByName(marks, allowMissingColumns=True), None, "_t",
                         {"_at": ("max", F.coalesce("_rk", F.lit(0)))}, tie="_tag").where("_tag = 1").select(*targets.columns, "_at")
                 .withColumn("_page", F.floor(F.col("_at") / page)))
    # Shares of a page: PAGE_TARGETS targets each, on average.
    shares = cut(placed.groupBy("_page").agg(F.ceil(F.count(F.lit(1)) / PAGE_TARGETS).cast("int").alias("_shares")))
    # Page p serves places p * page to p * page + page - 1, which see ranks from k - 1 before to k after.
    first = F.floor((F.col("_rk") - k) / page)
    pages = ranked.select("*", F.explode(F.sequence(first, F.floor((F.col("_rk") + k - 1) / page))).alias("_page"))
    pages = pages.groupBy("_page").agg(F.sort_array(F.collect_list(F.struct("_rk", mid, mv, *beside))).alias("_list"))
    pages = pages.join(shares, "_page").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    asked = placed.join(shares, "_page").withColumn("_share", F.pmod(F.xxhash64(tid), F.col("_shares")).cast("int")).drop("_shares")
    # The list starts at its first rank and holds every rank to its last.
    lo = F.greatest(F.col("_at") - (k - 1), F.col("_list")[0]["_rk"])
    around = F.slice("_list", (lo - F.col("_list")[0]["_rk"] + 1).cast("int"), F.greatest(F.col("_at") + k - lo + 1, F.lit(0)).cast("int"))
    near = F.transform(around, lambda m: F.struct(F.abs(F.col(tv) - m[mv]).alias("gap"), *[m[c].alias(c) for c in (mid, mv, *beside)]))
    # Few bytes, but a long look at each: a fixed number of partitions is not put together.
    spread = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asked.repartition(spread, "_page", "_share").join(pages.hint("merge"), ["_page", "_share"])
    return met.select(*targets.columns, F.slice(F.sort_array(near), 1, k).alias("_near"))


def by_rank(members: DataFrame, mid: str, mv: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """Members with their rank `_rk` by value; equal values go by a hash of their id."""
    m = members.select(F.col(mid), F.col(mv).cast("double").alias(mv), *beside)
    return cut(row_numbers(m.withColumn("_tie", F.xxhash64(mid).cast("double")), None, mv, "_tie", "_rk").drop("_tie"))


def knn_1d(targets: DataFrame, members: DataFrame, tid: str, tv: str, mid: str, mv: str, k: int) -> DataFrame:
    """The k members nearest in value to each target, exact, as rows: (tid, tv, mid, mv, gap, near_rank)."""
    lists = near_lists_1d(targets.select(tid, tv), members, tid, tv, mid, mv, k)
    return lists.select(tid, tv, F.posexplode("_near").alias("_i", "_m")).select(
        tid, tv, f"_m.{mid}", f"_m.{mv}", "_m.gap", (F.col("_i") + 1).alias("near_rank"))
