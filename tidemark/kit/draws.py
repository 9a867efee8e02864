"""Weighted draws from the nearest observations, made in Arrow batches by tasks that hold the observations they look at.

Observations (of two lengths and a day of the year, none of which is a key) lie in cells cut at quantiles of a sample, a cell small enough
for a task. A target looks at its own cell first and at those others that its k-th distance reaches; what cells find is put
together. Within a task, observations and targets are cut at medians into leaves and groups, and a group meets the leaves that the largest
k-th distance of its targets reaches. A target's list leaves its task only where it needs another cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .intervals import by_rank

#: Observations of a cell, of a leaf; targets of a group; observations of a stratum that choose the cuts.
CELL, LEAF, GROUP, SAMPLE = 100_000, 32, 64, 20_000
#: Least number of targets that one copy of a cell serves, on average, and the share of a cell's observations.
SHARE_TARGETS, SHARE_OF_CELL = 8_000, 2
#: Times that number at which a share is cut by id, which only many equal targets reach.
CROWD = 4
#: Members of a page along one value, targets that one copy of it serves on average, and targets looked at together.
PAGE, PAGE_TARGETS, TOGETHER = 2_000, 10_000, 4_000
#: Neighbours looked at beyond the k, so that equal distances are seen.
SPARE = 8
WIDE = 1 + 1e-9


def halves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of x in parts of at most `size`, cut at medians of the widest column."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            if len(at):
                out.append(at)
            continue
        v = x[at]
        v = v[:, np.argmax(v.max(0) - v.min(0))]
        half = len(at) // 2
        order = np.argpartition(v, half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


class Metric:
    """Squared distances of two lengths over their scales and the way between days round the year; a missing day adds nothing."""

    def __init__(self, r: float, c: float, season: float, year: float):
        self.r, self.c, self.season, self.year = r, c, season, year

    def pairs(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        gap = np.abs(t[:, 2, None] - m[None, :, 2])
        np.minimum(gap, self.year - gap, out=gap)
        gap *= self.season
        gap *= gap
        np.nan_to_num(gap, copy=False)
        for i, s in ((0, self.r), (1, self.c)):
            d = t[:, i, None] - m[None, :, i]
            d /= s
            d *= d
            gap += d
        return gap

    def below(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least squared distances from the box (lo, hi) to the boxes (low, high); a box without days has NaN there."""
        out = np.zeros(len(low))
        for i, s in ((0, self.r), (1, self.c)):
            out += (np.maximum(np.maximum(low[:, i] - hi[i], lo[i] - high[:, i]), 0.0) / s) ** 2
        apart = (low[:, 2] > hi[2]) | (high[:, 2] < lo[2])
        way = np.minimum((low[:, 2] - hi[2]) % self.year, (lo[2] - high[:, 2]) % self.year)
        return out + np.where(apart, (way * self.season) ** 2, 0.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x * np.array([1.0 / self.r, 1.0 / self.c, self.season])


def _boxed(x: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[p].min(0) for p in parts]).reshape(-1, 3), np.array([x[p].max(0) for p in parts]).reshape(-1, 3)


def _split(x: np.ndarray, metric: Metric, size: int) -> list[np.ndarray]:
    """Parts of rows that lie together, those without a day in parts of their own."""
    out = []
    for mine in (np.flatnonzero(~np.isnan(x[:, 2])), np.flatnonzero(np.isnan(x[:, 2]))):
        y = np.nan_to_num(metric.scaled(x[mine]))
        out += [mine[p] for p in halves(y, size)]
    return out


def nearest_of(t: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the k rows of m nearest to each of t and their squared distances, by distance, then id; fewer where m has fewer."""
    k = min(k, len(m))
    at, dist = np.zeros((len(t), k), np.int64), np.zeros((len(t), k))
    if not k:
        return at, dist
    leaves = _split(m, metric, LEAF)
    low, high = _boxed(m, leaves)
    sizes = np.array([len(p) for p in leaves])
    for g in _split(t, metric, GROUP):
        mine = t[g]
        least = metric.below(mine.min(0), mine.max(0), low, high)
        order = np.argsort(least, kind="stable")
        # Leaves at no distance, and as many more as hold k.
        first = max(int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1, int(np.searchsorted(least[order], 0.0, side="right")))
        seen = np.concatenate([leaves[i] for i in order[:first]])
        d = metric.pairs(mine, m[seen])
        reach = np.partition(d, k - 1, axis=1)[:, k - 1].max() * WIDE
        last = int(np.searchsorted(least[order], reach, side="right"))
        if last > first:
            more = np.concatenate([leaves[i] for i in order[first:last]])
            d = np.concatenate([d, metric.pairs(mine, m[more])], axis=1)
            seen = np.concatenate([seen, more])
        wide = min(len(seen), k + SPARE)
        part = np.argpartition(d, wide - 1, axis=1)[:, :wide] if wide < len(seen) else np.tile(np.arange(len(seen)), (len(g), 1))
        here = np.take_along_axis(d, part, 1)
        rank = np.lexsort((ids[seen][part], here), axis=1)
        full = here.max(1)
        part, here = np.take_along_axis(part, rank, 1)[:, :k], np.take_along_axis(here, rank, 1)[:, :k]
        if wide < len(seen):
            # All that were looked at are as near as the k-th: others may be so too, with smaller ids.
            for i in np.flatnonzero(here[:, k - 1] == full):
                part[i] = np.lexsort((ids[seen], d[i]))[:k]
                here[i] = d[i][part[i]]
        at[g], dist[g] = seen[part], here
    return at, dist


def draw(d2: np.ndarray, ids: np.ndarray, count: np.ndarray, u: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's spots (nearest first, `count` observations each) one of the first k observations, with weight 1 / distance: the
    spot's id, the observation's number there from 1, its distance and how many could be drawn."""
    before = np.cumsum(count, axis=1) - count
    n = np.clip(k - before, 0, count)
    dist = np.sqrt(d2)
    one = 1.0 / (dist + 1e-6)
    total = np.cumsum(n * one, axis=1)
    want = u * total[:, -1]
    spot = np.minimum((total <= want[:, None]).sum(1), (n > 0).sum(1) - 1)
    row = np.arange(len(u))
    inside = (want - (total[row, spot] - n[row, spot] * one[row, spot])) / one[row, spot]
    return ids[row, spot], np.clip(np.floor(inside).astype(np.int64) + 1, 1, n[row, spot]), dist[row, spot], n.sum(1)


def _cuts(spots: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Per stratum of more than one cell the cuts of a tree over the two lengths: node i has children 2i and 2i + 1."""
    large = {s: n for s, n in sizes.items() if n > CELL}
    out = {}
    for s, n in large.items():
        some = spots.where((F.col("_s") == s) & (F.pmod(F.xxhash64("_sid"), F.lit(max(1, n // SAMPLE))) == 0)).select("m_r", "m_c").limit(2 * SAMPLE)
        x = some.toPandas().to_numpy()  # a bounded sample, which chooses cuts and changes no result
        depth = int(np.ceil(np.log2(n / CELL)))
        tree, parts = np.zeros(2**depth), {1: x}
        for node in range(1, 2**depth):
            v = parts.pop(node)
            i = (node.bit_length() - 1) % 2
            tree[node] = np.median(v[:, i]) if len(v) else 0.0
            parts[2 * node], parts[2 * node + 1] = v[v[:, i] < tree[node]], v[v[:, i] >= tree[node]]
        out[s] = tree
    return out


def _with_cell(df: DataFrame, trees: dict[str, np.ndarray], r: str, c: str) -> DataFrame:
    if not trees:
        return df.withColumn("_cell", F.lit(0))

    @F.pandas_udf("int")
    def cell(s: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        out = np.zeros(len(s), np.int32)
        for name, tree in trees.items():
            mine = np.flatnonzero(s == name)
            node, x = np.ones(len(mine), np.int64), (r.to_numpy()[mine], c.to_numpy()[mine])
            for level in range(len(tree).bit_length() - 1):
                node = 2 * node + (x[level % 2] >= tree[node])
            out[mine] = node - len(tree)
        return pd.Series(out)

    return df.withColumn("_cell", cell("_s", r, c))


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def _columns(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy().astype(float) for n in names], axis=1) if table.num_rows else np.zeros((0, len(names)))


def draw_nearest(targets: DataFrame, members: DataFrame, tid: str, mid: str, k: int, season: float, year: float) -> DataFrame:
    """One of the k members of its stratum nearest to each target, drawn with weight 1 / distance: (tid, _s, mid, distance, candidates, other columns of members).

    `targets`: tid, _s, t_r, t_c, t_d, _u (uniform); `members`: mid, _s, m_r, m_c, m_d, _w_r, _w_c, where _s is a stratum and _w_r, _w_c
    its scales. Days may be null and then add nothing. Ties in distance go to the spot with the smaller id, then to the smaller id.
    Targets of a stratum without members have no row.
    """
    beside = [c for c in members.columns if c not in (mid, "_s", "m_r", "m_c", "m_d", "_w_r", "_w_c")]
    # Members on one spot have one distance: a spot is looked at once, and no more than k of it can be drawn.
    spot = Window.partitionBy("_s", "m_r", "m_c", "m_d")
    numbered = members.withColumn("_copy", F.row_number().over(spot.orderBy(mid))).where(F.col("_copy") <= k).withColumn("_sid", F.min(mid).over(spot))
    numbered = cut(numbered)
    spots = numbered.groupBy("_s", "m_r", "m_c", "m_d", "_w_r", "_w_c").agg(F.min("_sid").alias("_sid"), F.count(F.lit(1)).cast("int").alias("_count"))
    spots = cut(spots)
    facts = spots.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.first("_w_r").alias("r"), F.first("_w_c").alias("c")).collect()  # a row a stratum
    metrics = {f["_s"]: Metric(f["r"], f["c"], season, year) for f in facts}
    trees = _cuts(spots, {f["_s"]: f["n"] for f in facts})
    spots = _with_cell(spots, trees, "m_r", "m_c")
    edges = [f(c).alias(f"{n}{c}") for c in ("m_r", "m_c") for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = {}
    if trees:
        spots = cut(spots)
        for b in spots.groupBy("_s", "_cell").agg(*edges).collect():  # a row a cell
            boxes.setdefault(b["_s"], []).append((b["_cell"], b["lom_r"], b["him_r"], b["lom_c"], b["him_c"]))
    held = spots.groupBy("_s", "_cell").agg(F.count(F.lit(1)).alias("_held"))
    kind = targets.schema[tid].dataType.simpleString()
    place = ("_s", "_cell", "_share", "_part")

    def spread(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Targets dealt to shares of their cell, equal ones together unless they are many, and each cell's spots once a share."""
        per = F.greatest(F.lit(SHARE_TARGETS), F.col("_held") / SHARE_OF_CELL)
        sizes = cut(asked.groupBy("_s", "_cell").agg(F.count(F.lit(1)).alias("_n")).join(held, ["_s", "_cell"]).select(
            "_s", "_cell", per.alias("_per"), F.ceil(F.col("_n") / per).cast("int").alias("_shares")))
        dealt = asked.join(F.broadcast(sizes), ["_s", "_cell"]).withColumn("_share", F.pmod(F.xxhash64("t_r", "t_c", "t_d"), F.col("_shares")).cast("int")).drop("_shares")
        parts = cut(dealt.groupBy("_s", "_cell", "_share").agg(F.ceil(F.count(F.lit(1)) / F.first("_per") / CROWD).cast("int").alias("_parts")))
        parts = parts.select(*[F.col(c).alias(c) for c in parts.columns])  # columns of its own, for it is joined to what it comes from
        dealt = dealt.drop("_per").join(F.broadcast(parts), ["_s", "_cell", "_share"]).withColumn("_part", F.pmod(F.xxhash64(tid), F.col("_parts")).cast("int")).drop("_parts")
        told = spots.join(F.broadcast(parts), ["_s", "_cell"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
            *place, "m_r", "m_c", "m_d", "_sid", "_count")
        return dealt, told

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty_first
        s, here = left.column("_s")[0].as_py(), left.column("_cell")[0].as_py()
        metric, m = metrics[s], _columns(right, ("m_r", "m_c", "m_d"))
        ids, count = right.column("_sid").to_numpy() if len(m) else np.zeros(0, np.int64), right.column("_count").to_numpy() if len(m) else np.zeros(0, np.int64)
        t = _columns(left, ("t_r", "t_c", "t_d"))
        # Equal targets have one list.
        order = np.lexsort(t.T)
        new = np.concatenate([[True], ((np.diff(t[order], axis=0) != 0) & ~(np.isnan(t[order][1:]) & np.isnan(t[order][:-1]))).any(1)])
        which = np.empty(len(t), np.int64)
        which[order] = np.cumsum(new) - 1
        some = t[order[new]]
        at, d2 = nearest_of(some, m, ids, k, metric)
        sid, n = ids[at], count[at]
        far, reach = [np.zeros(0, np.int32)] * len(some), np.full(len(some), np.inf)
        if len(boxes.get(s, ())) > 1:
            whole = n.sum(1) >= k
            if at.shape[1]:
                last = np.minimum((np.cumsum(n, axis=1) < k).sum(1), at.shape[1] - 1)
                reach = np.where(whole, d2[np.arange(len(some)), last] * WIDE, np.inf)
            others = np.array([b for b in boxes[s] if b[0] != here], float).reshape(-1, 5)
            for i in range(0, len(some), 1000):
                x = some[i : i + 1000, None, :]
                low = (np.maximum(np.maximum(others[:, 1] - x[..., 0], x[..., 0] - others[:, 2]), 0.0) / metric.r) ** 2
                low += (np.maximum(np.maximum(others[:, 3] - x[..., 1], x[..., 1] - others[:, 4]), 0.0) / metric.c) ** 2
                hit = low <= reach[i : i + 1000, None]
                for j in np.flatnonzero(hit.any(1)):
                    far[i + j] = others[hit[j], 0].astype(np.int32)
        go = np.array([len(f) > 0 for f in far])[which]
        stay = np.flatnonzero(~go)
        got = draw(d2[which[stay]], sid[which[stay]], n[which[stay]], left.column("_u").to_numpy()[stay], k) if len(stay) and at.shape[1] else None
        out = [left.select([tid, "_s", "t_r", "t_c", "t_d", "_u"]).take(pa.array(stay if got else stay[:0]))]
        cols = got or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        none = lambda rows, kind: pa.nulls(rows, pa.list_(kind))
        rows = len(cols[0])
        done = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()),
                pa.nulls(rows, pa.float64()), none(rows, pa.int32()), none(rows, pa.float64()), none(rows, pa.int64()), none(rows, pa.int32())]
        away = np.flatnonzero(go)
        out.append(left.select([tid, "_s", "t_r", "t_c", "t_d", "_u"]).take(pa.array(away)))
        w = which[away]
        open_ = [pa.nulls(len(away), pa.int64()), pa.nulls(len(away), pa.int64()), pa.nulls(len(away), pa.float64()), pa.nulls(len(away), pa.int64()),
                 pa.array(reach[w], pa.float64()), _lists([far[i] for i in w], pa.int32()), _lists(list(d2[w]), pa.float64()), _lists(list(sid[w]), pa.int64()), _lists(list(n[w]), pa.int32())]
        parts = []
        for table, more in zip(out, (done, open_)):
            for name, col in zip(("_sid", "_copy", "distance", "candidates", "_reach", "_cells", "_d2", "_ids", "_ns"), more):
                table = table.append_column(name, col)
            parts.append(table)
        return pa.concat_tables(parts)

    fields = f"`{tid}` {kind}, _s string, t_r double, t_c double, t_d double, _u double, _sid long, _copy long, distance double, candidates long, " \
             "_reach double, _cells array<int>, _d2 array<double>, _ids array<long>, _ns array<int>"
    empty_first = _no_rows(targets.sparkSession, fields)
    dealt, told = spread(_with_cell(targets, trees, "t_r", "t_c"))
    first = _met(dealt, told, place, own, fields)
    drawn = ["_s", tid, "_sid", "_copy", "distance", "candidates"]
    if not trees:
        out = first.select(*drawn)
    else:
        first = cut(first)
        out = first.where("_cells is null").select(*drawn).unionByName(_from_cells(first.where("_cells is not null"), spread, metrics, tid, kind, k, place, drawn))
    return out.join(numbered.select("_s", "_sid", "_copy", mid, *beside), ["_s", "_sid", "_copy"]).drop("_sid", "_copy")


def _from_cells(asked: DataFrame, spread, metrics: dict[str, Metric], tid: str, kind: str, k: int, place: tuple[str, ...], drawn: list[str]) -> DataFrame:
    """Draws of targets that reach other cells: what those hold within reach is put to the target's own list."""
    lists = f"`{tid}` {kind}, _s string, _d2 array<double>, _ids array<long>, _ns array<int>"
    empty = _no_rows(asked.sparkSession, lists)

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        metric, m = metrics[left.column("_s")[0].as_py()], _columns(right, ("m_r", "m_c", "m_d"))
        ids, count = right.column("_sid").to_numpy(), right.column("_count").to_numpy()
        at, d2 = nearest_of(_columns(left, ("t_r", "t_c", "t_d")), m, ids, k, metric)
        near = d2 <= left.column("_reach").to_numpy()[:, None]
        keep = lambda x: [x[i][near[i]] for i in range(len(x))]
        out = left.select([tid, "_s"])
        for name, x, t in (("_d2", d2, pa.float64()), ("_ids", ids[at], pa.int64()), ("_ns", count[at], pa.int32())):
            out = out.append_column(name, _lists(keep(x), t))
        return out

    dealt, told = spread(asked.select(tid, "_s", "t_r", "t_c", "t_d", "_reach", F.explode("_cells").alias("_cell")))
    found = _met(dealt, told, place, look, lists)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # a few times k entries
    both = found.withColumn("_u", F.lit(None).cast("double")).unionByName(asked.select(tid, "_s", "_d2", "_ids", "_ns", "_u"))
    both = both.withColumn("_l", F.arrays_zip("_d2", "_ids", "_ns")).groupBy(tid, "_s").agg(flat("_l"), F.max("_u").alias("_u"))
    both = both.withColumn("_l", F.slice(F.sort_array("_l"), 1, k))
    # The lists are sorted by distance, then id; short ones are filled with spots of no observation.
    fill = lambda c, v: F.concat(F.transform("_l", lambda x: x[c]), F.array_repeat(F.lit(v), F.lit(k) - F.size("_l"))).alias(c)
    both = both.select(tid, "_s", "_u", fill("_d2", float("inf")), fill("_ids", 0), fill("_ns", 0))

    def finish(batches):
        for b in batches:
            if b.num_rows:
                square = lambda c, t: np.asarray(b.column(c).flatten()).reshape(b.num_rows, k).astype(t)
                got = draw(square("_d2", float), square("_ids", np.int64), square("_ns", np.int64), b.column("_u").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([b.column("_s"), b.column(tid), *map(pa.array, got)], names=drawn)

    return both.select("_s", tid, "_u", "_d2", "_ids", "_ns").mapInArrow(finish, f"_s string, `{tid}` {kind}, _sid long, _copy long, distance double, candidates long")


def _met(left: DataFrame, right: DataFrame, place: tuple[str, ...], look, fields: str) -> DataFrame:
    # Few bytes, but a long look at each: a fixed number of partitions is not put together.
    spread = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(spread, *place).groupBy(*place).cogroup(right.repartition(spread, *place).groupBy(*place)).applyInArrow(look, fields)


def _no_rows(spark, fields: str) -> pa.Table:
    return spark.createDataFrame([], fields).toArrow()


def paged(targets: DataFrame, members: DataFrame, tid: str, tv: str, mid: str, mv: str, beside: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Targets with the page of members that their value falls on and a share of its targets; members with their rank `_rk` by value."""
    ranked = by_rank(members, mid, mv, beside)
    starts = np.array([r[1] for r in sorted(ranked.where((F.col("_rk") - 1) % PAGE == 0).select("_rk", mv).collect())])  # a number a page

    @F.pandas_udf("int")
    def page(x: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts, x.to_numpy(), side="right") - 1, 0).astype(np.int32))

    placed = cut(targets.withColumn("_page", page(F.col(tv).cast("double"))))
    shares = placed.groupBy("_page").agg(F.ceil(F.count(F.lit(1)) / PAGE_TARGETS).cast("int").alias("_shares"))
    return placed.join(F.broadcast(shares), "_page").withColumn("_share", F.pmod(F.xxhash64(tid), F.col("_shares")).cast("int")), ranked


def pick_near(v: np.ndarray, less: np.ndarray, t: np.ndarray, u: np.ndarray, k: int, sigma_scale: float, sigma_min: float) -> np.ndarray:
    """For each of t the row of one of the k values of v (ascending) nearest to it, by weight exp(-(gap / sigma)^2 / 2) * less, where sigma
    is `sigma_scale` deviations of the k, and at least `sigma_min`. Of two at one distance the smaller value is nearer. All weigh the same
    where no weight is above zero."""
    k = min(k, len(v))
    windows, thin = np.lib.stride_tricks.sliding_window_view(v, k), np.lib.stride_tricks.sliding_window_view(less, k)
    sigma = np.maximum(windows.std(axis=1) * sigma_scale, sigma_min)
    out = np.empty(len(t), np.int64)
    for i in range(0, len(t), TOGETHER):
        x, at = t[i : i + TOGETHER], np.searchsorted(v, t[i : i + TOGETHER], side="right")
        # The first window whose next value to the right is not nearer than its first one.
        lo, hi = np.clip(at - k, 0, len(v) - k), np.minimum(at, len(v) - k)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            on = (lo < hi) & (v[np.minimum(mid + k, len(v) - 1)] - x < x - v[mid])
            lo, hi = np.where(on, mid + 1, lo), np.where(on, hi, np.minimum(hi, mid))
        w = windows[lo] - x[:, None]
        w /= sigma[lo, None]
        w *= w
        w *= -0.5
        np.exp(w, out=w)
        w *= thin[lo]
        w[~(w.sum(axis=1) > 0)] = 1.0
        total = np.cumsum(w, axis=1)
        out[i : i + TOGETHER] = lo + np.minimum((total <= (u[i : i + TOGETHER] * total[:, -1])[:, None]).sum(axis=1), k - 1)
    return out


def draw_paged(placed: DataFrame, ranked: DataFrame, tid: str, tv: str, mid: str, mv: str, k: int, keep: tuple[str, ...] | None, beside: tuple[str, ...] = (),
               sigma_scale: float = 0.5, sigma_min: float = 1e-6) -> DataFrame:
    """A member per target of `paged`, drawn by pick_near with the numbers `_u` of targets and weights `_less` of members: tid, the target columns `keep`,
    mid and the member columns `beside`. Without `keep` only (mid, `_n`), how often members were drawn, in parts."""
    t_kind, m_kind = {f.name: f.dataType.simpleString() for f in placed.schema}, {f.name: f.dataType.simpleString() for f in ranked.schema}
    fields = ", ".join([f"`{c}` {t_kind[c]}" for c in (tid, *keep)] + [f"`{c}` {m_kind[c]}" for c in (mid, *beside)]) if keep is not None else f"`{mid}` {m_kind[mid]}, _n long"
    empty = _no_rows(placed.sparkSession, fields)

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        order = np.argsort(right.column("_rk").to_numpy())
        v, less = right.column(mv).to_numpy()[order], right.column("_less").to_numpy()[order]
        got = order[pick_near(v, less, left.column(tv).to_numpy(), left.column("_u").to_numpy(), k, sigma_scale, sigma_min)]
        if keep is None:
            rows, n = np.unique(got, return_counts=True)
            return right.select([mid]).take(pa.array(rows)).append_column("_n", pa.array(n, pa.int64()))
        out, mine = left.select([tid, *keep]), right.take(pa.array(got))
        for c in (mid, *beside):
            out = out.append_column(c, mine.column(c))
        return out

    place = ("_page", "_share")
    first = F.greatest(F.floor((F.col("_rk") - 1 - k) / PAGE), F.lit(0)).cast("int")
    told = ranked.withColumn("_page", F.explode(F.sequence(first, F.floor((F.col("_rk") - 1 + k) / PAGE).cast("int"))))
    told = told.join(F.broadcast(placed.select("_page", "_shares").distinct()), "_page").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    return _met(placed.select(*place, tid, *[c for c in (keep or ()) if c != tv], tv, "_u"), told.select(*place, "_rk", mv, "_less", mid, *[c for c in beside if c != mv]), place, look, fields)
