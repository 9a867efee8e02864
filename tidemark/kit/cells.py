"""Point-in-box and point-in-ring joins through quadtree cells: an equi join instead of a range join.

Every shape is covered by at most a hundred cells of one quadtree level, the level at which its longer side takes about eight cells.
Points look up one cell for each level in use. Cell sides are powers of two, so cell numbers are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Levels are held between these exponents of two, so there are at most 91 of them whatever the shapes.
LOWEST, HIGHEST = -30, 60
#: Cover rows that are told to all tasks; more of them are joined by cell.
TOLD_ROWS = 100_000


def _side(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def cell_cover(shapes: DataFrame, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
    """`shapes` once for every cell (_k, _ix, _iy) that its box touches; boxes without finite sides touch none."""
    wide = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))
    k = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.ceil(F.log2(F.greatest(wide, F.lit(1e-12)) / 8)))).cast("int")
    s = shapes.where((F.abs(x0) + F.abs(x1) + F.abs(y0) + F.abs(y1) < float("inf")) & (F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1))).withColumn("_k", k)
    at = lambda c: F.floor(F.col(c) / _side(F.col("_k")))
    return s.withColumn("_ix", F.explode(F.sequence(at(x0), at(x1)))).withColumn("_iy", F.explode(F.sequence(at(y0), at(y1))))


def meet(points: DataFrame, cover: DataFrame, x: str, y: str, told_rows: int = TOLD_ROWS) -> DataFrame:
    """Inner join of points and cover rows on the cell."""
    cover = cut(cover)
    levels = sorted(r[0] for r in cover.select("_k").distinct().collect())
    if not levels:
        levels = [0]
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    p = points.where(F.abs(px) + F.abs(py) < float("inf")).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in levels])))
    p = p.withColumn("_ix", F.floor(px / _side(F.col("_k")))).withColumn("_iy", F.floor(py / _side(F.col("_k"))))
    known = F.broadcast(cover) if cover.count() <= told_rows else cover
    return p.join(known, ["_k", "_ix", "_iy"]).drop("_k", "_ix", "_iy")


def in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, x0: str, x1: str, y0: str, y1: str, told_rows: int = TOLD_ROWS) -> DataFrame:
    """Every (point, box) with the point inside the box or on its edge."""
    near = meet(points, cell_cover(boxes, x0, x1, y0, y1), x, y, told_rows)
    return near.where(F.col(x).between(F.col(x0), F.col(x1)) & F.col(y).between(F.col(y0), F.col(y1)))


def crossings_right(px: Column, py: Column, edges: Column) -> Column:
    """Whether an odd number of edges array<struct<ax,ay,bx,by>> is met going right from the point."""
    def step(acc, e):
        over_ = ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
        return F.when(F.coalesce(over_, F.lit(False)), ~acc).otherwise(acc)

    return F.aggregate(edges, F.lit(False), step)


def ring_cover(rings: DataFrame, vertices: str = "vertices") -> DataFrame:
    """Cells of closed rings array<struct<x,y>>: `_within` marks cells that lie wholly inside, the others carry `_edges`.

    Only edges at the height of the cell that reach as far right as its left side can decide a point of the cell.
    """
    v, n = F.col(vertices), F.size(vertices)
    at = lambda i, c: F.get(v, i)[c].cast("double")
    after = lambda i: F.when(i == n, F.lit(0)).otherwise(i)
    edge = lambda i: F.struct(at(i - 1, "x").alias("ax"), at(i - 1, "y").alias("ay"), at(after(i), "x").alias("bx"), at(after(i), "y").alias("by"))
    r = rings.where(n > 0).withColumn("_edges", F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), edge)).drop(vertices)
    r = r.withColumn("_x0", F.array_min("_edges.ax")).withColumn("_x1", F.array_max("_edges.ax")).withColumn("_y0", F.array_min("_edges.ay")).withColumn("_y1", F.array_max("_edges.ay"))
    cells = cell_cover(r, "_x0", "_x1", "_y0", "_y1").withColumn("_s", _side(F.col("_k")))
    left, low = F.col("_ix") * F.col("_s"), F.col("_iy") * F.col("_s")
    beside = lambda e: (F.greatest(e["ay"], e["by"]) >= low) & (F.least(e["ay"], e["by"]) <= low + F.col("_s")) & (F.greatest(e["ax"], e["bx"]) >= left)
    cells = cells.withColumn("_edges", F.filter("_edges", beside))
    border = F.exists("_edges", lambda e: F.least(e["ax"], e["bx"]) <= left + F.col("_s"))
    centre = crossings_right(left + F.col("_s") / 2, low + F.col("_s") / 2, F.col("_edges"))
    cells = cells.withColumn("_border", border).withColumn("_within", ~F.col("_border") & centre).where("_border or _within")
    return cells.withColumn("_edges", F.when(F.col("_border"), F.col("_edges"))).drop("_x0", "_x1", "_y0", "_y1", "_s", "_border")


def in_rings(points: DataFrame, rings: DataFrame, x: str, y: str, vertices: str = "vertices", told_rows: int = TOLD_ROWS) -> DataFrame:
    """Every (point, ring) with the point inside by the even-odd rule."""
    near = meet(points, ring_cover(rings, vertices), x, y, told_rows)
    return near.where(F.col("_within") | crossings_right(F.col(x).cast("double"), F.col(y).cast("double"), F.col("_edges"))).drop("_within", "_edges")
