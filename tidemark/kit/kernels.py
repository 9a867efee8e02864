"""Sums of Gaussian kernels over many points without pairs.

Mass is gathered in square cells. A cell keeps its moments about its centre, and a kernel seen from outside is its Hermite
series in them, so a point meets the cells around it and never their rows. Cells grow with the extent in bandwidths, not with rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a cell in bandwidths and terms of the series an axis: what is left out is below 1e-13 of a row's weight.
SIDE, TERMS = 0.5, 14
#: Points of a block that one task takes, on average, and points told to one product of matrices.
BLOCK_POINTS, CHUNK = 20_000, 1_000


def kernel_sums(points: DataFrame, mass: DataFrame, x: str, y: str, reach: float, name: str) -> DataFrame:
    """(x, y, name): sum of exp(-d^2 / 2) over the rows of `mass`, for each distinct spot of `points`; both have columns x and y.

    Cells stand in blocks `reach` wide and a point looks at 3 x 3 of them, so all rows within `reach` count. Blocks that
    many points lie in are told to several tasks.
    """
    wide = max(math.ceil(reach / SIDE), 1)
    whole = F.abs(x) + F.abs(y) < float("inf")
    cell = lambda c: F.floor(F.col(c) / SIDE)
    block = lambda c: F.floor(F.col(c) / wide)
    rows = mass.where(whole).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), cell(x).alias("_cx"), cell(y).alias("_cy"))
    # Rows come in the order of their cells, so a batch has one row of moments a cell.
    cells = rows.repartition("_cx", "_cy").sortWithinPartitions("_cx", "_cy").mapInPandas(_moments, "_cx long, _cy long, _m array<double>")
    spots = points.where(whole).select(x, y).distinct().withColumn("_bx", F.floor(cell(x) / wide)).withColumn("_by", F.floor(cell(y) / wide))
    shares = spots.groupBy("_bx", "_by").agg(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).alias("_shares"))
    asked = spots.join(shares, ["_bx", "_by"]).withColumn("_share", F.pmod(F.xxhash64(x, y), "_shares")).drop("_shares")
    around = lambda b: F.explode(F.array(*[F.col(b) + i for i in (-1, 0, 1)]))
    told = cells.withColumn("_bx", block("_cx")).withColumn("_by", block("_cy")).withColumn("_bx", around("_bx")).withColumn("_by", around("_by"))
    told = told.join(shares, ["_bx", "_by"]).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1))).drop("_shares")

    def sums(key, p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        side = 3 * wide
        first = [(int(key[0]) - 1) * wide, (int(key[1]) - 1) * wide]
        table = np.zeros((side, side, TERMS, TERMS))
        if len(m):
            np.add.at(table, (m["_cx"].to_numpy() - first[0], m["_cy"].to_numpy() - first[1]), np.stack(m["_m"].to_numpy()).reshape(-1, TERMS, TERMS))
        table = table.transpose(0, 2, 1, 3).reshape(side * TERMS, side * TERMS)
        at = [(f + np.arange(side) + 0.5) * SIDE for f in first]
        out = np.empty(len(p))
        for i in range(0, len(p), CHUNK):
            u, v = (hermite(p[c].to_numpy(float)[i:i + CHUNK, None] - a).reshape(-1, side * TERMS) for c, a in zip((x, y), at, strict=True))
            out[i:i + CHUNK] = np.einsum("ij,ij->i", u @ table, v)
        return p[[x, y]].assign(**{name: out})

    keys = ["_bx", "_by", "_share"]
    return asked.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(sums, f"`{x}` double, `{y}` double, `{name}` double")


def hermite(u: np.ndarray) -> np.ndarray:
    """Hermite polynomials 0 to TERMS - 1 at u, times exp(-u^2 / 2), along a new last axis."""
    out = np.empty((*u.shape, TERMS))
    out[..., 0] = np.exp(-u * u / 2)
    out[..., 1] = u * out[..., 0]
    for n in range(1, TERMS - 1):
        out[..., n + 1] = u * out[..., n] - n * out[..., n - 1]
    return out


def _moments(batches):
    scale = 1.0 / np.array([math.factorial(n) for n in range(TERMS)], float)
    for b in batches:
        if not len(b):
            continue
        cx, cy = b["_cx"].to_numpy(), b["_cy"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]))))
        powers = lambda c, at: ((b[c].to_numpy() - (at + 0.5) * SIDE)[:, None] ** np.arange(TERMS)) * scale
        m = np.add.reduceat((powers("_x", cx)[:, :, None] * powers("_y", cy)[:, None, :]).reshape(len(b), -1), start, axis=0)
        yield pd.DataFrame({"_cx": cx[start], "_cy": cy[start], "_m": list(m)})
