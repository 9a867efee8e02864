"""Product codes of vectors: every part of a vector is the number of its nearest codebook entry, found by Orchard search.

Each entry keeps all other entries sorted by their distance to it. A search holds a current entry and walks its list: an
unmarked entry is measured and marked; a nearer one becomes the current entry and its list is walked from the start; the
walk ends at the first entry farther from the current one than twice the current distance, for by the triangle inequality
none behind it can be nearer. Results are exact. All rows of an Arrow batch walk in step, as arrays.

Components are the integers floor(256 x). A codebook starts as the parts of the rows with the smallest ids; each round
assigns all rows and replaces an entry by the floor of its members' mean. Tasks add up members per entry, so a round hands on
entries x dimensions numbers a task and the driver holds the codebooks alone.

Rows whose vector is null, or holds a null or a non-finite component, are left out. The length that counts is that of the
kept row with the smallest id whose length is a positive multiple of `parts`; rows of any other length stay, with null code and
error. Null ids come after all others; rows that repeat an id are taken by their components. Fewer rows than entries give
a smaller codebook; no rows give no rows. Distances are exact: in 24, 53 or 63 bits, as the largest component needs;
beyond, where an error would not fit a long, the job ends with a ValueError. Equal labels share their error sum, null labels
too. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
#: Label sums that are told to all tasks; more of them meet the rows by label and salt.
TOLD_ROWS = 50_000
SALTS = 16
#: Rows that walk in step: bounds the arrays of a task.
STEP_ROWS = 8_192


@dataclass(frozen=True)
class Plan:
    parts: int = 16
    entries: int = 64
    rounds: int = 2


class Book:
    """Codebook of one part, with the sorted neighbour list of every entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # entries x dimensions, integers
        wide = entries.astype(np.int64)
        gaps = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(gaps, -1)  # an entry leads its own list, where it is left out
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        line = wide.sum(1)
        self.by_line = np.argsort(line, kind="stable")
        self.line = line[self.by_line]


def arithmetic(bound: int, dimensions: int, parts: int) -> type:
    """The cheapest number type in which squared distances of components up to `bound` are exact."""
    most = dimensions * (2 * bound) ** 2 * 4  # a walk compares four times a distance
    if most < 1 << 24:
        return np.float32
    if most < 1 << 53:
        return np.float64
    if most * parts < 1 << 63:
        return np.int64
    raise ValueError(f"components up to {bound}: squared distances do not fit a long")


def orchard(points: np.ndarray, book: Book, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every point and its squared distance; of equally near ones the lower number."""
    rows, dims = points.shape
    count = len(book.entries)
    bound = int(max(np.abs(points).max(initial=0), np.abs(book.entries).max(initial=0)))
    kind = arithmetic(bound, dims, parts)
    q, entries, gaps = points.astype(kind), book.entries.astype(kind), book.gaps.astype(kind)
    # The walk starts at the entry whose component sum is next to the point's.
    place = np.searchsorted(book.line, points.sum(1))
    best = book.by_line[np.minimum(place, count - 1)]
    dist = ((q - entries[best]) ** 2).sum(1)
    seen = np.zeros((rows, count), bool)
    seen[np.arange(rows), best] = True
    live = np.arange(rows) if count > 1 else np.arange(0)
    at = np.zeros(rows, np.int64)
    while live.size:
        here, step = best[live], at[live]
        near = gaps[here, step] <= 4 * dist[live]
        live, here, step = live[near], here[near], step[near]
        e = book.order[here, step]
        at[live] = step + 1
        fresh = ~seen[live, e]
        look, e = live[fresh], e[fresh]
        seen[look, e] = True
        d = ((q[look] - entries[e]) ** 2).sum(1)
        better = (d < dist[look]) | ((d == dist[look]) & (e < best[look]))
        moved = look[better]
        best[moved], dist[moved], at[moved] = e[better], d[better], 0
        live = live[at[live] < count - 1]
    return best, dist.astype(np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers."""
    wide = np.floor(x.astype(np.float64) * SCALE)
    if np.abs(wide).max(initial=0) >= 1 << 62:
        raise ValueError("components of 2^54 and more have no squared distance that fits a long")
    return wide.astype(np.int64)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector has finite components only."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("embedding").isNotNull() & ~bad)


def starts(rows: DataFrame, plan: Plan) -> np.ndarray:
    """The first `entries` kept vectors by id, as integers: parts x entries x dimensions."""
    fits = rows.where((F.size("embedding") > 0) & (F.size("embedding") % plan.parts == 0))
    by = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = fits.orderBy(*by).select(F.size("embedding").alias("n")).first()
    if first is None:
        return np.zeros((plan.parts, 0, 0), np.int64)
    chosen = fits.where(F.size("embedding") == first["n"]).orderBy(*by).limit(plan.entries).select("embedding").collect()
    return scaled(np.array([r[0] for r in chosen])).reshape(len(chosen), plan.parts, -1).transpose(1, 0, 2)


def steps(batch: pa.RecordBatch, column: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch as integers rows x parts x dimensions, `STEP_ROWS` at a time."""
    for lo in range(0, batch.num_rows, STEP_ROWS):
        some = batch.slice(lo, STEP_ROWS).column(column)
        x = some.flatten().to_numpy(zero_copy_only=False)
        yield lo, scaled(x).reshape(len(some), parts, -1)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floors of their members' means, entries without members stay."""
    parts, count, dims = books.shape
    sent = rows.sparkSession.sparkContext.broadcast([Book(b) for b in books])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, count, dims), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            for _, x in steps(batch, 0, parts):
                for p, book in enumerate(sent.value):
                    code, _ = orchard(x[:, p], book, parts)
                    n[p] += np.bincount(code, minlength=count)
                    order = np.argsort(code, kind="stable")
                    used, where = np.unique(code[order], return_index=True)
                    total[p, used] += np.add.reduceat(x[order, p], where, axis=0)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_pydict({"part": np.repeat(p, dims), "entry": np.repeat(e, dims), "place": np.tile(np.arange(dims), len(p)),
                                              "total": total[p, e].reshape(-1), "n": np.repeat(n[p, e], dims)})

    sums = rows.select("embedding").mapInArrow(add, "part long, entry long, place long, total long, n long")
    out = books.copy()
    # One row per part, entry and place: the size of the codebooks, whatever the rows.
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    sent.unpersist()
    return out


def trained(rows: DataFrame, plan: Plan) -> np.ndarray:
    books = starts(rows, plan)
    if books.size:
        mine = rows.where(F.size("embedding") == books.shape[0] * books.shape[2])
        for _ in range(plan.rounds):
            books = improved(mine, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row."""
    parts = books.shape[0]
    width = books.shape[0] * books.shape[2]
    sent = rows.sparkSession.sparkContext.broadcast([Book(b) for b in books] if books.size else [])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x in steps(batch, 2, parts):
                found = [orchard(x[:, p], book, parts) for p, book in enumerate(sent.value)]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                some = batch.slice(lo, STEP_ROWS)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([c.tobytes().hex() for c in codes]),
                                                  pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    fits = rows.where(F.size("embedding") == width) if width else rows.where(F.lit(False))
    other = rows.where(F.size("embedding") != width) if width else rows
    coded = fits.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id long, label {kind}, code string, error long")
    return coded.unionByName(other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))


def with_label_error(coded: DataFrame, told_rows: int = TOLD_ROWS) -> DataFrame:
    """`coded` with the sum of errors of all rows of its label."""
    coded = cut(coded)
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= told_rows:
        return coded.join(F.broadcast(sums), same, "left").drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    spread = sums.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_of")), "left").drop("_label", "_salt", "_of")


def compressed(vectors: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row."""
    rows = kept(vectors)
    books = trained(rows, plan)
    return with_label_error(assigned(rows, books)).withColumn("codebooks_sha256", F.lit(digest(books)))
