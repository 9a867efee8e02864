"""Gap sessions and greedy peak selection that split hot series exactly.

Time is cut into cells as long as the separation. Two instants in one cell are always closer than
the separation, so sessions follow from one (min, max, count) row per series and cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, listed

# Rows a session may hold before it is broken down by rounds instead of one in-task fold.
FOLD_ROWS = 20_000


def sessions(df: DataFrame, by, t: str, gap: float, name: str = "session") -> DataFrame:
    """Add a session number per key: a new one starts when the gap to the previous instant is >= gap."""
    by = listed(by)
    celled = df.withColumn("_cell", F.floor(F.col(t) / gap))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("_cell")
    cells = celled.groupBy(*by, "_cell").agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    start = F.coalesce(F.col("_t0") - F.lag("_t1").over(w) >= gap, F.lit(True))
    numbered = cells.withColumn("_new", start.cast("int")).select(*by, "_cell", F.sum("_new").over(w).alias(name))
    return celled.join(numbered, by + ["_cell"]).drop("_cell")


def greedy_peaks(df: DataFrame, by, t: str, v: str, gap: float, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Keep largest first, dropping anything closer than `gap` to a kept row; equal values keep the earlier.

    Returns (by, t, v). Sessions up to `fold_rows` rows are folded inside a task. Larger ones go
    through rounds: a row that beats everything in its own and both neighbouring cells is kept, rows
    near a kept one leave, and what is left falls apart into smaller sessions.
    """
    by = listed(by)
    rem = df.groupBy(*by, F.col(t)).agg(F.max(v).alias(v))
    parts = []
    while True:
        cells = sessions(_cell_counts(rem, by, t, gap), by, "_t", gap, "_s")
        biggest = cells.groupBy(*by, "_s").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0]
        if biggest is None or biggest <= fold_rows:
            parts.append(_fold(rem, by, t, v, gap))
            break
        kept, rem = _round(cut(rem), by, t, v, gap)
        parts.append(kept)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cell_counts(df, by, t, gap):
    cell = F.floor(F.col(t) / gap)
    ends = df.groupBy(*by, cell.alias("_c")).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.count(F.lit(1)).alias("_k"))
    # Both cell ends stand in for the rows between them; the count rides on the first.
    pair = F.explode(F.array(F.struct(F.col("_a").alias("t"), F.col("_k").alias("n")),
                             F.struct(F.col("_b").alias("t"), F.lit(0).cast("bigint").alias("n"))))
    return ends.select(*by, pair.alias("_p")).select(*by, F.col("_p.t").alias("_t"), F.col("_p.n").alias("_n"))


def _fold(df, by, t, v, gap):
    numbered = sessions(df, by, t, gap, "_s")
    row = F.struct((-F.col(v)).alias("k"), F.col(t).alias("t"), F.col(v).alias("v"))
    packed = numbered.groupBy(*by, "_s").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kind = packed.schema["_rows"].dataType
    empty = F.array().cast(kind)
    picked = F.aggregate("_rows", empty, lambda acc, x: F.when(
        F.exists(acc, lambda a: F.abs(a["t"] - x["t"]) < gap), acc).otherwise(F.concat(acc, F.array(x))))
    return packed.select(*by, F.explode(picked).alias("_x")).select(
        *by, F.col("_x.t").alias(t), F.col("_x.v").alias(v))


def _round(rem, by, t, v, gap):
    around = F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell")
    celled = rem.withColumn("_cell", F.floor(F.col(t) / gap))
    best = celled.groupBy(*by, "_cell").agg(F.max(F.struct(F.col(v).alias("v"), (-F.col(t)).alias("nt"))).alias("_m"))
    rival = best.select(*by, around, "_m").groupBy(*by, "_cell").agg(F.max("_m").alias("_r"))
    kept = cut(best.join(rival, by + ["_cell"]).where("_m = _r").select(
        *by, "_cell", (-F.col("_m.nt")).alias(t), F.col("_m.v").alias(v)))
    near = kept.select(*by, around, F.col(t).alias("_k")).groupBy(*by, "_cell").agg(F.collect_list("_k").alias("_ks"))
    left = celled.join(near, by + ["_cell"], "left").where(
        F.coalesce(~F.exists("_ks", lambda a: F.abs(a - F.col(t)) < gap), F.lit(True))).drop("_cell", "_ks")
    return kept.drop("_cell"), cut(left)


def anchored_events(df: DataFrame, by, t: str, gap: float, name: str = "events") -> DataFrame:
    """Count of distinct events per key: left to right, a new one when >= gap after the last counted one.

    Input is reduced to distinct instants first. The scan runs per session over bare instants.
    """
    by = listed(by)
    numbered = sessions(df.select(*by, F.col(t).cast("double").alias(t)).distinct(), by, t, gap, "_s")
    packed = numbered.groupBy(*by, "_s").agg(F.sort_array(F.collect_list(t)).alias("_ts"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("last"))
    step = lambda acc, x: F.when(acc["last"].isNull() | (x - acc["last"] >= gap),
                                 F.struct((acc["n"] + 1).alias("n"), x.alias("last"))).otherwise(acc)
    counted = packed.select(*by, F.aggregate("_ts", start, step, lambda acc: acc["n"]).alias("_n"))
    agg = F.sum("_n").alias(name)
    return counted.groupBy(*by).agg(agg) if by else counted.agg(agg)
