"""Finite streams to their end: the last windows and sessions are written too.

A watermark follows the latest event seen, so the windows nearest to the end of a finite stream stay in state for good. Here
the stream is drained, one closing row far behind the last event is put into a folder that the stream reads besides its
source, and the same query is drained again: only that row comes, the watermark passes every open window, and the query
writes them. The closing row's own window never closes, so it reaches no output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closing_row(batch: DataFrame, time: str, rank: str | None = None, days: int = 365) -> DataFrame:
    """The row of `batch` with the largest `rank` (default: the latest), `days` after the last event; none if all times are null.

    It is a copy of a true row, so it passes the filters and joins that the stream has ahead of its watermark, if any row
    does: for a filter on a column, rank by it.
    """
    last = batch.where(F.col(time).isNotNull()).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]),
        F.struct(F.col(rank or time).isNotNull(), F.col(rank or time))).alias("_row"), F.max(time).alias("_end"))
    at = (F.col("_end") + F.expr(f"INTERVAL {int(days)} DAYS")).cast(batch.schema[time].dataType)
    return last.where("_row is not null").select(*[at.alias(c) if c == time else F.col(f"_row.{c}").alias(c) for c in batch.columns])


def drain(out: DataFrame, home: str) -> None:
    """Process all that the stream's sources hold now, from the state under `home` on, into Parquet files there."""
    q = out.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
    q.trigger(availableNow=True).start().awaitTermination()


def run_to_end(stream: DataFrame, batch: DataFrame, build: Callable[[DataFrame], DataFrame], home: str, time: str | None = None,
               rank: str | None = None, days: int = 365) -> DataFrame:
    """Rows of `build(stream)` with every window closed; `batch` is the stream's source read as a table.

    `home` is a folder that all executors share. Called again after a failure with the same `home`, it goes on from the state
    there; a second closing row does no harm. Without `time` nothing is closed (streams without state). `days` must exceed
    the stream's lateness and its longest window. An empty source gives an empty table.
    """
    spark = stream.sparkSession
    if time is None:
        out = build(stream)
        drain(out, home)
    else:
        end = f"{home}/closing"
        batch.limit(0).write.mode("append").parquet(end)
        out = build(stream.unionByName(spark.readStream.schema(batch.schema).parquet(end)))
        drain(out, home)
        closing_row(batch, time, rank, days).write.mode("append").parquet(end)
        drain(out, home)
    return spark.read.schema(out.schema).parquet(f"{home}/out")
