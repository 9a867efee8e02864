"""What the text operators share: text folding, word splitting, hashes, Arrow passes and written cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kit.common import cut, ensure_checkpoint_dir

__all__ = ["arrow_pass", "cut", "documents", "ensure_checkpoint_dir", "let", "lower_ascii", "md5_long", "shared_folder",
           "set_apart", "small_batches", "spaced_words", "text_bytes"]

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A-Z to a-z; every other byte stays, so UTF-8 sequences are never touched.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and the six white-space bytes become blanks.
LOWER_SPACED = bytes(32 if b in SPACE else LOWER[b] for b in range(256))
#: Rows of text in one Arrow batch: keeps a batch of ordinary documents at a few MB.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Cap the rows of an Arrow batch, so that long texts do not pile up in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (string) and the named columns; other columns are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def set_apart(df: DataFrame, **more: Column) -> tuple[DataFrame, list[Column]]:
    """`df` under positional names beside the columns `more`, and the columns that give its own back: no name can clash."""
    inner = [f"in_{i}" for i in range(len(df.columns))]
    held = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(df.columns, inner)], *[v.alias(k) for k, v in more.items()])
    return held, [F.col(i).alias(c) for c, i in zip(df.columns, inner)]


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply `fn` to every Arrow batch of `df`."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""


def lower_ascii(raw: bytes) -> bytes:
    return raw.translate(LOWER)


def spaced_words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between runs of the six white-space characters."""
    return raw.translate(LOWER_SPACED).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def md5_long(*parts: Column) -> Column:
    """First 15 hex digits of the md5 of the parts joined by '|', as a long: SQL engines agree on it."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one table under the checkpoint folder that all executors share."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
