"""Small helpers every operator shares: time to seconds, null rules, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR = 3600.0
DAY = 86400.0
YEAR = 365.25 * DAY

# Unit conversions and the clip used on probabilities.
M_TO_FT = 3.28084
CFS_TO_CMS = 0.028316846592
CLIP_EPS = 1e-6


def secs(df: DataFrame, name: str) -> Column:
    """Column `name` as seconds since 1970 (double); numeric columns pass through."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")) / F.lit(1e6)
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double") * DAY
    return F.col(name).cast("double")


def from_secs(df: DataFrame, name: str, seconds: Column) -> Column:
    """Seconds back to the type column `name` has in `df`."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date((seconds / DAY).cast("int"))
    return seconds.cast(kind)


def finite(c) -> Column:
    """The value as double, with NaN and infinities turned into null."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def over(c: Column) -> Column:
    """A divisor: null in place of zero, so that a degenerate group gives null and does not end the job."""
    return F.when(c != 0, c)


def clip(c: Column, lo, hi) -> Column:
    """Clip that keeps null as null (least/greatest skip nulls)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def listed(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only on a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise on the checkpoint folder, so loops keep a short lineage and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Write a table under the checkpoint folder and read it again, for loops that join a table with itself.

    A checkpoint hands on the planner's size estimate, and each join multiplies the estimates of its sides: after
    ten rounds they have a million digits and planning takes minutes. A written table has the size of its files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
