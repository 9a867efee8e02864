"""Readers for driver records, track files and gauge tables, incremental merges and catalogue sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kit.common import finite


def clean_records(df: DataFrame, driver: str, time: str, value: str, group: str | None = None, sites: list[str] | None = None, aggregate: str | None = None) -> DataFrame:
    """(driver, time, value) of one record table: wanted sites, bad times and values dropped, optional per-instant aggregate."""
    if group and sites:
        df = df.where(F.col(group).cast("string").isin([str(s) for s in sites]))
    out = df.select(F.lit(driver).alias("driver"), F.col(time).try_cast("timestamp").alias("time"), finite(F.col(value).try_cast("double")).alias("value")).dropna()
    if aggregate:
        fn = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[aggregate]
        out = out.groupBy("driver", "time").agg(fn("value").alias("value"))
    return out


def scan_driver_records(spark: SparkSession, specs: dict[str, dict], sites: list[str] | None = None) -> DataFrame:
    """Union of configured records. A spec has path, time_column, value_column and optional group_column, aggregate, format."""
    out = None
    for driver, s in specs.items():
        kind = s.get("format", "parquet" if str(s["path"]).endswith(".parquet") else "csv")
        raw = spark.read.parquet(s["path"]) if kind == "parquet" else spark.read.option("header", True).csv(s["path"])
        part = clean_records(raw, driver, s["time_column"], s["value_column"], s.get("group_column"), sites, s.get("aggregate"))
        out = part if out is None else out.unionByName(part)
    return out


def _degrees(text: Column) -> Column:
    """28.0N -> 28.0, 94.8W -> -94.8."""
    sign = F.when(F.upper(F.right(text, F.lit(1))).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * F.regexp_replace(text, "[NSEWnsew]$", "").try_cast("double")


def flatten_tracks(lines: DataFrame, path: str = "path", line_no: str = "line_no", text: str = "value") -> DataFrame:
    """One row per track point from header lines `id,name,n` followed by n points; extra points are ignored.

    `lines` has file, line number and text. Headers carry forward inside one file, which is a storm archive of modest
    size; files spread over tasks.
    """
    p = lines.where(F.trim(text) != "").withColumn("_p", F.transform(F.split(text, ","), lambda x: F.trim(x)))
    p = p.withColumn("_head", (F.size("_p") >= 3) & (F.size("_p") < 7) & F.get(F.col("_p"), F.lit(2)).try_cast("int").isNotNull())
    w = Window.partitionBy(path).orderBy(line_no)
    p = p.withColumn("_h", F.last(F.when(F.col("_head"), F.struct(F.col(line_no).alias("at"), F.col("_p")[0].alias("id"), F.col("_p")[1].alias("name"), F.col("_p")[2].try_cast("int").alias("n"))), True).over(w))
    # Blank lines do not count, so the place is a rank within the header's block.
    v = Window.partitionBy(path, "_h.at").orderBy(line_no)
    q = p.withColumn("_i", F.row_number().over(v) - 1).where(~F.col("_head") & (F.col("_i") <= F.col("_h.n")) & (F.size("_p") >= 7))
    when = F.try_to_timestamp(F.concat(F.col("_p")[0], F.lpad(F.col("_p")[1], 4, "0")), F.lit("yyyyMMddHHmm"))
    return q.select(F.col("_h.id").alias("storm_id"), F.col("_h.name").alias("name"), when.alias("time"), F.col("_p")[3].alias("status"), _degrees(F.col("_p")[4]).alias("lat"),
                    _degrees(F.col("_p")[5]).alias("lon"), F.col("_p")[6].try_cast("double").alias("wind_kt")).where("time is not null")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track points of text files. Line numbers come from reading each file whole, as headers span lines."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return flatten_tracks(files)


def scan_gauge_rdb(spark: SparkSession, path: str, service: str) -> DataFrame:
    """Discharge rows of tab-separated gauge files: comments and the width row dropped, the 00060 value column found by name."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    alias = {"site_no": ("site_no", "site"), "time": ("datetime", "dateTime", "date", "time")}
    pick = lambda names: next((c for c in raw.columns if c in names), None)
    site, time = pick(alias["site_no"]), pick(alias["time"])
    flow = [c for c in raw.columns if "00060" in c and not c.endswith("_cd")]
    if not site or not time or not flow:
        raise ValueError(f"no site, time or 00060 column in {raw.columns}")
    q = F.coalesce(*[finite(F.col(f"`{c}`").try_cast("double")) for c in flow])
    rows = raw.where(~F.coalesce(F.col(site).rlike("^[0-9]+s$"), F.lit(False)))
    return rows.select(F.lpad(F.col(site), 8, "0").alias("site_no"), F.col(time).try_cast("timestamp").alias("time"), q.alias("discharge_cfs"), F.lit(f"usgs_{service}").alias("source")).dropna()


def merge_incremental(cached: DataFrame, fresh: DataFrame, wanted: DataFrame, key: str = "site_no") -> DataFrame:
    """Cached rows of wanted sites plus fresh rows of wanted sites not cached."""
    have = cached.select(key).distinct()
    return cached.join(wanted.select(key).distinct(), key, "left_semi").unionByName(
        fresh.join(have, key, "left_anti").join(wanted.select(key).distinct(), key, "left_semi"), allowMissingColumns=True)


def check_coverage(df: DataFrame, time: str, start, end, required: list[str] | None = None) -> DataFrame:
    """One row: first and last instant, rows, and whether the table spans [start, end]."""
    absent = [c for c in required or [] if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    a = df.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("rows"))
    kind = df.schema[time].dataType
    ok = (F.col("first") <= F.lit(start).cast(kind)) & (F.col("last") >= F.lit(end).cast(kind))
    return a.withColumn("covers", F.coalesce(ok, F.lit(False)))


# Leading columns of the event and driver catalogues.
EVENT_COLUMNS = ["event_id", "event_role", "event_origin", "event_family", "scenario_name", "sample_rp_years", "and_joint_exceedance_prob", "and_joint_aep",
                 "severity_band", "sampling_region", "sampling_weight", "probability_weight", "event_reference_time", "selection_reason"]
DRIVER_COLUMNS = ["event_id", "driver", "x", "u", "driver_role", "member_id", "member_file", "member_time", "template_value", "scale_factor", "lag_hours", "time_policy", "realization_policy", "source"]


def lead_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Leading columns in fixed order, nulls where absent, then everything else."""
    lead = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in first]
    return df.select(*lead, *[F.col(c) for c in df.columns if c not in first])


def write_catalog(df: DataFrame, path: str, first: list[str] = EVENT_COLUMNS, partition_by: list[str] | None = None, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a catalogue with its leading columns as Parquet, CSV or JSON."""
    w = lead_columns(df, first).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)
