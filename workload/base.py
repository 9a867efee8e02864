"""Query registry: a Spark callable, its SQL twin, and the digits both sides round to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Shared derivations; EVENTS_SQL and friends below repeat them for the SQL side.
    def series(self) -> DataFrame:
        """Five driver series: (k, t seconds, v)."""
        return self.events.select(F.col("event_type").alias("k"), us(F.col("ts")).alias("t"), F.col("value").alias("v"))

    def daily(self) -> DataFrame:
        """A daily record per order priority: (k, d date, t seconds, v)."""
        d = F.to_date("o_orderdate")
        day = self.orders.groupBy(F.col("o_orderpriority").alias("k"), d.alias("d")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("v"))
        return day.select("k", "d", (F.unix_date("d").cast("double") * 86400.0).alias("t"), "v")

    def cells(self) -> DataFrame:
        """A daily rainfall-like grid of 4 x 4 cells: (row, col, t seconds, v)."""
        d = F.unix_date(F.to_date("l_shipdate")).cast("double") * 86400.0
        return self.lineitem.groupBy((F.col("l_partkey") % 4).alias("row"), (F.floor(F.col("l_partkey") / 4) % 4).alias("col"),
                                     d.alias("t")).agg(F.sum("l_quantity").alias("v"))

    def discharge(self) -> DataFrame:
        """Discharge of 12 sources in 3 events per day: (event_id, source_id, t, q)."""
        d = F.unix_date(F.to_date("l_shipdate")).cast("double") * 86400.0
        return self.lineitem.groupBy(F.col("l_returnflag").alias("event_id"), (F.col("l_suppkey") % 12).alias("source_id"),
                                     d.alias("t")).agg(F.round(F.sum("l_extendedprice"), 2).alias("q"))


SERIES_SQL = "series AS (SELECT event_type AS k, epoch_us(ts)/1e6 AS t, value AS v FROM events)"
DAILY_SQL = ("daily AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS d, "
             "CAST(epoch(CAST(o_orderdate AS DATE)) AS DOUBLE) AS t, round(sum(o_totalprice), 2) AS v "
             "FROM orders GROUP BY ALL)")
CELLS_SQL = ('cells AS (SELECT l_partkey % 4 AS "row", (l_partkey // 4) % 4 AS col, '
             "CAST(epoch(CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)")
DISCHARGE_SQL = ("q AS (SELECT l_returnflag AS event_id, l_suppkey % 12 AS source_id, "
                 "CAST(epoch(CAST(l_shipdate AS DATE)) AS DOUBLE) AS t, round(sum(l_extendedprice), 2) AS q FROM lineitem GROUP BY ALL)")


def us(c):
    """Timestamp column to seconds as double."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def rounded(c: Column, digits: int) -> Column:
    """Rounded as the SQL side does: the scaled double to a whole number. F.round goes by decimal digits, so the two part at ties."""
    whole = F.round(c * 10.0**digits) / 10.0**digits
    # Adding zero turns a negative zero into zero; a value too large to be scaled stays.
    return F.when(F.abs(c * 10.0**digits) < float("inf"), whole).otherwise(c) + F.lit(0.0)


def query(name: str, sql: str | None = None, **digits: int):
    """Register a query. `digits` names double columns rounded alike on both sides."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            for c, d in digits.items():
                out = out.withColumn(c, rounded(F.col(c).cast("double"), d))
            return out

        QUERIES[name] = run
        if sql is not None:
            fix = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in digits.items())
            SQL[name] = f"SELECT * REPLACE ({fix}) FROM ({sql})" if fix else sql
        return fn

    return wrap
