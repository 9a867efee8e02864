"""End-to-end catalogue builds on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import peaks as P
from tidemark.plans import catalogues as C

from .base import query
from .events import part_members

FRACTIONS = {"mild": 0.2, "common": 0.2, "significant": 0.2, "rare": 0.2, "extreme": 0.1, "beyond_design": 0.1}


def inland(t):
    pk = P.cut(P.pot_peaks(t.series(), "k", "t", "v", None, 0.90, 6).select("v"))
    n = t.events.count()
    return C.build_inland(pk, part_members(t).select("member_id", (F.col("value") - 800).alias("value")), n, n // 20, FRACTIONS, 4.0, 21, "v")


@query("build_inland_catalogue")
def build_inland_catalogue(t):
    b = inland(t)
    return b["events"].join(b["drivers"], "event_id")


@query("build_joint_catalogue")
def build_joint_catalogue(t):
    s = t.series().where(F.col("k").isin("click", "error"))
    lib = part_members(t).select("member_id", (F.col("value") - 800).alias("value"))
    n = t.events.count()
    b = C.build_joint(s, ["click", "error"], {"click": lib, "error": lib}, n // 2, n // 20, FRACTIONS, 12.0, 31, "k", "t", "v", 6, 12, 0.9)
    return b["events"].join(b["drivers"], "event_id")


@query("build_reference_bundle")
def build_reference_bundle(t):
    """Audit row counts of the bundle tables."""
    b = C.build_bundle(inland(t), t.events.select(F.col("value").alias("lag_hours")), 5)
    out = None
    for name, df in b.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
