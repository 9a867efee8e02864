"""Whole seats for fractions of a total, as one plan over a table with a row per label."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F


def apportion(spark: SparkSession, fractions: dict[str, float], total: int, room: dict[str, int] | None = None) -> dict[str, int]:
    """Seats per label: the whole part of each share, then one more by rank of what was cut off.

    Without `room` a share is fraction x total, and labels of equal remainder keep their order. With `room` the labels that
    have any share the total among them (equal remainders: larger share first), none gets more than its room, and the seats
    that fall back are dealt out again: the j-th spare seat of every label comes before any (j+1)-th, larger fractions first.
    Only the labels' own rows are involved, whatever the data.
    """
    rows = [(i, k, float(f), None if room is None else int(room.get(k) or 0)) for i, (k, f) in enumerate(fractions.items())]
    t = spark.createDataFrame([r for r in rows if r[3] != 0] or [(0, "", 0.0, 0)], "place int, label string, fraction double, room long")
    every = Window.partitionBy(F.lit(0))
    share = F.lit(float(total)) * F.col("fraction")
    if room is not None:
        share = share / F.nullif(F.sum("fraction").over(every), F.lit(0.0))
    t = t.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("whole", F.floor("share"))
    cut_off = F.desc(F.col("share") - F.col("whole"))
    by = every.orderBy(cut_off, *([F.desc("share")] if room is not None else []), "place")
    extra = (F.row_number().over(by) <= F.lit(total) - F.sum("whole").over(every)) & (F.col("share") > 0 if room is not None else F.lit(True))
    t = t.withColumn("asked", F.col("whole") + extra.cast("long")).withColumn("held", F.least("asked", F.coalesce("room", "asked")))
    t = t.withColumn("back", F.sum(F.col("asked") - F.col("held")).over(every)).withColumn("spare", F.coalesce("room", "held") - F.col("held"))
    seats = t.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("spare", "back"))))
    turn = F.row_number().over(Window.partitionBy(F.col("j") > 0).orderBy("j", F.desc("fraction"), "place"))
    dealt = seats.withColumn("got", F.when(F.col("j") == 0, F.col("held")).otherwise((turn <= F.col("back")).cast("long")))
    return {r["label"]: int(r["n"]) for r in dealt.groupBy("place", "label").agg(F.sum("got").alias("n")).orderBy("place").collect() if r["label"]}
