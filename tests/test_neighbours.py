"""The tree of boxes against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.kit import neighbours
from tidemark.operators import events


@pytest.mark.parametrize(("told_rows", "leaf", "k"), [(100_000, 64, 5), (0, 4, 3)])
def test_nearest_members(spark, monkeypatch, told_rows, leaf, k):
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    rng = random.Random(6)
    members = [(i, rng.choice((rng.gauss(0, 1), rng.gauss(50, 9))), rng.choice((0.0, 2.0, rng.random())), rng.uniform(0, 9)) for i in range(700)]
    members += [(1000 + i, 1.5, 2.0, 3.0) for i in range(40)] + [(2000, None, 1.0, 1.0), (2001, 1.0, float("nan"), 1.0), (-1, None, None, None)]
    targets = [(i, rng.gauss(20, 30), rng.uniform(-1, 3), rng.uniform(0, 9)) for i in range(60)] + [(100, 1.5, 2.0, 3.0), (101, 1e6, 0.0, 0.0), (102, None, 1.0, 1.0), (103, float("nan"), 1.0, 1.0)]
    t = spark.createDataFrame(targets, "tid int, t_a double, t_b double, t_c double")
    m = spark.createDataFrame(members, "mid int, m_a double, m_b double, m_c double").withColumn("extra", F.col("mid") * 2)
    dist = F.sqrt((F.col("t_a") - F.col("m_a")) ** 2 + (2 * (F.col("t_b") - F.col("m_b"))) ** 2 + F.least(F.abs(F.col("t_c") - F.col("m_c")), F.lit(4.0)))
    got = neighbours.nearest_members(t, m, "tid", "mid", {"a": 1.0, "b": 2.0}, dist, k, ("m_c",), 4.0, told_rows)
    whole = [r for r in members if r[1] is not None and not math.isnan(r[2])]
    want = set()
    for i, a, b, c in targets:
        if a is None or math.isnan(a):
            want |= {(i, r[0], n, 0.0, 2 * r[0]) for n, r in enumerate(sorted(members, key=lambda r: r[0])[:k], 1)}
            continue
        near = sorted((math.sqrt((a - r[1]) ** 2 + (2 * (b - r[2])) ** 2 + min(abs(c - r[3]), 4.0)), r[0]) for r in whole)[:k]
        want |= {(i, r, n, round(d, 9), 2 * r) for n, (d, r) in enumerate(near, 1)}
    assert {(r.tid, r.mid, r.near_rank, round(r.distance, 9), r.extra) for r in got.collect()} == want


def test_few_or_no_members(spark):
    t = spark.createDataFrame([(1, 0.0), (2, None)], "tid int, t_a double")
    dist = F.abs(F.col("t_a") - F.col("m_a"))
    few = spark.createDataFrame([(5, 1.0), (6, 2.0)], "mid int, m_a double")
    assert sorted((r.tid, r.mid) for r in neighbours.nearest_members(t, few, "tid", "mid", {"a": 1.0}, dist, 9).collect()) == [(1, 5), (1, 6), (2, 5), (2, 6)]
    assert neighbours.nearest_members(t, few.limit(0), "tid", "mid", {"a": 1.0}, dist, 9).count() == 0


def test_lag_of_an_event_without_a_level(spark):
    pool = spark.createDataFrame([("tropical", float(i), i / 7.0, f"2020-0{i % 9 + 1}-01", float(i)) for i in range(30)],
                                 "storm_type string, rainfall double, coastal_water_level double, event_time string, observed_lag_hours double").withColumn("event_time", F.to_date("event_time"))
    catalog = spark.createDataFrame([(1, "tropical", 5.0, 1.0, "2020-05-01"), (2, "tropical", 5.0, None, "2020-05-01"), (3, "other", None, 2.0, None)],
                                    "event_id int, storm_type string, rainfall double, coastal_water_level double, event_time string").withColumn("event_time", F.to_date("event_time"))
    got = {r.event_id: r for r in events.lag_analogs(catalog, pool, 7, k=5).collect()}
    assert set(got) == {1, 2, 3} and got[1].analog_distance > 0 and got[2].analog_distance == got[3].analog_distance == 0
    assert [got[i].stratum for i in (1, 2, 3)] == ["tropical", "tropical", "all"] and all(r.candidates == 5 for r in got.values())
