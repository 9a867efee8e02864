"""Draws from the nearest observations against all pairs."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.kit import draws
from tidemark.operators import events


@pytest.mark.parametrize(("cell", "leaf", "share"), [(100_000, 32, 8_000), (40, 4, 3)])
def test_draws_from_the_nearest(spark, monkeypatch, cell, leaf, share):
    monkeypatch.setattr(draws, "CELL", cell)
    monkeypatch.setattr(draws, "SHARE_TARGETS", share)
    monkeypatch.setattr(draws, "SHARE_OF_CELL", 1e9)
    monkeypatch.setattr(draws, "LEAF", leaf)
    monkeypatch.setattr(draws, "GROUP", 8)
    rng = random.Random(4)
    day = lambda: rng.choice((None, 1.0, 366.0, float(rng.randint(1, 366)), float(rng.randint(1, 366))))
    spot = lambda: (rng.choice((rng.gauss(0, 1), float(rng.randint(0, 2)))), rng.choice((rng.gauss(5, 3), 4.0)), day())
    mem = [(i, rng.choice("ab"), *spot()) for i in range(400)]
    mem += [(1000 + i, "a", 1.0, 4.0, 50.0) for i in range(30)] + [(2000 + i, "a", 1.0, 5.0 - 2 * (i % 2), 300.0) for i in range(20)]
    tar = [(i, rng.choice("ab"), *spot(), rng.random()) for i in range(200)] + [(900, "a", 1.0, 4.0, 300.0, 0.4), (901, "b", 60.0, -90.0, 3.0, 0.99), (902, "a", 1.0, 4.0, 50.0, 0.01)]
    tar += [(1000 + i, "a", 0.5, 4.5, 40.0, (i + 0.5) / 60) for i in range(60)]
    m = spark.createDataFrame(mem, "mid long, _s string, m_r double, m_c double, m_d double").withColumn("_w_r", F.lit(1.5)).withColumn("_w_c", F.lit(3.0)).withColumn("extra", F.col("mid") * 2)
    t = spark.createDataFrame(tar, "tid long, _s string, t_r double, t_c double, t_d double, _u double")
    k = 7
    got = {r.tid: r for r in draws.draw_nearest(t, m, "tid", "mid", k, 0.01, 366.0).collect()}
    assert set(got) == {r[0] for r in tar}
    for i, s, r, c, d, u in tar:
        way = lambda x: 0.0 if d is None or x is None else min(abs(d - x), 366 - abs(d - x)) * 0.01
        far = lambda x: ((r - x[2]) / 1.5) ** 2 + ((c - x[3]) / 3.0) ** 2 + way(x[4]) ** 2
        first = {}
        for x in sorted(x for x in mem if x[1] == s):
            first.setdefault(x[2:], x[0])
        near = sorted((x for x in mem if x[1] == s), key=lambda x: (round(far(x), 12), first[x[2:]], x[0]))[:k]
        weights = np.cumsum([1 / (math.sqrt(far(x)) + 1e-6) for x in near])
        want = near[min(int(np.searchsorted(weights, u * weights[-1], side="right")), k - 1)]
        assert (got[i].mid, got[i].candidates, got[i].extra) == (want[0], k, 2 * want[0])
        assert got[i].distance == pytest.approx(math.sqrt(far(want)), abs=1e-9)


def test_nearest_of_meets_few():
    rng = np.random.default_rng(2)
    metric, met = draws.Metric(1.0, 1.0, 0.01, 366.0), []
    pairs = metric.pairs
    metric.pairs = lambda t, m: met.append(len(t) * len(m)) or pairs(t, m)
    t, m = (np.column_stack([rng.normal(size=(4000, 2)), rng.integers(1, 367, 4000)]).astype(float) for _ in "ab")
    at, d2 = draws.nearest_of(t, m, np.arange(4000), 5, metric)
    assert sum(met) < 4000 * 4000 / 2
    d = pairs(t[:100], m)
    assert (np.sort(d, axis=1)[:, :5] == d2[:100]).all()


@pytest.mark.parametrize(("page", "k", "rounds"), [(2_000, 20, 2), (16, 20, 2), (16, 5, 0), (2_000, 500, 1)])
def test_analogs_are_drawn_by_one_number(spark, monkeypatch, page, k, rounds):
    monkeypatch.setattr(draws, "PAGE", page)
    monkeypatch.setattr(draws, "PAGE_TARGETS", 30)
    monkeypatch.setattr(draws, "TOGETHER", 7)
    rng = random.Random(9)
    mem = [(i, rng.uniform(1, 90)) for i in range(150)] + [(200, 0.0), (201, None)]
    tar = [(i, rng.choice((rng.uniform(0.5, 120), rng.uniform(20, 21)))) for i in range(120)] + [(500, None), (501, -1.0), (502, 1e9), (503, 1e-9)]
    got = {r.event_id: r for r in events.realize_driver(spark.createDataFrame(tar, "event_id long, x double"), spark.createDataFrame(mem, "member_id long, value double"), "rain", "x", "value", 7,
                                                        k=k, reuse_penalty=0.3, rounds=rounds).collect()}
    u = {i: (int(hashlib.md5(f"7|rain|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for i, _ in tar}
    live = sorted((math.log(v), i, v) for i, v in mem if v)
    use = {}
    for _ in range(rounds + 1):
        want = {}
        for i, x in tar:
            if not x or x <= 0:
                want[i] = live[-1]
                continue
            near = sorted(sorted(live, key=lambda m: abs(m[0] - math.log(x)))[:k])
            sigma = max(0.5 * np.std([m[0] for m in near]), 1e-6)
            w = np.array([math.exp(-0.5 * ((m[0] - math.log(x)) / sigma) ** 2) * math.exp(-0.3 * use.get(m[1], 0)) for m in near])
            total = np.cumsum(w if w.sum() > 0 else np.ones(len(w)))
            want[i] = near[int(np.searchsorted(total, u[i] * total[-1], side="right"))]
        use = Counter(m[1] for m in want.values())
    assert {i: (r.member_id, r.template_value) for i, r in got.items()} == {i: m[1:] for i, m in want.items()}
    assert all(got[i].scale_factor == (pytest.approx(x / want[i][2]) if x and x > 0 else 1.0) for i, x in tar)
