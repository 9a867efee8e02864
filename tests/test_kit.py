"""Kit operators against plain loops on random frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.kit import blocks, dominance, graph, intervals, sessions


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "t": rng.integers(0, 400, n).astype(float),
                        "v": rng.integers(0, 60, n).astype(float), "id": range(n)})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("parts", [1, 7])
def test_running_matches_plain_windows(data, parts):
    pdf, df = data
    outs = {"rn": ("sum", F.lit(1)), "lg": ("lag", "id"), "ld": ("lead", "id"), "last": ("last", F.when(F.col("id") % 7 == 0, F.col("id"))), "mx": ("max", "v")}
    got = blocks.running(df.repartition(parts), ["k"], "t", outs, tie="id").toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    e = pdf.sort_values(["k", "t", "id"]).reset_index(drop=True)
    g = e.groupby("k")
    want = {"rn": g.cumcount() + 1, "lg": g.id.shift(1), "ld": g.id.shift(-1), "mx": g.v.cummax()}
    e["x"] = e.id.where(e.id % 7 == 0)
    want["last"] = e.groupby("k").x.ffill()
    for c, w in want.items():
        assert (got[c].astype(float).fillna(-1).values == w.astype(float).fillna(-1).values).all(), c


def test_running_with_many_cuts(data):
    pdf, df = data
    got = blocks.row_numbers(df, None, "v", "id", n=blocks.MANY).toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    assert all(got[i] == r + 1 for r, i in enumerate(want.id))


def test_quantiles_are_exact_and_skip_nan(spark, data):
    pdf, df = data
    bad = df.withColumn("v", F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    got = blocks.quantiles(bad, ["k"], {"m": ("v", 0.5), "p": ("v", 0.9)}).toPandas().set_index("k")
    ok = pdf[pdf.id % 50 != 0].groupby("k").v
    for k in "ab":
        assert got.m[k] == pytest.approx(ok.median()[k])
        assert got.p[k] == pytest.approx(ok.quantile(0.9)[k])


def greedy(d, gap):
    out = []
    for r in d.sort_values(["v", "t"], ascending=[False, True]).itertuples():
        if all(abs(r.t - x) >= gap for x, _ in out):
            out.append((r.t, r.v))
    return sorted(out)


@pytest.mark.parametrize("limit", [sessions.FOLD_ROWS, 4])
def test_greedy_peaks_fold_and_rounds(data, limit):
    pdf, df = data
    pk = sessions.greedy_peaks(df, ["k"], "t", "v", 5.0, fold_rows=limit).toPandas()
    for k in "ab":
        assert sorted(zip(pk[pk.k == k].t, pk[pk.k == k].v)) == greedy(pdf[pdf.k == k], 5.0)


def test_gap_exactly_equal_keeps_both(spark):
    df = spark.createDataFrame([(0.0, 3.0), (10.0, 2.0), (19.0, 1.0)], "t double, v double")
    assert sorted(r.t for r in sessions.greedy_peaks(df, None, "t", "v", 10.0).collect()) == [0.0, 10.0]


def test_anchored_events_differs_from_chain(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 6, 12, 18, 40)], "t double")
    assert sessions.anchored_events(df, None, "t", 10.0).first()[0] == 3
    assert sessions.sessions(df, None, "t", 10.0).select("session").distinct().count() == 2


@pytest.mark.parametrize("cols", [["t", "v"], ["t", "v", "w"]])
def test_dominance_counts(data, cols):
    pdf, df = data
    pdf = pdf.assign(w=(pdf.id * 7 % 101).astype(float))
    rf = df.withColumn("w", (F.col("id") * 7 % 101).cast("double"))
    got = dominance.count_exceeding(rf.where("id < 80"), rf, "id", cols).toPandas().set_index("id").n_exceeding
    ref = pdf[cols].values
    for i in range(80):
        assert got[i] == int((ref > pdf.loc[i, cols].values.astype(float)).all(axis=1).sum())


def test_components_and_chain(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(150, 220)]
    got = {r.node: r.component for r in graph.components(spark.range(240).toDF("node"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    par = list(range(240))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    assert all(got[i] == find(i) for i in range(240))


def test_subtree_sums_and_drains(spark):
    tree = spark.createDataFrame([(i, i // 2 if i > 1 else None, 1.0) for i in range(1, 100)], "n long, p long, v double")
    got = {r.n: r.v for r in graph.subtree_sums(tree, "n", "p", ["v"]).collect()}
    size = lambda i: 0 if i >= 100 else 1 + size(2 * i) + size(2 * i + 1)
    assert all(got[i] == size(i) for i in range(1, 100))
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, None)], "n long, d long")
    assert {(r.n, r.o) for r in graph.drains_to(loop, spark.createDataFrame([(4,)], "o long"), "n", "d", "o").collect()} == {(3, 4), (4, 4)}


def test_knn_is_exact(data):
    pdf, df = data
    near = intervals.knn_1d(df.where("id < 30").select("id", F.col("v").alias("tv")), df.select(F.col("id").alias("m"), F.col("t").alias("mv")), "id", "tv", "m", "mv", 10)
    far = near.groupBy("id").agg(F.max("gap").alias("g"), F.count("*").alias("n")).toPandas()
    for r in far.itertuples():
        assert r.n == 10 and r.g == sorted(abs(pdf.t - pdf.v[r.id]))[9]


def test_unbounded_nearest(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0)], "p int, x double, y double")
    c = spark.createDataFrame([(9, 3.0, 4.0), (7, 3.0, 4.0)], "c int, cx double, cy double")
    got = {r.p: (r.c, r.distance) for r in intervals.nearest(p, c, "p", "x", "y", "c", "cx", "cy", 10.0, unbounded=True).collect()}
    assert got[1] == (7, 5.0) and got[2][0] == 7


@pytest.mark.parametrize("unbounded", [False, True])
def test_nearest_meets_few_cells_whatever_the_radius(spark, monkeypatch, unbounded):
    rng = np.random.default_rng(4)
    cells = pd.DataFrame({"c": range(900), "cx": np.r_[rng.uniform(0, 900, 600), rng.uniform(500, 503, 300)].round(1), "cy": np.r_[rng.uniform(0, 900, 600), rng.uniform(500, 503, 300)].round(1)})
    pts = pd.DataFrame({"p": range(300), "x": np.r_[rng.uniform(0, 900, 299), 2000.0].round(1), "y": np.r_[rng.uniform(0, 900, 299), 2000.0].round(1)})
    sides, ring = [], intervals._ring
    monkeypatch.setattr(intervals, "_ring", lambda p, s, pid, cid, size: sides.append(size) or ring(p, s, pid, cid, size))
    got = {(r.p, r.c) for r in intervals.nearest(spark.createDataFrame(pts), spark.createDataFrame(cells), "p", "x", "y", "c", "cx", "cy", 800.0, unbounded).collect()}
    d = np.sqrt((pts.x.values[:, None] - cells.cx.values) ** 2 + (pts.y.values[:, None] - cells.cy.values) ** 2)
    assert got == {(i, int(d[i].argmin())) for i in range(300) if unbounded or d[i].min() <= 800.0}
    assert sides[0] < 20 and (unbounded or sides[-1] == 800.0)


def test_next_reads_no_frame_to_the_end(data):
    plan = blocks.running(data[1], ["k"], "t", {"n": ("next", "v")}, tie="id")._jdf.queryExecution().analyzed().toString().lower()
    assert "currentrow$(), unboundedfollowing" not in plan


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_two_dimensions_count_in_strips(spark, monkeypatch, by, strict):
    monkeypatch.setattr(dominance, "STRIP_ROWS", 20)
    monkeypatch.setattr(dominance, "_dyadic", None)  # copies of rows are for more dimensions
    rng = np.random.default_rng(8)
    n = 600
    d = pd.DataFrame({"id": range(n), "g": rng.integers(0, 2, n), "x": np.where(rng.random(n) < 0.4, 3.0, rng.uniform(0, 9, n).round(1)), "y": np.where(rng.random(n) < 0.3, 1.0, rng.normal(0, 3, n).round(1))})
    s = spark.createDataFrame(d)
    got = dominance.count_exceeding(s.where("id < 90"), s.drop("id"), "id", ["x", "y"], by, strict=strict).toPandas().set_index("id").n_exceeding
    more = np.greater if strict else np.greater_equal
    for i in range(90):
        e = d.iloc[i]
        assert got[i] == (more(d.x, e.x) & more(d.y, e.y) & ((d.g == e.g) | (not by))).sum()
