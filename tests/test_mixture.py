import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import extremes as X
from tidemark.operators import mixture as M


def factor_of(spark, corr):
    """Factor of a given correlation matrix, by hand."""
    d, low = len(corr), []
    for i in range(d):
        row = []
        for j in range(i):
            row.append((corr[i][j] - sum(row[m] * low[j][m] for m in range(j))) / low[j][j])
        low.append(row + [math.sqrt(1 - sum(x * x for x in row))])
    return spark.createDataFrame([([x for r in low for x in r],)], "factor array<double>")


def test_survival_of_three_and_four_drivers_at_the_medians(spark):
    u = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.5)], "id int, a double, b double, c double, d double")
    r = ((1, 0.6, 0.3), (0.6, 1, -0.4), (0.3, -0.4, 1))
    known = 1 / 8 + (math.asin(0.6) + math.asin(0.3) + math.asin(-0.4)) / (4 * math.pi)
    got = M.gaussian_joint_survival(u, "id", ["a", "b", "c"], factor_of(spark, r)).first().and_survival
    assert got == pytest.approx(known, rel=3e-3)
    # Equal correlations of one half: 1 / (d + 1).
    r4 = [[1.0 if i == j else 0.5 for j in range(4)] for i in range(4)]
    got = M.gaussian_joint_survival(u, "id", ["a", "b", "c", "d"], factor_of(spark, r4), nodes=1024).first().and_survival
    assert got == pytest.approx(1 / 5, rel=3e-3)


def test_survival_of_two_drivers_equals_the_integral(spark):
    rows = [(i, 0.05 + 0.1 * i, 0.95 - 0.07 * i) for i in range(9)] + [(9, None, 0.5)]
    u = spark.createDataFrame(rows, "id int, a double, b double")
    one = {r.id: r.and_survival for r in X.gaussian_and_survival(u, "a", "b", 0.55).collect()}
    two = {r.id: r.and_survival for r in M.gaussian_joint_survival(u, "id", ["a", "b"], factor_of(spark, ((1, 0.55), (0.55, 1)))).collect()}
    assert two.pop(9) is None and len(two) == 9
    for i, s in two.items():
        assert s == pytest.approx(one[i], rel=3e-3, abs=1e-5)


def test_factor_of_determined_and_constant_columns(spark):
    df = spark.createDataFrame([(0.1 * i, 0.1 * i, 0.5) for i in range(1, 10)], "a double, b double, c double")
    f = M.gaussian_factor(df, ["a", "b", "c"]).first().factor
    assert f[:2] == pytest.approx([1, 1]) and f[2] == pytest.approx(1e-3) and f[3:] == pytest.approx([0, 0, 1])


def test_digit_reversal_and_normal_law():
    got = M.digit_reversal(np.arange(1, 9), 3)
    assert got == pytest.approx([1 / 3, 2 / 3, 1 / 9, 4 / 9, 7 / 9, 2 / 9, 5 / 9, 8 / 9])
    x = np.array([-4.0, -1.0, 0.0, 0.3, 2.5])
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in x]
    assert M.normal_cdf(x) == pytest.approx(want, abs=1e-7) and M.normal_ppf(np.array(want)) == pytest.approx(x, abs=1e-6)


def law_and_rows(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a = rng.expovariate(1.0)
        rows.append((i, "wet" if i % 4 else "dry", a, a + rng.expovariate(2.0), rng.expovariate(0.5)))
    rows += [(1000 + i, "rare", 1.0 + i, 2.0, 3.0) for i in range(5)] + [(2000, "unresolved", 1.0, 1.0, 1.0), (2001, None, 1.0, 1.0, 1.0),
                                                                       (2002, "wet", None, 1.0, 1.0)]
    rows += [(3000 + i, "flat", 7.0, float(i), float(i % 3)) for i in range(30)]
    paired = spark.createDataFrame(rows, "eid int, storm_type string, a double, b double, c double")
    return M.fit_mixture_law(paired, ["a", "b", "c"], 3.0, "eid").cache(), paired


def test_law_and_pool(spark):
    law, paired = law_and_rows(spark)
    got = {r.storm_type: r for r in law.collect()}
    assert set(got) == {"wet", "dry", "rare", "flat"}
    assert not got["rare"].fitted and got["rare"].low_confidence and got["rare"].margins is None
    assert not got["flat"].fitted  # a constant driver has no tail
    assert got["wet"].rate == pytest.approx(3.0 * 301 / paired.count()) and got["wet"].fitted and not got["wet"].low_confidence
    pool = M.simulate_mixture_pool(law, ["a", "b", "c"], 1000, 3, nodes=64).cache()
    n = {r.storm_type: r["count"] for r in pool.groupBy("storm_type").count().collect()}
    assert n == {"wet": round(1000 * 301 / 401), "dry": round(1000 * 100 / 401)}
    assert pool.select("id").distinct().count() == pool.count()
    # Each type's first driver is spread evenly, more evenly than independent draws would be.
    share = {r.storm_type: r.s for r in pool.groupBy("storm_type").agg(F.avg((F.col("a_u") < 0.25).cast("double")).alias("s")).collect()}
    assert all(abs(s - 0.25) < 0.02 for s in share.values())
    # The copula's dependence is that of the sample.
    r = pool.where("storm_type = 'wet'").agg(F.corr("a_u", "b_u"), F.corr("a_u", "c_u")).first()
    assert r[0] > 0.6 and abs(r[1]) < 0.15
    # Frequency falls as drivers rise, and the same law gives the same pool again.
    worst = pool.orderBy(F.desc("return_period_years")).first()
    assert worst.frequency_per_year < 0.05 and worst.return_period_years == pytest.approx(1 / worst.frequency_per_year)
    again = M.simulate_mixture_pool(law.repartition(3), ["a", "b", "c"], 1000, 3, nodes=64)
    assert again.select("id", "a", "b").exceptAll(pool.select("id", "a", "b")).isEmpty()


def test_frequency_against_counting(spark):
    law, paired = law_and_rows(spark)
    probe = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.5, 0.8, 1.0), (3, 1e9, 1.0, 1.0), (4, None, 1.0, 1.0)], "id int, a double, b double, c double")
    got = {r.id: r for r in M.combined_frequency(probe, law, "id", ["a", "b", "c"]).collect()}
    all_rate = law.where("fitted").agg(F.sum("rate")).first()[0]
    assert got[1].frequency_per_year == pytest.approx(all_rate, rel=0.02)
    seen = paired.where("storm_type in ('wet', 'dry') and a > 0.5 and b > 0.8 and c > 1.0").count() / 400
    assert got[2].frequency_per_year == pytest.approx(all_rate * seen, rel=0.15)
    assert got[3].frequency_per_year < 1e-5 and got[4].frequency_per_year is None and got[4].return_period_years is None


def test_empty_law(spark):
    empty = spark.createDataFrame([], "eid int, storm_type string, a double, b double")
    law = M.fit_mixture_law(empty, ["a", "b"], 3.0, "eid")
    assert law.isEmpty() and M.simulate_mixture_pool(law, ["a", "b"], 100, 1).isEmpty()


def test_pool_is_not_told_to_all_tasks(spark):
    tail = "struct<dist:string,shape:double,loc:double,scale:double>"
    law = spark.createDataFrame([("a", 9, 1.0, True, False, [("exp", 0.0, 0.0, 1.0)] * 2, [1.0, 0.2, 0.9])],
                                f"storm_type string, n_events long, rate double, fitted boolean, low_confidence boolean, margins array<{tail}>, factor array<double>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        plan = M.simulate_mixture_pool(law, ["x", "y"], 20_000, 3, nodes=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin [id" not in plan and "SortMergeJoin [id" in plan
