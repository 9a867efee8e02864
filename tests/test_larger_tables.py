"""Queries on odd and larger inputs against their SQL, and the steps that keep them from growing faster than the input."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import workload
from tidemark.kit import dominance, graph, intervals, neighbours
from tidemark.kit.common import cut
from tidemark.operators import events, extremes, fields, flows, hydro, impact, peaks
from tidemark.sources import tables
from workload.base import rounded


def against_sql(spark, folder, name, tables):
    """Rows of a query on small tables, and those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = workload.QUERIES[name](spark, str(folder))
    ref = con.execute(workload.SQL[name])
    cols = sorted(d[0] for d in ref.description)
    ref = ref.df()[cols].astype(object).where(lambda d: d.notna(), None)
    return sorted(map(str, map(tuple, got.select(*cols).collect()))), sorted(str(tuple(x)) for x in ref.itertuples(index=False))


def test_event_without_flood_agrees_with_sql(spark, tmp_path):
    li = spark.createDataFrame([(e, c, 1 + n, 20000.0 * (0.5 + c % 3 + (n if e else 0))) for e in (0, 1) for c in range(60, 90) for n in (0, 1, 2)],
                               "l_suppkey long, l_partkey long, l_linenumber int, l_extendedprice double")
    part = spark.createDataFrame([(c,) for c in range(60, 90)], "p_partkey long")
    got, ref = against_sql(spark, tmp_path, "event_stats", {"lineitem": li, "part": part})
    assert len(got) == 2 and got == ref


def test_ties_round_as_in_sql(spark):
    got = spark.range(40000).select((F.col("id") * 2.5e-7).alias("x")).select(rounded(F.col("x"), 5)).collect()
    ref = duckdb.sql("SELECT round(i * CAST(2.5e-7 AS DOUBLE), 5) + 0.0 FROM range(40000) t(i) ORDER BY i").fetchall()
    assert [tuple(r) for r in got] == ref


def test_window_peak_meets_runs_not_instants(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, float(rng.randrange(300)), float(rng.randrange(9))) for k in "ab" for _ in range(400)]
    wins = [(i, "ab"[i % 2], float(rng.randrange(-20, 320)), float(rng.randrange(-20, 320))) for i in range(60)]
    monkeypatch.setattr(fields, "interval_join", None, raising=False)
    got = fields.window_peak(spark.createDataFrame(rows, "k string, time double, value double"), spark.createDataFrame(wins, "wid int, k string, a double, z double"),
                             "wid", "a", "z", "k")
    want = {}
    for i, k, a, z in wins:
        inside = [(v, -t) for kk, t, v in rows if kk == k and a <= t <= z]
        if inside:
            want[i] = (-max(inside)[1], max(inside)[0])
    assert {r.wid: (r.peak_time, r.peak_value) for r in got.collect()} == want and len(want) > 20


def test_reweighted_draws_keep_no_candidates(spark, monkeypatch):
    kept = []

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(events, "cut", counted)
    monkeypatch.setattr(intervals, "cut", counted)
    monkeypatch.setattr(intervals, "PAGE_TARGETS", 3)
    cat = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") * 3.0 - 5.0).alias("x"))
    mem = spark.range(1, 91).select(F.col("id").alias("member_id"), F.col("id").cast("double").alias("value"))
    got = events.realize_driver(cat, mem, "rain", "x", "value", 7, k=20, reuse_penalty=0.15, rounds=2).collect()
    assert len(got) == 40 and max(kept) <= 90
    near = {r.event_id: {m.member_id for m in r._near} for r in intervals.near_lists_1d(cat, mem, "event_id", "x", "member_id", "value", 20).collect()}
    for r in got:
        ranked = sorted(range(1, 91), key=lambda i: (abs(r.x - i), i))[:20]
        assert near[r.event_id] == set(ranked) and (r.x <= 0 or r.member_id is not None)


def test_season_keeps_targets_from_far_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 4)
    rng = random.Random(8)
    day = lambda: rng.choice((None, 1.0, 366.0, float(rng.randint(1, 366)), float(rng.randint(1, 366))))
    mem = [(i, rng.gauss(0, 1), day()) for i in range(500)]
    tar = [(i, rng.gauss(0, 1), day()) for i in range(50)]
    met = spark.sparkContext.accumulator(0)
    way = lambda a, b: 0.0 if a is None or b is None else min(abs(a - b), 366 - abs(a - b)) / 40
    look = F.udf(lambda x: met.add(1) or x, "double").asNondeterministic()
    gap = F.abs(F.col("t_d") - F.col("m_d"))
    dist = F.sqrt((F.col("t_a") - F.col("m_a")) ** 2 + F.coalesce((F.least(gap, 366 - gap) / 40) ** 2, F.lit(0.0)))
    got = neighbours.nearest_members(spark.createDataFrame(tar, "tid int, t_a double, t_d double"), spark.createDataFrame(mem, "mid int, m_a double, m_d double"),
                                     "tid", "mid", {"a": 1.0}, look(dist), 5, ring=("d", 1 / 40, 366.0)).collect()
    want = {(t, m[0]) for t, a, d in tar for m in sorted(mem, key=lambda m: (math.sqrt((a - m[1]) ** 2 + way(d, m[2]) ** 2), m[0]))[:5]}
    assert {(r.tid, r.mid) for r in got} == want and met.value < 50 * 500 / 2


def test_densities_meet_cells_not_rows(spark, monkeypatch):
    monkeypatch.setattr(extremes, "within_distance", None, raising=False)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(400, 60, 700), 1)
    y = np.round(0.4 * x + rng.standard_t(3, 700) * 30, 1)
    rp = np.exp(rng.normal(1.5, 1.0, 700))
    pool = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, y, rp))], "id long, x double, y double, and_return_period_years double")
    got = extremes.isoline_events(pool, [5.0, 10.0], ["x", "y"]).collect()
    z = np.linalg.solve(np.linalg.cholesky(np.cov(x, y)), np.stack([x, y])) * 700 ** (1 / 6)
    d = np.exp(-((z[:, :, None] - z[:, None, :]) ** 2).sum(0) / 2).sum(1) * 700 ** (1 / 3) / (2 * np.pi * 700 * np.sqrt(np.linalg.det(np.cov(x, y))))
    for r in got:
        near = np.abs(np.log(rp / r.target_return_period_years)) <= np.log1p(r.relative_tolerance)
        best = np.flatnonzero(near)[d[near].argmax()]
        assert r.isoline_points == near.sum() >= 25 and r.id == best and abs(r.kde_density / d[best] - 1) < 1e-11


def test_flowlines_meet_few_points(spark):
    rng = random.Random(11)
    at = lambda n: round(rng.uniform(0, n), 1)
    lines = [(i // 2, at(300), at(300)) for i in range(600)]
    lines = [(i, x, y, x + rng.choice((0.0, -9.0, 12.5)), y + rng.choice((0.0, 7.0, -15.0))) for i, x, y in lines] + [(999, 900.0, 0.0, 900.0, 300.0)]
    pts = [(i, at(300), at(300)) for i in range(80)] + [(80, 870.0, 150.0), (81, 600.0, 150.0)]
    # Two lines as far from a point as one another, but for the last bits.
    lines += [(1001, -60.1, -50.0, -60.1, -40.0), (1002, -59.9, -50.0, -59.9, -40.0)]
    pts += [(82, -60.0, -45.0)]
    met = spark.sparkContext.accumulator(0)
    look = F.udf(lambda v: met.add(1) or v, "double").asNondeterministic()
    joined = hydro._crossed
    try:
        hydro._crossed = lambda *a: joined(*a).withColumn("distance", look(F.col("distance")))
        got = hydro.nearest_flowline(spark.createDataFrame(pts, "point_id int, x double, y double"),
                                     spark.createDataFrame(lines, "line_id int, x1 double, y1 double, x2 double, y2 double"), 40.0).collect()
    finally:
        hydro._crossed = joined

    def far(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        t = min(max(((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / (dx * dx + dy * dy or 1.0), 0.0), 1.0)
        return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)

    want = set()
    for p in pts:
        best = min(round(far(p, s), 9) for s in lines)
        want |= {(p[0], s[0]) for s in lines if round(far(p, s), 9) == best <= 40}
    assert {(r.point_id, r.line_id) for r in got} == want and len(got) == len(want) and {(82, 1001), (82, 1002)} <= want
    assert all(abs(r.distance - min(far(pts[r.point_id], s) for s in lines)) < 1e-8 for r in got) and met.value < len(pts) * 60


def test_hours_of_a_hydrograph_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(flows, "interpolate", None)
    hour, rng = 3600.0, random.Random(4)
    rec = [(s, hour * rng.randrange(0, 400) / 4, float(rng.randrange(1, 90))) for s in "ab" for _ in range(150)]
    ev = [(i, "ab"[i % 2], 40 * hour + i * 1000.0, 1e6 + i, 1e6 + i - 9.5 * hour, 1e6 + i + 20.25 * hour, 50.0 + i) for i in range(8)]
    ev += [(3, "a", 50 * hour, 1e6 + 3, 1e6 + 3 - 9.5 * hour, 1e6 + 3 + 20.25 * hour, 53.0), (99, "a", 1e9, 1e6, 1e6 - hour, 1e6 + hour, 5.0)]
    got = flows.transfer_hydrograph(spark.createDataFrame(rec, "site_no string, t double, v double"), spark.createDataFrame(
        ev, "event_id int, site_no string, analog_time double, reference_time double, start double, end double, target_peak_cfs double"), "site_no", "t", "v")
    mean = {}
    for s, t, v in rec:
        mean.setdefault((s, t), []).append(v)
    want = {}
    for i in range(8):
        shape = {}
        for e, s, at, ref, a, z, target in ev:
            for (ss, t), v in mean.items():
                if e == i and ss == s and at - ref + a <= t <= at - ref + z:
                    shape[t - at + ref] = max(shape.get(t - at + ref, 0.0), sum(v) / len(v))
        ticks = ev[i][4] + np.arange(30) * hour
        q = np.interp(ticks, sorted(shape), [shape[t] for t in sorted(shape)])
        want |= {(i, round(t, 3)): x for t, x in zip(ticks, q * (50.0 + i) / q.max() * 0.028316846592)}
    rows = {(r.event_id, round(r.time, 3)): r.q_cms for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-9 for k in want)


def test_lookback_meets_runs_not_instants(spark, monkeypatch):
    monkeypatch.setattr(flows, "interval_join", None)
    rng = random.Random(6)
    ser = [("ab"[i % 2], float(rng.randrange(500)), rng.choice((None, float(rng.randrange(50))))) for i in range(900)]
    ev = [(i, "ab"[i % 2], float(rng.randrange(-20, 540))) for i in range(60)] + [(7, "b", 100.0)]
    got = flows.lookback_summary(spark.createDataFrame(ev, "event_id int, k string, time double"), spark.createDataFrame(ser, "k string, time double, value double"), 0.01, "k")
    want = {}
    for i, k, t in ev:
        inside = [v for kk, tt, v in ser if kk == k and t - 36 <= tt <= t]
        if inside:
            want.setdefault(i, []).extend(inside)
    rows = {r.event_id: r for r in got.collect()}
    assert rows.keys() == want.keys() and len(want) > 40
    for i, inside in want.items():
        v = [x for x in inside if x is not None]
        assert rows[i].row_count == len(v) and (rows[i].min_value, rows[i].max_value) == (min(v, default=None), max(v, default=None))
        assert not v or abs(rows[i].mean_value - sum(v) / len(v)) < 1e-9


def test_trend_counts_once_and_weighs_equal_rows(spark, monkeypatch):
    asked = []
    count = peaks.count_exceeding
    monkeypatch.setattr(peaks, "count_exceeding", lambda e, r, *a, **k: asked.append((e.count(), r.count())) or count(e, r, *a, **k))
    rng = random.Random(2)
    one = [(float(rng.randrange(12)), float(rng.randrange(8))) for _ in range(60)]
    rows = one * 5
    r = peaks.mann_kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    sign = lambda d: (d > 0) - (d < 0)
    s = sum(sign(b[0] - a[0]) * sign(b[1] - a[1]) for i, a in enumerate(rows) for b in rows[:i])
    free = [sum(a[i] != b[i] for j, a in enumerate(rows) for b in rows[:j]) for i in (0, 1)]
    assert asked == [(len(set(one)), len(set(one)))] and r.n == 300 and abs(r.tau - s / math.sqrt(free[0] * free[1])) < 1e-12


def test_profiles_are_made_once_a_schedule(spark, tmp_path, monkeypatch):
    loads = []
    made = impact.hourly_profiles
    monkeypatch.setattr(impact, "hourly_profiles", lambda a, *k: loads.append(a.count()) or made(a, *k))
    sup = spark.createDataFrame([(i, i * 37.2531 - 400) for i in range(40)], "s_suppkey long, s_acctbal double")
    got, ref = against_sql(spark, tmp_path, "hourly_profiles", {"supplier": sup})
    assert loads == [5] and len(got) == 5 * 8760 and got == ref


def test_sites_meet_the_nearest_primary_only(spark, monkeypatch):
    monkeypatch.setattr(tables, "within_distance", None, raising=False)
    rng = random.Random(12)
    at = lambda: float(rng.randrange(400))
    s = [(i, at(), at()) for i in range(200)] + [(900, None, 1.0)]
    p = [(at(), at()) for _ in range(60)] + [(None, 3.0)]
    got = tables.drop_overlapping_sites(spark.createDataFrame(s, "site_no int, x double, y double"), spark.createDataFrame(p, "x double, y double"), 13.0)
    near = lambda x, y: x is not None and any(px is not None and math.sqrt((x - px) ** 2 + (y - py) ** 2) <= 13.0 for px, py in p)
    want = {i for i, x, y in s if not near(x, y)}
    assert {r.site_no for r in got.collect()} == want and 900 in want and 20 < len(want) < 180


def test_soil_layers_reduce_before_anything_is_shuffled(spark):
    rng = random.Random(9)
    tops = (0.0, 5.0, 15.0, 20.0, 60.0, 90.0, 150.0)
    fields_ = ("dbthirdbar_r", "om_r", "ph1to1h2o_r", "claytotal_r", "silttotal_r", "sandtotal_r")
    rows = [(k, t, t + rng.choice((-1.0, 5.0, 10.0, 40.0, 50.0)), *(float(rng.randrange(1, 4)) for _ in fields_)) for k in range(60) for t in rng.sample(tops, rng.randrange(1, 6)) for _ in (0, 1)]
    got = hydro.soil_layers(spark.createDataFrame(rows, "mukey int, hzdept_r double, hzdepb_r double, " + ", ".join(f"{f} double" for f in fields_)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    want = {}
    for k in range(60):
        mine = [r for r in rows if r[0] == k and r[2] > r[1]]
        if not mine:
            continue
        deep = max(r[2] for r in mine)
        rank = lambda r, d: 0 if r[1] <= d < r[2] else 1 if d >= deep and r[2] >= d else 2
        pick = [min(mine, key=lambda r: (rank(r, d), abs(r[1] - d) if rank(r, d) == 2 else 0.0, r[1], *r[3:])) for d in hydro.LAYER_DEPTHS_CM]
        want[k] = (min(200.0, deep), [p[3] for p in pick], [p[8] for p in pick])
    rows = {r.mukey: (r.soilthickness, [r[f"bd_sl{i}"] for i in range(1, 8)], [r[f"sndppt_sl{i}"] for i in range(1, 8)]) for r in got.collect()}
    assert rows == want and any(v[0] in hydro.LAYER_DEPTHS_CM for v in want.values())


def test_shapes_are_made_once_a_schedule(spark, monkeypatch):
    asked = []
    shape = impact.load_shape
    monkeypatch.setattr(impact, "load_shape", lambda kind, hour: asked.append(kind) or shape(kind, hour))
    a = spark.createDataFrame([(i, (None, "24x7", "school_calendar")[i % 3], 2.0 + i) for i in range(30)], "load_asset_id int, schedule_overlay string, peak_kw double")
    e = spark.createDataFrame([(1, 8758, 4), (2, 30, 5)], "event_id int, start_hour int, steps int")
    got = impact.window_demand(a, e)
    plain = a.join(e.selectExpr("event_id", "posexplode(transform(sequence(0, steps - 1), i -> (start_hour + i) % 8760)) AS (step, hour)")).withColumn(
        "kw", F.round(F.col("peak_kw") * shape(F.col("schedule_overlay"), F.col("hour")), 6)).select("event_id", "load_asset_id", "step", "hour", "kw")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 270
    assert "schedule_overlay" not in str(asked[0])
    # A table in one file is worked on by all tasks.
    assert impact.window_demand(a.coalesce(1), e).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_meteo_sorts_only_rows_beside_a_tick(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.choice([*[round(rng.uniform(-50, 900), 2)] * 30, float(rng.randrange(0, 900, 100))]), rng.uniform(0, 300)) for k in "ab" for _ in range(2000)]
    rows += [("a", 300.0, None), ("b", None, 4.0), ("a", 300.0, 7.0), ("a", 300.0, 9.0)]
    cells = spark.createDataFrame(rows, "k string, t double, v double")
    # A regular clock with one instant far off, and two ticks close together.
    clock = spark.createDataFrame([(float(x),) for x in [*range(0, 900, 100), 1.0, 1.5, 5000.0]], "t double")
    held, plain = [], flows.interpolate
    monkeypatch.setattr(flows, "interpolate", lambda k, *a: held.append(k.count()) or plain(k, *a))
    got = {(r.k, r.t): r.v for r in flows.normalise_meteo(cells, clock, "k", "pressure", "t", "v").collect()}
    ticks = cells.select("k").distinct().join(clock)
    middle = float(np.median([v for _, _, v in rows if v is not None]))
    want = {(r.k, r.t): middle if r.v is None else r.v for r in plain(cells, ticks, ["k"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)
    fine = spark.createDataFrame([(float(x),) for x in range(0, 900, 100)], "t double")
    flows.normalise_meteo(cells, fine, "k", "pressure", "t", "v").collect()
    assert held[1] < 600  # of 4,002 rows with a value: those of the instants beside nine ticks


def test_survival_counts_only_where_few_rows_can_be_larger(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(300)), rng.choice([1.0, 2.0, rng.random() * 3])) for i in range(3000)]
    df = spark.createDataFrame(rows + [(3000, None, 1.0)], "id long, x double, y double")
    seen, plain = [], dominance._in_strips
    monkeypatch.setattr(dominance, "_in_strips", lambda p, *a: seen.append(p.count()) or plain(p, *a))
    monkeypatch.setattr(dominance, "STRIP_ROWS", 100)
    n = {i: sum(x2 > x and y2 > y for _, x2, y2 in rows) for i, x, y in rows}
    for most in (0, 37, 150.5):
        got = {r.id: r.n_exceeding for r in dominance.count_exceeding(df, df, "id", ["x", "y"], most=most).collect()}
        assert got == {i: c for i, c in n.items() if c <= most}
    assert max(seen) < 2500  # of some 6,000 rows


def test_components_of_stars_paths_and_lone_nodes(spark):
    star = [(1000, i) for i in range(900, 1000)]
    path = [(i, i + 1) for i in range(2000, 2100)]
    rng = random.Random(7)
    mixed = [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(220)]
    e = star + path + mixed + [(5, 5), (8, 7), (7, 8), (7, 8)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        if a != b:
            par[max(a, b)] = min(a, b)
    nodes = [3, 5, 7, *range(900, 950), *range(3000, 3400)]
    rounds = []
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(e, "src long, dst long"),
                                                        hold=lambda d: rounds.append(1) or cut(d)).collect()}
    assert got == {x: find(x) for x in {*nodes, *(y for a, b in e if a != b for y in (a, b))}}
    assert len(rounds) < 40


def test_large_ids_keep_their_counts(spark):
    rows = [(2**60 + i, float(i * 7 % 40), float(i * 11 % 40)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.n_exceeding for r in dominance.count_exceeding(df, df, "id", ["x", "y"]).collect()}
    assert got == {i: sum(a > x and b > y for _, a, b in rows) for i, x, y in rows}
