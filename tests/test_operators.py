"""Operators on small hand-made frames with worked-out results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import mathx
from tidemark.kit.apportion import apportion
from tidemark.kit.intervals import nearest
from tidemark.operators import events as V
from tidemark.operators import extremes as X
from tidemark.operators import flows as H
from tidemark.operators import hydro as Y
from tidemark.operators import impact as I
from tidemark.operators import network as N
from tidemark.operators import outcomes as O
from tidemark.operators import peaks as P
from tidemark.sources import readers as R


def test_math_columns(spark):
    r = spark.range(1).select(mathx.erf(F.lit(0.7)), mathx.gamma(F.lit(4.5)), mathx.norm_ppf(F.lit(0.975))).first()
    assert r[0] == pytest.approx(math.erf(0.7), abs=2e-7)
    assert r[1] == pytest.approx(math.gamma(4.5), rel=1e-10)
    assert r[2] == pytest.approx(1.959963985, abs=1e-6)


@pytest.mark.parametrize("rp,band", [(0.0, "mild"), (2.0, "common"), (10.0, "significant"), (50.0, "rare"), (100.0, "extreme"), (500.0, "beyond_design"),
                                     (float("inf"), "beyond_design"), (-1.0, "unclassified"), (None, "unclassified"), (float("nan"), "unclassified")])
def test_band_edges(spark, rp, band):
    df = spark.createDataFrame([(rp,)], "rp double")
    assert X.assign_band(df, "rp").first().severity_band == band


def test_theil_sen_by_counting_equals_pairs(spark):
    pts = spark.createDataFrame([("a", float(i), float((i * 37) % 23) + 0.3 * i) for i in range(9)], "k string, x double, y double")
    pair = P.theil_sen(pts, "x", "y", "k").first()
    count = P._slope_by_counting(pts.withColumnRenamed("x", "_x").withColumnRenamed("y", "_y"), ["k"], steps=9).first()
    assert count.slope == pytest.approx(pair.slope, abs=0.1)  # nine halvings of a bracket of about +-25


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1e6, 6.0), (2e6, 7.0)], "t double, v double")
    assert {r.v for r in P.pot_peaks(df, None, "t", "v", 5.0, sep_h=1).collect()} == {6.0, 7.0}
    assert {r.v for r in P.rank_storms(df, 5.0, 1, None, None, "t", "v").collect()} == {5.0, 6.0, 7.0}


def test_components_add_up(spark):
    rows = [("s", 3600.0 * i, 2.0 + math.cos(math.radians(28.9841042 * i)) + (0.5 if i == 300 else 0.0)) for i in range(600)]
    out = P.split_components(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v", 15.0, 100, {"M2": 28.9841042})
    r = out.agg(F.max(F.abs(F.col("wl") - F.col("msl") - F.col("tide") - F.col("ntr"))).alias("e"), F.max("ntr").alias("n")).first()
    assert r.e < 1e-9 and r.n > 0.4


def test_selection_weights(spark):
    pool = spark.range(400).select("id", F.when(F.col("id") < 390, "mild").otherwise("rare").alias("severity_band"))
    got = X.select_catalog(pool, 40, {"mild": 0.5, "rare": 0.5}, 1)
    per = {r.severity_band: (r.n, r.w, r.p) for r in got.groupBy("severity_band").agg(F.count("*").alias("n"), F.max("sampling_weight").alias("w"), F.sum("probability_weight").alias("p")).collect()}
    assert per["mild"][:2] == (20, pytest.approx(390 / 400 / 0.5)) and per["rare"][0] == 20  # ten members drawn with replacement
    assert per["mild"][2] + per["rare"][2] == pytest.approx(1.0)


def test_apportion(spark):
    f = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert apportion(spark, f, 11) == {"a": 6, "b": 3, "c": 2}
    # Seats beyond the room of a label go to the others, larger fractions first.
    assert apportion(spark, f, 20, {"a": 100, "b": 2, "c": 100}) == {"a": 12, "b": 2, "c": 6}
    assert apportion(spark, f, 20, {"a": 3, "b": 2}) == {"a": 3, "b": 2} and apportion(spark, f, 5, {}) == {}


def test_degenerate_groups_give_nulls(spark):
    one = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("c", 3.0, 4.0)], "k string, x double, value double")
    assert {r.k for r in X.fit_tail(one, ["k"]).collect()} == {"c"}
    got = {r.k: r.tau for r in P.mann_kendall(one, "x", "value", ["k"]).collect()}
    assert got["a"] is None and got["b"] is None and got["c"] == pytest.approx(1.0)
    flat = spark.createDataFrame([("e", i, 1.0) for i in range(4)], "event_id string, time int, value double")
    r = H.hydrograph_scores(flat, flat, ["event_id"]).first()
    assert r.n == 4 and r.kge is None and r.nse is None


def test_flat_hydrographs_are_duplicates(spark):
    q = spark.createDataFrame([("e", s, float(t), v) for s, f in (("a", 0), ("b", 0), ("c", 1)) for t, v in enumerate((1.0 + f * k for k in range(5)))],
                              "event_id string, source_id string, time double, q double")
    assert [(r.source_id, r.other_source) for r in H.shape_duplicates(q).collect()] == [("a", "b")]


def test_nested_outlets_and_cycles(spark):
    r = spark.createDataFrame([(3, 2), (2, 1), (1, None), (7, 8), (8, 9), (9, 7)], "hydroseq int, dnhydroseq int")
    got = {(x.hydroseq, x.outlet) for x in Y.upstream(r, spark.createDataFrame([(1,), (2,)], "outlet int")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (2, 2), (3, 2)}


def test_far_points_still_find_a_cell(spark):
    pts = spark.createDataFrame([(1, 1e6, 0.0), (2, None, 0.0)], "pid int, x double, y double")
    cells = spark.createDataFrame([(9, 0.0, 0.0)], "cid int, cx double, cy double")
    got = nearest(pts, cells, "pid", "x", "y", "cid", "cx", "cy", 1e-3, unbounded=True).collect()
    assert [(r.pid, r.cid, r.distance) for r in got] == [(1, 9, 1e6)]


def test_realize_draws_only_near_members(spark):
    cat = spark.createDataFrame([(1, 50.0), (2, None)], "event_id int, x double")
    mem = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "member_id int, value double")
    got = {r.event_id: r for r in V.realize_driver(cat, mem, "rain", "x", "value", 7, k=5).collect()}
    assert abs(math.log(got[1].template_value / 50.0)) < 0.07 and got[1].scale_factor == pytest.approx(50.0 / got[1].template_value)
    assert got[2].template_value == pytest.approx(100.0) and got[2].scale_factor == 1.0


def test_isolines_keep_every_target(spark):
    rng = random.Random(5)
    rows = [(i, 1.0 + i % 12, rng.gauss(0, 1), rng.gauss(3, 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, and_return_period_years double, x double, y double")
    got = {r.target_return_period_years: r for r in X.isoline_events(df, [5.0, 5000.0], ["x", "y"], min_points=5).collect()}
    assert set(got) == {5.0, 5000.0} and got[5.0].isoline_points >= 5 and got[5.0].kde_density > 0
    lost = got[5000.0]
    assert (lost.isoline_points, lost.id, lost.kde_density, lost.x) == (0, None, None, None) and lost.relative_tolerance >= 4.0
    flat = X.isoline_events(df.withColumn("x", F.lit(1.0)), [5.0], ["x", "y"], min_points=5).first()
    assert flat.kde_density is None and flat.id == 4 and flat.x == 1.0


def test_season_wraps_the_year(spark):
    ev = spark.createDataFrame([(1, "2020-12-31"), (2, "2020-07-01")], "event_id int, time string").withColumn("time", F.to_timestamp("time"))
    mem = spark.createDataFrame([(10, "2001-01-03"), (11, "2001-03-20")], "member_id int, member_time string").withColumn("member_time", F.to_timestamp("member_time"))
    got = {r.event_id: r.member_id for r in V.pair_seasonal(ev, mem, 10, 1).collect()}
    assert got == {1: 10, 2: 11}  # the second falls back to the nearest day


def test_validation_names_each_issue(spark):
    row = dict(event_id="e1", study_location="x", event_family="f", scenario_name="s", sampling_weight="1", sample_rp_years="5", sampling_region="body",
               coastal_source="a", coastal_member_file="b", coastal_member_id="c")
    code = lambda **kw: {r.code for r in V.validate_catalog(spark.createDataFrame([{**row, **kw}])).collect()}
    assert code() == set()
    assert code(sampling_weight="0") == {"invalid_sampling_weight"}
    assert code(sampling_region="edge") == {"invalid_sampling_region"}
    assert code(coastal_member_id="") == {"incomplete_forcing"}


def test_interpolation_and_ends(spark):
    known = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0)], "k string, t double, v double")
    clock = spark.createDataFrame([("a", x) for x in (-5.0, 0.0, 2.5, 10.0, 12.0)], "k string, t double")
    open_, held = ({r.t: r.v for r in H.interpolate(known, clock, "k", fill_ends=f).collect()} for f in (False, True))
    assert open_ == {-5.0: None, 0.0: 0.0, 2.5: 5.0, 10.0: 20.0, 12.0: None}
    assert held[-5.0] == 0.0 and held[12.0] == 20.0


def test_perfect_scores(spark):
    s = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(20)], "k string, time double, value double")
    r = H.hydrograph_scores(s, s, "k").first()
    assert r.nse == pytest.approx(1.0) and r.kge == pytest.approx(1.0) and r.peak_bias_fraction == 0.0


def test_depth_delta_and_masked_depth(spark):
    cells = spark.createDataFrame([("e", 0, 1, 1.0), ("e", 1, 1, 2.5), ("e", 0, 2, None), ("e", 1, 2, 0.55)], "event_id string, t int, cell int, zs double")
    bed = spark.createDataFrame([(1, 0.5, True), (2, 0.5, True)], "cell int, zb double, active boolean")
    got = {r.cell: r.depth_ft for r in O.masked_depth(cells, bed).collect()}
    assert got[1] == pytest.approx(1.5 * 3.28084) and got[2] is None
    d = O.scenario_delta(spark.createDataFrame([(1, 2.0), (2, None)], "cell int, depth_ft double"), spark.createDataFrame([(1, 0.5), (2, 0.0)], "cell int, depth_ft double"), ["cell"])
    assert {r.cell: r.delta_ft for r in d.collect()} == {1: 1.5, 2: None}


def test_fragility_location_and_alias(spark):
    curve = spark.createDataFrame([("transformer_mad_mount", 0.5, 0.3, 1.0)], "asset_class string, shape double, loc_m double, scale_m double")
    df = spark.createDataFrame([("transformer", 0.3), ("transformer", 1.3), ("source", 1.0), ("transformer", None)], "asset_type string, sampled_depth_m double")
    got = [(r.asset_type, r.sampled_depth_m, r.failure_probability, r.unmapped_class) for r in I.failure_probability(df, curve).collect()]
    p = {(a, d): (q, u) for a, d, q, u in got}
    assert p[("transformer", 0.3)] == (0.0, False) and p[("transformer", 1.3)][0] == pytest.approx(0.5, abs=1e-6)
    assert p[("source", 1.0)] == (None, True) and p[("transformer", None)] == (0.0, False)


def test_marginal_budget_with_forced_steps(spark):
    f = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 5.0), ("b", 2, 4.0), ("c", 1, 0.5)], "component_id string, k_switches int, marginal_benefit double")

    def merge(cap, floor, forced):
        at, out = {c: 0 for c in "abc"}, []
        steps = {"a": [1.0, 9.0], "b": [5.0, 4.0], "c": [0.5]}
        for phase in (0, 1):
            while len(out) < cap:
                opts = [(steps[c][at[c]], c) for c in "abc" if at[c] < len(steps[c]) and (phase or at[c] < forced)]
                if not opts or (phase and max(opts)[0] < floor):
                    break
                b, c = max(opts)
                at[c] += 1
                out.append((c, at[c]))
        return out

    for cap, floor, forced in ((3, 0.0, 0), (9, 2.0, 0), (4, 2.0, 1), (9, 0.0, 1)):
        got = [(r.component_id, r.k_switches) for r in N.marginal_budget(f, floor, cap, forced).orderBy("pick_order").collect()]
        assert got == merge(cap, floor, forced)


def test_tree_metrics(spark):
    lines = spark.createDataFrame([("l1", "a", "b", 3, 2.0), ("l2", "b", "c", 3, 3.0), ("l3", "b", "d", 1, 4.0)], "line_name string, from_bus string, to_bus string, phases int, length double")
    buses = spark.createDataFrame([(x,) for x in "abcd"], "bus string")
    src = spark.createDataFrame([("a",)], "bus string")
    loads = spark.createDataFrame([("c", 1.0), ("d", 2.0)], "bus string, kw double")
    r = N.graph_metrics(lines.withColumn("feeder_id", F.lit(1))).first()
    assert r.mean_path_length == pytest.approx((2 + 5 + 6 + 3 + 4 + 7) / 6) and r.diameter == 7.0 and r.average_degree == 1.5
    tree = N.orient_feeders(buses, lines, src, loads)
    best = {x.node: x.benefit for x in N.switch_benefit(tree, loads).collect()}
    assert best["d"] == pytest.approx(3 * 9 - 2 * 4 - 1 * 5)
    assert {x.line_name: x.fuse_bus for x in N.derive_fuses(lines).collect()} == {"l3": "b"}


def test_block_violations(spark):
    lines = spark.createDataFrame([("l1", "a", "b", 3), ("l2", "b", "a2", 3), ("l3", "a2", "a", 3)], "line_name string, from_bus string, to_bus string, phases int")
    buses = spark.createDataFrame([(x,) for x in ("a", "b", "a2", "z")], "bus string")
    comp = N.bus_components(buses, lines)
    kv = spark.createDataFrame([("a", 12.47), ("b", 12.47), ("a2", 0.24)], "bus string, kv double")
    loads, src = spark.createDataFrame([("b", 5.0)], "bus string, kw double"), spark.createDataFrame([("a",)], "bus string")
    b = N.load_blocks(comp, lines, None, None, loads, src, kv)
    got = {(r.component, r.invariant) for r in N.block_violations(b, comp, lines, None, kv).collect()}
    assert got == {("a", "F"), ("a", "C"), ("z", "B")}


def test_dedupe_points_in_order(spark):
    rows = [(i, float((i * 53) % 97), float((i * 31) % 89)) for i in range(120)]
    got = sorted(r.point_id for r in Y.dedupe_points(spark.createDataFrame(rows, "point_id int, x double, y double"), 12.0).collect())
    kept = []
    for i, x, y in rows:
        if all(math.hypot(x - a, y - b) > 12.0 for _, a, b in kept):
            kept.append((i, x, y))
    assert got == [k[0] for k in kept]


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("AL011851, UNNAMED, 2,\n18510625, 0000, , HU, 28.0N, 94.8W, 80\n18510625, 0600, , HU, 28.0S, 95.4E, 80\n18510625, 1200, , HU, 1.0N, 1.0W, 1\n")
    got = R.read_tracks(spark, str(tmp_path / "t.txt")).orderBy("time").collect()
    assert [(r.storm_id, r.lat, r.lon) for r in got] == [("AL011851", 28.0, -94.8), ("AL011851", -28.0, 95.4)]
    (tmp_path / "g.rdb").write_text("# note\nagency_cd\tsite_no\tdatetime\t123_00060\t123_00060_cd\n5s\t15s\t20d\t14n\t10s\nUSGS\t1234567\t2020-01-01 00:00\t5.5\tA\nUSGS\t1234567\t2020-01-01 01:00\tIce\tA\n")
    rdb = R.scan_gauge_rdb(spark, str(tmp_path / "g.rdb"), "iv").collect()
    assert [(r.site_no, r.discharge_cfs, r.source) for r in rdb] == [("01234567", 5.5, "usgs_iv")]
    R.write_catalog(spark.createDataFrame([("e1", 2.0)], "event_id string, x double"), str(tmp_path / "cat"))
    assert spark.read.parquet(str(tmp_path / "cat")).columns[:3] == ["event_id", "event_role", "event_origin"]


def test_facility_profiles(spark):
    f = spark.createDataFrame([("a:b:7", "school"), ("8", "unheard"), (None, None)], "facility_id string, facility_class string")
    got = {r.facility_class: r for r in I.facility_profiles(f, "town").collect()}
    assert got["school"].loadshape_id == "town:loadshape:7:comstock:PrimarySchool:school_calendar"
    assert got["unheard"].loadshape_id == "town:loadshape:8:comstock:SmallOffice:business_hours" and got[None].loadshape_id is None
    assert got[None].customer_class == "critical_facility"


def test_dedupe_joins_no_crowds(spark, monkeypatch):
    rng, sizes, join = random.Random(5), [], Y.within_distance
    monkeypatch.setattr(Y, "within_distance", lambda a, b, *more: sizes.append(min(a.count(), b.count())) or join(a, b, *more))
    pts = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(1500)]
    kept = []
    for p in pts:
        if all(math.dist(p[1:], q[1:]) > 2.0 for q in kept):
            kept.append(p)
    got = Y.dedupe_points(spark.createDataFrame(pts, "point_id int, x double, y double"), 2.0)
    assert {r.point_id for r in got.collect()} == {p[0] for p in kept}
    assert max(sizes) < 750


def test_windows_meet_instants_not_members(spark, monkeypatch):
    rng, rights, join = random.Random(9), [], V.interval_join
    monkeypatch.setattr(V, "interval_join", lambda a, b, *more, **kw: rights.append(b.count()) or join(a, b, *more, **kw))
    day = 86400.0
    members = [(i, day * (i % 4), float(rng.randint(0, 40)), day * (i % 4)) for i in range(200)]
    events = [(i, day * rng.choice((0.5, 1.0, 2.2, 90.0)), rng.uniform(-3, 45) if i % 9 else None) for i in range(60)]
    m = spark.createDataFrame(members, "member_id int, member_time double, member_value double, rainfall_peak_time double")
    e = spark.createDataFrame(events, "event_id int, event_time double, value double")
    got = {r.event_id: r.member_id for r in V.nearest_member(e.where("event_time < 1e6"), m, window_h=24.0).collect()}
    for i, t, x in events:
        if t < 1e6:
            seen = [r for r in members if abs(r[1] - t) <= day]
            assert got[i] == min(seen, key=lambda r: (0 if x is None else abs(r[2] - x), abs(r[1] - t), r[0]))[0]
    assert rights == [4]
    rain = m.select("member_id", "member_time", "rainfall_peak_time", F.col("member_value").alias("rainfall_metric"), F.lit(72.0).alias("duration_hours"))
    pairs = V.compound_pairing(e.withColumn("sample_rp_years", F.col("event_id") + 1.0), rain, 3, 60, 24.0).where("compound_role = 'historical_coastal_rainfall_pair'")
    best = {r.event_id: r.member_id for r in pairs.collect()}
    assert best == {i: min((r for r in members if abs(r[1] - t) <= day), key=lambda r: (-(r[2] - abs(r[1] - t) / 3600.0 / 24.0), -r[2], r[0]))[0] for i, t, x in events if t < 1e6}
    assert rights == [4, 4]
