"""Tail, joint-probability and catalogue operators on `events`, `orders` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.rand import uniform
from tidemark.operators import extremes as X
from tidemark.operators import peaks as P

from .base import SERIES_SQL, query
from .peaks import HOUR, greedy

MOMENTS_SQL = """r AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS i, CAST(count(*) OVER (PARTITION BY k) AS DOUBLE) AS n FROM {src}),
m AS (SELECT k, max(n) AS n, min(v) AS lo, avg(v) AS b0, sum(i / (n - 1) * v / n) AS b1, sum(i * (i - 1) / ((n - 1) * (n - 2)) * v / n) AS b2 FROM r GROUP BY k)"""

POT_FIT_SQL = MOMENTS_SQL + """,
e AS (SELECT k, n, 'exp' AS dist, CAST(0 AS DOUBLE) AS shape, lo AS loc, b0 - lo AS scale FROM m UNION ALL
  SELECT k, n, 'gpd', -((b0 - lo) / (2 * b1 - b0) - 2), lo, (1 + (b0 - lo) / (2 * b1 - b0) - 2) * (b0 - lo) FROM m),
ll AS (SELECT e.*, CASE WHEN dist = 'exp' OR abs(shape) < 1e-9 THEN -(r.v - loc) / scale
  WHEN 1 + shape * (r.v - loc) / scale > 0 THEN -(1 + 1 / shape) * ln(1 + shape * (r.v - loc) / scale) END - ln(scale) AS lp FROM e JOIN r USING (k)),
fit AS (SELECT k, dist, shape, loc, scale, n, 6 - 2 * CASE WHEN count(lp) = n THEN sum(lp) ELSE CAST('-inf' AS DOUBLE) END AS score
  FROM (SELECT k, n, dist, shape, loc, scale, lp FROM ll) GROUP BY k, dist, shape, loc, scale, n
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY score, dist) = 1)"""


@query("fit_tail_pot", f"""WITH {SERIES_SQL}, {POT_FIT_SQL.format(src='series')}
SELECT k, dist, shape, loc, scale, score, CAST(n AS BIGINT) AS n FROM fit""", shape=7, loc=4, scale=5, score=3)
def fit_tail_pot(t):
    return X.fit_tail(t.series(), "k", "v", "pot")


@query("fit_tail_block_maxima", f"""WITH bm AS (SELECT event_type AS k, CAST(ts AS DATE) AS d, max(value) AS v FROM events GROUP BY ALL),
{MOMENTS_SQL.format(src='bm')},
l AS (SELECT k, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3 FROM m),
c AS (SELECT *, 2 / (3 + t3) - ln(2.0) / ln(3.0) AS c FROM l),
g AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS sh FROM c),
e AS (SELECT k, n, 'gumb' AS dist, 0.0 AS shape, l1 - 0.5772156649015329 * l2 / ln(2.0) AS loc, l2 / ln(2.0) AS scale FROM g UNION ALL
  SELECT k, n, 'gev', sh, l1 - l2 * sh / ((1 - pow(2.0, -sh)) * gamma(1 + sh)) * (1 - gamma(1 + sh)) / sh, l2 * sh / ((1 - pow(2.0, -sh)) * gamma(1 + sh)) FROM g),
ll AS (SELECT e.*, CASE WHEN dist = 'gumb' THEN -(r.v - loc) / scale - exp(-(r.v - loc) / scale)
  WHEN 1 - shape * (r.v - loc) / scale > 0 THEN ln(pow(1 - shape * (r.v - loc) / scale, 1 / shape)) * (1 - shape) - pow(1 - shape * (r.v - loc) / scale, 1 / shape) END - ln(scale) AS lp
  FROM e JOIN r USING (k))
SELECT k, dist, shape, loc, scale, 6 - 2 * CASE WHEN count(lp) = n THEN sum(lp) ELSE CAST('-inf' AS DOUBLE) END AS score, CAST(n AS BIGINT) AS n
FROM (SELECT k, n, dist, CAST(CASE WHEN dist = 'gumb' THEN 0.0 ELSE shape END AS DOUBLE) AS shape, loc, scale, lp FROM ll) GROUP BY k, dist, shape, loc, scale, n QUALIFY row_number() OVER (PARTITION BY k ORDER BY score, dist) = 1""".replace(
    "ll AS (SELECT e.*, CASE WHEN dist = 'gumb'", "ll AS (SELECT e.*, CASE WHEN e.dist = 'gumb'"), shape=6, loc=4, scale=4, score=3)
def fit_tail_block_maxima(t):
    bm = t.events.groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("d")).agg(F.max("value").alias("v"))
    return X.fit_tail(bm, "k", "v", "bm")


RP_SQL = "(VALUES (2.0), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (500.0)) AS rp(rp)"


def level_sql(rate: float) -> str:
    q = f"least(greatest(1 / rp / {rate}, 1e-6), 1 - 1e-6)"
    return f"loc + scale * CASE WHEN dist = 'exp' OR abs(shape) < 1e-9 THEN -ln({q}) ELSE (pow({q}, -shape) - 1) / nullif(shape, 0) END"


@query("return_level", f"""WITH {SERIES_SQL}, {POT_FIT_SQL.format(src='series')}
SELECT k, CAST(rp AS DOUBLE) AS return_period_years, {level_sql(12.0)} AS level FROM fit, {RP_SQL}""", level=4)
def return_level(t):
    return X.return_level(X.fit_tail(t.series(), "k", "v"), 12.0).select("k", "return_period_years", "level")


PERIOD_SQL = """CASE WHEN p.v <= loc THEN 1.0 WHEN dist = 'exp' OR abs(shape) < 1e-9 THEN exp(-(p.v - loc) / scale)
  WHEN 1 + shape * (p.v - loc) / scale <= 0 THEN 0.0 ELSE pow(1 + shape * (p.v - loc) / scale, -1 / nullif(shape, 0)) END"""
BAND_SQL = """CASE WHEN {rp} IS NULL OR {rp} < 0 THEN 'unclassified' WHEN {rp} >= 500 THEN 'beyond_design' WHEN {rp} >= 100 THEN 'extreme'
  WHEN {rp} >= 50 THEN 'rare' WHEN {rp} >= 10 THEN 'significant' WHEN {rp} >= 2 THEN 'common' ELSE 'mild' END"""


@query("peak_return_periods", f"""WITH RECURSIVE {SERIES_SQL},
u AS (SELECT k, quantile_cont(v, 0.90) AS u FROM series GROUP BY k),
over_u AS (SELECT s.* FROM series s JOIN u USING (k) WHERE v > u),
{greedy(6 * HOUR)},
{POT_FIT_SQL.format(src='picked')},
t AS (SELECT p.k, p.t, p.v, f.dist, 1 / (least(greatest({PERIOD_SQL}, 1e-6), 1.0) * 12.0) AS return_period_years FROM picked p JOIN fit f USING (k))
SELECT k, t, v, dist, return_period_years, {BAND_SQL.format(rp='return_period_years')} AS severity_band FROM t""", t=3, return_period_years=4)
def peak_return_periods(t):
    pk = P.cut(P.pot_peaks(t.series(), "k", "t", "v", None, 0.90, 6))
    fit = P.cut(X.fit_tail(pk, "k", "v"))
    rp = X.return_period(pk, fit, 12.0, "k", "v").join(fit.select("k", "dist"), "k")
    return X.assign_band(rp, "return_period_years")


@query("empirical_cdf", f"""WITH {SERIES_SQL},
s AS (SELECT k, v, CAST(row_number() OVER (PARTITION BY k ORDER BY v) AS DOUBLE) / (count(*) OVER (PARTITION BY k) + 1) AS p FROM series WHERE k IN ('click', 'error')),
kn AS (SELECT k, v, max(p) AS hi, min(p) AS lo FROM s GROUP BY ALL),
q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE 'error' END AS k, o_totalprice / 1000 AS v FROM orders),
a AS (SELECT q.*, n.v AS v0, n.hi AS p0 FROM q ASOF LEFT JOIN kn n ON q.k = n.k AND q.v >= n.v),
b AS (SELECT a.*, n.v AS v1, n.lo AS p1 FROM a ASOF LEFT JOIN kn n ON a.k = n.k AND a.v <= n.v)
SELECT id, k, v, CASE WHEN v0 IS NULL THEN 0.0 WHEN v0 = v THEN p0 WHEN v1 IS NULL THEN 1.0 ELSE p0 + (p1 - p0) * (v - v0) / (v1 - v0) END AS u FROM b""", v=5, u=7)
def empirical_cdf(t):
    q = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "click").otherwise("error").alias("k"),
                        (F.col("o_totalprice") / 1000).alias("v"))
    return X.empirical_cdf(q, t.series().where(F.col("k").isin("click", "error")), "k", "v")


@query("empirical_ppf", f"""WITH {SERIES_SQL},
s AS (SELECT k, v, CAST(row_number() OVER (PARTITION BY k ORDER BY v) AS DOUBLE) / (count(*) OVER (PARTITION BY k) + 1) AS p FROM series),
q AS (SELECT o_orderkey AS id, s.k, (o_orderkey % 997) / 996.0 AS u FROM orders JOIN (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT k FROM series)) s ON s.i = o_orderkey % 5),
a AS (SELECT q.*, n.p AS p0, n.v AS v0 FROM q ASOF LEFT JOIN s n ON q.k = n.k AND q.u >= n.p),
b AS (SELECT a.*, n.p AS p1, n.v AS v1 FROM a ASOF LEFT JOIN s n ON a.k = n.k AND a.u <= n.p)
SELECT id, k, u, CASE WHEN p0 IS NULL THEN v1 WHEN p0 = u OR p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (u - p0) / (p1 - p0) END AS x FROM b""", u=8, x=5)
def empirical_ppf(t):
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    q = t.orders.select(F.col("o_orderkey").alias("id"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("k"),
                        ((F.col("o_orderkey") % 997) / 996.0).alias("u"))
    return X.empirical_ppf(q, t.series(), "k", "u", "v")


@query("bootstrap_levels")
def bootstrap_levels(t):
    pk = P.cut(P.pot_peaks(t.series(), "k", "t", "v", None, 0.90, 6))
    return X.bootstrap_levels(pk, 50, 7, 12.0, "k", "v")


@query("pseudo_obs", """SELECT event_id, CAST(row_number() OVER (ORDER BY x) AS DOUBLE) / (count(*) OVER () + 1) AS x_u,
 CAST(row_number() OVER (ORDER BY y) AS DOUBLE) / (count(*) OVER () + 1) AS y_u
FROM (SELECT event_id, epoch_us(ts) / 1e6 AS x, value * 1000000 + event_id AS y FROM events)""", x_u=9, y_u=9)
def pseudo_obs(t):
    e = t.events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("x"), (F.col("value") * 1000000 + F.col("event_id")).alias("y"))
    return X.pseudo_obs(e, ["x", "y"], "event_id").select("event_id", "x_u", "y_u")


AND_SQL = """e AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders),
r AS (SELECT l_extendedprice * 5 AS x, CAST(l_partkey AS DOUBLE) AS y, l_returnflag AS storm_type FROM lineitem)"""


def drivers(t):
    e = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    r = t.lineitem.select((F.col("l_extendedprice") * 5).alias("x"), F.col("l_partkey").cast("double").alias("y"), F.col("l_returnflag").alias("storm_type"))
    return e, r


SURV_SQL = f"""{AND_SQL},
c AS (SELECT e.id, count(*) AS c FROM e JOIN r ON r.x > e.x AND r.y > e.y GROUP BY e.id),
s AS (SELECT e.id, e.x, coalesce(c, 0) / CAST((SELECT count(*) FROM r) AS DOUBLE) AS and_survival FROM e LEFT JOIN c USING (id))"""


@query("and_survival", f"WITH {SURV_SQL} SELECT id, and_survival FROM s", and_survival=9)
def and_survival(t):
    e, r = drivers(t)
    return X.and_survival(e, r, "id", ["x", "y"])


@query("and_survival_cdf", f"WITH {SURV_SQL} SELECT id, and_survival FROM s", and_survival=9)
def and_survival_cdf(t):
    e, r = drivers(t)
    return X.and_survival_cdf(e, r, "id", ["x", "y"])


@query("and_return_period", f"""WITH {SURV_SQL} SELECT id, and_survival, least(greatest(4.5 * and_survival, 0), 1) AS and_aep,
 CASE WHEN and_survival > 0 THEN 1 / (4.5 * and_survival) ELSE CAST('inf' AS DOUBLE) END AS and_return_period_years FROM s""", and_survival=9, and_aep=9)
def and_return_period(t):
    e, r = drivers(t)
    out = X.and_return_period(X.and_survival(e, r, "id", ["x", "y"]), 4.5)
    return out.withColumn("and_return_period_years", F.round("and_return_period_years", 6))


def _round_rp():
    from .base import SQL

    SQL["and_return_period"] = f"SELECT * REPLACE (CASE WHEN isinf(and_return_period_years) THEN and_return_period_years ELSE round(and_return_period_years, 6) END AS and_return_period_years) FROM ({SQL['and_return_period']})"


_round_rp()


@query("mixture_frequency", f"""WITH {AND_SQL},
g AS (SELECT storm_type, count(*) AS n FROM r GROUP BY 1), w AS (SELECT *, 3.0 * n / sum(n) OVER () AS rate FROM g),
c AS (SELECT e.id, r.storm_type, count(*) AS c FROM e JOIN r ON r.x > e.x AND r.y > e.y GROUP BY ALL),
f AS (SELECT e.id, sum(rate * coalesce(c, 0) / n) AS frequency_per_year FROM e CROSS JOIN w LEFT JOIN c ON c.id = e.id AND c.storm_type = w.storm_type GROUP BY e.id)
SELECT id, frequency_per_year, false AS low_confidence FROM f""", frequency_per_year=9)
def mixture_frequency(t):
    e, r = drivers(t)
    return X.mixture_frequency(e, r, 3.0, "id", ["x", "y"]).drop("return_period_years")


@query("assign_band", f"SELECT o_orderkey, {BAND_SQL.format(rp='rp')} AS severity_band FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice / 500 - 20 END AS rp FROM orders)")
def assign_band(t):
    d = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice") / 500 - 20).alias("rp"))
    return X.assign_band(d, "rp").select("o_orderkey", "severity_band")


@query("simulate_pool")
def simulate_pool(t):
    """One candidate per observed event row, so the pool grows with the record."""
    n = t.events.count()
    fit = P.cut(X.fit_tail(t.series(), None, "v"))
    return X.simulate_pool(t.spark, n, fit.select("dist", "shape", "loc", "scale"), 4.0, 11)


@query("simulate_joint_pool")
def simulate_joint_pool(t):
    e, _ = drivers(t)
    return X.simulate_joint_pool(t.spark, e.count(), e, ["x", "y"], 5, "id")


POOL_SQL = f"""pool AS (SELECT o_orderkey AS id, {BAND_SQL.format(rp='(o_totalprice / 1000)')} AS severity_band,
  (('0x' || substr(md5('9|select|' || o_orderkey), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS h FROM orders)"""
FRACTIONS = {"mild": 0.1, "common": 0.15, "significant": 0.25, "rare": 0.2, "extreme": 0.3}


def pool(t):
    return X.assign_band(t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("rp")), "rp").drop("rp")


@query("select_catalog", f"""WITH {POOL_SQL},
goal AS (SELECT * FROM (VALUES ('mild', 25), ('common', 38), ('significant', 62), ('rare', 50), ('extreme', 75)) AS g(severity_band, goal)),
c AS (SELECT severity_band, count(*) AS m FROM pool GROUP BY 1),
p AS (SELECT goal.severity_band, goal, m, (m / (SELECT CAST(count(*) AS DOUBLE) FROM pool)) / (goal / 250.0) AS w FROM goal JOIN c USING (severity_band)),
r AS (SELECT *, row_number() OVER (PARTITION BY severity_band ORDER BY h) AS r FROM pool),
slots AS (SELECT p.*, unnest(range(1, goal + 1)) AS slot FROM p),
pick AS (SELECT *, CASE WHEN m >= goal THEN slot ELSE
  CAST(floor((('0x' || substr(md5('9|again|' || severity_band || '|' || slot), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 * m) AS BIGINT) + 1 END AS rr FROM slots)
SELECT r.id, pick.severity_band, w AS sampling_weight, w / (SELECT sum(goal * w) FROM p) AS probability_weight
FROM pick JOIN r ON r.severity_band = pick.severity_band AND r.r = pick.rr""", sampling_weight=8, probability_weight=9)
def select_catalog(t):
    return X.select_catalog(pool(t), 250, FRACTIONS, 9)


@query("check_budget", f"""WITH {POOL_SQL}, b AS (SELECT * FROM (VALUES ('mild', 1000), ('common', 1500), ('significant', 2500), ('rare', 2000), ('extreme', 3000), ('beyond_design', 0)) AS g(severity_band, need)),
c AS (SELECT p.severity_band, count(*) AS n, count(DISTINCT o_custkey) AS d FROM pool p JOIN orders ON o_orderkey = id GROUP BY 1)
SELECT severity_band, CAST(need AS BIGINT) AS stress_budget_count, coalesce(n, 0) AS catalog_count, coalesce(d, 0) AS distinct_support,
 coalesce(n, 0) >= need AS meets_budget, need > 0 AND coalesce(d, 0) < need AS low_support_flag FROM b LEFT JOIN c USING (severity_band)""")
def check_budget(t):
    c = X.assign_band(t.orders.select((F.col("o_totalprice") / 1000).alias("rp"), F.col("o_custkey").cast("double").alias("c_u")), "rp")
    return X.check_budget(c, FRACTIONS, 10000, ["c_u"])


@query("isoline_events")
def isoline_events(t):
    e, r = drivers(t)
    s = X.and_return_period(X.and_survival(e, r, "id", ["x", "y"]), 4.5)
    return X.isoline_events(s.join(e, "id"), [2.0, 10.0, 50.0, 100.0], ["x", "y"])


CAT_SQL = "cat AS (SELECT c_custkey AS event_id, greatest(c_acctbal, 0) / sum(greatest(c_acctbal, 0)) OVER () AS probability_weight FROM customer)"


def catalog(t):
    w = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    tot = t.customer.agg(F.sum(w).alias("_t"))
    return t.customer.join(F.broadcast(tot)).select(F.col("c_custkey").alias("event_id"), (w / F.col("_t")).alias("probability_weight"))


@query("annual_rates", f"WITH {CAT_SQL} SELECT event_id, probability_weight, 2.5 AS total_rate_per_year, 2.5 * probability_weight AS annual_rate FROM cat",
       probability_weight=12, annual_rate=12, total_rate_per_year=2)
def annual_rates(t):
    return X.annual_rates(catalog(t), 2.5)


@query("outcome_coverage", f"""WITH {CAT_SQL}, o AS (SELECT c.* FROM cat c WHERE event_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))
SELECT (SELECT count(*) FROM o) AS completed_outcome_events, (SELECT sum(probability_weight) FROM o) AS covered_probability_weight,
 (SELECT count(*) FROM cat) AS catalog_weighted_events, (SELECT sum(probability_weight) FROM cat) AS catalog_probability_weight,
 (SELECT sum(probability_weight) FROM o) / (SELECT sum(probability_weight) FROM cat) AS weight_coverage""",
       covered_probability_weight=9, catalog_probability_weight=9, weight_coverage=9)
def outcome_coverage(t):
    c = catalog(t)
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("event_id"))
    return X.outcome_coverage(c.join(done, "event_id", "left_semi"), c)


@query("depth_aep", f"""WITH {CAT_SQL}, d AS (SELECT o_custkey AS event_id, l_partkey AS cell, max(l_quantity) / 10 AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT event_id, 2.5 * probability_weight AS rate FROM cat WHERE probability_weight > 0),
s AS (SELECT cell, sum(CASE WHEN depth > 0.5 THEN rate ELSE 0 END) AS a, sum(CASE WHEN depth > 2 THEN rate ELSE 0 END) AS b, sum(CASE WHEN depth > 4 THEN rate ELSE 0 END) AS c FROM d JOIN r USING (event_id) GROUP BY cell)
SELECT cell, a AS depth_gt_0p5ft_annual_rate, b AS depth_gt_2p0ft_annual_rate, c AS depth_gt_4p0ft_annual_rate,
 1 - exp(-a) AS depth_gt_0p5ft_aep, 1 - exp(-b) AS depth_gt_2p0ft_aep, 1 - exp(-c) AS depth_gt_4p0ft_aep FROM s""",
       depth_gt_0p5ft_annual_rate=9, depth_gt_2p0ft_annual_rate=9, depth_gt_4p0ft_annual_rate=9, depth_gt_0p5ft_aep=9, depth_gt_2p0ft_aep=9, depth_gt_4p0ft_aep=9)
def depth_aep(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("event_id"), F.col("l_partkey").alias("cell")).agg((F.max("l_quantity") / 10).alias("depth_ft"))
    return X.depth_aep(d, X.annual_rates(catalog(t), 2.5), [0.5, 2.0, 4.0])


@query("reference_curve", f"""WITH {SERIES_SQL}, u AS (SELECT k, quantile_cont(v, 0.95) AS u FROM series GROUP BY k),
ov AS (SELECT s.* FROM series s JOIN u USING (k) WHERE v >= u), {POT_FIT_SQL.format(src='ov')}
SELECT k, CAST(rp AS DOUBLE) AS return_period_years, dist, {level_sql(40.0)} AS level FROM fit, {RP_SQL}""", level=4)
def reference_curve(t):
    return X.reference_curve(t.series(), 40.0, "k", "v").select("k", "return_period_years", "dist", "level")
