"""Peaks, trends and components on `events` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import peaks as P

from .base import DAILY_SQL, SERIES_SQL, query

HOUR = 3600.0

# Greedy selection, one candidate per step in (value desc, time asc) order.
GREEDY = """
ranked AS (SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY v DESC, t) AS i FROM over_u),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS kept FROM (SELECT DISTINCT k FROM over_u)
  UNION ALL
  SELECT w.k, r.i, CASE WHEN len(list_filter(w.kept, lambda a: abs(a - r.t) < {gap})) = 0
                        THEN list_append(w.kept, r.t) ELSE w.kept END
  FROM walk w JOIN ranked r ON r.k = w.k AND r.i = w.i + 1),
final AS (SELECT k, unnest(kept) AS t FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
picked AS (SELECT r.k, r.t, r.v FROM (SELECT w.k, unnest(w.kept) AS t FROM walk w
  JOIN (SELECT k, max(i) AS i FROM walk GROUP BY k) m ON m.k = w.k AND m.i = w.i) f JOIN ranked r ON r.k = f.k AND r.t = f.t)
"""


def greedy(gap: float) -> str:
    lines = GREEDY.format(gap=gap).strip().split("\n")
    return "\n".join(x for x in lines if not x.startswith("final AS"))


@query("annual_mean", f"""WITH {DAILY_SQL}
SELECT k, CAST(year(d) AS INTEGER) AS year, avg(v) AS mean, count(v) AS "count" FROM daily GROUP BY ALL HAVING count(v) >= 150""",
       mean=3)
def annual_mean(t):
    return P.annual_mean(t.daily(), "k", "d", "v", 150)


@query("theil_sen", f"""WITH {DAILY_SQL},
a AS (SELECT k, CAST(year(d) AS DOUBLE) + 0.5 AS x, avg(v) AS y FROM daily GROUP BY k, year(d)),
s AS (SELECT a.k, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM a JOIN a b ON a.k = b.k AND b.x > a.x GROUP BY a.k)
SELECT a.k, s.slope, regr_slope(a.y, a.x) AS ols_slope, count(*) AS n FROM a JOIN s USING (k) GROUP BY a.k, s.slope""",
       slope=3, ols_slope=3)
def theil_sen(t):
    y = P.annual_mean(t.daily(), "k", "d", "v", 1).select("k", (F.col("year") + 0.5).alias("x"), F.col("mean").alias("y"))
    return P.theil_sen(y, "x", "y", "k")


@query("detrend", f"""WITH {DAILY_SQL}
SELECT k, strftime(d, '%Y-%m-%d') AS d, v - 1000.0 * (year(d) + (dayofyear(d) - 1.0) / 365.25 - 1998.0) AS detrended FROM daily""",
       detrended=2)
def detrend(t):
    return P.detrend(t.daily(), 1000.0, 1998.0, "d", "v").select("k", F.date_format("d", "yyyy-MM-dd").alias("d"), "detrended")


ERF_SQL = ("(1.0 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592)"
           " * {t} * exp(-({x}) * ({x})))")


def erf_sql(x: str) -> str:
    """Error function of a non-negative SQL expression."""
    return ERF_SQL.format(t=f"(1.0 / (1.0 + 0.3275911 * ({x})))", x=x)


@query("mann_kendall", f"""WITH {SERIES_SQL},
c AS (SELECT a.k, sum(sign(b.v - a.v)) AS s FROM series a JOIN series b ON a.k = b.k AND b.t > a.t GROUP BY a.k),
y AS (SELECT k, sum(c * (c - 1) / 2.0) AS ty, sum(c * (c - 1) * (2 * c + 5)) AS tyv FROM
  (SELECT k, v, CAST(count(*) AS DOUBLE) AS c FROM series GROUP BY k, v) GROUP BY k),
n AS (SELECT k, CAST(count(*) AS DOUBLE) AS n FROM series GROUP BY k),
z AS (SELECT k, n, s, s / sqrt((n * (n - 1) / 2) * (n * (n - 1) / 2 - ty)) AS tau,
  abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - tyv) / 18.0) / sqrt(2.0) AS a FROM c JOIN y USING (k) JOIN n USING (k)),
p AS (SELECT *, 1.0 - {erf_sql('a')} AS p_value FROM z)
SELECT k, CAST(n AS BIGINT) AS n, tau, p_value, CASE WHEN p_value >= 0.05 THEN 'no detectable trend'
  WHEN s > 0 THEN 'rising trend' ELSE 'falling trend' END AS verdict FROM p""", tau=8, p_value=6)
def mann_kendall(t):
    return P.mann_kendall(t.series(), "t", "v", "k")


@query("pot_peaks", f"""WITH RECURSIVE {SERIES_SQL},
u AS (SELECT k, quantile_cont(v, 0.95) AS u FROM series GROUP BY k),
over_u AS (SELECT s.* FROM series s JOIN u USING (k) WHERE v > u),
{greedy(24 * HOUR)}
SELECT k, t, v FROM picked""", t=3)
def pot_peaks(t):
    return P.pot_peaks(t.series(), "k", "t", "v", None, 0.95, 24)


@query("calibrate_threshold", f"""WITH RECURSIVE {SERIES_SQL},
u AS (SELECT k, quantile_cont(v, 0.90) AS u, (max(t) - min(t)) / 31557600.0 AS record_years FROM series GROUP BY k),
over_u AS (SELECT s.* FROM series s JOIN u USING (k) WHERE v > u),
{greedy(12 * HOUR)},
o AS (SELECT p.*, record_years, row_number() OVER (PARTITION BY k ORDER BY v DESC, t) AS rn FROM picked p JOIN u USING (k))
SELECT k, t, v, min(v) OVER (PARTITION BY k) AS threshold, record_years FROM o
WHERE rn <= greatest(1, round_even(120.0 * record_years, 0))""", t=3, record_years=8)
def calibrate_threshold(t):
    return P.calibrate_threshold(t.series(), 120.0, "k", "t", "v", 12)


@query("rank_storms", f"""WITH RECURSIVE {DAILY_SQL},
over_u AS (SELECT k, t, v FROM daily WHERE v >= 700000.0),
{greedy(120 * HOUR)}
SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY v DESC, t) AS por_rank,
  row_number() OVER (PARTITION BY k, year(make_timestamp(CAST(t * 1000000 AS BIGINT))) ORDER BY v DESC, t) AS annual_rank FROM picked""", v=2)
def rank_storms(t):
    return P.rank_storms(t.daily().select("k", "t", "v"), 700000.0, 120, "k", None, "t", "v")


@query("distinct_event_rate", f"""WITH RECURSIVE {SERIES_SQL},
u AS (SELECT k, quantile_cont(v, 0.95) AS u FROM series GROUP BY k),
over_u AS (SELECT s.* FROM series s JOIN u USING (k) WHERE v > u),
{greedy(24 * HOUR)},
all_t AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM picked),
scan AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS last
  UNION ALL SELECT a.i, CASE WHEN s.last IS NULL OR a.t - s.last >= 86400.0 THEN s.n + 1 ELSE s.n END,
    CASE WHEN s.last IS NULL OR a.t - s.last >= 86400.0 THEN a.t ELSE s.last END FROM scan s JOIN all_t a ON a.i = s.i + 1)
SELECT max(n) AS distinct_events, max(n) / 2.0 AS events_per_year FROM scan""", events_per_year=6)
def distinct_event_rate(t):
    return P.distinct_event_rate(P.pot_peaks(t.series(), "k", "t", "v", None, 0.95, 24), 24, 2.0, None, "t")


@query("dedupe_events", f"""WITH {SERIES_SQL},
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t) < 1800.0 THEN 0 ELSE 1 END AS b FROM series),
s AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY t) AS sid FROM g)
SELECT k, t, v FROM s QUALIFY row_number() OVER (PARTITION BY k, sid ORDER BY v DESC, t) = 1""", t=3)
def dedupe_events(t):
    return P.dedupe_events(t.series(), 0.5, "v", "k", "t").select("k", "t", "v")


@query("local_peaks", f"""WITH RECURSIVE {SERIES_SQL},
i AS (SELECT k, t AS tt, v, row_number() OVER (PARTITION BY k ORDER BY t) AS n FROM series),
r AS (SELECT *, n - row_number() OVER (PARTITION BY k, v ORDER BY n) AS g FROM i),
runs AS (SELECT k, v, min(n) AS a, max(n) AS b FROM r GROUP BY k, v, g),
nb AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY a) AS pv, lead(v) OVER (PARTITION BY k ORDER BY a) AS nv FROM runs),
over_u AS (SELECT k, CAST(floor((a + b) / 2.0) AS DOUBLE) AS t, v FROM nb WHERE pv < v AND nv < v),
{greedy(20.0)}
SELECT p.k, i.tt AS t, p.v FROM picked p JOIN i ON i.k = p.k AND i.n = p.t""", t=3)
def local_peaks(t):
    return P.local_peaks(t.series(), 20, "k", "t", "v")


@query("paired_peaks", f"""WITH RECURSIVE {SERIES_SQL},
u AS (SELECT k, quantile_cont(v, 0.95) AS u FROM series GROUP BY k),
over_u AS (SELECT s.* FROM series s JOIN u USING (k) WHERE v > u),
{greedy(24 * HOUR)},
b AS (SELECT p.k, p.t, p.v, o.k AS ok, o.v AS ov, o.t AS ot,
  row_number() OVER (PARTITION BY p.k, p.t, o.k ORDER BY o.v DESC, o.t) AS rn
  FROM picked p JOIN series o ON o.k <> p.k AND o.t BETWEEN p.t - 43200.0 AND p.t + 43200.0),
x AS (SELECT k, t, k AS ok, v AS ov, t AS ot FROM picked UNION ALL SELECT k, t, ok, ov, ot FROM b WHERE rn = 1),
w AS (SELECT t AS event_time, k AS conditioned_on,
  max(ov) FILTER (ok = 'click') AS click, max(ov) FILTER (ok = 'error') AS "error", max(ov) FILTER (ok = 'view') AS "view",
  max(ot) FILTER (ok = 'click') AS click_time, max(ot) FILTER (ok = 'error') AS error_time, max(ot) FILTER (ok = 'view') AS view_time,
  max(ov) FILTER (ok = 'purchase') AS purchase, max(ot) FILTER (ok = 'purchase') AS purchase_time,
  max(ov) FILTER (ok = 'signup') AS signup, max(ot) FILTER (ok = 'signup') AS signup_time FROM x GROUP BY k, t)
SELECT * FROM w WHERE click IS NOT NULL AND "error" IS NOT NULL AND "view" IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL""",
       event_time=3, click_time=3, error_time=3, view_time=3, purchase_time=3, signup_time=3)
def paired_peaks(t):
    return P.paired_peaks(t.series(), "k", "t", "v", sep_h=24, pair_h=12, q=0.95)


@query("split_components")
def split_components(t):
    return P.split_components(t.daily().select("k", "t", "v"), "k", "t", "v", 15.0, 20)


@query("recombine_level", f"""WITH {DAILY_SQL},
e AS (SELECT o_orderkey AS event_id, o_orderpriority AS k, CAST(epoch(CAST(o_orderdate AS DATE)) AS DOUBLE) AS p FROM orders)
SELECT e.k, e.event_id, d.t, (d.t - e.p) / 3600.0 AS relative_hour,
  d.v + 0.123457 + d.v / 10 + (1 + e.event_id % 5) * (d.v / 100) AS water_level
FROM e JOIN daily d ON d.k = e.k AND d.t BETWEEN e.p - 259200 AND e.p + 259200""", water_level=2)
def recombine_level(t):
    c = t.daily().select("k", "t", F.col("v").alias("msl"), (F.col("v") / 10).alias("tide"), (F.col("v") / 100).alias("ntr"))
    e = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("k"),
                        (F.unix_date(F.to_date("o_orderdate")).cast("double") * 86400.0).alias("p"),
                        (1 + F.col("o_orderkey") % 5).alias("ntr_scale"), F.lit(0.123457).alias("msl_shift"))
    return P.recombine_level(c, e, "k", "t", "event_id", "p")
