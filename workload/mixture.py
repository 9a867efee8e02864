"""Storm-type mixtures of three drivers on `events`: the fitted law, joint survival and the candidate pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import mathx
from tidemark.kit.common import cut
from tidemark.operators import extremes as X
from tidemark.operators import mixture as M

from .base import query
from .extremes import BAND_SQL, POT_FIT_SQL
from .peaks import erf_sql

COLS = ["x", "y", "z"]
RATE, SEED, NODES = 3.0, 13, 32

PAIRED_SQL = """paired AS (SELECT event_id, event_type AS storm_type, value + event_id / 1000000.0 AS x, user_id + event_id / 10000000.0 AS y,
  epoch_us(ts) / 3600000000.0 AS z FROM events)"""


def paired(t):
    return t.events.select("event_id", F.col("event_type").alias("storm_type"), (F.col("value") + F.col("event_id") / F.lit(1000000.0)).alias("x"),
                           (F.col("user_id") + F.col("event_id") / F.lit(10000000.0)).alias("y"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000.0)).alias("z"))


def cdf_sql(x: str) -> str:
    return f"(0.5 * (1.0 + sign({x}) * {erf_sql(f'(abs({x}) / 1.4142135623730951)')}))"


def poly_sql(x: str, coef) -> str:
    out = repr(coef[0])
    for c in coef[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def ppf_sql(p: str) -> str:
    q, r = f"sqrt(-2.0 * ln(least({p}, 1.0 - {p})))", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"{poly_sql(q, mathx.ACK_C)} / {poly_sql(q, (*mathx.ACK_D, 1.0))}"
    return (f"CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 0.97575 THEN -({tail}) "
            f"ELSE {poly_sql(r, mathx.ACK_A)} * ({p} - 0.5) / {poly_sql(r, (*mathx.ACK_B, 1.0))} END")


def clip_sql(x: str, eps: str = "1e-6") -> str:
    return f"least(greatest({x}, {eps}), 1 - {eps})"


def factor_sql(by: str, key: str) -> str:
    """CTE factor: entries of the triangle per group of pseudo-observations `uo`."""
    score = {c: ppf_sql(f"{c}_u") for c in COLS}
    return f"""uo AS (SELECT *, {', '.join(f'CAST(row_number() OVER ({by} ORDER BY {c}) AS DOUBLE) / (count(*) OVER ({by}) + 1) AS {c}_u' for c in COLS)} FROM paired),
sc AS (SELECT {key} AS g, {', '.join(f'{score[c]} AS {c}' for c in COLS)} FROM uo),
co AS (SELECT g, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM sc GROUP BY g),
f1 AS (SELECT *, sqrt(greatest(1 - xy * xy, 1e-6)) AS l11 FROM co),
f2 AS (SELECT *, (yz - xz * xy) / l11 AS l21 FROM f1),
factor AS (SELECT g, xy AS l10, l11, xz AS l20, l21, sqrt(greatest(1 - xz * xz - l21 * l21, 1e-6)) AS l22 FROM f2)"""


def chance_sql(src: str, nodes: int, keep: str) -> str:
    """CTEs from `src` (keep, s0, s1, s2 as exceedance per driver, factor entries) to `surv` (keep, s)."""
    tent = lambda root: f"abs(2.0 * (k * {root} - floor(k * {root})) - 1.0)"
    inner = "1e-12"
    return f"""h AS (SELECT *, {ppf_sql('p1')} AS h1, {ppf_sql('p2')} AS h2 FROM (SELECT *, {clip_sql('s1', inner)} AS p1, {clip_sql('s2', inner)} AS p2 FROM {src})),
n0 AS (SELECT h.*, {clip_sql(tent('sqrt(2.0)') + ' * s0', inner)} AS q0, k FROM h CROSS JOIN (SELECT CAST(unnest(range(1, {nodes} + 1)) AS DOUBLE) AS k)),
n1 AS (SELECT *, {ppf_sql('q0')} AS y0 FROM n0),
n2 AS (SELECT *, (h1 - l10 * y0) / l11 AS a1 FROM n1),
n3 AS (SELECT *, {cdf_sql('a1')} AS e1 FROM n2),
n4 AS (SELECT *, {clip_sql(tent('sqrt(3.0)') + ' * e1', inner)} AS q1 FROM n3),
n5 AS (SELECT *, {ppf_sql('q1')} AS y1 FROM n4),
n6 AS (SELECT *, (h2 - l20 * y0 - l21 * y1) / l22 AS a2 FROM n5),
surv AS (SELECT {keep}, avg(s0 * e1 * {cdf_sql('a2')}) AS s FROM n6 GROUP BY {keep})"""


@query("gaussian_joint_survival", f"""WITH {PAIRED_SQL}, {factor_sql('PARTITION BY 1', '1')},
u AS (SELECT event_id, 1 - x_u AS s0, 1 - y_u AS s1, 1 - z_u AS s2, factor.* FROM uo CROSS JOIN factor),
{chance_sql('u', 64, 'event_id')}
SELECT event_id, s AS and_survival FROM surv""", and_survival=8)
def gaussian_joint_survival(t):
    u = cut(X.pseudo_obs(paired(t), COLS, "event_id"))
    names = [f"{c}_u" for c in COLS]
    return M.gaussian_joint_survival(u, "event_id", names, M.gaussian_factor(u, names), nodes=64)


LAW_SQL = f"""{PAIRED_SQL},
long AS (SELECT storm_type || '|x' AS k, x AS v FROM paired UNION ALL SELECT storm_type || '|y', y FROM paired UNION ALL SELECT storm_type || '|z', z FROM paired),
{POT_FIT_SQL.format(src='long')},
{factor_sql('PARTITION BY storm_type', 'storm_type')},
ty AS (SELECT storm_type, count(*) AS n_events, {RATE} * count(*) / (SELECT count(*) FROM paired) AS rate FROM paired GROUP BY 1),
law AS (SELECT ty.*, factor.*, {', '.join(f'f{i}.shape AS c{i}, f{i}.loc AS o{i}, f{i}.scale AS w{i}' for i in range(3))} FROM ty JOIN factor ON g = storm_type
  {' '.join(f"JOIN fit f{i} ON f{i}.k = storm_type || '|{c}'" for i, c in enumerate(COLS))})"""


@query("mixture_law", f"""WITH {LAW_SQL} SELECT storm_type, n_events, rate, true AS fitted, n_events < 20 AS low_confidence,
 w0 AS scale_x, c1 AS shape_y, o2 AS loc_z, l10, l22 FROM law""", rate=9, scale_x=5, shape_y=7, loc_z=5, l10=8, l22=8)
def mixture_law(t):
    law = M.fit_mixture_law(paired(t), COLS, RATE, "event_id")
    m = lambda i, p: F.col("margins")[i][p]
    return law.select("storm_type", "n_events", "rate", "fitted", "low_confidence", m(0, "scale").alias("scale_x"), m(1, "shape").alias("shape_y"),
                      m(2, "loc").alias("loc_z"), F.col("factor")[1].alias("l10"), F.col("factor")[5].alias("l22"))


def reversed_sql(base: int, places: int) -> str:
    p = f"CAST(pow({base}, i) AS BIGINT)"
    return f"(list_sum(list_transform(range(0, {places}), lambda i: ((k // {p}) % {base}) / pow({base}, i + 1))) + 0.5 / pow({base}, {places}))"


def shift_sql(i: int) -> str:
    return f"(('0x' || substr(md5('{SEED}|mixture|' || storm_type || '|{i}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


PLACES = ((2, 40), (3, 26), (5, 18))
POOL_SQL = f"""{LAW_SQL},
pt AS (SELECT law.*, CAST(unnest(range(1, CAST(greatest(1, round((SELECT count(*) FROM paired) * rate / (SELECT sum(rate) FROM law))) AS BIGINT) + 1)) AS BIGINT) AS k FROM law),
w AS (SELECT *, {', '.join(f'{reversed_sql(b, n)} + {shift_sql(i)} AS t{i}' for i, (b, n) in enumerate(PLACES))} FROM pt),
wc AS (SELECT *, {', '.join(f"{clip_sql(f'(t{i} - floor(t{i}))')} AS v{i}" for i in range(3))} FROM w),
g AS (SELECT *, {', '.join(f"{ppf_sql(f'v{i}')} AS g{i}" for i in range(3))} FROM wc),
gz AS (SELECT *, g0 AS z0, l10 * g0 + l11 * g1 AS z1, l20 * g0 + l21 * g1 + l22 * g2 AS z2 FROM g),
pu AS (SELECT *, {', '.join(f"{clip_sql(cdf_sql(f'z{i}'))} AS u{i}" for i in range(3))} FROM gz),
pool AS (SELECT storm_type || '-' || k AS id, storm_type, {', '.join(f'u{i} AS {c}_u' for i, c in enumerate(COLS))},
  {', '.join(f'o{i} + w{i} * CASE WHEN abs(c{i}) < 1e-9 THEN -ln(1 - u{i}) ELSE (pow(1 - u{i}, -c{i}) - 1) / nullif(c{i}, 0) END AS {c}' for i, c in enumerate(COLS))} FROM pu),
ex AS (SELECT id, rate, l10, l11, l20, l21, l22, {', '.join(
    f'CASE WHEN {c} <= o{i} THEN 1.0 WHEN abs(c{i}) < 1e-9 THEN exp(-({c} - o{i}) / w{i}) WHEN 1 + c{i} * ({c} - o{i}) / w{i} <= 0 THEN 0.0 '
    f'ELSE pow(1 + c{i} * ({c} - o{i}) / w{i}, -1 / nullif(c{i}, 0)) END AS s{i}' for i, c in enumerate(COLS))} FROM pool CROSS JOIN (SELECT * EXCLUDE (storm_type) FROM law)),
{chance_sql('ex', NODES, 'id, rate, l10')},
fq AS (SELECT id, sum(rate * s) AS frequency_per_year FROM surv GROUP BY id)"""


@query("mixture_pool", f"""WITH {POOL_SQL} SELECT pool.*, frequency_per_year, {BAND_SQL.format(rp='(1 / frequency_per_year)')} AS severity_band
FROM pool JOIN fq USING (id)""", x=4, y=4, z=4, x_u=8, y_u=8, z_u=8, frequency_per_year=7)
def mixture_pool(t):
    """One candidate per observed row, dealt to the types by rate; each counts the frequency of all types."""
    p = paired(t)
    law = cut(M.fit_mixture_law(p, COLS, RATE, "event_id"))
    return M.simulate_mixture_pool(law, COLS, p.count(), SEED, nodes=NODES).drop("return_period_years")
