"""Network operators on a distribution tree derived from `customer`: bus k hangs below bus k div 2.

Segment MACHINERY edges are transformers, the others lines; BUILDING lines carry open switches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.kit.graph import components
from tidemark.operators import network as N

from .base import query


def bus(k):
    return F.concat(F.lit("b"), F.lpad(k.cast("string"), 12, "0"))


BUS = "('b' || lpad(CAST(({k}) AS VARCHAR), 12, '0'))"
TREE_SQL = """n AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS p, c_mktsegment = 'BUILDING' AS cut, c_mktsegment = 'MACHINERY' AS tx, c_nationkey, abs(c_acctbal) / 1000 AS kw, c_mktsegment FROM customer),
walk AS (SELECT k, k AS cur FROM n UNION ALL SELECT w.k, n.p FROM walk w JOIN n ON n.k = w.cur WHERE n.p IS NOT NULL AND NOT n.cut),
comp AS (SELECT k, min(cur) AS c FROM walk GROUP BY k)"""


class Net:
    def __init__(self, t):
        c = t.customer.withColumn("k", F.col("c_custkey"))
        k, seg = F.col("k"), F.col("c_mktsegment")
        up = F.floor(k / 2)
        xy = lambda key, name: ((key * 7919 % 10007).cast("double").alias(f"{name}_lon"), (key * 104729 % 10009).cast("double").alias(f"{name}_lat"))
        feeder = F.col("c_nationkey").alias("feeder_id")
        self.buses = c.select(bus(k).alias("bus"), feeder, (k * 7919 % 10007).cast("double").alias("x"), (k * 104729 % 10009).cast("double").alias("y"))
        ln = c.where((k > 0) & (seg != "MACHINERY"))
        self.lines = ln.select(F.concat(F.lit("l"), k).alias("line_name"), feeder, bus(up).alias("from_bus"), bus(k).alias("to_bus"), (k % 3 + 1).alias("phases"),
                               (k % 50 + 1).cast("double").alias("length"), F.concat(F.lit("code_"), F.lower(seg)).alias("linecode"), *xy(up, "from"), *xy(k, "to"))
        self.tx = c.where((k > 0) & (seg == "MACHINERY")).select(F.concat(F.lit("t"), k).alias("transformer_name"), feeder, F.concat_ws(",", bus(up), bus(k)).alias("winding_buses"),
                                                                F.lit(12.47).alias("max_kv"), F.lit(0.24).alias("min_kv"), (k % 9 * 25.0).alias("max_kva"), *xy(k, "location"))
        self.loads = c.select(bus(k).alias("bus"), F.concat(F.lit("d"), k).alias("load_name"), feeder, (F.abs("c_acctbal") / 1000).alias("kw"), (F.abs("c_acctbal") / 3000).alias("kvar"), F.lit(0.24).alias("kv"))
        self.sources = c.where("c_acctbal > 9000").select(bus(k).alias("bus"), bus(k).alias("source_name"), feeder, F.lit(12.47).alias("basekv"), (k * 7919 % 10007).cast("double").alias("lon"), (k * 104729 % 10009).cast("double").alias("lat"))
        self.switches = c.where((k > 0) & (seg == "BUILDING")).select(F.concat(F.lit("s"), k).alias("switch_id"), bus(up).alias("from_bus"), bus(k).alias("to_bus"), F.concat(F.lit("l"), k).alias("line_name"), (k * 7919 % 1009).cast("double").alias("marginal_benefit"), bus(k).alias("node"), feeder)
        self.customers = c.select(bus(k).alias("bus"), feeder, (k % 7).cast("double").alias("customers"))
        self.tree = c.select(F.lit("all").alias("component"), bus(k).alias("node"), F.when(k > 0, bus(up)).alias("parent"), F.when(k > 0, (k % 50 + 1).cast("double")).otherwise(0.0).alias("exposure"))


@query("rollup_registry", f"""WITH n AS (SELECT c_custkey AS k, c_custkey // 2 AS p, c_mktsegment = 'MACHINERY' AS tx, abs(c_acctbal) / 1000 AS kw, c_acctbal > 9000 AS src FROM customer),
e AS (SELECT k AS b, 1 AS l, 0 AS t FROM n WHERE k > 0 AND NOT tx UNION ALL SELECT p, 1, 0 FROM n WHERE k > 0 AND NOT tx UNION ALL SELECT k, 0, 1 FROM n WHERE k > 0 AND tx UNION ALL SELECT p, 0, 1 FROM n WHERE k > 0 AND tx),
d AS (SELECT b, sum(l) AS l, sum(t) AS t FROM e GROUP BY b)
SELECT {BUS.format(k='k')} AS bus, CAST(coalesce(l, 0) AS BIGINT) AS line_degree, CAST(1 AS BIGINT) AS load_count, kw AS load_kw, CAST(coalesce(t, 0) AS BIGINT) AS transformer_count, CAST(CASE WHEN src THEN 1 ELSE 0 END AS BIGINT) AS source_count FROM n LEFT JOIN d ON b = k""", load_kw=5)
def rollup_registry(t):
    g = Net(t)
    return N.rollup_registry(g.buses, g.lines, g.loads, g.tx, g.sources).select("bus", "line_degree", "load_count", "load_kw", "transformer_count", "source_count")


@query("rollup_feeders", """SELECT c_nationkey AS feeder_id, count(*) AS bus_count, CAST(count_if(c_custkey > 0 AND c_mktsegment <> 'MACHINERY') AS BIGINT) AS line_count, CAST(count_if(c_custkey > 0 AND c_mktsegment = 'MACHINERY') AS BIGINT) AS transformer_count,
 CAST(count_if(c_acctbal > 9000) AS BIGINT) AS source_count, count(*) AS load_count, sum(abs(c_acctbal) / 1000) AS load_kw, sum(abs(c_acctbal) / 3000) AS load_kvar FROM customer GROUP BY c_nationkey""", load_kw=5, load_kvar=5)
def rollup_feeders(t):
    g = Net(t)
    return N.rollup_feeders(g.buses, g.lines, g.loads, g.tx, g.sources)


@query("missing_coordinates", "SELECT 'part' AS table_name, CAST(count_if(p_size = 7) AS BIGINT) AS missing FROM part UNION ALL SELECT 'supplier', CAST(count_if(s_nationkey < 3) AS BIGINT) FROM supplier")
def missing_coordinates(t):
    p = t.part.select(F.when(F.col("p_size") != 7, 1.0).alias("lon"), F.lit(2.0).alias("lat"))
    s = t.supplier.select(F.lit(1.0).alias("lon"), F.when(F.col("s_nationkey") >= 3, 2.0).alias("lat"))
    return N.missing_coordinates({"part": p, "supplier": s})


@query("classify_lines", """SELECT p_partkey, CASE WHEN x LIKE '%\\_ug\\_%' ESCAPE '\\' OR x LIKE '%underground%' OR x LIKE '%cable%' THEN 'underground' WHEN x LIKE '%\\_oh\\_%' ESCAPE '\\' OR x LIKE '%overhead%' THEN 'overhead'
 WHEN x LIKE '%fuse%' THEN 'fuse' ELSE 'line' END AS line_class FROM (SELECT p_partkey, lower(CASE p_size % 5 WHEN 0 THEN 'x_UG_' WHEN 1 THEN 'x_OH_1' WHEN 2 THEN 'Cable' WHEN 3 THEN 'fuse' ELSE '' END || ' ' || p_name) AS x FROM part)""")
def classify_lines(t):
    m = F.col("p_size") % 5
    code = F.when(m == 0, "x_UG_").when(m == 1, "x_OH_1").when(m == 2, "Cable").when(m == 3, "fuse").otherwise("")
    return N.classify_lines(t.part.withColumn("linecode", code), "linecode", "p_name").select("p_partkey", "line_class")


@query("qualify_bus", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || ':' || lower(split_part(c_name || '.1.2', '.', 1)) AS bus FROM customer")
def qualify_bus(t):
    return t.customer.select("c_custkey", N.qualify_bus(F.concat(F.col("c_name"), F.lit(".1.2")), F.col("c_nationkey").cast("string")).alias("bus"))


@query("bus_components", f"WITH RECURSIVE {TREE_SQL} SELECT {BUS.format(k='k')} AS bus, {BUS.format(k='c')} AS component FROM comp")
def bus_components(t):
    g = Net(t)
    return N.bus_components(g.buses, g.lines, g.tx, g.switches)


@query("order_network_components")
def order_network_components(t):
    """Customers and parts joined by line items: a many-to-many graph with hot nodes."""
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    e = li.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    nodes = t.customer.select((F.col("c_custkey") * 2).alias("node")).union(t.part.select((F.col("p_partkey") * 2 + 1).alias("node")))
    return components(nodes, e).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


@query("control_filter")
def control_filter(t):
    g = Net(t)
    return N.control_filter(g.buses, g.lines, g.tx, 100.0)


VOLTAGE_SQL = f"""WITH RECURSIVE n AS (SELECT c_custkey AS k, c_custkey // 2 AS p, c_custkey > 0 AND c_mktsegment = 'MACHINERY' AS tx, c_acctbal FROM customer),
s AS (SELECT k, 12.47 AS kv, 0 AS pr, '' AS o, 0 AS pos FROM n WHERE c_acctbal > 9000
  UNION ALL SELECT p, 12.47, 1, 't' || k, 0 FROM n WHERE tx UNION ALL SELECT k, 0.24, 1, 't' || k, 1 FROM n WHERE tx
  UNION ALL SELECT k, 0.24, 2, 'd' || k, 0 FROM n WHERE abs(c_acctbal) / 1000 > 9.5),
one AS (SELECT k, kv FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY pr, o, pos) = 1),
wd AS (SELECT k FROM n WHERE tx UNION SELECT p FROM n WHERE tx),
l AS (SELECT k, p FROM n WHERE k > 0 AND NOT tx AND NOT (k IN (SELECT k FROM wd) AND p IN (SELECT k FROM wd))),
a AS (SELECT k AS u, p AS v FROM l UNION ALL SELECT p, k FROM l),
w(seed, node, prev, h) AS (SELECT k, k, CAST(NULL AS BIGINT), 0 FROM one UNION ALL SELECT w.seed, a.v, a.u, h + 1 FROM w JOIN a ON a.u = w.node WHERE w.prev IS DISTINCT FROM a.v),
m AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY h, seed) = 1)
SELECT {BUS.format(k='node')} AS bus, CAST(kv AS DOUBLE) AS kv, {BUS.format(k='seed')} AS seed_bus, CAST(h AS INTEGER) AS hops FROM m JOIN one ON one.k = m.seed"""


@query("bus_voltage", VOLTAGE_SQL)
def bus_voltage(t):
    g = Net(t)
    return N.bus_voltage(g.lines, g.sources, g.tx, g.loads.where(F.col("kw") > 9.5))


BLOCK_SQL = """b AS (SELECT comp.c, count(*) AS bus_count, sum(kw) AS load_kw, bool_or(src) AS has_source, CAST(max(ph) AS INTEGER) AS phi_max FROM comp JOIN
 (SELECT n.k, n.kw, c_acctbal > 9000 AS src, greatest(CASE WHEN n.k > 0 AND NOT n.tx AND NOT n.cut THEN n.k % 3 + 1 ELSE 0 END, coalesce(m.ph, 0)) AS ph FROM n JOIN customer ON c_custkey = n.k LEFT JOIN (SELECT p, max(k % 3 + 1) AS ph FROM n WHERE k > 0 AND NOT tx AND NOT cut GROUP BY p) m ON m.p = n.k) x USING (k) GROUP BY comp.c)"""


def blocks(t):
    g = Net(t)
    comp = N.cut(N.bus_components(g.buses, g.lines, g.tx, g.switches))
    volt = g.loads.select("bus", "kv")
    return g, comp, volt, N.load_blocks(comp, g.lines, g.tx, g.switches, g.loads, g.sources, volt)


@query("load_blocks", f"""WITH RECURSIVE {TREE_SQL}, {BLOCK_SQL}
SELECT {BUS.format(k='c')} AS component, bus_count, load_kw, has_source, phi_max, bus_count - 1 AS edge_count, CASE WHEN has_source THEN 'substation_pcc' ELSE 'pending_der_inventory' END AS reachability FROM b""", load_kw=5)
def load_blocks(t):
    return blocks(t)[3].drop("voltage_kv", "phase_set")


@query("block_violations", f"""WITH RECURSIVE {TREE_SQL}, e AS (SELECT DISTINCT comp.c FROM n JOIN comp USING (k) WHERE k > 0 AND NOT tx AND NOT cut AND ((k % 11 = 0) <> (p % 11 = 0)))
SELECT {BUS.format(k='c')} AS component, 'C' AS invariant FROM e""")
def block_violations(t):
    g, comp, _, b = blocks(t)
    volt = t.customer.select(bus(F.col("c_custkey")).alias("bus"), F.when(F.col("c_custkey") % 11 == 0, 12.47).otherwise(0.24).alias("kv"))
    return N.block_violations(b, comp, g.lines, g.switches, volt)


@query("block_rows", f"""WITH RECURSIVE {TREE_SQL},
f AS (SELECT c, c_nationkey FROM (SELECT c, c_nationkey, count(*) AS x FROM comp JOIN n USING (k) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c ORDER BY x DESC, c_nationkey DESC) = 1),
sw AS (SELECT 's' || k AS s, k AS e FROM n WHERE cut AND k > 0 UNION ALL SELECT 's' || k, p FROM n WHERE cut AND k > 0),
s AS (SELECT c, string_agg(DISTINCT s, ',' ORDER BY s) AS bs FROM sw JOIN comp ON comp.k = e GROUP BY c),
h AS (SELECT c, count(*) AS n, string_agg({BUS.format(k='k')}, '|' ORDER BY k) AS names FROM comp GROUP BY c)
SELECT {BUS.format(k='c')} AS component, CAST(c_nationkey AS VARCHAR) AS feeder_id, n AS bus_count, coalesce(bs, '') AS bounding_switches, length(names) AS name_length FROM h JOIN f USING (c) LEFT JOIN s USING (c)""")
def block_rows(t):
    g, comp, _, _ = blocks(t)
    return N.block_rows(comp, g.buses, g.switches, "site").drop("block_id").withColumn("name_length", F.col("bus_count") * 14 - 1)


@query("reachable_blocks", f"""WITH RECURSIVE {TREE_SQL}, {BLOCK_SQL} SELECT {BUS.format(k='c')} AS component, has_source, (SELECT bool_or(has_source) FROM b) AS reaches_source FROM b""")
def reachable_blocks(t):
    g, comp, _, b = blocks(t)
    return N.reachable_blocks(b, comp, g.switches)


@query("block_summary", f"""WITH RECURSIVE {TREE_SQL}, s AS (SELECT c, count(*) AS n FROM comp GROUP BY c)
SELECT CAST(1 AS BIGINT) AS components_before, count(*) AS components_after, CAST(count_if(n > 1) AS BIGINT) AS non_trivial_blocks, CAST(count_if(n = 1) AS BIGINT) AS single_bus_blocks, max(n) AS largest_block, quantile_cont(n, 0.5) AS median_block FROM s""")
def block_summary(t):
    g = Net(t)
    return N.block_summary(g.buses, g.lines, g.tx, g.switches)


@query("derive_fuses", f"""WITH l AS (SELECT c_custkey AS k, c_custkey // 2 AS p, c_custkey % 3 + 1 AS ph FROM customer WHERE c_custkey > 0 AND c_mktsegment <> 'MACHINERY'),
b AS (SELECT b, max(ph) AS m FROM (SELECT k AS b, ph FROM l UNION ALL SELECT p, ph FROM l) GROUP BY b)
SELECT 'l' || k AS line_name, CASE WHEN x.m > ph THEN {BUS.format(k='p')} ELSE {BUS.format(k='k')} END AS fuse_bus, CAST(ph AS INTEGER) AS phases FROM l JOIN b x ON x.b = p JOIN b y ON y.b = k WHERE x.m > ph OR y.m > ph""")
def derive_fuses(t):
    return N.derive_fuses(Net(t).lines)


ORIENT_SQL = f"""WITH RECURSIVE l AS (SELECT c_custkey AS k, c_custkey // 2 AS p, CAST(c_custkey % 50 + 1 AS DOUBLE) AS ex FROM customer WHERE c_custkey > 0 AND c_mktsegment <> 'MACHINERY'),
a AS (SELECT k AS u, p AS v, ex FROM l UNION ALL SELECT p, k, ex FROM l),
up AS (SELECT DISTINCT u AS k, u AS cur FROM a UNION ALL SELECT up.k, l.p FROM up JOIN l ON l.k = up.cur),
comp AS (SELECT k, min(cur) AS c FROM up GROUP BY k), d AS (SELECT u AS k, count(*) AS d FROM a GROUP BY u),
root AS (SELECT c, coalesce(min(CASE WHEN c_acctbal > 9000 THEN k END), first(k ORDER BY d DESC, coalesce(abs(c_acctbal) / 1000, 0) DESC, k)) AS r FROM comp JOIN d USING (k) LEFT JOIN customer ON c_custkey = k GROUP BY c),
w AS (SELECT c, r AS node, CAST(NULL AS BIGINT) AS parent, 0 AS hops, CAST(0 AS DOUBLE) AS ex FROM root UNION ALL SELECT w.c, a.v, a.u, hops + 1, a.ex FROM w JOIN a ON a.u = w.node WHERE w.parent IS DISTINCT FROM a.v)
SELECT {BUS.format(k='c')} AS component, {BUS.format(k='node')} AS node, CASE WHEN parent IS NOT NULL THEN {BUS.format(k='parent')} END AS parent, CAST(hops AS INTEGER) AS hops, ex AS exposure FROM w"""


@query("orient_feeders", ORIENT_SQL)
def orient_feeders(t):
    g = Net(t)
    return N.orient_feeders(g.buses, g.lines, g.sources, g.loads)


BENEFIT_SQL = """n AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS p, abs(c_acctbal) / 1000 AS kw, CASE WHEN c_custkey > 0 THEN CAST(c_custkey % 50 + 1 AS DOUBLE) ELSE 0 END AS ex, c_mktsegment = 'BUILDING' AS cut, c_custkey % 7 AS cu FROM customer),
up AS (SELECT k, k AS a FROM n UNION ALL SELECT u.k, n.p FROM up u JOIN n ON n.k = u.a WHERE n.p IS NOT NULL),
s AS (SELECT a AS k, count(*) AS dn, sum(kw) AS dl, sum(ex) AS de FROM up JOIN n USING (k) GROUP BY a),
tt AS (SELECT count(*) AS n, sum(kw) AS l, sum(ex) AS e FROM n),
bn AS (SELECT s.k, dn, tt.n - dn AS un, dl, de, tt.l * tt.e - dl * de - (tt.l - dl) * (tt.e - de) AS benefit FROM s, tt WHERE s.k > 0)"""


@query("switch_benefit", f"WITH RECURSIVE {BENEFIT_SQL} SELECT {BUS.format(k='k')} AS node, CAST(dn AS DOUBLE) AS downstream_nodes, CAST(un AS DOUBLE) AS upstream_nodes, dl AS downstream_load, de AS downstream_exposure, benefit FROM bn",
       downstream_load=5, downstream_exposure=3, benefit=1)
def switch_benefit(t):
    g = Net(t)
    return N.switch_benefit(g.tree, g.loads).select("node", "downstream_nodes", "upstream_nodes", "downstream_load", "downstream_exposure", "benefit")


@query("candidate_edges", f"WITH RECURSIVE {BENEFIT_SQL} SELECT {BUS.format(k='k')} AS node, benefit FROM bn WHERE least(dn, un) >= 5 ORDER BY benefit DESC, k LIMIT 20", benefit=1)
def candidate_edges(t):
    g = Net(t)
    return N.candidate_edges(N.switch_benefit(g.tree, g.loads), 5, 0.0, 20).select("node", "benefit")


FRONT_SQL = """f AS (SELECT c_nationkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, c_acctbal AS b FROM customer),
ph AS (SELECT *, CASE WHEN k <= 2 THEN 0 ELSE 1 END AS ph FROM f), ke AS (SELECT *, min(b) OVER (PARTITION BY c, ph ORDER BY k) AS key FROM ph),
o AS (SELECT *, row_number() OVER (ORDER BY ph, key DESC, c DESC, k) AS pick_order FROM ke WHERE ph = 0 OR key >= 1000)"""


def frontiers(t):
    from tidemark.kit.blocks import row_numbers

    r = row_numbers(t.customer, ["c_nationkey"], "c_custkey", name="k_switches")
    return r.select(F.col("c_nationkey").alias("component_id"), "k_switches", F.col("c_acctbal").alias("marginal_benefit"))


@query("marginal_budget", f"WITH {FRONT_SQL} SELECT c AS component_id, k AS k_switches, b AS marginal_benefit, pick_order FROM o WHERE pick_order <= 120")
def marginal_budget(t):
    return N.marginal_budget(frontiers(t), 1000.0, 120, 2)


@query("two_tier", """WITH s AS (SELECT 's' || c_custkey AS switch_id, c_custkey * 7919 % 1009 AS b FROM customer WHERE c_custkey > 0 AND c_mktsegment = 'BUILDING'), r AS (SELECT *, row_number() OVER (ORDER BY b DESC, switch_id) AS rn FROM s)
SELECT switch_id, CASE WHEN rn <= 40 THEN 'automated_sectionalizing' ELSE 'manual_sectionalizing' END AS switch_role_class, rn <= 40 AS dispatchable FROM r""")
def two_tier(t):
    return N.two_tier(Net(t).switches, 40).select("switch_id", "switch_role_class", "dispatchable")


@query("zone_totals", f"""WITH RECURSIVE {BENEFIT_SQL}, w AS (SELECT k, k AS cur FROM n UNION ALL SELECT w.k, n.p FROM w JOIN n ON n.k = w.cur WHERE n.p IS NOT NULL AND NOT n.cut),
z AS (SELECT k, min(cur) AS z FROM w GROUP BY k) SELECT {BUS.format(k='z')} AS zone, count(*) AS nodes, sum(kw + cu) AS load, sum(ex) AS exposure FROM z JOIN n USING (k) GROUP BY z""", load=5, exposure=2)
def zone_totals(t):
    g = Net(t)
    return N.zone_totals(g.tree, g.switches, g.loads, g.customers)


@query("feeder_metrics", """WITH l AS (SELECT c_nationkey AS f, sum((c_custkey % 50 + 1) / 1609.344) AS m, sum(CASE WHEN c_custkey % 3 = 2 THEN (c_custkey % 50 + 1) / 1609.344 ELSE 0 END) AS m3 FROM customer WHERE c_custkey > 0 AND c_mktsegment <> 'MACHINERY' GROUP BY 1),
x AS (SELECT c_nationkey AS f, sum(abs(c_acctbal) / 1000) AS kw, sum(c_custkey % 7) AS cu, sum(CASE WHEN c_custkey > 0 AND c_mktsegment = 'MACHINERY' THEN c_custkey % 9 * 25.0 ELSE 0 END) / 1000 AS mva, count_if(c_custkey > 0 AND c_mktsegment = 'BUILDING') AS sw FROM customer GROUP BY 1)
SELECT f AS feeder_id, m AS line_miles, m3 AS three_phase_miles, mva AS transformer_mva, kw AS load_kw, CAST(cu AS DOUBLE) AS customers, CAST(sw AS BIGINT) AS switches, kw / nullif(cu, 0) AS kw_per_customer, kw / 1000 / nullif(mva, 0) AS load_to_transformer_ratio FROM l JOIN x USING (f)""",
       line_miles=6, three_phase_miles=6, transformer_mva=6, load_kw=5, kw_per_customer=6, load_to_transformer_ratio=6)
def feeder_metrics(t):
    g = Net(t)
    return N.feeder_metrics(g.tx, g.loads, g.lines.withColumnRenamed("length", "length_m"), g.customers, g.switches)


@query("grade", """WITH v AS (SELECT 'price' AS m, p_retailprice AS v FROM part UNION ALL SELECT 'size', p_size FROM part),
f AS (SELECT m, avg(CASE WHEN (m = 'price' AND v BETWEEN 900 AND 1050) OR (m = 'size' AND (v BETWEEN 1 AND 20 OR v BETWEEN 30 AND 40)) THEN 1.0 ELSE 0 END) AS t,
 avg(CASE WHEN (m = 'price' AND v BETWEEN 1050.01 AND 1095) OR (m = 'size' AND v BETWEEN 21 AND 29) THEN 1.0 ELSE 0 END) AS u, count(*) AS n FROM v GROUP BY m)
SELECT m AS metric_id, n AS feeder_count, t AS typical_fraction, u AS uncommon_fraction, greatest(1 - t - u, 0) AS rare_fraction, CASE WHEN round(greatest(1 - t - u, 0), 9) <= 0.05 THEN 'good' WHEN round(greatest(1 - t - u, 0), 9) <= 0.1 THEN 'marginal' ELSE 'check' END AS grade FROM f""",
       typical_fraction=8, uncommon_fraction=8, rare_fraction=8)
def grade(t):
    m = t.part.select(F.explode(F.array(F.struct(F.lit("price").alias("metric_id"), F.col("p_retailprice").alias("value")), F.struct(F.lit("size").alias("metric_id"), F.col("p_size").cast("double").alias("value")))).alias("s")).select("s.*")
    r = t.spark.createDataFrame([("price", "typical", 900.0, 1050.0), ("price", "uncommon", 1050.01, 1095.0), ("size", "typical", 1.0, 20.0), ("size", "typical", 30.0, 40.0), ("size", "uncommon", 21.0, 29.0)], "metric_id string, kind string, lo double, hi double")
    return N.grade(m, r)


@query("nearest_standard", """SELECT p_partkey, s AS standard_kva FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size * 12.5 - s), s) AS rn FROM part, (VALUES (25.0), (50.0), (75.0), (100.0), (167.0), (300.0), (500.0)) v(s)) WHERE rn = 1""", standard_kva=1)
def nearest_standard(t):
    return N.nearest_standard(t.part.select("p_partkey", (F.col("p_size") * 12.5).alias("kva")), "kva", [25, 50, 75, 100, 167, 300, 500]).select("p_partkey", "standard_kva")


def looped_lines(t):
    """Feeders of 40 buses: a binary tree with some lines missing and some that close loops."""
    k = F.col("c_custkey")
    i = k % 40
    base = k - i
    line = lambda cond, to, x: t.customer.where(cond).select(F.floor(k / 40).alias("feeder_id"), bus(k).alias("from_bus"), bus(to).alias("to_bus"), x.cast("double").alias("length"))
    tree = line((i > 0) & (k % 17 != 3), base + F.floor(i / 2), k % 50 + 1)
    return tree.unionByName(line((i > 3) & (k % 13 == 5), k - 3, k % 7))


def doubled(x: str, y: str) -> str:
    return f"{y} AS (SELECT l.f, l.a, r.b, min(l.d + r.d) AS d FROM {x} l JOIN {x} r ON r.f = l.f AND r.a = l.b GROUP BY ALL)"


METRICS_SQL = f"""WITH l AS (SELECT c_custkey // 40 AS f, c_custkey AS a, c_custkey - c_custkey % 40 + c_custkey % 40 // 2 AS b, CAST(c_custkey % 50 + 1 AS DOUBLE) AS d FROM customer WHERE c_custkey % 40 > 0 AND c_custkey % 17 <> 3
  UNION ALL SELECT c_custkey // 40, c_custkey, c_custkey - 3, CAST(c_custkey % 7 AS DOUBLE) FROM customer WHERE c_custkey % 40 > 3 AND c_custkey % 13 = 5),
d0 AS (SELECT f, a, b, min(d) AS d FROM (SELECT f, a, b, d FROM l UNION ALL SELECT f, b, a, d FROM l UNION ALL SELECT f, a, a, 0 FROM l UNION ALL SELECT f, b, b, 0 FROM l) GROUP BY ALL),
{", ".join(doubled(f"d{i}", f"d{i + 1}") for i in range(6))},
c AS (SELECT f, a, min(b) AS c FROM d6 GROUP BY f, a), z AS (SELECT f, c, count(*) AS n FROM c GROUP BY f, c QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, c) = 1),
far AS (SELECT d6.f, d6.b FROM z JOIN d6 ON d6.f = z.f AND d6.a = z.c QUALIFY row_number() OVER (PARTITION BY d6.f ORDER BY d6.d DESC, d6.b) = 1),
dia AS (SELECT d6.f, max(d6.d) AS diameter FROM far JOIN d6 ON d6.f = far.f AND d6.a = far.b GROUP BY d6.f),
av AS (SELECT d6.f, avg(d6.d) AS m FROM z JOIN c USING (f, c) JOIN d6 ON d6.f = z.f AND d6.a = c.a WHERE d6.a < d6.b GROUP BY d6.f),
k AS (SELECT f, count(DISTINCT a) AS n FROM c GROUP BY f)
SELECT k.f AS feeder_id, k.n AS bus_count, 2.0 * (SELECT count(*) FROM l WHERE l.f = k.f) / k.n AS average_degree, coalesce(m, 0) AS mean_path_length, coalesce(diameter, 0) AS diameter
FROM k LEFT JOIN av USING (f) LEFT JOIN dia USING (f)"""


@query("graph_metrics", METRICS_SQL, average_degree=9, mean_path_length=6, diameter=6)
def graph_metrics(t):
    return N.graph_metrics(looped_lines(t))


@query("switch_rows", f"""WITH l AS (SELECT c_custkey AS k, c_custkey // 2 AS p FROM customer WHERE c_custkey > 0), ln AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT {BUS.format(k='p')} AS from_bus, {BUS.format(k='l.k')} AS to_bus, CASE WHEN ln.k IS NOT NULL THEN 'l' || ln.k END AS associated_line_name, CASE WHEN ln.k IS NOT NULL THEN l.k % 3 + 1 END AS phases,
 CASE WHEN ln.k IS NOT NULL THEN (p * 7919 % 10007 + l.k * 7919 % 10007) / 2.0 END AS lon, ln.k IS NOT NULL AS opens_existing_line FROM l LEFT JOIN ln USING (k)""", lon=3)
def switch_rows(t):
    g = Net(t)
    return N.switch_rows(N.switch_benefit(g.tree, g.loads), g.lines).select("from_bus", "to_bus", "associated_line_name", "phases", "lon", "opens_existing_line")
