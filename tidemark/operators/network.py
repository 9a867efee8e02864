"""Distribution-network operators on bus and line tables: roll-ups, components, blocks, trees, switches, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kit.blocks import quantiles, row_numbers
from ..kit.common import cut, finite
from ..kit.forest import Graph, nearest_seed, simple_edges
from ..kit.graph import components, subtree_sums
from ..kit.intervals import within_distance


def windings(tx: DataFrame) -> DataFrame:
    """Winding buses of each transformer with their place: (transformer_name, feeder_id, pos, bus, max_kv, min_kv)."""
    return tx.select("transformer_name", "feeder_id", "max_kv", "min_kv", F.posexplode(F.split("winding_buses", ",")).alias("pos", "bus")).withColumn(
        "bus", F.trim("bus")).where("bus <> ''")


def rollup_registry(buses: DataFrame, lines: DataFrame, loads: DataFrame, tx: DataFrame, sources: DataFrame) -> DataFrame:
    """Bus rows with line degree, load sums, transformer and source counts."""
    ends = lines.select(F.explode(F.array("from_bus", "to_bus")).alias("bus")).groupBy("bus").agg(F.count(F.lit(1)).alias("line_degree"))
    ld = loads.groupBy("bus").agg(F.count(F.lit(1)).alias("load_count"), F.sum(finite("kw")).alias("load_kw"), F.sum(finite("kvar")).alias("load_kvar"))
    wd = windings(tx).groupBy("bus").agg(F.count(F.lit(1)).alias("transformer_count"))
    sr = sources.groupBy("bus").agg(F.count(F.lit(1)).alias("source_count"))
    out = buses
    for part in (ends, ld, wd, sr):
        out = out.join(part, "bus", "left")
    return out.na.fill(0, ["line_degree", "load_count", "transformer_count", "source_count"]).na.fill(0.0, ["load_kw", "load_kvar"])


def rollup_feeders(buses: DataFrame, lines: DataFrame, loads: DataFrame, tx: DataFrame, sources: DataFrame) -> DataFrame:
    """Feeder totals over the five tables; feeders are those of the buses. Counting is one tagged union."""
    tag = lambda df, name, *cols: df.select("feeder_id", F.lit(name).alias("_k"), *(cols or (F.lit(0.0).alias("kw"), F.lit(0.0).alias("kvar"))))
    u = tag(buses, "bus").unionByName(tag(lines, "line")).unionByName(tag(tx, "transformer")).unionByName(tag(sources, "source")).unionByName(
        tag(loads, "load", F.coalesce(finite("kw"), F.lit(0.0)).alias("kw"), F.coalesce(finite("kvar"), F.lit(0.0)).alias("kvar")))
    n = lambda k: F.count_if(F.col("_k") == k).alias(f"{k}_count")
    g = u.where(F.col("feeder_id").isNotNull() & (F.col("feeder_id").cast("string") != "")).groupBy("feeder_id").agg(*[n(k) for k in ("bus", "line", "transformer", "source", "load")],
                                                               F.sum("kw").alias("load_kw"), F.sum("kvar").alias("load_kvar"))
    return g.where("bus_count > 0")


def missing_coordinates(tables: dict[str, DataFrame], lon: str = "lon", lat: str = "lat") -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count_if(finite(lon).isNull() | finite(lat).isNull()).alias("missing")).select(F.lit(name).alias("table_name"), "missing")
        out = row if out is None else out.unionByName(row)
    return out


def classify_lines(df: DataFrame, code: str = "linecode", name: str = "line_name") -> DataFrame:
    """line_class from the code and name: underground, overhead, fuse or line."""
    text = F.lower(F.concat_ws(" ", F.col(code).cast("string"), F.col(name).cast("string")))
    has = lambda *w: F.greatest(*[text.contains(x).cast("int") for x in w], F.lit(0)) == 1
    return df.withColumn("line_class", F.when(has("_ug_", "underground", "cable"), "underground").when(has("_oh_", "overhead"), "overhead").when(
        text.contains("fuse"), "fuse").otherwise("line"))


def qualify_bus(bus: Column, feeder: Column) -> Column:
    """Feeder-qualified bus name without its node suffix."""
    return F.concat_ws(":", feeder, F.lower(F.split(bus, r"\.")[0]))


def network_edges(lines: DataFrame, tx: DataFrame | None, opened: DataFrame | None = None) -> DataFrame:
    """Undirected (src, dst): lines not opened, and a star from the first winding of each transformer to the others."""
    ln = lines if opened is None else lines.join(opened.select("line_name").distinct(), "line_name", "left_anti")
    e = ln.select(F.col("from_bus").alias("src"), F.col("to_bus").alias("dst"))
    if tx is not None:
        w = windings(tx)
        hub = w.where("pos = 0").select("transformer_name", F.col("bus").alias("src"))
        e = e.unionByName(hub.join(w.where("pos > 0"), "transformer_name").select("src", F.col("bus").alias("dst")).distinct())
    return e


def bus_components(buses: DataFrame, lines: DataFrame, tx: DataFrame | None = None, opened: DataFrame | None = None) -> DataFrame:
    """(bus, component): component is the smallest bus id connected."""
    return components(buses.select(F.col("bus").alias("node")), network_edges(lines, tx, opened)).withColumnRenamed("node", "bus")


def control_filter(buses: DataFrame, lines: DataFrame, tx: DataFrame | None, tie_m: float = 100.0, x: str = "x", y: str = "y") -> DataFrame:
    """Buses of the largest group of components tied by buses of different feeders (degree >= 2) at most tie_m apart."""
    comp = cut(bus_components(buses, lines, tx))
    deg = lines.select(F.explode(F.array("from_bus", "to_bus")).alias("bus")).groupBy("bus").agg(F.count(F.lit(1)).alias("_deg"))
    b = buses.join(deg.where("_deg >= 2"), "bus").join(comp, "bus")
    a = b.select("component", F.col("feeder_id").alias("_f1"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    o = b.select(F.col("component").alias("_c2"), F.col("feeder_id").alias("_f2"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    ties = within_distance(a, o, "_x1", "_y1", "_x2", "_y2", tie_m).where("_f1 <> _f2 and component <> _c2").select(
        F.col("component").alias("src"), F.col("_c2").alias("dst")).distinct()
    groups = components(comp.select(F.col("component").alias("node")).distinct(), ties, label="control_group").withColumnRenamed("node", "component")
    j = cut(comp.join(groups, "component"))
    best = j.groupBy("control_group").agg(F.count(F.lit(1)).alias("_n")).agg(F.max(F.struct("_n", "control_group")).alias("m")).select(F.col("m.control_group").alias("control_group"))
    return j.join(F.broadcast(best), "control_group", "left_semi").select("bus", "component", "control_group")


def bus_voltage(lines: DataFrame, sources: DataFrame, tx: DataFrame, loads: DataFrame) -> DataFrame:
    """(bus, kv, hops): seeds from sources, then windings, then loads spread over lines, never winding to winding."""
    w = windings(tx).where("max_kv is not null and min_kv is not null")
    many = w.groupBy("transformer_name").agg(F.count(F.lit(1)).alias("_k")).where("_k >= 2")
    ws = w.join(many, "transformer_name", "left_semi").select("bus", F.when(F.col("pos") == 0, F.col("max_kv")).otherwise(F.col("min_kv")).alias("kv"),
                                                              F.struct(F.lit(1).alias("p"), F.col("transformer_name").alias("o"), "pos").alias("_r"))
    rank = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(0).alias("pos")).alias("_r")
    seeds = sources.select("bus", finite("basekv").alias("kv"), rank(0, F.col("bus"))).unionByName(ws).unionByName(
        loads.where(finite("kv").isNotNull()).select("bus", finite("kv").alias("kv"), rank(2, F.col("load_name"))))
    one = cut(seeds.groupBy("bus").agg(F.min(F.struct("_r", "kv")).alias("m")).select("bus", F.col("m.kv").alias("kv")))
    tb = windings(tx).select("bus").distinct()
    e = lines.select(F.col("from_bus").alias("src"), F.col("to_bus").alias("dst")).join(
        tb.select(F.col("bus").alias("src"), F.lit(1).alias("_a")), "src", "left").join(tb.select(F.col("bus").alias("dst"), F.lit(1).alias("_b")), "dst", "left")
    e = e.where("_a is null or _b is null").select("src", "dst")
    walk = nearest_seed(one.select(F.col("bus").alias("node"), F.col("bus").alias("label")), e)
    return walk.join(one.select(F.col("bus").alias("label"), "kv"), "label").select(F.col("node").alias("bus"), "kv", F.col("label").alias("seed_bus"), "hops")


def voltage_band(kv: Column) -> Column:
    return F.when(kv.isNull(), "unknown").when(kv < 1.0, "LV").when(kv < 69.0, "MV").otherwise("HV")


def load_blocks(comp: DataFrame, lines: DataFrame, tx: DataFrame | None, opened: DataFrame | None, loads: DataFrame, sources: DataFrame,
                voltage: DataFrame, der: DataFrame | None = None) -> DataFrame:
    """One row per component: buses, load, source flag, voltage, phases, edges and reachability."""
    live = lines if opened is None else lines.join(opened.select("line_name").distinct(), "line_name", "left_anti")
    phase = live.select(F.explode(F.array("from_bus", "to_bus")).alias("bus"), F.col("phases").cast("int").alias("p")).groupBy("bus").agg(F.max("p").alias("_ph"))
    kw = loads.groupBy("bus").agg(F.sum(finite("kw")).alias("_kw"))
    src = sources.select("bus").distinct().withColumn("_src", F.lit(True))
    gfm = (der.select("bus").distinct().withColumn("_gfm", F.lit(True))) if der is not None else None
    j = comp.join(phase, "bus", "left").join(kw, "bus", "left").join(src, "bus", "left").join(voltage.select("bus", "kv"), "bus", "left")
    j = j.join(gfm, "bus", "left") if gfm is not None else j.withColumn("_gfm", F.lit(None).cast("boolean"))
    b = j.groupBy("component").agg(
        F.count(F.lit(1)).alias("bus_count"), F.coalesce(F.sum("_kw"), F.lit(0.0)).alias("load_kw"), F.coalesce(F.max("_src"), F.lit(False)).alias("has_source"),
        F.coalesce(F.max("kv"), F.lit(0.0)).alias("voltage_kv"), F.coalesce(F.max("_ph"), F.lit(0)).alias("phi_max"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_ph") > 0, F.col("_ph")))).cast("array<string>"), ",").alias("phase_set"), F.coalesce(F.max("_gfm"), F.lit(False)).alias("_g"))
    edges = network_edges(lines, tx, opened)
    per = edges.join(comp, F.col("src") == F.col("bus")).groupBy("component").agg(F.count(F.lit(1)).alias("edge_count"))
    reach = (F.when(F.col("has_source") & F.col("_g"), "both").when(F.col("has_source"), "substation_pcc").when(F.col("_g"), "gfm_eligible_der")
             .otherwise("none" if der is not None else "pending_der_inventory"))
    return b.join(per, "component", "left").na.fill(0, ["edge_count"]).withColumn("reachability", reach).drop("_g")


def block_violations(blocks: DataFrame, comp: DataFrame, lines: DataFrame, opened: DataFrame | None, voltage: DataFrame, strict: bool = False) -> DataFrame:
    """Invariant breaches: B no load and no source, C a line across voltage bands, F cyclic."""
    bad = F.filter(F.array(F.when((F.col("load_kw") <= 0) & ~F.col("has_source"), F.lit("B")), F.when(F.col("edge_count") > F.col("bus_count") - 1, F.lit("F"))), lambda v: v.isNotNull())
    bf = blocks.select("component", F.explode(bad).alias("invariant"))
    live = lines if opened is None else lines.join(opened.select("line_name").distinct(), "line_name", "left_anti")
    v = voltage.select("bus", voltage_band(F.col("kv")).alias("_v"))
    c = live.join(v.select(F.col("bus").alias("from_bus"), F.col("_v").alias("_a")), "from_bus").join(v.select(F.col("bus").alias("to_bus"), F.col("_v").alias("_b")), "to_bus")
    c = c.where("_a <> 'unknown' and _b <> 'unknown' and _a <> _b").join(comp.withColumnRenamed("bus", "from_bus"), "from_bus").select("component", F.lit("C").alias("invariant")).distinct()
    out = bf.unionByName(c)
    if strict and not out.isEmpty():
        raise ValueError(f"block invariants broken, e.g. {out.limit(5).collect()}")
    return out


def block_rows(comp: DataFrame, buses: DataFrame, switches: DataFrame, location: str) -> DataFrame:
    """Stable block id from the sorted buses, modal feeder (larger id on ties) and bounding switches.

    The id hashes the ordered bus names of the block, as its definition asks; only names are collected.
    """
    j = comp.join(buses.select("bus", "feeder_id"), "bus", "left")
    modal = j.where("feeder_id is not null").groupBy("component", "feeder_id").agg(F.count(F.lit(1)).alias("_c")).groupBy("component").agg(
        F.max(F.struct("_c", "feeder_id")).alias("m")).select("component", F.col("m.feeder_id").alias("feeder_id"))
    ident = j.groupBy("component").agg(F.count(F.lit(1)).alias("bus_count"), F.substring(F.sha1(F.array_join(F.sort_array(F.collect_list(F.col("bus").cast("string"))), "|")), 1, 12).alias("_h"))
    sw = switches.select("switch_id", F.explode(F.array("from_bus", "to_bus")).alias("bus")).join(comp, "bus").groupBy("component").agg(
        F.array_join(F.sort_array(F.collect_set(F.col("switch_id").cast("string"))), ",").alias("bounding_switches"))
    out = ident.join(modal, "component", "left").join(sw, "component", "left")
    token = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("feeder_id").cast("string"), F.lit("unknown")), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return out.select("component", F.concat_ws(":", F.lit(location), F.lit("block"), token, "_h").alias("block_id"), F.coalesce(F.col("feeder_id").cast("string"), F.lit("unknown")).alias("feeder_id"),
                      "bus_count", F.coalesce("bounding_switches", F.lit("")).alias("bounding_switches"))


def reachable_blocks(blocks: DataFrame, comp: DataFrame, switches: DataFrame) -> DataFrame:
    """(component, reaches_source): whether switches connect the block to one with a source."""
    c = comp.select("bus", "component")
    e = switches.join(c.select(F.col("bus").alias("from_bus"), F.col("component").alias("src")), "from_bus").join(
        c.select(F.col("bus").alias("to_bus"), F.col("component").alias("dst")), "to_bus").select("src", "dst")
    g = components(blocks.select(F.col("component").alias("node")), e, label="_g").withColumnRenamed("node", "component")
    j = cut(blocks.select("component", "has_source").join(g, "component"))
    return j.join(j.groupBy("_g").agg(F.max("has_source").alias("reaches_source")), "_g").select("component", "has_source", "reaches_source")


def block_summary(buses: DataFrame, lines: DataFrame, tx: DataFrame | None, opened: DataFrame) -> DataFrame:
    """Component counts before and after opening switches, with size statistics after (one row)."""
    before = bus_components(buses, lines, tx).agg(F.countDistinct("component").alias("components_before"))
    size = cut(bus_components(buses, lines, tx, opened).groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    after = size.agg(F.count(F.lit(1)).alias("components_after"), F.count_if(F.col("n") > 1).alias("non_trivial_blocks"), F.count_if(F.col("n") == 1).alias("single_bus_blocks"), F.max("n").alias("largest_block"))
    return before.join(after).join(quantiles(size, None, {"median_block": ("n", 0.5)}))


def derive_fuses(lines: DataFrame) -> DataFrame:
    """Lines whose end bus carries more phases than the line; the from end is looked at first."""
    ph = lines.select(F.explode(F.array("from_bus", "to_bus")).alias("bus"), F.col("phases").cast("int").alias("p")).groupBy("bus").agg(F.max("p").alias("_p"))
    j = lines.join(ph.select(F.col("bus").alias("from_bus"), F.col("_p").alias("_a")), "from_bus").join(ph.select(F.col("bus").alias("to_bus"), F.col("_p").alias("_b")), "to_bus")
    own = F.col("phases").cast("int")
    at = F.when(F.col("_a") > own, F.col("from_bus")).when(F.col("_b") > own, F.col("to_bus"))
    return j.withColumn("fuse_bus", at).where("fuse_bus is not null").select("line_name", "fuse_bus", own.alias("phases"))


def orient_feeders(buses: DataFrame, lines: DataFrame, sources: DataFrame, loads: DataFrame, exposure: str = "length") -> DataFrame:
    """Rooted trees: (component, node, parent, hops, exposure).

    Root is the smallest source bus of the component, else the bus with most lines, then most load, then smallest id. Parents come from a
    breadth-first walk, the lowest id among first arrivals; other edges are dropped as loops or parallels. Trees are rooted in
    logarithmic rounds; only the hops inside loop blocks are walked. A line
    without a length counts 1; buses without a line form no feeder.
    """
    comp = cut(bus_components(buses, lines))
    deg = lines.select(F.explode(F.array("from_bus", "to_bus")).alias("bus")).groupBy("bus").agg(F.count(F.lit(1)).alias("_d"))
    kw = loads.groupBy("bus").agg(F.sum(finite("kw")).alias("_kw"))
    c = comp.join(deg, "bus", "left").join(kw, "bus", "left").join(sources.select("bus").distinct().withColumn("_s", F.lit(True)), "bus", "left")
    pick = c.where("_d is not null").groupBy("component").agg(F.min(F.when(F.col("_s"), F.col("bus"))).alias("s"), F.min(F.struct(
        (-F.coalesce("_d", F.lit(0))).alias("d"), (-F.coalesce("_kw", F.lit(0.0))).alias("k"), "bus")).alias("m"))
    root = pick.select(F.coalesce("s", "m.bus").alias("node"), F.col("component").alias("label"))
    walk = Graph(simple_edges(lines, "from_bus", "to_bus")).walk(root)
    ex = lines.select(F.least("from_bus", "to_bus").alias("_lo"), F.greatest("from_bus", "to_bus").alias("_hi"), finite(exposure).alias("_x")).groupBy("_lo", "_hi").agg(F.min("_x").alias("exposure"))
    j = walk.withColumn("_lo", F.least("node", "parent")).withColumn("_hi", F.greatest("node", "parent")).join(ex, ["_lo", "_hi"], "left")
    return j.select(F.col("label").alias("component"), "node", "parent", "hops", F.when(F.col("parent").isNotNull(), F.coalesce("exposure", F.lit(1.0))).otherwise(0.0).alias("exposure"))


def switch_benefit(tree: DataFrame, loads: DataFrame) -> DataFrame:
    """Subtree sums and single-switch benefit of every edge (node to its parent): L*E - Ld*Ed - Lu*Eu."""
    t = tree.join(loads.groupBy(F.col("bus").alias("node")).agg(F.sum(finite("kw")).alias("_kw")), "node", "left").withColumn("_one", F.lit(1.0))
    t = cut(t.withColumn("_kw", F.coalesce("_kw", F.lit(0.0))))
    sub = subtree_sums(t.select("node", "parent", "_one", "_kw", "exposure"), "node", "parent", ["_one", "_kw", "exposure"]).select(
        "node", F.col("_one").alias("downstream_nodes"), F.col("_kw").alias("downstream_load"), F.col("exposure").alias("downstream_exposure"))
    tot = t.groupBy("component").agg(F.sum("_one").alias("_n"), F.sum("_kw").alias("_l"), F.sum("exposure").alias("_e"))
    j = t.where("parent is not null").select("component", "node", "parent").join(sub, "node").join(tot, "component")
    ul, ue = F.col("_l") - F.col("downstream_load"), F.col("_e") - F.col("downstream_exposure")
    return j.select("component", "node", "parent", "downstream_nodes", (F.col("_n") - F.col("downstream_nodes")).alias("upstream_nodes"), "downstream_load", ul.alias("upstream_load"),
                    "downstream_exposure", (F.col("_l") * F.col("_e") - F.col("downstream_load") * F.col("downstream_exposure") - ul * ue).alias("benefit"))


def candidate_edges(benefit: DataFrame, min_nodes: int = 1, min_load: float = 0.0, top_n: int | None = None) -> DataFrame:
    """Edges with enough nodes and load on both sides; the best top_n per component when given."""
    ok = benefit.where((F.least("downstream_nodes", "upstream_nodes") >= min_nodes) & (F.least("downstream_load", "upstream_load") >= min_load))
    if top_n is None:
        return ok
    r = row_numbers(ok.withColumn("_nb", -F.col("benefit")), ["component"], "_nb", name="_r", then=("node",))
    return r.where(F.col("_r") <= top_n).drop("_nb", "_r")


def marginal_budget(frontiers: DataFrame, min_benefit: float, cap: int | None = None, min_per_feeder: int = 0) -> DataFrame:
    """Steps the largest-next-step-first merge of all frontiers takes: (component_id, k_switches, marginal_benefit, pick_order).

    A step cannot come before the ones under it, so its key is the running minimum of its frontier; sorting by key gives the
    merge. Forced steps come first and ignore the threshold; the running minimum restarts after them.
    """
    f = frontiers.where("k_switches > 0").withColumn("_ph", F.when(F.col("k_switches") <= min_per_feeder, 0).otherwise(1))
    w = Window.partitionBy("component_id", "_ph").orderBy("k_switches")  # one frontier: as many rows as switches tried
    f = f.withColumn("_key", F.min("marginal_benefit").over(w))
    names = row_numbers(f.select("component_id").distinct().withColumn("_z", F.lit(0.0)), None, "_z", name="_c", then=("component_id",)).select("component_id", "_c")
    f = f.join(names, "component_id").where((F.col("_ph") == 0) | (F.col("_key") >= min_benefit))
    f = cut(f.withColumn("_nk", -F.col("_key")).withColumn("_nc", -F.col("_c")))
    n0 = f.agg(F.count_if(F.col("_ph") == 0).alias("_n0"))
    r = row_numbers(f, ["_ph"], "_nk", "_nc", "_r", then=("k_switches",)).join(F.broadcast(n0))
    r = r.withColumn("pick_order", F.col("_r") + F.when(F.col("_ph") == 1, F.col("_n0")).otherwise(0))
    if cap is not None:
        r = r.where(F.col("pick_order") <= cap)
    return r.select("component_id", "k_switches", "marginal_benefit", "pick_order")


def two_tier(rows: DataFrame, n: int, key: str = "switch_id") -> DataFrame:
    """The n largest marginal benefits are automated and dispatchable, the rest manual."""
    r = row_numbers(rows.withColumn("_nb", -F.coalesce(finite("marginal_benefit"), F.lit(0.0))), None, "_nb", name="_r", then=(key,))
    auto = F.col("_r") <= n
    return r.withColumn("switch_role_class", F.when(auto, "automated_sectionalizing").otherwise("manual_sectionalizing")).withColumn("dispatchable", auto).drop("_nb", "_r")


def zone_totals(tree: DataFrame, switches: DataFrame, loads: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Load and exposure per zone after cutting the switch edges; a cut edge's exposure counts below it. Load is kW plus customers."""
    cutn = switches.select(F.col("node").alias("_n")).distinct()
    e = tree.where("parent is not null").join(cutn, F.col("node") == F.col("_n"), "left_anti").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    z = components(tree.select("node"), e, label="zone")
    kw = loads.groupBy(F.col("bus").alias("node")).agg(F.sum(finite("kw")).alias("_kw"))
    if customers is not None:
        cu = customers.groupBy(F.col("bus").alias("node")).agg(F.sum(finite("customers")).alias("_cu"))
        kw = kw.join(cu, "node", "full").select("node", (F.coalesce("_kw", F.lit(0.0)) + F.coalesce("_cu", F.lit(0.0))).alias("_kw"))
    j = z.join(tree.select("node", "exposure"), "node").join(kw, "node", "left")
    return j.groupBy("zone").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("_kw"), F.lit(0.0)).alias("load"), F.sum("exposure").alias("exposure"))


def feeder_metrics(tx: DataFrame, loads: DataFrame, lines: DataFrame, customers: DataFrame, switches: DataFrame) -> DataFrame:
    """Per feeder: transformer MVA, load kW, line miles by phases, customers, ratios and switches."""
    mile = finite("length_m") / 1609.344
    t = tx.groupBy("feeder_id").agg((F.sum(finite("max_kva")) / 1000).alias("transformer_mva"))
    l = loads.groupBy("feeder_id").agg(F.sum(finite("kw")).alias("load_kw"))
    n = lines.groupBy("feeder_id").agg(F.sum(mile).alias("line_miles"), F.coalesce(F.sum(F.when(F.col("phases") == 3, mile)), F.lit(0.0)).alias("three_phase_miles"))
    c = customers.groupBy("feeder_id").agg(F.sum(finite("customers")).alias("customers"))
    s = switches.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("switches"))
    out = n.join(t, "feeder_id", "left").join(l, "feeder_id", "left").join(c, "feeder_id", "left").join(s, "feeder_id", "left").na.fill(0)
    return out.withColumn("kw_per_customer", F.col("load_kw") / F.nullif(F.col("customers"), F.lit(0.0))).withColumn(
        "load_to_transformer_ratio", F.col("load_kw") / 1000 / F.nullif(F.col("transformer_mva"), F.lit(0.0)))


def grade(metrics: DataFrame, ranges: DataFrame) -> DataFrame:
    """Share of feeders in typical, uncommon and rare ranges per metric: good <= 5 % rare, marginal <= 10 %, else check.

    `metrics` is (metric_id, value); `ranges` is (metric_id, kind, lo, hi) and small.
    """
    r = ranges.groupBy("metric_id").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("_r"))
    j = metrics.join(F.broadcast(r), "metric_id")
    hit = lambda kind: F.exists("_r", lambda x: (x["kind"] == kind) & (F.col("value") >= x["lo"]) & (F.col("value") <= x["hi"]))
    typ, unc = hit("typical").cast("double"), hit("uncommon").cast("double")
    g = j.groupBy("metric_id").agg(F.count(F.lit(1)).alias("feeder_count"), F.avg(typ).alias("typical_fraction"), F.avg(unc).alias("uncommon_fraction"),
                                   F.greatest(1 - F.avg(typ) - F.avg(unc), F.lit(0.0)).alias("rare_fraction"))
    rare = F.round("rare_fraction", 9)
    return g.withColumn("grade", F.when(rare <= 0.05, "good").when(rare <= 0.10, "marginal").otherwise("check"))


def nearest_standard(df: DataFrame, value: str, sizes: list[float], out: str = "standard_kva") -> DataFrame:
    """Closest standard size, the smaller on ties."""
    opts = F.array(*[F.struct(F.abs(F.col(value) - float(s)).alias("d"), F.lit(float(s)).alias("s")) for s in sorted(sizes)])
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.array_min(opts)["s"]))


def graph_metrics(lines: DataFrame, feeder: str = "feeder_id", length: str = "length") -> DataFrame:
    """Per feeder: buses, average degree, mean shortest path and weighted diameter of its largest component, loops included.

    A bridge with m of n buses behind it lies on m (n - m) shortest paths, so distances between all pairs are taken inside loop
    blocks only, weighted by the buses that hang on each. The diameter is a double sweep: the farthest bus from the smallest
    one (smallest id on ties), then the greatest distance from there. Missing and negative lengths count 0; lines without both
    ends count for the degree alone. Of equally large components the one with the smallest bus is taken.
    """
    name = lambda c: F.when(F.col(c).cast("string") != "", F.concat_ws("\0", F.col(feeder).cast("string"), F.col(c).cast("string"))).alias(c)
    named = lines.select(F.col(feeder).alias("_f"), name("from_bus"), name("to_bus"), F.greatest(F.coalesce(finite(length), F.lit(0.0)), F.lit(0.0)).alias("w"))
    whole = named.where("from_bus is not null and to_bus is not null")
    nodes = cut(whole.select("_f", F.explode(F.array("from_bus", "to_bus")).alias("node")).distinct())
    count = named.groupBy("_f").agg(F.count(F.lit(1)).alias("_lines")).join(nodes.groupBy("_f").agg(F.count(F.lit(1)).alias("bus_count")), "_f", "left")
    graph = Graph(simple_edges(whole, "from_bus", "to_bus", "w"))
    largest = graph.sizes.join(nodes.withColumnRenamed("node", "component"), "component").groupBy("_f").agg(F.min(F.struct((-F.col("nodes")).alias("k"), "component")).alias("m"))
    roots = cut(largest.select("_f", F.col("m.component").alias("label"), (-F.col("m.k")).alias("n")))
    seen = graph.seen_from(roots.select(F.col("label").alias("node"), "label"))
    within = graph.block_distances() if graph.loops else None
    far = graph.distances(seen, within).groupBy("label").agg(F.min(F.struct((-F.col("distance")).alias("d"), "node")).alias("m")).select("label", F.col("m.node").alias("node"))
    reach = graph.distances(graph.seen_from(far), within).groupBy("label").agg(F.max("distance").alias("diameter"))

    down = seen.where("parent is not null").select("label", "node", "parent", "size", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v")).join(graph.edges, ["u", "v"])
    if within is not None:
        down = down.join(graph.on_loops.select("u", "v"), ["u", "v"], "left_anti")
    down = cut(down.join(roots.select("label", "n"), "label"))
    total = down.select("label", (F.col("w") * F.col("size") * (F.col("n") - F.col("size"))).alias("s"))
    if within is not None:
        total = total.unionByName(_block_paths(graph, seen, down, within, roots))
    total = total.groupBy("label").agg(F.sum("s").alias("_sum"))
    j = count.join(roots, "_f", "left").join(total, "label", "left").join(reach, "label", "left")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    zero = F.lit(0.0)
    return j.select(F.col("_f").alias(feeder), F.coalesce("bus_count", F.lit(0)).cast("long").alias("bus_count"), F.coalesce(2 * F.col("_lines") / F.col("bus_count"), zero).alias("average_degree"),
                    F.coalesce(F.col("_sum") / pairs, zero).alias("mean_path_length"), F.coalesce("diameter", zero).alias("diameter"))


def _block_paths(graph: Graph, seen: DataFrame, down: DataFrame, within: DataFrame, roots: DataFrame) -> DataFrame:
    """(label, s): summed lengths of the parts of all shortest paths that lie inside each loop block."""
    hung = down.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("_below"))
    inner = graph.block.join(seen.select("node", "label"), "node").join(hung, "node", "left").join(graph.entries(seen), "block").withColumn("hang", 1 + F.coalesce("_below", F.lit(0)))
    # The rest of the component hangs on the node by which the block is entered.
    rest = inner.where("node <> entry").groupBy("block", "label").agg(F.sum("hang").alias("_in")).join(roots.select("label", "n"), "label").select("block", (F.col("n") - F.col("_in")).alias("_rest"))
    weight = cut(inner.join(rest, "block").select("node", "label", F.when(F.col("node") == F.col("entry"), F.col("_rest")).otherwise(F.col("hang")).alias("hang")))
    pair = within.where("source < node").join(weight, "node").join(weight.select(F.col("node").alias("source"), F.col("hang").alias("_h")), "source")
    return pair.select("label", (F.col("distance") * F.col("hang") * F.col("_h")).alias("s"))


def switch_rows(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Chosen tree edges with their physical line: midpoint, phases, element name, benefit."""
    key = lambda a, b: F.array_sort(F.array(F.col(a), F.col(b)))
    ln = lines.withColumn("_key", key("from_bus", "to_bus")).groupBy("_key").agg(F.min(F.struct("line_name", "phases", "from_lon", "from_lat", "to_lon", "to_lat")).alias("l"))
    j = edges.withColumn("_key", key("parent", "node")).join(ln, "_key", "left")
    return j.select("component", F.concat_ws("_", F.lit("sw"), "l.line_name").alias("switch_id"), F.col("parent").alias("from_bus"), F.col("node").alias("to_bus"),
                    F.col("l.line_name").alias("associated_line_name"), F.concat(F.lit("Line."), F.col("l.line_name")).alias("element_name"), F.col("l.phases").alias("phases"),
                    ((F.col("l.from_lon") + F.col("l.to_lon")) / 2).alias("lon"), ((F.col("l.from_lat") + F.col("l.to_lat")) / 2).alias("lat"), F.col("benefit").alias("marginal_benefit"),
                    F.col("l.line_name").isNotNull().alias("opens_existing_line"))
