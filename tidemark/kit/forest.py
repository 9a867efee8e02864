"""Rooted forests, bridges and shortest paths without a round per hop.

A forest is rooted by its Euler tour: every edge gives two arcs, an arc is followed by the next arc out of the node it enters,
and pointer doubling ranks the arcs of the tour. The rank alone tells which end of an edge is the parent, the depth and
the size of each subtree, so a path of n nodes takes log2(2n) rounds. Graphs with loops are cut at their bridges:
between loops there is one way only, and only within a loop block are distances walked or relaxed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import running
from .common import settle
from .graph import bfs, components, root_sums, subtree_sums


def simple_edges(edges: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Undirected (u, v, w) with u < v, the least weight of parallel edges, no edge from a node to itself."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"), w.alias("w"), F.col(src).alias("_a"), F.col(dst).alias("_b")).where(
        "_a is not null and _b is not null and u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v) of a spanning forest of the distinct edges (u, v): every group of nodes picks its least edge to another group.

    Groups at least halve each round.
    """
    live = settle(edges.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")))
    picked = None
    while not live.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("a").alias("l"), F.col("b").alias("o")), F.struct(F.col("b").alias("l"), F.col("a").alias("o")))).alias("s")
        best = settle(live.select(ends, "u", "v").groupBy(F.col("s.l").alias("l")).agg(F.min(F.struct("u", "v", F.col("s.o").alias("o"))).alias("m")).select(
            "l", "m.u", "m.v", "m.o"))
        chosen = best.select("u", "v").distinct()
        picked = chosen if picked is None else picked.unionByName(chosen)
        group = components(best.select(F.col("l").alias("node")), best, src="l", dst="o", label="g", hold=settle)
        live = live.join(group.select(F.col("node").alias("a"), F.col("g").alias("_ga")), "a").join(group.select(F.col("node").alias("b"), F.col("g").alias("_gb")), "b")
        live = settle(live.where("_ga <> _gb").select("u", "v", F.col("_ga").alias("a"), F.col("_gb").alias("b")))
    return edges.select("u", "v").limit(0) if picked is None else picked


def list_ranks(arcs: DataFrame) -> DataFrame:
    """(id, left): arcs from each arc of a list to its end, itself included; `next` is null at the end. Doubles its reach each round."""
    cur = settle(arcs.select("id", F.col("next").alias("nx"), F.lit(1).cast("long").alias("left")))
    while not cur.where("nx is not null").isEmpty():
        # Arcs that have arrived meet themselves, so that no task gathers them.
        ahead = cur.select(F.col("id").alias("at"), F.col("nx").alias("_nx"), F.col("left").alias("_left"))
        cur = settle(cur.withColumn("at", F.coalesce("nx", "id")).join(ahead, "at").select(
            "id", F.col("_nx").alias("nx"), (F.col("left") + F.when(F.col("nx").isNull(), 0).otherwise(F.col("_left"))).alias("left")))
    return cur.select("id", "left")


def orient(tree: DataFrame, roots: DataFrame, component: DataFrame) -> DataFrame:
    """A forest of edges (u, v) with its (node, component) seen from `roots` (node, label), one in each tree that counts.

    Returns (label, node, parent, depth, size, first, last): size counts the subtree, first and last are the places of its
    arcs in the tour (null for the root). Trees without a root give no rows.
    """
    roots = settle(roots.select("node", "label"))
    both = tree.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(tree.select(F.col("v").alias("a"), F.col("u").alias("b")))
    arcs = settle(both.withColumn("id", F.monotonically_increasing_id()))
    # Arcs out of a node in the order of their hashed ends; the block computation splits a node of very many arcs.
    fan = settle(running(arcs.withColumn("_o", F.xxhash64("b").cast("double")), ["a"], "_o", {"after": ("lead", "id")}, then=("b",)))
    head = fan.groupBy(F.col("a").alias("b")).agg(F.min(F.struct("_o", F.col("b").alias("e"), "id")).alias("m")).select("b", F.col("m.id").alias("head"))
    back = fan.select(F.col("a").alias("b"), F.col("b").alias("a"), "after")
    ends = roots.select(F.col("node").alias("b"), F.lit(True).alias("_root"))
    linked = arcs.join(back, ["a", "b"]).join(head, "b").join(ends, "b", "left").select("a", "b", "id", F.when(
        F.col("after").isNotNull(), F.col("after")).when(F.col("_root").isNull(), F.col("head")).alias("next"))
    # A tree without a root is a ring that never ends: only tours that are closed at a root are ranked.
    named = component.join(roots, "node").select("component", "label")
    mine = settle(linked.join(component.join(named, "component").select(F.col("node").alias("a"), "label"), "a"))
    ranked = mine.join(list_ranks(mine), "id").select("label", "a", "b", (-F.col("left")).alias("place"))
    turned = ranked.join(ranked.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("place").alias("_back")), ["a", "b"])
    walk = running(turned.withColumn("_p", F.col("place").cast("double")), ["label"], "_p", {"depth": ("sum", F.when(F.col("place") < F.col("_back"), 1).otherwise(-1).cast("long"))})
    below = walk.where(F.col("place") < F.col("_back")).select(
        "label", F.col("b").alias("node"), F.col("a").alias("parent"), F.col("depth").cast("int").alias("depth"),
        ((F.col("_back") - F.col("place") + 1) / 2).cast("long").alias("size"), F.col("place").alias("first"), F.col("_back").alias("last"))
    count = below.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    kind = below.schema["node"].dataType
    top = roots.join(count, "label", "left").select("label", "node", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("size"),
                                                    F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return settle(below.unionByName(top))


def loop_edges(edges: DataFrame, tree: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges (u, v, w) that lie on a loop, that is all but the bridges, for trees as `orient` saw them.

    An edge of the tree is a bridge if no edge outside the tree leaves the subtree below it.
    """
    other = settle(edges.join(tree, ["u", "v"], "left_anti"))
    far = 4.0 * (edges.count() + 1)  # beyond all places, so that shifted places are positive
    at = seen.select("node", F.coalesce("first", F.lit(-far / 2)).cast("double").alias("at"))
    ends = other.select(F.col("u").alias("node"), F.col("v").alias("o")).unionByName(other.select(F.col("v").alias("node"), F.col("u").alias("o")))
    reach = ends.join(at.withColumnRenamed("node", "o"), "o").groupBy("node").agg(F.max("at").alias("_hi"), F.min("at").alias("_lo"))
    own = seen.join(at, "node").join(reach, "node", "left").select("node", "parent", (F.lit(far) + F.greatest("at", "_hi")).alias("hi"), (F.lit(far) - F.least("at", "_lo")).alias("lo"))
    span = subtree_sums(own, "node", "parent", ["hi", "lo"], ("hi", "lo")).join(seen.select("node", "parent", "first", "last"), "node")
    looped = span.where("parent is not null").where((F.col("hi") - far > F.col("last")) | (F.lit(far) - F.col("lo") < F.col("first")))
    keys = looped.select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    return settle(edges.join(keys, ["u", "v"], "left_semi").unionByName(other))


class Graph:
    """Edges (u, v, w), their components, a spanning forest and the blocks of nodes that share loops."""

    def __init__(self, edges: DataFrame):
        self.edges = settle(edges.select("u", "v", "w"))
        ends = self.edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        self.component = settle(components(ends, self.edges, src="u", dst="v", hold=settle))
        size = self.component.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
        held = self.edges.join(self.component.withColumnRenamed("node", "u"), "u")
        count = held.groupBy("component").agg(F.count(F.lit(1)).alias("links"))
        #: (component, nodes, links, looped)
        self.sizes = settle(size.join(count, "component").withColumn("looped", F.col("links") >= F.col("nodes")))
        self.loops = not self.sizes.where("looped").isEmpty()
        if not self.loops:
            self.tree = self.edges.select("u", "v")
        else:
            kinds = held.join(self.sizes.select("component", "looped"), "component")
            self.tree = settle(kinds.where("not looped").select("u", "v").unionByName(spanning_forest(kinds.where("looped").select("u", "v"))))
        self.on_loops = self.block = None

    def seen_from(self, roots: DataFrame) -> DataFrame:
        """The spanning forest from `roots` (node, label); blocks are found on the way, from the first roots given."""
        seen = orient(self.tree, roots, self.component)
        if self.loops and self.on_loops is None:
            self.on_loops = loop_edges(self.edges.join(seen.select(F.col("node").alias("u")), "u", "left_semi"), self.tree, seen)
            ends = self.on_loops.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            self.block = settle(components(ends, self.on_loops, src="u", dst="v", label="block", hold=settle))
        return seen

    def entries(self, seen: DataFrame) -> DataFrame:
        """(block, entry): the one node by which each block is entered from the root."""
        return self.block.join(seen.select("node", "depth"), "node").groupBy("block").agg(F.min(F.struct("depth", "node")).alias("m")).select("block", F.col("m.node").alias("entry"))

    def walk(self, roots: DataFrame) -> DataFrame:
        """Breadth-first trees of one root a component: (node, label, hops, parent), as `bfs` gives them.

        Rounds grow with the logarithm of the nodes and with the hops across the largest block, not with the depth.
        """
        seen = self.seen_from(roots)
        if not self.loops:
            return seen.select("node", "label", F.col("depth").alias("hops"), "parent")
        entry = settle(self.entries(seen))
        inside = bfs(entry.select(F.col("entry").alias("node"), F.col("entry").alias("label")), self.on_loops, src="u", dst="v").where("hops > 0").select(
            "node", F.struct(F.col("parent").alias("p")).alias("_in"))
        tree = settle(seen.join(inside, "node", "left").select("node", "label", F.when(F.col("_in").isNotNull(), F.col("_in.p")).otherwise(F.col("parent")).alias("parent"), F.lit(1.0).alias("one")))
        hops = root_sums(tree, "node", "parent", "one")
        return tree.join(hops.select("node", (F.col("one") - 1).cast("int").alias("hops")), "node").select("node", "label", "hops", "parent")

    def block_distances(self) -> DataFrame:
        """(block, source, node, distance) of all nodes of one block: the loops of a network, not the network."""
        every = self.block.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"))
        near = shortest_paths(every, self.on_loops)
        return settle(near.join(self.block, "node").select("block", "source", "node", "distance"))

    def distances(self, seen: DataFrame, within: DataFrame | None) -> DataFrame:
        """(label, node, distance) from the root of every tree along shortest paths."""
        w = self.edges.select(F.col("u").alias("node"), F.col("v").alias("parent"), "w").unionByName(self.edges.select(F.col("v").alias("node"), F.col("u").alias("parent"), "w"))
        up = seen.join(w, ["node", "parent"], "left").select("label", "node", F.col("parent").alias("to"), F.col("w").alias("cost"))
        if within is not None:
            legs = within.join(self.entries(seen), "block").where("source = entry and node <> entry").select("node", F.struct(F.col("entry").alias("to"), F.col("distance").alias("cost")).alias("_leg"))
            up = up.join(legs, "node", "left").select("label", "node", F.coalesce("_leg.to", "to").alias("to"), F.coalesce("_leg.cost", "cost").alias("cost"))
        up = settle(up.withColumn("cost", F.coalesce("cost", F.lit(0.0))))
        return up.select("label", "node").join(root_sums(up, "node", "to", "cost").withColumnRenamed("cost", "distance"), "node")


def shortest_paths(seeds: DataFrame, edges: DataFrame, delta: float | None = None) -> DataFrame:
    """(source, node, distance): least sums of the weights of undirected edges (u, v, w) from the seeds (source, node, distance).

    Delta stepping: nodes reached are settled in buckets of width `delta` (four mean weights if not given), nearest bucket first;
    within a bucket only rows that became nearer are relaxed. Weights must not be negative.
    """
    both = settle(edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    if delta is None:
        delta = 4 * (both.agg(F.avg("w")).first()[0] or 0.0)
    width = float(delta) if delta > 0 else 1.0
    best = settle(seeds.groupBy("source", "node").agg(F.min("distance").alias("distance")).withColumn("open", F.lit(True)))
    while (low := best.where("open").agg(F.min("distance")).first()[0]) is not None:
        edge = low + width
        now = F.col("open") & (F.col("distance") < edge)
        step = best.where(now).join(both, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("_d"))
        met = best.join(step, ["source", "node"], "full")
        nearer = F.col("_d").isNotNull() & (F.col("distance").isNull() | (F.col("_d") < F.col("distance")))
        best = settle(met.select("source", "node", F.when(nearer, F.col("_d")).otherwise(F.col("distance")).alias("distance"), F.when(nearer, True).otherwise(
            F.col("open") & (F.col("distance") >= edge)).alias("open")))
    return best.select("source", "node", "distance")


def nearest_seed(seeds: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", carry: str = "label") -> DataFrame:
    """(node, label, hops): the seed label fewest hops away, of equally near ones the smallest; seeds keep their own.

    A node's nearest seed lies below one of its ancestors. In components without loops the least of (depth of seed - 2 depth of
    ancestor, label) over subtrees and then over ancestors gives it by pointer doubling; components with loops are
    walked hop by hop.
    """
    s = settle(seeds.groupBy(F.col(node).alias("node")).agg(F.min(carry).alias("label")))
    graph = Graph(simple_edges(edges, src, dst))
    lit = graph.component.join(s, "node", "left").groupBy("component").agg(F.max(F.col("label").isNotNull()).alias("_lit")).where("_lit")
    kinds = settle(graph.sizes.join(lit, "component").select("component", "looped"))
    plain = kinds.where("not looped").select(F.col("component").alias("node"), F.col("component").alias("label"))
    lone = s.join(graph.component, "node", "left_anti").select("node", "label", F.lit(0).alias("hops"))
    tree = orient(graph.tree, plain, graph.component).select("node", "parent", "depth")
    low = subtree_least(tree.join(s, "node", "left").select("node", "parent", "depth", F.when(F.col("label").isNotNull(), F.struct(F.col("depth").alias("d"), F.col("label").alias("l"))).alias("v")), down=True)
    here = low.join(tree.select("node", "parent", "depth"), "node").select("node", "parent", F.when(
        F.col("v").isNotNull(), F.struct((F.col("v.d") - 2 * F.col("depth")).alias("d"), F.col("v.l").alias("l"))).alias("v"))
    near = subtree_least(here, down=False).join(tree.select("node", "depth"), "node").where("v is not null").select(
        "node", F.col("v.l").alias("label"), (F.col("v.d") + F.col("depth")).cast("int").alias("hops"))
    out = near.unionByName(lone)
    if not kinds.where("looped").isEmpty():
        held = graph.component.join(kinds.where("looped"), "component", "left_semi").select("node")
        inside = graph.edges.join(held.withColumnRenamed("node", "u"), "u", "left_semi")
        out = out.unionByName(bfs(s.join(held, "node", "left_semi"), inside, src="u", dst="v").select("node", "label", "hops"))
    return out


def subtree_least(tree: DataFrame, down: bool) -> DataFrame:
    """(node, v): least v over each node's subtree (`down`) or over the node and its ancestors, by pointer doubling."""
    cur = settle(tree.select("node", F.col("parent").alias("a"), "v"))
    while not cur.where("a is not null").isEmpty():
        # Nodes that have arrived at the root meet themselves, so that no task gathers them.
        up = cur.select(F.col("node").alias("at"), F.col("a").alias("_a"), F.col("v").alias("_v"))
        jumped = cur.withColumn("at", F.coalesce("a", "node")).join(up, "at")
        if down:
            gain = cur.where("a is not null and v is not null").groupBy(F.col("a").alias("node")).agg(F.min("v").alias("_g"))
            cur = settle(jumped.select("node", F.col("_a").alias("a"), "v").join(gain, "node", "left").select("node", "a", F.least("v", "_g").alias("v")))
        else:
            cur = settle(jumped.select("node", F.col("_a").alias("a"), F.least("v", "_v").alias("v")))
    return cur.select("node", "v")
