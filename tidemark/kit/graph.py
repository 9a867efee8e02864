"""Iterative graph operators: components, breadth-first labels, subtree sums, downstream marking.

Every round is a few joins and aggregates with map-side combine, and ends on a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, settle


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst",
               label: str = "component", hold: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, label) with the smallest node id of each connected component.

    Every node points at its smallest neighbour; where two point at each other, the smaller is a root. It is the smallest of its
    tree, for a node's second pointer never leads to a larger one. Pointers double until all are at roots, then each tree becomes
    one node: groups at least halve each round, and an edge inside a tree is never looked at again. `hold` ends each round.
    """
    e = hold(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v"))
    rounds = []
    while not e.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("p")), F.struct(F.col("v").alias("n"), F.col("u").alias("p")))).alias("s")
        f = hold(e.select(ends).groupBy(F.col("s.n").alias("n")).agg(F.min("s.p").alias("p")))
        step = f.join(f.select(F.col("n").alias("p"), F.col("p").alias("g")), "p")
        # Of two that point at each other the smaller stays.
        f = hold(step.select("n", F.when((F.col("g") == F.col("n")) & (F.col("n") < F.col("p")), F.col("n")).otherwise(F.col("p")).alias("p")))
        while True:
            step = f.join(f.select(F.col("n").alias("p"), F.col("p").alias("g")), "p").select("n", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
            step = hold(step)
            f = step.select("n", "p")
            if step.where("moved").isEmpty():
                break
        rounds.append(f)
        to = lambda c: f.select(F.col("n").alias(c), F.col("p").alias(f"_{c}"))
        e = hold(e.join(to("u"), "u").join(to("v"), "v").where("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
    out = None
    for f in reversed(rounds):
        # Roots of a round are the nodes of the next.
        if out is not None:
            f = hold(f.join(out.select(F.col("n").alias("p"), F.col("p").alias("g")), "p", "left").select("n", F.coalesce("g", "p").alias("p")))
        out = f
    named = nodes.select(F.col(node).alias("n")).where("n is not null").distinct()
    if out is None:
        return hold(named.select(F.col("n").alias(node), F.col("n").alias(label)))
    # Ends of edges need not be among the nodes.
    return hold(named.join(out, "n", "full").select(F.col("n").alias(node), F.coalesce("p", "n").alias(label)))


def bfs(seeds: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst",
        carry: str = "label", blocked: Column | None = None) -> DataFrame:
    """Hop-synchronous spread of a seed label over undirected edges: (node, label, hops, parent).

    A node takes the smallest (label, parent) among its first arrivals. `blocked` is a predicate on an
    edge row (src, dst directed) that may not be walked.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), *[c for c in edges.columns if c not in (src, dst)])
    extra = [c for c in e.columns if c not in ("u", "v")]
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), *extra))
    if blocked is not None:
        both = both.where(~blocked)
    both = cut(both.select("u", "v").where("u <> v").distinct())
    kind = both.schema["u"].dataType
    seen = cut(seeds.groupBy(F.col(node).alias("n")).agg(F.min(carry).alias("l")).select(
        "n", "l", F.lit(0).alias("h"), F.lit(None).cast(kind).alias("p")))
    front, hop = seen, 0
    while True:
        hop += 1
        reach = front.join(both, F.col("n") == F.col("u")).groupBy("v").agg(
            F.min(F.struct("l", F.col("u").alias("p"))).alias("m"))
        new = cut(reach.join(seen.select(F.col("n").alias("v")), "v", "left_anti").select(
            F.col("v").alias("n"), F.col("m.l").alias("l"), F.lit(hop).alias("h"), F.col("m.p").alias("p")))
        if new.isEmpty():
            return seen.select(F.col("n").alias(node), F.col("l").alias(carry), F.col("h").alias("hops"),
                               F.col("p").alias("parent"))
        seen, front = seen.unionByName(new), new
        if hop % 8 == 0:
            seen = cut(seen)


def doublings(nodes: DataFrame) -> int:
    """Rounds of pointer doubling after which every pointer of a forest has left it."""
    return max(1, nodes.count()).bit_length() + 1


def subtree_sums(tree: DataFrame, node: str, parent: str, values: list[str], largest: tuple[str, ...] = ()) -> DataFrame:
    """Sum (or maximum, for `largest`) of each value over a node and all its descendants, by pointer doubling.

    After round k a node holds the sum over descendants fewer than 2^k steps below it; the node
    exactly 2^k above takes it in. Rows stay at one per node, rounds grow with log(depth).
    """
    cur = settle(tree.select(F.col(node).alias("n"), F.col(parent).alias("a"),
                          *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]))
    for _ in range(doublings(cur)):
        if cur.where("a is not null").isEmpty():
            break
        gain = cur.where("a is not null").groupBy(F.col("a").alias("n")).agg(
            *[(F.max(v) if v in largest else F.sum(v)).alias(f"_{v}") for v in values])
        jump = cur.select(F.col("n").alias("a"), F.col("a").alias("_aa"))
        grown = cur.join(gain, "n", "left").join(jump, "a", "left")
        cur = settle(grown.select("n", F.col("_aa").alias("a"),
                               *[(F.greatest(v, f"_{v}") if v in largest else F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0.0))).alias(v)
                                 for v in values]))
    # Pointers that are left stand on a cycle or lead into one; such nodes have no finite subtree.
    return cur.select(F.col("n").alias(node), *[F.when(F.col("a").isNull(), F.col(v)).alias(v) for v in values])


def root_sums(tree: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """Sum of a value over the path from each node up to its root (node included), by pointer doubling."""
    cur = settle(tree.select(F.col(node).alias("n"), F.col(parent).alias("a"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))
    for _ in range(doublings(cur)):
        if cur.where("a is not null").isEmpty():
            break
        up = cur.select(F.col("n").alias("a"), F.col("v").alias("_v"), F.col("a").alias("_a"))
        cur = settle(cur.join(up, "a", "left").select("n", F.col("_a").alias("a"), (F.col("v") + F.coalesce("_v", F.lit(0.0))).alias("v")))
    return cur.select(F.col("n").alias(node), F.when(F.col("a").isNull(), F.col("v")).alias(value))


def drains_to(reaches: DataFrame, outlets: DataFrame, node: str, down: str, outlet: str) -> DataFrame:
    """Every (node, outlet) where the downstream path of node meets the outlet, node included.

    A first pass gives each reach the outlet it meets first: outlets end a path, other reaches double their
    downstream pointer each round. Outlets below outlets follow by joining pairs of outlets only. A reach with several
    downstream links follows all of them; paths that run into a cycle without an outlet end there.
    """
    o = outlets.select(F.col(outlet).alias("n"), F.col(outlet).alias("o")).distinct()
    links = cut(reaches.select(F.col(node).alias("n"), F.col(down).alias("d")).distinct())
    cur = cut(links.join(o, "n", "left").select("n", "o", F.when(F.col("o").isNull(), F.col("d")).alias("d")).distinct())
    for _ in range(doublings(cur)):
        if cur.where("o is null and d is not null").isEmpty():
            break
        nxt = cur.select(F.col("n").alias("d"), F.col("o").alias("_o"), F.col("d").alias("_d"))
        step = cur.join(nxt, "d", "left").select("n", F.coalesce("o", "_o").alias("o"), F.when(
            F.col("o").isNull() & F.col("_o").isNull() & (F.col("_d") != F.col("n")), F.col("_d")).alias("d"))
        cur = cut(step.distinct())
    first = cur.where("o is not null").select("n", "o").distinct()
    # The outlet below an outlet is the first one its own downstream reach meets.
    below = links.join(o.select("n"), "n").select(F.col("n").alias("a"), F.col("d").alias("n")).join(first, "n").select("a", F.col("o").alias("b"))
    pairs = cut(below.where("a <> b").distinct())
    while True:
        more = cut(pairs.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).unionByName(pairs)
                   .where("a <> b").distinct())
        if more.count() == pairs.count():
            break
        pairs = more
    deeper = first.join(pairs.withColumnRenamed("a", "o"), "o").select("n", F.col("b").alias("o"))
    return first.unionByName(deeper).distinct().select(F.col("n").alias(node), F.col("o").alias(outlet))
