"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is weight x total characters / its own characters, so the mixed table holds each source in
proportion to its weight. Every document inverts the Poisson distribution with that mean at a uniform number hashed from
its id and the seed (large means: the sum of independent parts, see counts), is exploded by its count, and all copies are
dealt to partitions and ordered by a second hash.

Weights are a mapping given by the caller; sources outside it, and null sources, form one group with the weight of
OTHER. So the table of rates has one row per given weight and one more, whatever the data, and is broadcast. A hot source
needs no splitting: its documents are only read where they lie. Null ids hash as empty strings; repeated rows draw alike.
A null or empty text counts no characters but is replicated as its source is; a source without characters keeps rate 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import md5_long, set_apart

OTHER = "*"
SCALE = float(16**15)
#: Means up to WHOLE are inverted at one number; larger ones are sums of equal parts with means of at most PART.
WHOLE, PART = 700.0, 500.0


def uniform(*parts: Column) -> Column:
    """Uniform on (0, 1) from the parts' hash."""
    return (md5_long(*parts).cast("double") + 0.5) / SCALE


def group_of(source: Column, weights: dict[str, float]) -> Column:
    named = [w for w in weights if w != OTHER]
    return F.when(source.isin(named), source).otherwise(OTHER) if named else F.lit(OTHER)


def rates(docs: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """(mix_group, rate): mean copies per document of each group, one row per given weight at most and one for the rest."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights are non-negative and not all zero")
    whole = sum(weights.values())
    share = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w / whole)])
    sizes = docs.groupBy(group_of(F.col("source"), weights).alias("mix_group")).agg(
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("chars"))
    wanted = F.lit(float(total)) if total is not None else F.coalesce(F.sum("chars").over(all_groups()), F.lit(0.0))
    weight = F.coalesce(F.try_element_at(share, F.col("mix_group")), F.lit(0.0))
    return sizes.withColumn("want", wanted).select("mix_group", F.when(
        F.col("chars") > 0, weight * F.col("want") / F.col("chars")).otherwise(1.0).alias("rate"))


def all_groups():
    """One window over the table of groups, whose rows are bounded by the given weights."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def copies(u: Column, rate: Column) -> Column:
    """The smallest k whose Poisson cumulative probability reaches u, by adding terms of the distribution.

    The terms end at the first k beyond which the tail is smaller than the spacing of u; a mean of up to WHOLE keeps
    exp(-rate) above the smallest double, larger ones go through counts.
    """
    last = F.ceil(rate + 12.0 * F.sqrt(rate) + 40.0).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        return F.when(acc["sum"] >= u, acc).otherwise(F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), k.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])


def counts(seed: int, doc_id: Column, rate: Column) -> Column:
    """Poisson copies of a document at any mean: a sum of independent Poisson counts is one of the summed mean, so a mean
    beyond WHOLE is drawn in parts, each at a uniform number hashed from the part's number too."""
    key, parts = F.lit(f"mix{seed}"), F.ceil(rate / PART).cast("int")
    summed = F.aggregate(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), F.lit(0),
                         lambda n, k: n + copies(uniform(key, doc_id, k), rate / parts))
    return F.when(rate <= WHOLE, copies(uniform(key, doc_id), rate)).otherwise(summed)


#: Columns that the operator adds.
ADDED = ("rate", "copy", "place")


def mixed(docs: DataFrame, weights: dict[str, float], seed: int = 0, total: float | None = None, added: bool = True) -> DataFrame:
    """Rows of `docs` by their counts, in shuffled order, with rate, copy (from 1) and place, the hash that orders them.

    An input column named as one of these gives way to it; with `added` false the result has just the columns of `docs`.
    """
    table = F.broadcast(rates(docs, weights, total))  # bounded: see rates
    held, own = set_apart(docs, key=F.col("doc_id"), mix_group=group_of(F.col("source"), weights))
    drawn = held.join(table, "mix_group").withColumn("n", counts(seed, F.col("key"), F.col("rate")))
    many = drawn.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "mix_group")
    placed = many.withColumn("place", md5_long(F.lit(f"order{seed}"), F.col("key"), F.col("copy")))
    dealt = placed.repartition("place").sortWithinPartitions("place", "key", "copy")
    if not added:
        return dealt.select(*own)
    return dealt.select(*[c for c, name in zip(own, docs.columns) if name.lower() not in ADDED], *ADDED)


def expected_shares(weights: dict[str, float]) -> dict[str, float]:
    whole = math.fsum(weights.values())
    return {k: w / whole for k, w in weights.items()}
