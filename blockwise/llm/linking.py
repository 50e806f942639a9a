"""Connected groups from shared signatures, without ever making all pairs of a group.

Nodes that share a signature are candidates. In rounds, every signature's nodes are checked against
one of them, the lead: at first the one that shares the most signatures, as the centre of a group
does, in further rounds the like one outside the largest component that the signature holds. What
these links connect is one component. At last, in the signatures that still hold several components, the pairs
of different components that a cheap bound can't rule out are checked too. A pair left unchecked is
thus in one component already, so the components are those of all links between candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stored

Check = Callable[[DataFrame], DataFrame]


def shared(signatures: DataFrame) -> DataFrame:
    """Rows (signature, node) of the signatures that at least two nodes have.

    One shuffle by signature, of sixteen bytes a row; a frame over a signature spills, it isn't gathered.
    """
    by = W.partitionBy("signature")
    led = signatures.withColumn("first", F.min("node").over(by)).withColumn("last", F.max("node").over(by))
    return stored(led.where("first < last").select("signature", "node").distinct(), "shared-signatures")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the least node reachable. Alternates large and small stars.

    Every round writes its links to the shared folder; a hub is met by partial aggregation and by
    joins that can be split, so its neighbours are never gathered.
    """
    links = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").union(down.select(F.col("u").alias("x"), "m"))
        before, links = links, stored(small.where("x != m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "links")
        discard(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        state = now


def merged(own: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of `own` after further links (a, b): only the components that these join are dealt with."""
    a, b = (own.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(ends).select(F.col("node").alias("was"), F.col("component").alias("now"))
    moved = own.join(joined, own["component"] == joined["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
    new = joined.join(own, joined["was"] == own["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return moved.unionByName(new)


def split(held: DataFrame) -> DataFrame:
    """The rows of signatures that hold several components."""
    ends = held.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("signature")
    return held.join(ends, "signature", "left_semi")


def _leads(held: DataFrame, first: bool) -> DataFrame:
    """Pairs (a, b) of every signature's lead and its nodes of other components. held: signature, node, component, degree."""
    rank = F.struct("degree", -F.col("node"))
    if first:
        leads = held.groupBy("signature").agg(F.max_by(F.struct("node", "component"), rank).alias("lead"))
    else:
        sizes = held.groupBy("signature", "component").agg(F.count("*").alias("n"), F.max_by("node", rank).alias("node"), F.max("degree").alias("degree"))
        main = sizes.groupBy("signature").agg(F.max(F.struct("n", "component")).alias("main"))
        outside = sizes.join(main, "signature").where(F.col("component") != F.col("main.component"))
        leads = outside.groupBy("signature").agg(F.max_by(F.struct("node", "component"), rank).alias("lead"))
    pairs = held.join(leads, "signature").where(F.col("component") != F.col("lead.component"))
    return pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def connect(buckets: DataFrame, facts: DataFrame, possible: Callable[[str, str], Column], check: Check, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Components and checked links of the nodes in `buckets`, which shared() made.

    facts: one row per node with what `possible` needs; possible(x, y): a Column over columns with
    these prefixes that is true for every pair that may link; check: keeps the pairs (a, b) that do.
    """
    def paired(pairs: DataFrame) -> DataFrame:
        first, second = (facts.select(*[F.col(c).alias(p + c) for c in facts.columns]) for p in ("x_", "y_"))
        both = pairs.join(first, pairs["a"] == first["x_node"]).join(second, F.col("b") == second["y_node"])
        return both.where(possible("x_", "y_")).select("a", "b")

    held = buckets.join(buckets.groupBy("node").agg(F.count("*").alias("degree")), "node").withColumn("component", F.col("node"))
    tried = links = None
    for k in range(rounds):
        pairs = _leads(held, k == 0)
        pairs = stored(paired(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")), "lead-pairs")
        found = stored(check(pairs), "lead-links")
        tried, links = (pairs, found) if tried is None else (tried.union(pairs), links.union(found))
        own = components(found if k == 0 else found.union(own.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        held = stored(split(held.drop("component").join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))), "split-signatures")
    rows = held.drop("degree").join(facts, "node")
    x, y = (rows.select("signature", *[F.col(c).alias(p + c) for c in rows.columns if c != "signature"]) for p in ("x_", "y_"))
    across = x.join(y, "signature").where((F.col("x_node") < F.col("y_node")) & (F.col("x_component") != F.col("y_component")) & possible("x_", "y_"))
    rest = across.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    new = stored(check(rest), "cross-links")
    if new.isEmpty():
        return own, links
    return merged(own, new), links.union(new)
