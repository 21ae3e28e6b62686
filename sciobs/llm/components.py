"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Keys that the edges of one node are dealt over.
SALTS = 8
#: Up to so many nodes (a few MB) a table of their minima is broadcast; more are joined by sorting, salted.
BROADCAST_NODES = 100_000


def components(edges: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """edges (a long, b long) -> (node, component: the smallest node it is connected to).

    Alternating rounds of two steps, each a group-by with partial aggregation
    and a join: large-star ties every larger neighbour of a node to the smallest
    one, small-star does so for the smaller ones, until each component is a star:
    no node has a smaller neighbour beside any other. Rounds grow with the
    logarithm of the nodes. Every round is written to the shared folder and
    deleted when the next is there. The minima of counted, few nodes are
    broadcast; else a hub's edges are dealt over SALTS keys and its minimum is
    repeated for each. Self loops and repeated edges are allowed; nodes
    without edges do not appear.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = shared.keep(edges, "stars")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.expr("a <> b")).alias("n"))
        open_ = F.expr("low < a AND (high > a OR n > 1)").alias("open")
        nodes = shared.keep(around.select("a", F.least("a", "low").alias("m"), open_), "nodes")
        count, unfinished = nodes.agg(F.count("*"), F.bool_or("open")).first()
        if not unfinished:
            shared.drop(now)
            return nodes.select(F.col("a").alias("node"), F.col("m").alias("component"))
        few = count <= broadcast_nodes
        # large-star: larger neighbours -> minimum of the neighbourhood and the node
        large = _with_minimum(both.where("b > a"), nodes.select("a", "m"), few).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: a node's smaller neighbours and itself -> their minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = _with_minimum(large, least, few).select(F.explode(ties).alias("e")).select("e.*").where("a <> b")
        after = shared.keep(small.unionByName(now.where("a = b")).distinct(), "stars")
        shared.drop(now)
        shared.drop(nodes)
        now = after


def _with_minimum(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Edges (a, b) with the minimum m of a."""
    if few:
        return edges.join(F.broadcast(least), "a")
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(least.select("a", "m", salts).hint("merge"), ["a", "salt"]).drop("salt")
