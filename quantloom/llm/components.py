"""Connected components by alternating large and small stars.

Every round relinks each node's neighbours to the least of them, first the greater ones
and then the others, until only stars around the components' least nodes are left; the
number of rounds grows with the logarithm of the component's size.  Edges stay in Spark:
each round is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Scratch


# Minima are written before they are joined, so that Spark can split the edges of a frequent node.


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m")), name)
    return both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    least = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m"), name)
    joined = edges.join(least, F.col("u") == F.col("of"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("of").alias("u"), F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether there are only stars around their least nodes: no node has two lesser neighbours, or lesser and greater ones."""
    ends = edges.selectExpr("u AS node", "1 AS lesser", "0 AS greater").unionAll(edges.selectExpr("v", "0", "1"))
    return not ends.groupBy("node").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater")).where("lesser > 1 OR lesser = 1 AND greater = 1").take(1)


def components(edges: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """node, component (its least node) of every node with an edge but the least ones.

    ``edges`` has two columns of longs; loops and repeats are ignored.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = scratch.write(now, f"{name}0")
    for step in range(1, most):
        if _settled(now):
            break
        large = scratch.write(_large_star(now, scratch, f"{name}least").where("u != v").distinct(), f"{name}large")
        new = scratch.write(_small_star(large, scratch, f"{name}less").where("u != v").distinct(), f"{name}{step}")
        for done in (step - 1, "large", "least", "less"):
            scratch.drop(f"{name}{done}")
        now = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between components so far; ``labels`` has node and component."""
    a, b = edges.columns
    for end in (a, b):
        of = labels.select(F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_component"))
        edges = edges.join(of, F.col(end) == F.col(f"{end}_node"), "left")
    return edges.select(F.coalesce(f"{a}_component", a).alias(a), F.coalesce(f"{b}_component", b).alias(b))


def extended(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after components of contracted edges joined some of theirs."""
    moved = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("moved")), "component", "left")
    return moved.select("node", F.coalesce("moved", "component").alias("component")).unionAll(more)
