"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) to one row (node, component) for each node in them; the component is its smallest node.

    By alternating stars (Kiveris et al., 2014): links lead from larger nodes to smaller ones, and
    each round draws them anew to the smallest neighbour, first those of the larger neighbours of
    each node, then those of the smaller ones, until all are stars. Minima are partial before each
    shuffle, and joins are plain equi-joins that adaptive execution splits where a node has very
    many links.
    """
    links = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    loops = links.filter("v = u").select("v").distinct()
    edges, before = checkpoint(links.filter("v <> u").distinct()), None
    while (mark := edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()) != before and mark[0]:
        before = mark
        # each step reads its links twice, so they are written before
        edges = checkpoint(_drawn(checkpoint(_drawn(edges, larger=True)), larger=False))
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")))
    # what is linked with itself alone is a component too
    alone = loops.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return checkpoint(stars.unionByName(alone).groupBy("node").agg(F.min("component").alias("component")))


def _drawn(edges: DataFrame, larger: bool) -> DataFrame:
    """Links (v, u) with u < v, drawn anew: each node sends its larger (or smaller) neighbours, and itself, to its smallest neighbour."""
    if larger:
        near = edges.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("u").alias("y")), F.struct(F.col("u").alias("x"), F.col("v").alias("y")))).alias("e")).select("e.*")
        near = near.groupBy("x").agg(F.min("y").alias("least")).select("x", F.least("x", "least").alias("least"))
        sent = edges.join(near.withColumnRenamed("x", "u"), "u").select("v", F.col("least").alias("u"))
    else:
        near = edges.groupBy("v").agg(F.min("u").alias("least"))
        sent = edges.join(near, "v").select(F.explode(F.array(F.struct("v", F.col("least").alias("u")), F.struct(F.col("u").alias("v"), F.col("least").alias("u")))).alias("e")).select("e.*")
    return sent.filter("v <> u").distinct()
