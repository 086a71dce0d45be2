"""Connected components of link tables that only ever exist distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the
    links (a, b).  Self links and repeated links are allowed; nulls aren't.

    Each round hooks the label of a node's label to the smallest label among its
    neighbours and then jumps over labels, so long chains shrink geometrically.
    Every round is a written table; joins are plain equi-joins, which Spark
    splits where a node has very many links.
    """
    both = A.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = A.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "labels")
    while True:
        # the smallest label next to each node
        near = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        seen = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        # hook: what a node has found also holds for the node that labels it
        found = seen.select("a", "m").union(seen.filter("m < l").select(F.col("l").alias("a"), "m")).groupBy("a").agg(F.min("m").alias("m"))
        jump = found.select(F.col("a").alias("m"), F.col("m").alias("n"))
        new = A.table(labels.join(found, "a").join(jump, "m").select("a", F.col("n").alias("l"), (F.col("l") != F.col("n")).alias("moved")), "labels")
        if not new.filter("moved").limit(1).count():
            return new.select(F.col("a").alias("node"), F.col("l").alias("component"))
        labels = new.select("a", "l")
