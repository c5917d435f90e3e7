"""Connected components of an edge table by labels that hook and shortcut, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id that can be reached.

    Each round gives a node, and the node that its label names, the smallest label across its edges, and
    then replaces every label by that label's own. Rounds grow with the logarithm of the longest path. Grouped
    minima are combined before a shuffle, and the joins have plain tables on both sides, so a hub can be split.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("c")), "labels")
    while True:
        ends = both.join(labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        seen = ends.where("cb < ca").select(F.explode(F.array(F.struct(F.col("a").alias("id"), "cb"), F.struct(F.col("ca").alias("id"), "cb"))).alias("x")).groupBy("x.id").agg(F.min("x.cb").alias("least"))
        hooked = materialize(labels.join(seen, "id", "left").select("id", F.least("c", F.coalesce("least", "c")).alias("c"), "c", "least").toDF("id", "c", "was", "least").drop("least"), "hooked")
        jumps = hooked.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        moved = materialize(hooked.join(jumps, "c").select("id", F.least("c", "cc").alias("c"), "was"), "labels")
        labels = moved.select("id", "c")
        if moved.where("c <> was").isEmpty():
            return labels.withColumnRenamed("c", "component")
