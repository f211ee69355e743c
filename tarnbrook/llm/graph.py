"""Connected components as DataFrame rounds; nothing of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over `edges`; only nodes with an edge are returned.

    Each round takes the least label of the neighbours, then follows labels once more (pointer jumping), so
    stars end in two rounds and chains in a number of rounds that is logarithmic in practice. The aggregates
    combine before their shuffle and the joins are plain equi-joins, which adaptive execution splits where a
    hub is hot. No edges: an empty table. Null ends and self-loops are ignored."""
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialize(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.u, "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("hop"))
        far = labels.select(F.col("node").alias("hop"), F.col("label").alias("far"))
        fresh = materialize(step.join(far, "hop", "left").select("node", F.least("hop", "far").alias("label"), (F.least("hop", "far") != F.col("old")).alias("moved")), "cc-labels")
        ended = fresh.where("moved").limit(1).count() == 0
        release(spark, labels)
        labels = fresh.select("node", "label")
        if ended:
            release(spark, both)
            return labels
