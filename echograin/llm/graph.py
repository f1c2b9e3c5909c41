"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """v, c for each end of ``links`` (a, b): c is the smallest node that v reaches.

    A round takes the smallest label among a node and its neighbours and then that label's own label, so long chains
    halve; each round is a table in the shared folder. Nodes and labels stay distributed; the driver sees a count.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("c")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("n"))
        lower = labels.join(near, labels["v"] == near["a"]).select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        of = labels.select(F.col("v").alias("w"), F.col("c").alias("d"))
        jumped = materialize(lower.join(of, F.col("c") == F.col("w")).select("v", "old", F.least("c", "d").alias("c")), "labels")
        release(labels)
        labels = jumped.select("v", "c")
        labels._echograin_path = jumped._echograin_path
        if jumped.where("c <> old").isEmpty():
            release(both)
            return labels
