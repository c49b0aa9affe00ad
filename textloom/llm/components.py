"""Connected components of a link table, all in Spark: neither links nor labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connect(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the least node reachable.

    Each round takes the least label among neighbours (aggregated before the shuffle) and then the
    label's label. Rounds go on until no label changes; each is written to the shared folder."""
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("least"))
        better = labels.join(near, labels.node == near.a).select("node", F.least("comp", "least").alias("comp"), F.col("comp").alias("old"))
        up = labels.select(F.col("node").alias("up"), F.col("comp").alias("up_comp"))
        jumped = settle(better.join(up, better.comp == up.up, "left").select("node", F.least("comp", F.coalesce("up_comp", "comp")).alias("comp"), "old"))
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> old").isEmpty():
            return labels
