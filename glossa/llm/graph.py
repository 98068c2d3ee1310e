"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import materialize, remove


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected (a, b) links; the label is
    the least node of its component. Labels spread to neighbours and then jump
    to their label's label, so the rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder."""
    spark = links.sparkSession
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    both, both_at = materialize(both.distinct(), "links")
    labels, labels_at = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other")
        seen = near.groupBy("node").agg(F.min("seen").alias("seen"))
        least = labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        new = least.join(jump, "next").select("node", F.least("next", "jumped").alias("label"), (F.least("next", "jumped") != F.col("label")).alias("moved"))
        new, new_at = materialize(new, "labels")
        moved = new.where("moved").limit(1).count()
        remove(spark, labels_at)
        labels, labels_at = new.select("node", "label"), new_at
        if not moved:
            remove(spark, both_at)
            return labels
