"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of links (u, v long): the smallest node that links reach.

    Each round takes the smallest label among a node's neighbours and then twice the label of that label, so chains shorten
    fourfold a round at least. Links are held in both directions; groups are reduced before they are shuffled, and
    joins against one label per node leave a hot node's rows to be split.
    """
    spark = links.sparkSession
    both, path = written(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "links")
    labels, old = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        new, mid = written(new, "labels")
        hop = new.select(F.col("node").alias("at"), F.col("label").alias("to"))
        jumped = new.join(hop, F.col("label") == F.col("at")).select("node", F.col("to").alias("label"), "was")
        jumped = jumped.join(hop, F.col("label") == F.col("at")).select("node", F.col("to").alias("label"), "was")
        done, path2 = written(jumped, "labels")
        moved = done.where("label <> was").limit(1).count()
        removed(spark, old, mid)
        labels, old = done.select("node", "label"), path2
        if not moved:
            removed(spark, path)
            return labels.withColumnRenamed("label", "component")
