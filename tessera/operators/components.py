"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of each node of ``edges`` (u, v, both long); a component is named by its smallest id.

    Every node takes the smallest label among its neighbours and then the label of its label, so a chain of n nodes takes
    about log n rounds. Labels meet in partial minima before they shuffle, and a node of very many edges is a hot join key
    that adaptive execution splits. Each round is a table in the shared folder. Loops and repeated edges do no harm.
    """
    both = scratch.save(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u IS NOT NULL AND v IS NOT NULL").distinct())
    labels = scratch.save(both.groupBy(F.col("u").alias("id")).agg(F.least("u", F.min("v")).alias("label")))
    was = None
    while True:
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("id") == F.col("u")).select("id", F.least("label", "near").alias("label"))
        of = least.select(F.col("id").alias("of"), F.col("label").alias("next"))
        after = scratch.save(least.join(of, F.col("label") == F.col("of")).select("id", F.col("next").alias("label")))
        now = after.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        scratch.drop(labels)
        labels = after
        if now == was:
            scratch.drop(both)
            return labels.select("id", F.col("label").alias("component"))
        was = now
