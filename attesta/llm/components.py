"""Connected components of a link table, by joins alone.

Each round every node takes the smallest label among its neighbours' and then
its label's label, so a component of diameter d settles in about log(d)
rounds.  Nothing but one count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    ``links`` should be a stored table: it is read in each round.  Links with a
    null end are ignored; an empty table gives an empty result.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = scratch.save(both, "edges")
    label = scratch.save(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = edges.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("near"))
        step = label.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        step = scratch.save(step, "step")
        up = step.select(F.col("u").alias("l"), F.col("l").alias("up"))
        jumped = step.join(up, "l", "left").select("u", "old", F.coalesce(F.least("l", "up"), "l").alias("l"))
        new = scratch.save(jumped, "labels")
        moved = new.where("l <> old").limit(1).count()
        scratch.drop(label, step)
        label = new
        if not moved:
            scratch.drop(edges)
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
