"""Connected components by repeated contraction, with staged rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import stage, unstage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node.

    Each round maps every node to the smallest of itself and its neighbours
    and contracts the edges accordingly, so stars vanish in one round and
    chains halve or better. All rounds are tables in the shared folder; only
    emptiness is asked on the driver. Self-loops give a component of their
    own; null ends are ignored.
    """
    known = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    current = stage(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found: DataFrame | None = None
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        step = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "cc-step")
        one, two = step.toDF("a", "a2"), step.toDF("b", "b2")
        shrunk = current.join(one, "a").join(two, "b").where("a2 <> b2")
        shrunk = shrunk.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        after = stage(shrunk, "cc-edges")
        unstage(current)
        current = after
        if found is None:
            found = step.withColumnRenamed("to", "component")
        else:
            hop = step.toDF("component", "to")
            found = found.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    if found is None:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stage(found, "components")
