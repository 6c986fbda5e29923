"""Connected components of a link table, in rounds that each at least halve the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qlog.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs); a component is named by its smallest node.

    Each round maps every node to the smallest of itself and its neighbours and rewrites the links by
    that map; links within a node vanish. A node with a link either moves or is moved to, so the
    nodes halve at least. All tables stay distributed and are written each round; a node with very many
    links is a skewed join key that adaptive execution splits, as both sides are plain shuffles.
    Nulls and loops in the links are ignored.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "step")
        moved = edges.join(step, "a").select("b", F.col("to").alias("a2")).join(step.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        past, edges = edges, written(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        if labels is None:  # the first map holds every node
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("component"))
            forget(past)
        else:
            old, named = labels, labels.join(step.withColumnRenamed("a", "component"), "component", "left")
            labels = written(named.select("node", F.coalesce("to", "component").alias("component")), "nodes")
            forget(past, step)
            if hasattr(old, "_qlog_path"):
                forget(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels
