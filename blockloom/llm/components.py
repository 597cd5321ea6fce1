"""Connected components by contraction.

In each round every node takes the smallest of its neighbours, the pointers are followed twice, and the edges are
carried over to where they point; edges inside a component vanish. A round at least halves the nodes that still have
edges within two steps, and no step gathers the edges of a node: minima are pre-aggregated, look-ups are joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge; edges (u, v) are longs, in either direction, repeated or not."""
    e = cut(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        step = cut(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")))
        for _ in range(2):
            again = step.select(F.col("x").alias("to"), F.col("to").alias("then"))
            step = step.join(again, "to", "left").select("x", F.coalesce("then", "to").alias("to"))
        step = cut(step)
        if labels is None:
            labels = step.select(F.col("x").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(step, labels["root"] == step["x"], "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = cut(labels)
        e = e.join(step.select(F.col("x").alias("u"), F.col("to").alias("a")), "u").join(step.select(F.col("x").alias("v"), F.col("to").alias("b")), "v")
        e = cut(e.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return labels
