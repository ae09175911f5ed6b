"""Connected components of a graph of any size and shape, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavecohort.session import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Distributed union-find by contraction: each node is hooked to its smallest neighbour,
    edges are rewritten to the hooks, loops and repeats dropped, until no edge is left. Every
    node that has a smaller neighbour disappears in a round. A hub's rows meet in partial
    aggregates and in joins that can be split, never in one group. Each round is written to
    the shared folder. Null ends and loops link nothing; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = e.where("u is not null and v is not null and u <> v")
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    e = durable(e.select(low, high).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        hooks = durable(hooks.select("node", F.least("node", "low").alias("hook")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("hook").alias("component"))
        else:
            moved = hooks.select(F.col("node").alias("component"), "hook")
            labels = labels.join(moved, "component", "left").select(
                "node", F.coalesce("hook", "component").alias("component")
            )
        labels = durable(labels, "labels")
        e = e.join(hooks.select(F.col("node").alias("u"), F.col("hook").alias("hu")), "u")
        e = e.join(hooks.select(F.col("node").alias("v"), F.col("hook").alias("hv")), "v")
        e = e.select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
        e = durable(e.where("u <> v").distinct(), "edges")
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
