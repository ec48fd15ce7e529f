"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.sources.shared import never_sent, written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component = smallest node reachable).

    In every round each label takes the label of the local minimum that its smaller neighbours lead
    to. The next round's edges connect labels only, without self-loops and repeats, so the edge table
    shrinks by a factor. Tables of edges and labels pack well in files, so none is broadcast by their size. Each round is written to the shared folder; the loop ends when no edge
    between two labels is left. Hubs are no hot groups: the minimum is pre-aggregated on the map side.
    Edges with a null end are ignored; no edges give no rows.
    """
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    nodes = both.select(F.col("a").alias("node")).union(both.select(F.col("b").alias("node"))).distinct()
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    live = written(both.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not live.isEmpty():
        # every label points to the smallest label beside it, if that is smaller than itself, and pointers double until all end at a local minimum
        jump = written(live.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to")), "low")
        while True:
            on = jump.join(never_sent(jump.select(F.col("label").alias("to"), F.col("to").alias("far"))), "to", "left")
            jump = written(on.select("label", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "jump")
            if jump.where("moved").isEmpty():
                break
            jump = jump.drop("moved")
        labels = written(labels.join(never_sent(jump), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        step = live.join(never_sent(jump.select(F.col("label").alias("a"), F.col("to").alias("ta"))), "a", "left")
        step = step.join(never_sent(jump.select(F.col("label").alias("b"), F.col("to").alias("tb"))), "b", "left")
        step = step.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a != b")
        live = written(step.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels.select("node", F.col("label").alias("component"))
