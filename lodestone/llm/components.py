"""Connected components of link tables, by rounds of joins over ever smaller link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """links: (x, y) of longs, a written table -> (node, component): every linked node with the smallest node it reaches.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers to their ends (the
    ways shrink to a quarter with each step), and replaces the links by links between those ends. Rounds end when no link is left.
    """
    labels, k = None, 0
    edges = links.where("x <> y").select("x", "y")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("to"))
        near = scratch.write(near, f"{name}-near-{k}")
        step = 0
        while True:
            hop = lambda c: near.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
            twice = near.join(hop("to"), "to").join(hop("to_to"), "to_to").select("node", F.col("to_to_to").alias("end"), (F.col("to_to_to") != F.col("to")).alias("moved"))
            near = scratch.write(twice.select("node", F.col("end").alias("to"), "moved"), f"{name}-points-{k}-{step}")
            step += 1
            if near.where("moved").isEmpty():
                break
            near = near.drop("moved")
        to = lambda c: near.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        ends = edges.join(to("x"), "x").join(to("y"), "y").select(F.col("x_to").alias("x"), F.col("y_to").alias("y")).where("x <> y")
        k += 1
        edges = scratch.write(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), f"{name}-edges-{k}")
        if labels is None:
            labels = near.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(near.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = scratch.write(moved, f"{name}-labels-{k}")
    if labels is None:
        labels = edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return labels
