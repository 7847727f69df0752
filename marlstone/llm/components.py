"""Connected components of an edge table, by contraction towards neighbours in a random order that changes each round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import attach, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each vertex of edges (a, b): label is the smallest vertex of its component.

    A round maps each vertex to that one of itself and its neighbours which comes first in the round's order, and relabels the edges. Orders
    are hashes of vertex and round: by the vertices' own order a chain whose numbers rise would lose one vertex a round, by a
    random one a graph loses a constant share in the mean. No neighbour list is gathered. Loops and repeated edges do no harm; without
    edges there are no rows.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c, n=len(rounds): F.xxhash64(F.lit(n), c)
        both = edges.select("a", "b").union(edges.select("b", "a")).withColumn("order", order("b"))
        first = both.groupBy("a").agg(F.min_by("b", "order").alias("b"), F.min("order").alias("order"))
        chosen = materialize(first.select("a", F.when(F.col("order") < order("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "chosen")
        rounds.append(chosen)
        at_a, at_b = chosen.withColumnRenamed("to", "to_a"), chosen.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = materialize(edges.join(at_a, "a").join(at_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        return found.join(step.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))

    found = reduce(follow, rounds[1:], rounds[0].select(F.col("a").alias("node"), F.col("to").alias("label")))
    found = materialize(found, "found")
    smallest = found.groupBy("label").agg(F.min("node").alias("smallest"), F.count("*").alias("n"))
    return attach(found, smallest, "label").select("node", F.col("smallest").alias("label"))
