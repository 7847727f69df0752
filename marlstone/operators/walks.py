"""Walks over a weighted graph from a few nodes, and what is told of cited nodes; links, lines and merges of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise

#: Seeds, nodes of a frontier and edges of a node at most, and the boost of a weight at each hop.
SEEDS, FRONTIER, BOOSTS = 6, 18, (0.07, 0.02)
#: Neighbours of a cited node, and cited nodes at most.
NEIGHBOURS, CITED = 6, 8


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def _heaviest(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The n heaviest edges of each of a few nodes, which are broadcast; ties by the other end. Tasks keep n a node before they shuffle."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    return both_ways(edges).join(F.broadcast(nodes.select(F.col("node").alias("a"))), "a", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= n)


def walk(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hop, via, boost) of what edges (a, b, weight) lead to from the best seeds (node, score), one hop for each of BOOSTS.

    A node counts where it is first reached: from the earliest node of the frontier, over its heaviest edge. Frontiers have
    FRONTIER nodes with FRONTIER edges each at most, so that they are ranked in one task.
    """
    best = seeds.filter("score > 0").orderBy(F.desc("score"), "node").limit(SEEDS)
    frontier = best.select("node", F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("place"))
    visited, found = frontier.select("node"), None
    for hop, share in enumerate(BOOSTS, 1):
        now = frontier.filter(F.col("place") <= FRONTIER)
        met = now.select(F.col("node").alias("a"), "place").join(_heaviest(edges, now, FRONTIER), "a")
        first = met.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("place", "rank", F.col("a").alias("via"), "weight")).alias("x")).join(visited, "node", "left_anti")
        step = first.select("node", F.lit(hop).alias("hop"), "x.via", (F.col("x.weight") * share).alias("boost"), "x.place", "x.rank")
        found = step if found is None else found.unionByName(step)
        frontier = step.select("node", F.row_number().over(Window.orderBy("place", "rank")).alias("place"))
        visited = visited.union(step.select("node"))
    return found.select("node", "hop", "via", quantise(F.col("boost"), 6).alias("boost"))


def context(cited: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, score, neighbours) of cited nodes, a page of them: their weight (node, weight) and that of their heaviest edges; the best CITED."""
    near = _heaviest(edges, cited, NEIGHBOURS).groupBy("a").agg(F.sum("weight").alias("_more"), F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("_n"))
    told = nodes.join(F.broadcast(cited.select("node").distinct()), "node", "left_semi").join(near.withColumnRenamed("a", "node"), "node", "left")
    score = quantise(F.col("weight") + F.coalesce("_more", F.lit(0)), 3)
    names = F.coalesce(F.transform("_n", lambda x: x["b"]), F.array())
    return told.select("node", score.alias("score"), names.alias("neighbours")).orderBy(F.desc("score"), "node").limit(CITED)


def wiki_links(text: Column) -> Column:
    """The targets of [[target]] and [[target|title]] links, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """struct<first, last>: the lines, from 1, of a stretch of a text, whose end isn't part of it."""
    ends = lambda n: F.regexp_count(F.left(text, F.greatest(F.lit(0), n)), F.lit("\n"))
    return F.struct((ends(start) + 1).alias("first"), (ends(F.greatest(start, end - 1)) + 1).alias("last"))


def merged_proposals(rows: DataFrame, key: str) -> DataFrame:
    """(key, confidence, aliases, sources, updated) of proposals (alias, source, confidence, at) of one key: the best confidence, all names, the last change."""
    return rows.groupBy(key).agg(quantise(F.max("confidence"), 2).alias("confidence"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("at").alias("updated"))
