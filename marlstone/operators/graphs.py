"""Chains and cycles of directed edges, by rounds of joins until nothing moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.tables import materialize


def _jumps(steps: DataFrame) -> list[DataFrame]:
    """For steps (a, b), a once: where each leads to after 1, 2, 4, ... of them, as (a, at, ended, low).

    What has ended stands where it ended; low is the smallest node passed. The last table has gone as many steps as there are nodes, so what still goes on
    runs in a cycle.
    """
    keys = steps.select(F.col("a").alias("at"), F.lit(True).alias("_key"))
    rows = materialize(steps.select("a", F.col("b").alias("at")).join(keys, "at", "left").select("a", "at", F.col("_key").isNull().alias("ended"), F.col("a").alias("low")), "steps")
    found, n, length = [rows], rows.count(), 1
    while length < n and not rows.filter("NOT ended").isEmpty():
        further = rows.select(F.col("a").alias("at"), F.col("at").alias("next"), F.col("ended").alias("last"), F.col("low").alias("less"))
        moved = rows.filter("NOT ended").join(further, "at").select("a", F.col("next").alias("at"), F.col("last").alias("ended"), F.least("low", "less").alias("low"))
        rows, length = materialize(rows.filter("ended").union(moved), "steps"), length * 2
        found.append(rows)
    return found


def _followed(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """steps (a, b), a once, followed to their ends: (a, end) of chains that end, and (a, at) of those that never do, whose `at`s are the nodes of cycles."""
    rows = _jumps(steps)[-1]
    return rows.filter("ended").select("a", F.col("at").alias("end")), rows.filter("NOT ended").select("a", "at")


def _core(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes on cycles of edges (a, b): those with one label lie on cycles together.

    The largest node that leads to each is found; those that lead back to theirs lie on a cycle with it. What is found is taken off, and the rest is asked again.
    """
    found = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    while True:
        n = None
        while n != (n := edges.count()) and n:
            heads, tails = edges.select("b").distinct(), edges.select("a").distinct()
            edges = materialize(edges.join(heads.withColumnRenamed("b", "a"), "a", "left_semi").join(tails.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), "edges")
        if not n:
            return found
        label, moved = materialize(edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "label"), True
        while moved:
            reached = edges.join(label, edges.a == label.node).groupBy("b").agg(F.max("root").alias("other"))
            after = materialize(label.join(reached, label.node == reached.b, "left").select("node", F.greatest("root", "other").alias("root"), (F.col("other") > F.col("root")).alias("moved")), "label")
            moved, label = not after.filter("moved").isEmpty(), after.select("node", "root")
        # within a root's nodes, those that lead back to it
        own = materialize(edges.join(label.select(F.col("node").alias("a"), "root"), "a").join(label.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").filter("root = other").select("a", "b", "root"), "own")
        back = materialize(label.filter("node = root").select("node"), "back")
        front = back
        while not front.isEmpty():
            front = materialize(own.join(front, own.b == front.node).select(F.col("a").alias("node")).distinct().join(back, "node", "left_anti"), "front")
            back = back.union(front)
        back = materialize(back, "back")
        on = own.join(back.withColumnRenamed("node", "a"), "a", "left_semi").join(back.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node"), F.col("root").alias("label")).distinct()
        found = found.union(on)
        edges = materialize(edges.join(back.withColumnRenamed("node", "a"), "a", "left_anti").join(back.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "edges")


@dataclass(frozen=True)
class _Contracted:
    """A round: edges of nodes with several, jumps of those with one, where these end, which run in rings, and which nodes lead back to themselves."""

    branching: DataFrame
    jumps: list[DataFrame]
    ends: DataFrame
    rings: DataFrame
    loops: DataFrame


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node) of the nodes of edges (a, b) that lie on a cycle, of any length; an edge from a node to itself is one.

    Edges into dead ends and from nodes that nothing leads to are taken off. A node with one edge leads where that does: all such chains are followed at
    once, by pointers that double, and are left out; those that never end are rings. So long chains, rings and trees take rounds in the logarithm of their
    length. What is left branches everywhere, and is small as a rule: its cycles are found by `_core`, whose rounds may grow with its longest path. Then
    chains are put in again, the last first: one that leads from a node on a cycle to another of the same lies on it too.
    """
    edges = materialize(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    own, edges, rounds = edges.filter("a = b").select(F.col("a").alias("node")), edges.filter("a <> b"), []
    labels = own.select("node", F.col("node").alias("label")).limit(0)
    while True:
        sources, targets = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        edges = materialize(edges.join(sources, "b", "left_semi").join(targets, "a", "left_semi").select("a", "b"), "edges")
        if edges.isEmpty():
            break
        ones = materialize(edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).filter("n = 1").select("a", "b"), "ones")
        if ones.isEmpty():
            labels = materialize(_core(edges), "labels")
            break
        jumps = _jumps(ones)
        ends, endless = jumps[-1].filter("ended").select("a", F.col("at").alias("end")), jumps[-1].filter("NOT ended")
        rings = materialize(endless.select("at").distinct().join(endless.select(F.col("a").alias("at"), "low"), "at").select(F.col("at").alias("node"), F.col("low").alias("label")), "rings")
        branching = materialize(edges.join(ones.select("a"), "a", "left_anti").select("a", "b"), "branching")
        onward = branching.join(endless.select(F.col("a").alias("b")), "b", "left_anti").join(ends.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("end", "b").alias("b"))
        edges = materialize(onward.distinct(), "onward")
        rounds.append(_Contracted(branching, jumps, ends, rings, edges.filter("a = b").select(F.col("a").alias("node"))))
        edges = edges.filter("a <> b")
    for r in reversed(rounds):
        labels = materialize(labels.union(r.loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "labels")
        entered = r.branching.join(r.ends.withColumnRenamed("a", "b"), "b").join(labels.select(F.col("node").alias("a"), "label"), "a").join(labels.select(F.col("node").alias("end"), F.col("label").alias("_other")), "end").filter("label = _other")
        marked = materialize(entered.select(F.col("b").alias("node"), "label").distinct(), "marked")
        for jump in r.jumps if not marked.isEmpty() else ():
            further = marked.join(jump.filter("NOT ended").select(F.col("a").alias("node"), "at"), "node").select(F.col("at").alias("node"), "label")
            marked = materialize(marked.union(further).distinct(), "marked")
        labels = materialize(labels.union(marked).union(r.rings).distinct(), "labels")
    return labels.select("node").union(own).distinct()


def canonical(steps: DataFrame) -> DataFrame:
    """(a, canonical): where redirects (a, b) lead to, however long a chain is; one that runs into a cycle ends before the place it has already seen.

    Of several redirects of one place the smallest counts.
    """
    one = steps.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a").agg(F.min("b").alias("b"))
    one = materialize(one, "redirects")
    ended, endless = _followed(one)
    ended, cycle = materialize(ended, "ended"), materialize(endless.select(F.col("at").alias("node")).distinct(), "cycle")
    # with the cycles' nodes as ends, chains into them end where they enter; the place before that, along the cycle, is the last one unseen
    entries, _ = _followed(one.join(cycle, one.a == cycle.node, "left_anti").join(ended.select("a"), "a", "left_anti"))
    entries = entries.union(cycle.select(F.col("node").alias("a"), F.col("node").alias("end")))
    before = one.join(cycle, one.a == cycle.node, "left_semi").select(F.col("b").alias("end"), F.col("a").alias("canonical"))
    return ended.select("a", F.col("end").alias("canonical")).union(entries.join(before, "end").select("a", "canonical"))
