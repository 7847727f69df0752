"""Chains and cycles of any length; vector search against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.arrays import running
from marlstone.operators import advice, graphs, relational, retrieval


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_long_redirects_are_followed_to_their_end(spark):
    pairs = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 102), (102, 103), (103, 101), (200, 200), (300, 200), (7, 7)]
    pairs.remove((7, 8))
    rows = spark.createDataFrame([(k,) for k in (0, 7, 8, 49, 50, 100, 101, 102, 103, 200, 300, 999)], "a long")
    found = dict(relational.canonical_redirects(rows, edges(spark, pairs), "a").collect())
    assert found == {0: 7, 7: 7, 8: 50, 49: 50, 50: 50, 100: 103, 101: 103, 102: 101, 103: 102, 200: 200, 300: 200, 999: 999}
    assert dict(relational.canonical_redirects(rows, edges(spark, pairs), "a", hops=4).select("a", "canonical").collect())[8] == 12
    assert dict(relational.canonical_redirects(rows, edges(spark, []), "a").collect())[8] == 8


def test_cycles_of_any_length_are_found(spark):
    ring = [(k, (k + 1) % 20) for k in range(20)]
    more = [(30, 31), (31, 30), (31, 5), (40, 0), (0, 41), (41, 42), (50, 50), (60, 61), (61, 62), (62, 63), (5, 70), (70, 71), (71, 70)]
    found = {r.node for r in graphs.cycle_nodes(edges(spark, ring + more)).collect()}
    assert found == {*range(20), 30, 31, 50, 70, 71}
    assert graphs.cycle_nodes(edges(spark, [(1, 2), (2, 3)])).count() == 0 and graphs.cycle_nodes(edges(spark, [])).count() == 0


def plain_cycle_nodes(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, todo = set(), list(out[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        if start in seen:
            found.add(start)
    return found


def test_cycles_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((12, 14), (30, 33), (40, 60), (25, 80)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert {r.node for r in graphs.cycle_nodes(edges(spark, pairs)).collect()} == plain_cycle_nodes(pairs), pairs


def test_long_chains_rings_and_trees_take_few_rounds(spark):
    import time

    n = 10_000
    ids = spark.range(n).withColumnRenamed("id", "a")
    chain = ids.select("a", (F.col("a") + 1).alias("b"))
    began = time.time()
    assert graphs.cycle_nodes(chain).count() == 0
    assert time.time() - began < 60
    ring = chain.union(spark.createDataFrame([(n, 0)], "a long, b long"))
    leaves = ids.select("a", (F.col("a") + 1_000_000).alias("b"))  # each node of the ring leads to a dead end too
    began = time.time()
    assert graphs.cycle_nodes(ring.union(leaves)).count() == n + 1
    assert time.time() - began < 120


def test_nearest_vectors_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    rng = np.random.default_rng(4)
    held = [(k, rng.normal(size=8).tolist()) for k in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0])]
    rows = spark.createDataFrame(held, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in retrieval.nearest(rows, rows.filter("vec_id % 7 = 0"), 4).collect():
        found.setdefault(r.query, {})[r.place] = (r.vec_id, r.similarity)
    for k, v in held[:60:7]:
        alike = {j: np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) for j, w in held[:60]} | {60: 0, 61: 0, 62: 0}
        best = sorted(alike, key=lambda j: (-np.floor((alike[j] if alike[j] >= 0.15 else 0) * 1e6 + 0.5), j))[:4]
        assert [found[k][p][0] for p in range(1, 5)] == best
    assert set(found) == set(range(0, 63, 7))


def test_advice_in_words(spark):
    rows = [("please do not sell", "flat", "cash"), ("not to sell but hold", "not_down", "long"), ("watch closely", "flat", "cash"), ("sell? no, buy", "down", "cash"), ("不宜卖出，建议持有", "not_down", "long"), (None, "flat", "cash"), ("Strong Buy", "up", "long")]
    found = spark.createDataFrame(rows, "t string, d string, p string").select("t", "d", "p", advice.direction(F.col("t")).alias("x"), advice.position(F.col("t")).alias("y")).collect()
    assert [(r.x, r.y) for r in found] == [(r.d, r.p) for r in found]


def test_running_folds(spark):
    for n in (0, 1, 127, 128, 129, 700):
        items = F.array(*(F.lit(k) for k in range(n))) if n else F.array().cast("array<int>")
        row = spark.range(1).select(running(items, F.lit(0), lambda s, x: (s + x, s), "int").alias("r")).first()
        assert row.r == [k * (k - 1) // 2 for k in range(n)]


def test_pages_are_bounded(spark, monkeypatch):
    hits = spark.createDataFrame([(k, float(k)) for k in range(5)], "doc_id long, score double")
    assert [(r.doc_id, r.place) for r in retrieval.placed(hits, F.desc("score")).collect()] == [(4 - k, k + 1) for k in range(5)]
    monkeypatch.setattr(retrieval, "PAGE", 4)
    with pytest.raises(Exception, match="at most 4 hits"):
        retrieval.placed(hits, F.desc("score")).collect()
