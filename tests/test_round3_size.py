"""Findings 9 to 28 of the third round: steps whose rows, shuffles or memory grew faster than their input."""

import pytest

from pyspark.sql import functions as F

from tests.conftest import SMALL


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


CHUNK = "chunk long, page string, title string, section string, slug string, headings array<string>, links array<string>, text string"


def test_concepts_are_counted_in_their_rows(spark):
    from marlstone.operators import entities as E

    said = [None, "", "Big Blue Engine runs. Big Blue engine engine", "é1é ångström2 é3é water water", "camelCase iPhone BigWord-X Bigword x About about", " ".join(f"word{k % 37} Name{k % 11}" for k in range(400))]
    rows = [(k, "p", "Alpha Page", "sources", "s", ["Intro Part", None], ["sources/p2#x", None], t) for k, t in enumerate(said)]
    # chunks of two rows, and without an id, are added up over their rows
    rows += [(9, "p", "Twice Told", "concepts", "c", [], [], t) for t in ("water engine", "engine water water")] + [(None, "p", "None", "concepts", "c", None, None, f"nothing {k}") for k in range(2)]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    told = E._told(*(F.col(c) for c in ("title", "section", "headings", "links", "text")))
    item = lambda x, kind, weight, name: F.struct(x.alias("label"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), name.alias("name"))
    every = F.concat("x.named", F.transform("x.names", lambda x: item(x, "entity", 1.0, E.concept_name(x))), F.transform("x.words", lambda x: item(x, "concept", 0.25, E.concept_name(x))))
    want = {}
    for r in chunks.select("chunk", told.alias("x")).select("chunk", F.posexplode(every)).orderBy("pos").collect():
        label, kind, weight, name = r.col
        if name is not None and len(name) >= 3 and name not in E.STOP:
            one = want.setdefault(r.chunk, {}).setdefault(("topic:" if kind == "topic" else "concept:") + name, [0.0, name, label, kind])
            one[0] += weight
    ranked = {(c, k, id, *x[2:], x[0]) for c, held in want.items() for k, (id, x) in enumerate(sorted(held.items(), key=lambda e: (-e[1][0], e[1][1], e[0]))[: E.TOP], 1)}
    assert {(r.chunk, r["rank"], r.id, r.label, r.kind, r.weight) for r in E.concepts(chunks).collect()} == ranked
    assert (9, 1, "concept:twice-told", "Twice Told", "concept", 5.0) in ranked and (None, 1, "concept:none", "None", "concept", 5.5) in ranked
    plan = plan_of(E.concepts(chunks))
    assert "Generate" not in plan and plan.count("MapInArrow") == 2


def test_edges_of_a_graph_are_written_once(spark):
    from marlstone.plans import entities

    assert "Join" not in plan_of(entities.entity_edges(spark, SMALL)) and "Aggregate" not in plan_of(entities.entity_edges(spark, SMALL))


def test_words_are_counted_in_their_rows(spark):
    from marlstone.functions.counts import word_counts

    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (None, ["a"]), (2, []), (3, None)], "key long, words array<string>").repartition(2)
    found = word_counts(rows, "words")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(1, "a", 1, 3), (1, "b", 2, 3), (None, "a", 1, 1), (2, None, 0, 0), (3, None, 0, 0)]))
    assert word_counts(rows.limit(0), "words").count() == 0
    assert plan_of(word_counts(rows.coalesce(1), "words")).count("Exchange") <= 1


@pytest.mark.parametrize("held", [256, 1])
def test_the_nearest_vectors_are_kept_whatever_order_blocks_meet_in(spark, monkeypatch, held):
    import numpy as np

    from marlstone.operators import retrieval as R

    monkeypatch.setattr(R, "BLOCK", 16)
    monkeypatch.setattr(R, "HELD", held)
    made = np.random.default_rng(5).normal(size=(150, 4)).round(1).tolist()
    rows = [(k, v) for k, v in enumerate(made)] + [(k + 150, made[7]) for k in range(60)] + [(300, None), (301, [0.0] * 4), (302, [1.0, 2.0]), (303, [1.0, float("nan"), 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def alike(a, b):
        if a is None or b is None or len(a) != len(b) or not np.isfinite([*a, *b]).all() or not any(a) or not any(b):
            return 0.0
        x = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
        return np.floor((x if x >= R.EMBEDDING_LEAST else 0.0) * 1e6 + 0.5) / 1e6

    asked = vectors.filter("vec_id % 5 = 0")
    want = {(q, b, n): s for q, v in rows if q % 5 == 0 for n, (s, b) in enumerate(sorted(((-alike(v, w), b) for b, w in rows))[:20], 1)}
    for broadcast in (str(10 << 20), "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            found = {(r.query, r.vec_id, r.place): -r.similarity for r in R.nearest(vectors, asked, 20).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_tasks_pass_on_the_best_of_a_query_once(spark):
    """A task that met the blocks of queries in turn for each block of rows passed on k rows a query for each pair of blocks."""
    from marlstone.operators import retrieval as R

    rows = spark.range(0, 8192, 1, 1).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k).cast("double") for k in (1, 2, 3))).alias("embedding"))
    pairs = R._matched(R._vectors(rows, "vec_id", "embedding"), R._vectors(rows.filter("vec_id % 4 = 0"), "vec_id", "embedding"), 5, lambda alike, weight: alike, False)
    assert pairs.count() == 2048 * 5
    counted = pairs.groupBy().count()
    counted.collect()
    todo, passed = [counted._jdf.queryExecution().executedPlan()], []
    while todo:
        at = todo.pop()
        if "AdaptiveSparkPlan" in at.nodeName():
            todo.append(at.executedPlan())
        elif "QueryStage" in at.nodeName():
            todo.append(at.plan())
        else:
            if at.nodeName() == "MapInArrow":
                passed.append(at.metrics().apply("pythonNumRowsReceived").value())
            todo += [at.children().apply(k) for k in range(at.children().size())]
    # one partition of rows: blocks, and the best of each query
    assert max(passed) == 2048 * 5


def test_terms_of_a_long_text_are_counted_in_one_pass(spark):
    """Each term was held against all words of its text."""
    import time

    from marlstone.operators import knowledge

    text = " ".join(f"word{k}x{j}" for k in range(20000) for j in range(1 + (k % 20000 == 7)))
    rows = spark.createDataFrame([(1, text + " tie1 tie1 tie2 tie2 both both both"), (2, None), (3, "")], "id long, text string")
    nodes, edges = knowledge.term_graph(rows, "id", "text", 3)
    began = time.time()
    assert {(r.term, r.weight) for r in nodes.collect()} == {("both", 3), ("tie1", 2), ("tie2", 2)}
    assert time.time() - began < 8
    assert {(r.a, r.b, r.weight) for r in edges.collect()} == {("both", "tie1", 1), ("both", "tie2", 1), ("tie1", "tie2", 1)}
