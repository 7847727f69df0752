"""The graph of concepts on small chunks, worked out by hand; odd rows; and boosts over it."""

import pytest

from pyspark.sql import functions as F

from marlstone.operators import entities as E
from marlstone.operators import walks as W

CHUNK = "chunk long, page string, title string, section string, slug string, headings array<string>, links array<string>, text string, extra int"


def test_concept_names(spark):
    names = {"concepts/DeepLearning_Model#Part": "deep-learning-model-part", "sources/x--Y ": "x-y", "  Été 2024!": "été-2024", "#": "", "": ""}
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", E.concept_name(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in found} == names


@pytest.fixture(scope="module")
def graph(spark):
    rows = [
        (1, "p1", "Alpha Page", "concepts", "s1", ["Intro Part"], ["sources/p2#x"], "Big Blue Engine runs. `Hidden Name` Big Blue Engine", 0),
        (2, "p1", "Alpha Page", "concepts", "s1", [], [], "Deep water text that has the water", 0),
        (3, "p2", "Beta", "sources", "s2", None, None, None, 0),
        (4, "p3", "Gamma", "sources", "s3", [], [], "text", 0),
        (5, "p4", "Gamma", "queries", "s3", [], [], "text", 0),
        (6, "p2", None, "sources", "s2", [None], [None], "", 0),
    ]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(3)
    links = spark.createDataFrame([("p1", "p2"), ("p1", "p2"), ("p2", "p9"), ("p2", "p2")], "from string, to string")
    topics = spark.createDataFrame([("Alpha Page", "p2"), ("Alpha Page", "nowhere"), ("p2", "p2")], "from string, to string")
    entities = spark.createDataFrame([("p1", "Ann Lee"), ("p1", " "), ("p9", "Nobody"), ("p2", "Bob")], "page string, name string")
    relations = spark.createDataFrame([("p1", "Ann Lee", "Bob"), ("p2", "Bob", "Ann Lee"), ("p1", "Ann Lee", "Cy")], "page string, source string, target string")
    return E.build(chunks, links, topics, entities, relations)


def test_nodes(graph):
    nodes = {r.id: r for r in graph.nodes.collect()}
    assert "topic:gamma" not in nodes  # its slug stands in two sections
    # title, its two words of four letters; the heading, and its words
    assert nodes["concept:alpha-page"].weight == 5.0 and (nodes["concept:alpha-page"].chunks, nodes["concept:alpha-page"].pages) == (2, 1)
    assert (nodes["concept:big-blue-engine"].kind, nodes["concept:big-blue-engine"].label, nodes["concept:big-blue-engine"].weight) == ("entity", "Big Blue Engine", 2.0)
    assert nodes["topic:beta"].weight == 2.5 and nodes["entity:ann-lee"].weight == 2.0 and "entity:nobody" not in nodes and "concept:hidden-name" not in nodes
    assert all(len([m for m in graph.mentions.collect() if m.chunk == c and not m.id.startswith("entity:")]) <= E.TOP for c in (1, 2, 3, 6))


def test_edges(graph):
    edges = {(r.a, r.b, r.kind): r for r in graph.edges.collect()}
    assert edges["concept:alpha-page", "concept:big-blue-engine", "cooccurs"].weight == 1.0
    told = edges["entity:ann-lee", "entity:bob", "llm-relation"]
    assert (told.weight, told.chunks, told.pages, told.routing_only) == (2.5, 2, 2, False)
    linked = [e for e in edges.values() if e.kind == "page-link"]
    assert linked and all(e.routing_only and e.weight == 0.75 and e.chunks == 4 and e.pages == 2 for e in linked if "topic:beta" in (e.a, e.b) and "alpha" in e.a + e.b)
    assert not any(e.a == e.b for e in edges.values()) and all(e.a < e.b for e in edges.values())


def test_boosts_reach_what_a_question_does_not_hit(spark, graph):
    lexical = spark.createDataFrame([(1, 2.0)], "chunk long, score double")
    walked = W.walk(E.seeds(graph, ["alpha", "page"], lexical), graph.edges.select("a", "b", "weight"))
    boosts = {r.chunk: r.boost for r in E.chunk_boosts(graph, walked, lexical).collect()}
    assert 1 not in boosts and boosts and all(0 < b <= 0.14 for b in boosts.values())
    assert E.seeds(graph, [], lexical.limit(0)).count() == 0


def test_supplements(spark):
    chunks = spark.createDataFrame([(4, "a"), (2, "a"), (9, "b"), (1, None)], "chunk long, page string")
    records = spark.createDataFrame([("a", 1, "k", "v"), ("a", 0, "j", None), ("c", 0, "x", "y"), (None, 0, "x", "y")], "page string, place int, key string, value string")
    assert [tuple(r) for r in E.supplements(records, chunks).collect()] == [(2, "j: \nk: v")]
    assert E.supplements(records.limit(0), chunks).count() == 0


def test_a_concept_that_every_chunk_names(spark):
    chunks = spark.range(3000).select(F.col("id").alias("chunk"), F.lit("p").alias("page"), F.lit("Common Title").alias("title"), F.lit("sources").alias("section"), F.lit("s").alias("slug"), F.array().cast("array<string>").alias("headings"), F.array().cast("array<string>").alias("links"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    none = spark.createDataFrame([], "from string, to string")
    made = E.build(chunks, none, none, spark.createDataFrame([], "page string, name string"), spark.createDataFrame([], "page string, source string, target string"))
    top = made.nodes.filter("id = 'topic:common-title'").first()
    assert (top.weight, top.chunks, top.pages) == (7500.0, 3000, 1) and made.edges.filter("a = 'concept:common' AND b = 'concept:title'").first().chunks == 3000
    empty = E.build(chunks.limit(0), none, none, spark.createDataFrame([], "page string, name string"), spark.createDataFrame([], "page string, source string, target string"))
    assert empty.nodes.count() == 0 and empty.edges.count() == 0
