"""Confidence, claims, related sources and news against cases worked out by hand, with needles where a cut text would miss them."""

import pytest

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import catalog, lints, policy, relational

HIT = "query string, place int, lexical double, embedding double, graph double, taxonomy double, metadata double, rerank double, total double, raw boolean, reason string, card boolean"


def sure(spark, hits, modes, **more):
    rows = spark.createDataFrame([h for h in hits], HIT)
    asked = spark.createDataFrame(list(modes.items()), "query string, mode string")
    found = policy.confidence(asked, rows, "query", F.col("place"), F.col("raw"), F.col("reason"), F.col("card"), **more).collect()
    return {r["query"]: (r.score, r.level, r.low, r.reasons) for r in found}


def test_confidence_follows_the_rule(spark):
    one = ("a", 1, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, True, "lexical-coverage", False)
    assert sure(spark, [one], {"a": "matched"}) == {"a": (0.54, "medium", False, ["raw-evidence-backed", "query-coverage-supported"])}
    assert sure(spark, [one], {"a": "matched"}, threshold=0.8)["a"][2] is True
    with pytest.raises(ValueError, match="between 0 and 1"):
        sure(spark, [one], {"a": "matched"}, threshold=1.5)
    # a single hit without a raw source, with few signals, is weak whatever it scores
    assert sure(spark, [(*one[:9], False, *one[10:])], {"a": "matched"})["a"][2] is True
    strong = [("b", k, 1.0, 0.4, 0.1, 0.0, 0.05, 0.0, 1.2, False, "semantic-signal", k == 3) for k in (1, 2, 3)]
    assert sure(spark, strong, {"b": "matched"})["b"] == (0.6, "medium", False, ["strong-top-score", "multiple-supporting-hits", "multi-signal-retrieval", "query-coverage-supported", "boilerplate-penalty"])
    alone = [("c", 1, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.2, True, "semantic-signal", False)]
    score, level, low, reasons = sure(spark, alone, {"c": "matched"})["c"]
    assert (score, level, low) == (0.375, "low", False) and reasons == ["raw-evidence-backed", "query-coverage-supported", "embedding-only-penalty"]
    modes = sure(spark, [one], {"a": "overview", "f": "fallback", "s": "stale-index", "n": "no-match", "m": "matched"})
    assert modes["a"] == (0.35, "low", True, ["overview-fallback-not-answer-evidence"])
    assert modes["f"] == (0.0, "none", True, ["retrieval-index-unavailable"]) and modes["s"] == (0.0, "none", True, ["retrieval-index-stale"])
    assert modes["n"] == (0.0, "none", False, ["no-retrieval-hits"]) and modes["m"] == (0.0, "none", True, ["no-retrieval-hits"])
    weak = [("d", 1, 0.01, 0.0, 0.0, 0.0, 0.0, 0.0, 0.01, False, "x", False), ("d", 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, "x", False)]
    assert sure(spark, weak, {"d": "matched"})["d"][3] == ["weak-retrieval-signals"]


def test_link_stems(spark):
    words = {"cities": "city", "pies": "pies", "boxes": "boxe", "matches": "match", "axes": "axes", "logs": "logs", "model": "model", "models": "model", "bus": "bus"}
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.link_stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in found} == words


def test_related_sources_use_whole_texts(spark, monkeypatch):
    filler = " ".join(["of the a to"] * 400)
    rows = [(1, "x", f"{filler} zeta9"), (2, None, f"{filler} ZETA9s"), (3, "alpha beta gamm", ""), (4, "alpha beta", "gamm"), (5, "", None), (6, "one alpha", ""), (7, "alpha beta gamm", None)]
    pages = spark.createDataFrame(rows, "id long, title string, text string")
    monkeypatch.setattr(catalog, "BLOCK", 2)
    found = {(r.id, r.other): (r.score, r.place) for r in catalog.related(pages, pages, "id", "title", "text").collect()}
    assert found[1, 2] == (1, 1)  # by one term with a digit, at the end of long texts
    assert found[3, 7] == (6, 1) and found[3, 4] == (5, 2) and found[4, 3] == (5, 1) and (3, 6) not in found and not any(5 in k for k in found)
    same = spark.createDataFrame([(1, "", f"{filler} zeta9"), (2, "", f"{filler} zeta9")], "id long, title string, text string")
    assert catalog.related(same, same, "id", "title", "text").count() == 2 and catalog.related(same.limit(0), same, "id", "title", "text").count() == 0


def test_news_keys_tell_titles_sources_and_dates_apart(spark):
    rows = [
        (1, None, "A", "s", "2024-01-01", "old"), (2, "", " A ", "s", "2024-01-01", ""), (3, None, "A", "s", "2024-01-02", "x"), (4, None, "A", "t", "2024-01-01", "x"), (5, None, "B", "s", None, None), (6, None, "", "s", None, "x"),
        (7, " http://x ", None, None, None, "x"), (8, "http://x", "T", "s", None, "y"), (9, None, None, None, None, None),
    ]
    news = lints.news(spark.createDataFrame(rows, "id int, url string, title string, source string, published string, snippet string").withColumn("published", F.col("published").cast("date")), "url", F.lit("600519"), "title", "source", "published")
    keys = {r.id: r.key for r in news.collect()}
    assert set(keys) == {1, 2, 3, 4, 5, 7, 8} and keys[1] == keys[2] and keys[7] == keys[8] == "http://x" and len(set(keys.values())) == 5
    import hashlib

    assert keys[1] == "no-url:600519:" + hashlib.md5(b"600519|A|s|2024-01-01T00:00:00").hexdigest() and keys[5] == "no-url:600519:" + hashlib.md5(b"600519|B|s|").hexdigest()
    empty = news.limit(0).select("key", "title", "source", "snippet")
    first = relational.filled(empty, news.filter("id < 3"), "key", "id", ["title"], ["source", "snippet"])
    assert [(r.title, r.snippet, r.state) for r in first.collect()] == [("A", "old", "inserted")]
    after = {r.key: r for r in relational.filled(first.drop("state"), news.filter("id = 2 OR id >= 7"), "key", "id", ["title"], ["source", "snippet"]).collect()}
    assert (after[keys[1]].title, after[keys[1]].snippet, after[keys[1]].state) == ("A", "old", "updated")
    assert (after["http://x"].title, after["http://x"].source, after["http://x"].snippet, after["http://x"].state) == (None, "s", "y", "inserted")
