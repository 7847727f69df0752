"""Routes of texts to wikis and domains of questions, on cases worked out by hand."""

from pyspark.sql import functions as F

from marlstone.operators import routing as G

PROFILES = [
    ("fin", "core", "stock market analysis"), ("fin", "alias", "fin"), ("fin", "alias", "Equity Research"), ("fin", "adjacent", "macro economics"), ("fin", "negative", "cooking recipes"),
    ("ml", "core", "deep learning"), ("ml", "core", "model"), ("ml", "alias", "ml"), ("ml", "adjacent", "statistics"), ("ml", "negative", "stock"), ("none", "core", None), ("none", None, "x"), ("none", "core", "the"),
]


def routes(spark, *texts):
    rows = spark.createDataFrame([(k, t, f, 1) for k, (t, f) in enumerate(texts)], "key int, text string, focus string, score int")
    found = G.ranked(rows, "key", "text", "focus", spark.createDataFrame(PROFILES, "wiki string, kind string, phrase string")).collect()
    return {(r.key, r.wiki): r for r in found}


def test_routes(spark):
    far = " filler" * 5000
    found = routes(spark, (f"{far} Stock-Market analysis!{far}", "stock"), ("deep learning models and a stock", "deep"), ("macro economic things", "macro"), ("cooking recipes about the stock market analysis", ""), (None, None), ("stock marketanalysis", "x"))
    a = found[0, "fin"]
    assert (a.score, a.quality, a.hint) == (7.4, "strong", "same_scheme") and a.terms == ["analysis", "market", "stock", "stock market analysis"]
    assert (found[0, "ml"].score, found[0, "ml"].quality, found[0, "ml"].hint, found[0, "ml"].negatives) == (0.0, "none", "unrelated", ["stock"])
    # the phrase (5), generic words deep, learning and model (0.1 each), less the phrase and the word stock (4 and 2)
    assert (found[1, "ml"].score, found[1, "ml"].quality) == (0.0, "none") and found[1, "fin"].score == 0.8 and found[1, "fin"].hint == "generic_overlap"
    assert found[2, "fin"].score == 0.3 and found[2, "fin"].quality == "weak"  # macro only: economics isn't a form of economic
    assert found[3, "fin"].score == max(0, 7.4 - 4 - 4) and (4, "fin") not in found and found[5, "fin"].score == 0.8
    assert [found[1, w].place for w in ("fin", "ml")] == [1, 2] and not any(w == "none" for _, w in found)
    assert G.matches(spark.createDataFrame([(1, "x")], "key int, text string"), "key", "text", spark.createDataFrame([], "wiki string, kind string, phrase string")).count() == 0


def test_domains_and_fits(spark):
    profiles = spark.createDataFrame(
        [("cook", ["recipe"], ["oven", "salt"], ["time", "best"], ["law"], ["pasta"]), ("law", ["court"], ["judge", "act"], ["best", "time"], ["cook", "gone"], []), ("void", None, None, None, None, None)],
        "domain string, core array<string>, support array<string>, generic array<string>, negative array<string>, focus array<string>",
    )
    asked = [("A RECIPE, for pasta", "t", "recipe with salt"), ("oven", "t", "x"), ("oven best time", "t", "court"), ("compare recipe and court", "t", "court recipe"), (None, None, None), ("recipe oven salt court", "t", "pasta recipe")]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(asked)], "k int, q string, title string, said string")
    found = {r.k: r for r in G.evidence_fit(G.intents(rows, "q", profiles), F.col("title"), F.col("said")).collect()}
    assert found[0].dominant == ["cook"] and found[0].focused == ["cook"] and [(x.domain, x.score) for x in found[0].scores] == [("cook", 0.75), ("law", 0.0), ("void", 0.0)]
    assert (found[0].fit.positive, found[0].fit.negative, found[0].fit.margin, found[0].fit.strong) == (0.55, 0.35, 0.2, False)
    assert found[1].dominant == [] and (found[1].fit.domain, found[1].fit.score, found[1].fit.strong) == (None, 0.5, True)
    assert found[2].dominant == ["cook"] and found[2].scores[0].score == 0.59 and found[2].fit.negative == 0.25 and found[2].fit.positive == 0.0
    assert found[3].crossing and found[3].dominant == ["cook", "law"] and found[4].dominant == [] and not found[4].crossing
    assert found[5].dominant == ["cook"] and found[5].scores[0].score == 1.0  # law has 0.75, too far behind
    assert G.intents(rows.limit(0), "q", profiles).count() == 0
