"""Findings of the third round: rows that differed from their SQL, and work that grew faster than its input."""

import time

from pyspark.sql import functions as F


def plain_joined(a, b):
    for n in range(min(180, len(a), len(b)), 39, -1):
        if a[len(a) - n :] == b[:n]:
            return a + b[n:]
    return a + "\n\n" + b


def test_passages_are_joined_at_their_longest_overlap_in_little_time(spark):
    from marlstone.operators import policy

    letters = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(900))
    odd = [("a" * 100, "a" * 90), ("x" + "ab" * 80, "ab" * 30 + "c"), ("b" * 39, "b" * 39), ("q" * 200, "q" * 300), ("ab" * 50 + "b" * 45, "ab" * 22 + "b" * 50), ("k", "m" * 50), (letters[:512], letters[448:]), ("ü" * 60 + "é", "ü" * 60)]
    pairs = odd + [(letters[k % 97 : 512], letters[448:]) for k in range(20000)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").repartition(4).cache()
    rows.count()
    began = time.time()
    found = {r.k: r.x for r in rows.select("k", policy.joined_passages(F.col("a"), F.col("b")).alias("x")).collect()}
    took = time.time() - began
    assert found == {k: plain_joined(*p) for k, p in enumerate(pairs)}
    assert took < 6

def test_sentences_are_cut_once_for_all_their_contexts(spark):
    from marlstone.functions.text import sentences
    from marlstone.operators import policy

    text = " ".join(f"Sentence {k} stands here." for k in range(4000))
    rows = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    found = rows.select(F.explode(policy.sentence_contexts(sentences(F.col("t")), 1)).alias("c")).select("c.*").collect()
    assert [r.context for r in found[:2]] == ["Sentence 0 stands here. Sentence 1 stands here.", "Sentence 0 stands here. Sentence 1 stands here. Sentence 2 stands here."]
    assert len(found) == 4000 and time.time() - began < 4

def test_advice_at_no_price_is_evaluated_where_asked(spark):
    from marlstone.operators import backtest

    kind = "start double, position string, direction string, stop double, target double, ahead array<struct<day:int,high:double,low:double,close:double>>"
    rows = spark.createDataFrame([(0.0, "cash", "down", 0.0, 0.0, [(1, 5.0, 2.0, 3.0)])], kind)
    one = backtest.evaluate(rows, 1, priced=False).first()
    assert (one.status, one.change, one.outcome, one.gain, one.max_high) == ("completed", float("inf"), "loss", 0.0, 5.0)
    assert backtest.evaluate(rows, 1).first().status == "error"

def test_entities_end_with_a_semicolon():
    from marlstone.functions.articles import to_markdown

    assert to_markdown("<h1>A &amp; B&amp</h1>") == "# A & B&amp\n"
    assert to_markdown("<p>&lt;x&gt; &#39;y&#x27; R&D &copy</p>") == "<x> 'y' R&D &copy\n"

def test_a_close_after_none_is_a_change(spark, tmp_path):
    from datetime import datetime

    from marlstone.plans import reports

    events = [(1, 7, datetime(2024, 1, 1), 0.0), (2, 7, datetime(2024, 1, 2), 1.0), (3, 7, datetime(2024, 1, 3), 1.1)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [(str(r.day), r.alert) for r in reports.price_alerts(spark, str(tmp_path)).collect()] == [("2024-01-02", "change")]

def test_a_secret_may_follow_a_letter_that_is_not_ascii(spark):
    from marlstone.functions.text import redacted

    rows = spark.createDataFrame([("Ein FÜRSCHEINSCHACH!! Tag",), ("xABCDEFGHIJKLM ABCDEFGHIJKLMx",), ("ABCDEFGHIJKLM",)], "t string")
    assert [r.t for r in rows.select(redacted(F.col("t")).alias("t")).collect()] == ["Ein FÜ[REDACTED]!! Tag", "xABCDEFGHIJKLM ABCDEFGHIJKLMx", "[REDACTED]"]

def test_related_pages_are_counted_by_terms_not_held_against_each_other(spark):
    from marlstone.operators import catalog

    words = ["alpha", "beta", "gamma", "delta", "x99", "longest"]
    rows = [(k, words[k % 6], " ".join(words[j] for j in range(6) if (k >> j) & 1)) for k in range(64)] + [(None, "alpha", "beta gamma")]
    pages = spark.createDataFrame(rows, "id long, title string, text string")
    found = catalog.related(pages.filter("id % 4 = 0"), pages, "id", "title", "text")
    terms = {k: ({t, *body.split()}, {t}) for k, t, body in rows[:-1]}
    plain = {}
    for a in range(0, 64, 4):
        met = [(len(terms[a][0] & terms[b][0]) + len(terms[a][1] & terms[b][1]), b) for b in range(64) if a != b and (len(terms[a][0] & terms[b][0]) + len(terms[a][1] & terms[b][1]) >= 3 or {"x99", "longest"} & terms[a][0] & terms[b][0])]
        plain |= {(a, b): (n, place) for place, (n, b) in enumerate(sorted(met, key=lambda m: (-m[0], m[1]))[:3], 1)}
    assert {(r.id, r.other): (r.score, r.place) for r in found.collect()} == plain
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

def test_routes_deal_texts_once_and_shuffle_no_matches(spark):
    from marlstone.operators import routing

    texts = spark.createDataFrame([(1, "macro economics and deep learning", "macro"), (2, "deep learning", None), (3, None, "deep")], "key int, text string, focus string")
    profiles = spark.createDataFrame([("fin", "adjacent", "macro economics"), ("ml", "core", "deep learning"), ("ml", "negative", "macro")], "wiki string, kind string, phrase string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = routing.ranked(texts, "key", "text", "focus", profiles)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {(r.key, r.wiki): (r.score, r.terms, r.hint) for r in found.collect()} == {
            (1, "fin"): (3.1, ["economics", "macro", "macro economics"], "adjacent_family"), (1, "ml"): (0.0, ["deep", "deep learning", "learning"], "unrelated"), (2, "ml"): (5.2, ["deep", "deep learning", "learning"], "same_scheme"),
        }
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan

def test_advice_is_searched_once_for_each_intent(spark):
    from marlstone.operators import advice

    texts = ["Do not sell; hold", "wait, then buy", "\U0001f600 buy", "buy", "", None, "建议买入", "never sell. Reduce"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(advice.intent_place(F.col("t"), "bullish").alias("place"), advice.direction(F.col("t")).alias("d"), advice.position(F.col("t")).alias("p")).collect()
    assert [r.place for r in found] == [None, 12, 3, 1, None, None, 3, None]
    assert [(r.d, r.p) for r in found[:2]] == [("not_down", "long"), ("flat", "cash")]
    plan = rows.select(advice.stance(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("regexp_extract(") == len(advice.INTENTS)
