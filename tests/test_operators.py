"""Operators on small literal tables: known results, nulls, ties and empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import numeric, text
from marlstone.operators import backtest, bars, dedup, knowledge, ledger, relational, retrieval
from marlstone.sources import files
from marlstone.streaming import suppression

DAY = datetime.date(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def evaluated(spark, closes, highs, lows, position="long", direction="up", stop=95.0, target=110.0, n=3):
    rows = [("c", DAY + datetime.timedelta(k), float(c), float(h), float(low)) for k, (c, h, low) in enumerate(zip([100, *closes], [100, *highs], [100, *lows], strict=True))]
    held = backtest.forward(spark.createDataFrame(rows, "code string, day date, close double, high double, low double"), n)
    asked = held.select("code", "day", F.col("close").alias("start"), F.lit(position).alias("position"), F.lit(direction).alias("direction"), F.lit(stop).alias("stop"), F.lit(target).alias("target"), "ahead")
    return backtest.evaluate(asked, n).orderBy("day").first()


@pytest.mark.parametrize(
    ("bar", "hit", "price"),
    [
        (((99, 98, 97), (101, 100, 99), (94, 97, 96)), "stop_loss", 95),
        (((105, 106, 107), (111, 107, 108), (103, 105, 106)), "take_profit", 110),
        (((100, 100, 100), (111, 100, 100), (94, 99, 99)), "ambiguous", 95),
        (((100, 100, 101), (101, 101, 101), (99, 99, 99)), "neither", 101),
    ],
)
def test_first_touch(spark, bar, hit, price):
    row = evaluated(spark, *bar)
    assert (row.status, row.first_hit, row.exit_price) == ("completed", hit, price)


def test_cash_and_flat_positions(spark):
    sell = evaluated(spark, (98, 97, 96), (99, 98, 97), (97, 96, 95), "cash", "down")
    assert (sell.outcome, sell.gain, sell.first_hit) == ("win", 0.0, "not_applicable")
    wait = evaluated(spark, (98, 96, 95), (99, 98, 97), (97, 95, 94), "cash", "flat")
    assert (wait.outcome, wait.correct) == ("loss", False)
    assert evaluated(spark, (98,), (99,), (97,), n=3).status == "insufficient_data"


TRADES = [("s", 1, "a", "buy", 100.0, 10.1), ("s", 2, "b", "buy", 100.0, 20.1), ("s", 3, "c", "sell", 150.0, 29.9)]


def trades(spark, rows):
    return spark.createDataFrame([(s, DAY + datetime.timedelta(d), i, side, q, p) for s, d, i, side, q, p in rows], "symbol string, day date, id string, side string, qty double, price double")


def test_fifo_and_average_cost(spark):
    rows = ledger.fifo(trades(spark, TRADES)).orderBy("buy_id").collect()
    assert [(r.sell_id, r.buy_id, r.qty) for r in rows] == [("c", "a", 100.0), ("c", "b", 50.0)]
    assert sum(r.proceeds - r.cost for r in rows) == pytest.approx(2470)
    average = ledger.average_cost(trades(spark, TRADES)).first()
    assert (average.held, average.cost, average.realised) == (50.0, pytest.approx(50 * 15.1), pytest.approx(2220))
    assert ledger.fifo(trades(spark, [])).count() == 0


def test_oversold_symbols(spark):
    assert [r.symbol for r in ledger.oversold(trades(spark, [*TRADES, ("t", 1, "x", "sell", 1.0, 1.0), ("t", 2, "y", "buy", 1.0, 1.0)])).collect()] == ["t"]


def test_as_of_takes_the_latest_row_and_keeps_its_null(spark):
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 3, None), ("b", 5, 50.0)], "k string, t int, v double")
    left = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 9), ("a", 2)], "k string, at int")
    found = backtest.as_of(left, right, ["k"], "at", "t", ["v"]).collect()
    assert sorted((r.k, r["at"], r.t if r.t is not None else -1, r.v if r.v is not None else -1) for r in found) == [("a", 0, -1, -1), ("a", 1, 1, 10), ("a", 2, 1, 10), ("a", 2, 1, 10), ("a", 3, 3, -1), ("b", 4, -1, -1), ("c", 9, -1, -1)]


def test_indicators_without_change_or_loss(spark):
    rows = [(1, DAY + datetime.timedelta(k), 10.0 + (k if code else 0), 1) for code in (0, 1) for k in range(8)]
    rows = [(code, day, close, volume) for (_, day, close, volume), code in zip(rows, [0] * 8 + [1] * 8, strict=True)]
    found = bars.rsi(spark.createDataFrame(rows, "code int, day date, close double, volume int")).filter(F.col("day") == DAY + datetime.timedelta(7)).orderBy("code").collect()
    assert [r.rsi6 for r in found] == [50.0, 100.0] and [r.rsi12 for r in found] == [50.0, 50.0]


def test_bars_of_no_events(spark):
    none = spark.createDataFrame([], "user_id long, ts timestamp, value double, event_id long")
    assert bars.signal(bars.daily(none)).count() == 0


def test_text_functions(spark):
    assert value(spark, text.tokens(F.lit("The Café-bar, naïve42x of 日本語テスト and ok"))) == ["caf", "bar", "ve42x", "日本語テスト"]
    assert value(spark, text.canonical(F.lit("a  \r\nb\n\n\n\nc \n"))) == "a\nb\n\nc"
    assert value(spark, text.title_similarity(F.lit("A b c"), F.lit("c B d"))) == pytest.approx(0.5)
    assert value(spark, text.title_similarity(F.lit(""), F.lit("x"))) == 0.0
    assert value(spark, text.slug(F.lit("--!!"))) == "chunk" and value(spark, text.concept(F.lit("camelCase Word"))) == "camel-case-word"
    assert value(spark, text.readable(F.lit("<p>a &amp;lt; b</p><script>x</script><p>c</p>"))) == "a < b\nc"
    assert value(spark, text.redacted(F.lit("use sk-abcdefgh1 or MY_SECRET_TOKEN, not short"))) == "use [REDACTED] or [REDACTED], not short"
    assert value(spark, text.redacted(F.lit("xghp_12345678x ghp_12345678."), "of ghp_12345678")) == "x[REDACTED]x [REDACTED]."
    assert [(w.start, len(w.text)) for w in value(spark, text.windows(F.lit("x" * 1000), 512, 64))] == [(0, 512), (448, 512), (896, 104)]
    assert value(spark, text.windows(F.lit(""), 512, 64)) == []


def test_numbers(spark):
    assert value(spark, numeric.quantise(F.lit(2.5), 0)) == 3.0
    assert value(spark, numeric.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, numeric.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert value(spark, numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_retrieval_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta alpha")], "doc_id long, text string")
    found = retrieval.index(docs)
    assert (found.n, found.average) == (3, 5 / 3)
    assert [(r.doc_id, r.terms) for r in retrieval.bm25(found, ["alpha", "alpha", "gamma"]).collect()] == [(3, ["alpha"])]
    assert retrieval.bm25(found, []).count() == 0 and retrieval.bm25(retrieval.index(docs.limit(0)), ["alpha"]).count() == 0
    titles = docs.select("doc_id", F.lit("ALPHA").alias("title"))
    assert round(retrieval.bm25(found, ["alpha"], titles).first().score - retrieval.bm25(found, ["alpha"]).first().score, 6) == 0.25
    assert retrieval.evidence_budget(99) == (4, 6000) and retrieval.evidence_budget(5000) == (10, 30000) and retrieval.evidence_budget(6000, 0) == (1, 40000)


def test_title_pairs_are_those_of_all_pairs(spark):
    titles = ["a b c d", "a b c e", "b c d a", "x y", "x y z", "", "A B C D!", "q", "q"]
    found = dedup.title_pairs(spark.createDataFrame([(t,) for t in titles], "title string"), "title", 0.6)
    assert {(r.a, r.b) for r in found.collect()} == {("a b c d", "a b c e"), ("a b c d", "b c d a"), ("a b c e", "b c d a"), ("x y", "x y z")}


def test_relational(spark):
    links = spark.createDataFrame([("p/x",), ("x",), ("y",), ("z",)], "link string")
    pages = spark.createDataFrame([("p/x", "x"), ("q/y", "y"), ("r/y", "y")], "target string, slug string")
    assert {(r.link, r.status) for r in relational.resolve(links, pages, "link", "target", "slug").collect()} == {("p/x", "resolved"), ("x", "resolved"), ("y", "ambiguous"), ("z", "missing")}
    assert value(spark, relational.days_ago(F.lit("2 weeks ago"), F.lit("2024-01-15").cast("date"))) == DAY
    assert value(spark, relational.days_ago(F.lit("soon"), F.lit("2024-01-15").cast("date"))) is None


def test_heading_paths(spark):
    lines = [("d", k, t) for k, t in enumerate(["# A", "text", "## B", "#### C", "## D", "# E", "### F"])]
    found = knowledge.heading_paths(spark.createDataFrame(lines, "doc string, line int, text string"), "doc").orderBy("line").collect()
    assert [r.path for r in found] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"], ["E", "F"]]


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("证券代码,成交日期,买卖方向,成交数量,成交价格,手续费\n600519,20240102,买入,\"1,000\",10.5,3\n,20240102,买入,1,1,0\nX,bad,buy,1,1,0\nY,2024-01-03,hold,1,1,0\nZ,2024/01/03,S,2,3,\n")
    rows = sorted(map(tuple, files.trades_from_csv(spark, str(tmp_path / "t.csv")).collect()))
    assert rows == [("600519", datetime.date(2024, 1, 2), "buy", 1000.0, 10.5, 3.0, 0.0), ("Z", datetime.date(2024, 1, 3), "sell", 2.0, 3.0, 0.0, 0.0)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.md").write_text('---\ntitle: "My page"\ntags: x\n---\n# Head\n\nSome *bold* [link](http://x) text\n')
    (tmp_path / "m/b.txt").write_text("one\ntwo")
    page = {r.title: r.text for r in files.markdown(spark, str(tmp_path / "m")).collect()}
    assert page["My page"] == "Head Some bold link text" and "b" in page
    assert {(r.kind, r.lines) for r in files.manifest(spark, str(tmp_path / "m")).collect()} == {("md", 8), ("txt", 2)}


def test_suppression(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    events = spark.createDataFrame([("k", at(s), s) for s in (0, 50, 90, 110, 150, 220)], "k string, ts timestamp, id int")
    assert [r.id for r in suppression.ttl_dedup(events, ["k"], "ts", "id", 100).filter("sent").orderBy("id").collect()] == [0, 110, 220]
    calls = spark.createDataFrame([("s", at(s), s, s in (400, 401)) for s in (0, 1, 2, 3, 100, 400, 401)], "s string, ts timestamp, id int, ok boolean")
    assert [r.circuit for r in suppression.circuit(calls, "s", "ts", "id", "ok").orderBy("id").collect()] == ["passed", "passed", "passed", "rejected", "rejected", "passed", "passed"]
