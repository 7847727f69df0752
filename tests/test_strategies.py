"""Declared strategies: what each condition asks, what isn't known, and what is refused."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators.strategies import Condition as C
from marlstone.operators.strategies import signals, told


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("a", k, c, v) for k, (c, v) in enumerate([(1.0, 5.0), (3.0, 2.0), (2.0, 2.0), (None, 4.0), (5.0, 1.0)])] + [("b", 0, 9.0, None)]
    return spark.createDataFrame(rows, "code string, day int, close double, volume double").withColumn("strategy", F.lit("clash"))


@pytest.mark.parametrize("conditions, days", [
    ([C("s", "all", "close", ">", 2.0)], {("a", 1), ("a", 4), ("b", 0)}),
    ([C("s", "all", "close", ">=", 2.0), C("s", "all", "volume", "<=", 2.0)], {("a", 1), ("a", 2), ("a", 4)}),
    ([C("s", "any", "close", "=", 1.0), C("s", "any", "volume", "=", 4.0)], {("a", 0), ("a", 3)}),
    ([C("s", "all", "close", ">", other="close", other_back=1)], {("a", 1)}),
    ([C("s", "all", "close", ">", other="close", factor=2.0, value=-1.0, back=1, other_back=2)], {("a", 2)}),
    ([C("s", "all", "close", "crosses_above", other="volume")], {("a", 1)}),
    ([C("s", "all", "close", "crosses_above", other="volume", within=3)], {("a", 1), ("a", 2), ("a", 3)}),
    ([C("s", "all", "volume", "crosses_below", 3.0)], {("a", 1), ("a", 4)}),
    ([], set()),
])
def test_conditions(bars, conditions, days):
    found = signals(bars, conditions).filter("array_contains(strategies, 's')").select("code", "day").collect()
    assert {tuple(r) for r in found} == days


def test_several_strategies_in_order(bars):
    found = signals(bars, [C("z", "all", "close", ">", 0.0), C("a", "all", "volume", ">", 1.0), C("a", "any", "close", "=", 2.0)]).filter("day = 2").first()
    assert found.strategies == ["a", "z"] and found.strategy == "clash"


def test_refusals(bars):
    wrong = [C("s", "all", "open", ">", 1.0), C("s", "none", "close", "~", 1.0), C("t", "all", "close", ">", other="rsi"), C("t", "all", "close", ">", 1.0, back=-1)]
    with pytest.raises(ValueError, match="s: no field open; s: no test ~; s: no need none; t: no field rsi; t: bars to come"):
        signals(bars, wrong)


def test_told_by_a_table(spark, bars):
    rows = spark.createDataFrame([("s", "all", "close", ">", 2.0, None, None, None, None, None)], "strategy string, need string, field string, test string, value double, other string, factor double, back int, other_back int, within int")
    assert told(rows) == [C("s", "all", "close", ">", 2.0)]
    assert signals(bars.limit(0), told(rows)).count() == 0
