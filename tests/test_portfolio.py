"""Portfolios: the figures of a small account by both methods, foreign money, missing prices and rates."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.operators import portfolio as P

TRADES = "account long, symbol string, currency string, day date, id string, side string, qty double, price double, fee double, tax double"
RATES = "from string, to string, since date, rate double"
D = datetime.date


def of(spark, trades, moves, prices, rates=(), method="fifo", day="2024-02-01"):
    return (
        spark.createDataFrame(trades, TRADES), spark.createDataFrame(moves, "account long, currency string, day date, direction string, amount double"),
        spark.createDataFrame(prices, "symbol string, close double"), spark.createDataFrame(list(rates), RATES), F.lit("CNY"), F.lit(day).cast("date"), method,
    )


BOUGHT = [(1, "a", "CNY", D(2024, 1, 2), "1", "buy", 100.0, 10.0, 10.0, 0.0), (1, "a", "CNY", D(2024, 1, 3), "2", "buy", 100.0, 20.0, 10.0, 0.0), (1, "a", "CNY", D(2024, 1, 4), "3", "sell", 150.0, 30.0, 10.0, 5.0)]


@pytest.mark.parametrize(("method", "realised", "unrealised"), [("fifo", 2470.0, 245.0), ("average", 2220.0, 495.0)])
def test_both_methods_on_a_partial_sale(spark, method, realised, unrealised):
    row = P.snapshot(*of(spark, BOUGHT, [(1, "CNY", D(2024, 1, 1), "in", 100_000.0)], [("a", 25.0)], method=method)).first()
    assert (row.realised, row.unrealised) == (realised, unrealised)
    assert (row.value, row.fees, row.taxes, row.stale) == (1250.0, 30.0, 5.0, False)
    assert row.cash == 100_000 - 1010 - 2010 + 4485 and row.equity == row.cash + row.value


def test_foreign_money_and_what_is_missing(spark):
    trades = [(1, "a", "USD", D(2024, 1, 2), "1", "buy", 10.0, 5.0, 1.0, None), (1, "a", "USD", D(2024, 1, 9), "2", "sell", 5.0, 8.0, None, 0.0), (2, "b", "EUR", D(2024, 1, 2), "3", "buy", 1.0, 7.0, 0.0, 0.0), (1, "z", "CNY", D(2024, 3, 1), "4", "buy", 1.0, 1.0, 0.0, 0.0)]
    rates = [("USD", "CNY", D(2024, 1, 1), 7.0), ("USD", "CNY", D(2024, 1, 8), 6.0), ("CNY", "USD", D(2024, 1, 1), 99.0), ("USD", "CNY", D(2024, 2, 9), 1.0)]
    rows = {r.account: r for r in P.snapshot(*of(spark, trades, [], [("a", 10.0)], rates)).collect()}
    assert rows[1].cash == pytest.approx((-51 + 40) * 6) and rows[1].realised == pytest.approx((40 - 25.5) * 6) and rows[1].fees == pytest.approx(7)
    assert rows[1].value == 300 and rows[1].unrealised == pytest.approx((50 - 25.5) * 6) and not rows[1].stale
    assert rows[2].stale and rows[2].value == 0 and rows[2].unrealised == 0 and rows[2].cash == -7


def test_unknown_directions_are_errors(spark):
    with pytest.raises(Exception, match="direction"):
        P.snapshot(*of(spark, [], [(1, "CNY", D(2024, 1, 1), "sideways", 1.0)], [])).collect()


def test_empty_tables(spark):
    assert P.snapshot(*of(spark, [], [], [])).count() == 0
