"""Portfolios: positions with price and value, cash of a ledger, gains by sale, and the totals of accounts in their own money.

Trades are (account, symbol, currency, day, id, side, qty, price, fee, tax); what a trade costs or brings includes fee and tax.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import ledger as L
from marlstone.operators.backtest import as_of

_KEY = ("account", "symbol", "currency")


def net(trades: DataFrame) -> DataFrame:
    """trades as the ledger replays them, where a position is an account, a symbol and a currency, and the price holds fee and tax."""
    gross, costs = F.col("qty") * F.col("price"), F.coalesce("fee", F.lit(0.0)) + F.coalesce("tax", F.lit(0.0))
    unit = F.when(F.col("side") == "sell", gross - costs).otherwise(gross + costs) / F.col("qty")
    return trades.select(F.struct(*_KEY).alias("symbol"), "day", "id", "side", "qty", unit.alias("price"))


def positions(trades: DataFrame, method: str = "fifo") -> DataFrame:
    """(account, symbol, currency, held, cost) of what is still held, by first in first out or at average cost (`average`)."""
    rows = net(trades)
    if method == "average":
        found = L.average_cost(rows).select("symbol", "held", "cost")
    else:
        taken = L.fifo(rows).groupBy("symbol", F.col("buy_id").alias("id")).agg(F.sum("qty").alias("taken"))
        left = F.col("qty") - F.coalesce("taken", F.lit(0.0))
        lots = rows.filter("side = 'buy'").join(taken, ["symbol", "id"], "left").select("symbol", left.alias("held"), (left * F.col("price")).alias("cost"))
        found = lots.filter(F.col("held") > L.EPS).groupBy("symbol").agg(F.sum("held").alias("held"), F.sum("cost").alias("cost"))
    return found.filter(F.col("held") > L.EPS).select("symbol.*", "held", "cost")


def gains(trades: DataFrame, method: str = "fifo") -> DataFrame:
    """(account, symbol, currency, day, gain) of each sale."""
    rows = net(trades)
    if method == "average":
        before = F.lag("realised", 1, 0.0).over(Window.partitionBy("symbol").orderBy("day", "id"))
        found = L.average_costs(rows).withColumn("gain", F.col("realised") - before).filter("side = 'sell'")
    else:
        found = L.fifo(rows).groupBy("symbol", "sell_id", F.col("sell_day").alias("day")).agg((F.sum("proceeds") - F.sum("cost")).alias("gain"))
    return found.select("symbol.*", "day", "gain")


def cash(trades: DataFrame, moves: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """(account, currency, balance): trades, what is paid in or out (account, currency, direction, amount), and dividends (account, currency, amount)."""
    gross, costs = F.col("qty") * F.col("price"), F.coalesce("fee", F.lit(0.0)) + F.coalesce("tax", F.lit(0.0))
    parts = trades.select("account", "currency", F.when(F.col("side") == "sell", gross - costs).otherwise(-(gross + costs)).alias("amount"))
    known = F.when(F.col("direction") == "in", F.col("amount")).when(F.col("direction") == "out", -F.col("amount")).otherwise(F.raise_error(F.lit("a direction is in or out")).cast("double"))
    parts = parts.unionByName(moves.select("account", "currency", known.alias("amount")))
    if paid is not None:
        parts = parts.unionByName(paid.select("account", "currency", "amount"))
    return parts.groupBy("account", "currency").agg(F.sum("amount").alias("balance"))


def in_money(rows: DataFrame, rates: DataFrame, amount: str, source: Column, target: Column, at: Column) -> DataFrame:
    """rows with `converted` and `stale`: an amount at the last rate (from, to, since, rate) of its day, else one over the last inverse, else as it is.

    Rates are sought once for each pair and day there is, not for each row, so that a common pair is no hot key.
    """
    named = rows.withColumn("_from", source).withColumn("_to", target).withColumn("_day", at)
    asked = named.select("_from", "_to", "_day").distinct()
    direct = as_of(asked, rates.select(F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("since").alias("_since1"), F.col("rate").alias("_rate")), ["_from", "_to"], "_day", "_since1", ["_rate"])
    turned = rates.select(F.col("to").alias("_from"), F.col("from").alias("_to"), F.col("since").alias("_since2"), F.col("rate").alias("_inverse"))
    known = as_of(direct.drop("_since1"), turned, ["_from", "_to"], "_day", "_since2", ["_inverse"]).select(F.col("_from").alias("_f"), F.col("_to").alias("_t"), F.col("_day").alias("_d"), "_rate", "_inverse")
    joined = named.join(known, F.col("_from").eqNullSafe(F.col("_f")) & F.col("_to").eqNullSafe(F.col("_t")) & F.col("_day").eqNullSafe(F.col("_d")), "left")
    value, stale = L.converted(F.col(amount), F.col("_from") == F.col("_to"), F.col("_rate"), F.col("_inverse"))
    return joined.select(*rows.columns, value.alias("converted"), stale.alias("stale"))


def valued(held: DataFrame, prices: DataFrame, rates: DataFrame, base: Column, day: Column) -> DataFrame:
    """positions with `price`, `average`, `value` and `book` in the account's money, `unrealised`, `percent` and `stale`; prices are (symbol, close).

    A position without a price has no value, and counts no cost.
    """
    priced = held.join(prices.select("symbol", F.col("close").alias("price")), "symbol", "left")
    priced = priced.withColumn("_value", F.coalesce(F.col("held") * F.col("price"), F.lit(0.0))).withColumn("_book", F.when(F.col("price").isNotNull(), F.col("cost")).otherwise(0.0))
    value = in_money(priced, rates, "_value", F.col("currency"), base, day).withColumnRenamed("converted", "value").withColumnRenamed("stale", "_stale")
    book = in_money(value, rates, "_book", F.col("currency"), base, day).withColumnRenamed("converted", "book")
    gained = F.col("value") - F.col("book")
    return book.select(
        "account", "symbol", "currency", "held", (F.col("cost") / F.col("held")).alias("average"), "cost", "price", "value", "book", gained.alias("unrealised"),
        F.when(F.abs("book") > L.EPS, gained / F.nullif(F.col("book"), F.lit(0.0)) * 100).alias("percent"), (F.col("_stale") | F.col("stale")).alias("stale"),
    )


def snapshot(trades: DataFrame, moves: DataFrame, prices: DataFrame, rates: DataFrame, base: Column, day: Column, method: str = "fifo", unit: int = 10_000) -> DataFrame:
    """(account, cash, value, equity, realised, unrealised, fees, taxes, stale) of each account in its own money, on a day.

    A sale's gain, fee and tax are converted at the rates of their day, balances and values at those of the snapshot's. Amounts are
    summed in whole units, so that the order of rows doesn't matter.
    """
    trades, moves = trades.filter(F.col("day") <= day), moves.filter(F.col("day") <= day)
    columns = ("cash", "value", "book", "realised", "fees", "taxes")

    def amounts(rows: DataFrame, name: str) -> DataFrame:
        whole = F.floor(F.col("converted") * unit + 0.5).cast("decimal(24,0)")
        return rows.select("account", *((whole if c == name else F.lit(0).cast("decimal(24,0)")).alias(c) for c in columns), "stale")

    held = valued(positions(trades, method), prices, rates, base, day)
    zero = F.lit(0).cast("decimal(24,0)")
    whole = lambda c: F.floor(F.col(c) * unit + 0.5).cast("decimal(24,0)")
    parts = held.select("account", zero.alias("cash"), whole("value").alias("value"), whole("book").alias("book"), *(zero.alias(c) for c in columns[3:]), "stale")
    for name, rows, amount, at in (("cash", cash(trades, moves), "balance", day), ("realised", gains(trades, method), "gain", F.col("day")), ("fees", trades, "fee", F.col("day")), ("taxes", trades, "tax", F.col("day"))):
        some = rows.select("account", "currency", F.coalesce(F.col(amount), F.lit(0.0)).alias("amount"), *(["day"] if name != "cash" else []))
        parts = parts.unionByName(amounts(in_money(some, rates, "amount", F.col("currency"), base, at), name))
    summed = parts.groupBy("account").agg(*(F.sum(c).alias(c) for c in columns), F.bool_or("stale").alias("stale"))
    money = lambda c: (c.cast("double") / unit)
    return summed.select(
        "account", money(F.col("cash")).alias("cash"), money(F.col("value")).alias("value"), money(F.col("cash") + F.col("value")).alias("equity"), money(F.col("realised")).alias("realised"),
        money(F.col("value") - F.col("book")).alias("unrealised"), money(F.col("fees")).alias("fees"), money(F.col("taxes")).alias("taxes"), "stale",
    )
