"""Replay of trades (symbol, day, id, side, qty, price): lots first in first out, average cost, positions, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise
from marlstone.operators.folds import fold

EPS = 1e-8


def running(trades: DataFrame) -> DataFrame:
    """trades with the quantity held after each; sells count against buys of the same symbol before them."""
    w = Window.partitionBy("symbol").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("held", F.sum(F.when(F.col("side") == "sell", -F.col("qty")).otherwise(F.col("qty"))).over(w))


def oversold(trades: DataFrame) -> DataFrame:
    """Symbols that are sold beyond what is held at some time; their lots can't be matched."""
    return running(trades).groupBy("symbol").agg(F.min("held").alias("lowest")).filter(F.col("lowest") < -EPS)


def judged(trades: DataFrame) -> DataFrame:
    """trades with `status` and `held` after each: a sale of more than is held is refused, whole, and changes nothing; all else is accepted.

    Whether a sale is refused hangs on those before it, which no window can express: symbols are streamed in order, never held whole.
    """

    def step(held: float, side: str | None, qty: float | None) -> tuple[float, tuple]:
        n = qty or 0.0
        if side == "sell" and n > held + EPS:
            return held, ("refused", held)
        held += -n if side == "sell" else n
        return held, ("accepted", held)

    rows = trades.select("symbol", "day", "id", "side", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    return fold(rows, ["symbol"], ["day", "id"], ["side", "qty"], float, step, "status string, held double")


def accepted(trades: DataFrame) -> DataFrame:
    """trades without refused sales: what fifo and average_cost replay."""
    return judged(trades).filter("status = 'accepted'").drop("status", "held")


def fifo(trades: DataFrame) -> DataFrame:
    """(symbol, sell_id, sell_day, buy_id, qty, cost, proceeds): which lot each sale took how much of.

    Buys and sales of a symbol are stretches of cumulative quantity; where a sale's stretch overlaps a lot's, it takes
    from it. Merged by their ends and sorted, each stretch between ends belongs to one lot and one sale: a window, not
    a join of pairs. Oversold symbols must be left out before.
    """
    w = Window.partitionBy("symbol", "side").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, 0)
    ends = trades.withColumn("end", F.sum("qty").over(w))
    by_end = Window.partitionBy("symbol").orderBy("end", F.col("side").desc(), "day", "id")
    backwards = Window.partitionBy("symbol").orderBy(F.desc("end"), "side", F.desc("day"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)  # running, where a frame that looks ahead is quadratic
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    cut = ends.select(
        "symbol", (F.col("end") - F.coalesce(F.lag("end").over(by_end), F.lit(0.0))).alias("qty"),
        F.last(F.when(buy, F.struct("id", "price")), ignorenulls=True).over(backwards).alias("lot"), F.last(F.when(sell, F.struct("id", "price", "day")), ignorenulls=True).over(backwards).alias("sale"),
    ).filter((F.col("qty") > EPS) & F.col("lot").isNotNull() & F.col("sale").isNotNull())
    return cut.select("symbol", F.col("sale.id").alias("sell_id"), F.col("sale.day").alias("sell_day"), F.col("lot.id").alias("buy_id"), "qty", (F.col("qty") * F.col("lot.price")).alias("cost"), (F.col("qty") * F.col("sale.price")).alias("proceeds"))


def average_costs(trades: DataFrame) -> DataFrame:
    """trades with `held`, `cost` and `realised` after each, at average cost: a fold in order, streamed by symbol."""

    def step(state: tuple, side: str, qty: float, price: float) -> tuple[tuple, tuple]:
        held, cost, realised = state
        if side == "sell":
            average = cost / held if held > EPS else 0.0
            state = held - qty, cost - average * qty, realised + (price - average) * qty
        else:
            state = held + qty, cost + qty * price, realised
        return state, state

    return fold(trades.select("symbol", "day", "id", "side", "qty", "price"), ["symbol"], ["day", "id"], ["side", "qty", "price"], lambda: (0.0, 0.0, 0.0), step, "held double, cost double, realised double")


def average_cost(trades: DataFrame) -> DataFrame:
    """(symbol, held, cost, realised) at average cost after a symbol's last trade."""
    last = F.max_by(F.struct("held", "cost", "realised"), F.struct("day", "id"))
    return average_costs(trades).groupBy("symbol").agg(last.alias("r")).select("symbol", "r.*")


def with_actions(trades: DataFrame, actions: DataFrame) -> DataFrame:
    """All events of trades and of actions (symbol, day, id, ratio, per_share) with `factor`, `before` and `cash`.

    factor is how many shares of the end a share of the event's time became by later splits; before is what was held then, in
    shares of that time; cash is what a dividend paid on it. A day's actions come before its trades. A ratio that isn't above 0 is
    an error where there is one; a null ratio or per_share is none. Two running windows share one shuffle by symbol.
    """
    ratio = F.when(F.col("ratio").isNull(), 1.0).when(F.col("ratio") > 0, F.col("ratio")).otherwise(F.raise_error(F.lit("a split's ratio must be above 0")).cast("double"))
    traded = trades.select("symbol", "day", F.lit(1).alias("kind"), "id", "side", "qty", "price", F.lit(1.0).alias("ratio"), F.lit(0.0).alias("per_share"))
    acted = actions.select("symbol", "day", F.lit(0).alias("kind"), "id", *(F.lit(None).cast(t).alias(c) for c, t in (("side", "string"), ("qty", "double"), ("price", "double"))), ratio.alias("ratio"), F.coalesce("per_share", F.lit(0.0)).alias("per_share"))
    before = Window.unboundedPreceding, -1
    later = Window.partitionBy("symbol").orderBy(F.desc("day"), F.desc("kind"), F.desc("id")).rowsBetween(*before)
    earlier = Window.partitionBy("symbol").orderBy("day", "kind", "id").rowsBetween(*before)
    events = traded.unionByName(acted).withColumn("factor", F.coalesce(F.product("ratio").over(later), F.lit(1.0)))
    signed = F.when(F.col("side") == "sell", -F.col("qty")).when(F.col("side") == "buy", F.col("qty")).otherwise(0.0) * F.col("factor")
    held = events.withColumn("before", F.coalesce(F.sum(signed).over(earlier), F.lit(0.0)) / (F.col("factor") * F.col("ratio")))
    return held.withColumn("cash", F.when((F.col("per_share") > 0) & (F.col("before") > EPS), F.col("before") * F.col("per_share")).otherwise(0.0))


def split_adjusted(trades: DataFrame, actions: DataFrame) -> DataFrame:
    """trades in shares of the end, so that fifo, average_cost and available hold across splits."""
    return with_actions(trades, actions).filter("kind = 1").select("symbol", "day", "id", "side", (F.col("qty") * F.col("factor")).alias("qty"), (F.col("price") / F.col("factor")).alias("price"))


def available(trades: DataFrame) -> DataFrame:
    """(symbol, held) after all trades."""
    return trades.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "sell", -F.col("qty")).otherwise(F.col("qty"))).alias("held"))


def concentration(values: DataFrame, by: str, value: str = "value", alert: float = 5.0, n: int = 10) -> DataFrame:
    """The n largest groups by summed value, their weight in percent of all, and whether it is an alert.

    The total comes from the groups' sums, so rows are read and shuffled once.
    """
    summed = values.groupBy(by).agg(F.sum(F.col(value).cast("decimal(20,2)")).alias("value"))
    total = summed.agg(F.sum("value")).first()[0] or 0
    weight = F.when(F.lit(total) != 0, F.col("value").cast("double") / float(total) * 100).otherwise(0.0)
    return summed.select(by, F.col("value").cast("double").alias("value"), quantise(weight, 4).alias("weight"), (weight >= alert).alias("alert")).orderBy(F.desc("value"), by).limit(n)


def converted(amount: Column, same: Column, rate: Column, inverse: Column) -> tuple[Column, Column]:
    """An amount at the direct rate, else at one over the inverse, else as it is; and whether that last is so, which makes it stale."""
    none = F.abs(amount) <= EPS
    factor = F.when(same, 1.0).when(rate > 0, rate).when(inverse > 0, 1 / inverse)
    return F.when(none, 0.0).otherwise(amount * F.coalesce(factor, F.lit(1.0))), ~none & factor.isNull()


def convert(amounts: DataFrame) -> DataFrame:
    """amounts (amount, from, to, rate, inverse) with `converted` and `stale`."""
    value, stale = converted(F.col("amount"), F.col("from") == F.col("to"), F.col("rate"), F.col("inverse"))
    return amounts.withColumn("converted", value).withColumn("stale", stale)
