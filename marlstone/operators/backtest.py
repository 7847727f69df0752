"""Joins in time and the evaluation of advice against the bars that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise, quotient, ratio


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its keys whose `since` isn't after `at`; null where there is none.

    Both sides are merged by key and time, and a running last value is carried over: one shuffle, and no row pairs. Of
    right rows with the same time the one with the greatest values counts. A null value of the latest row stays null.
    """
    tagged = right.select(*keys, F.col(since).alias("_at"), F.struct(F.col(since).alias("_since"), *values).alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    asked = left.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(tagged.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_left").isNotNull(), "_right").rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.unionByName(asked).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_left IS NOT NULL")
    return carried.select("_left.*", F.col(f"_right._since").alias(since), *(F.col(f"_right.{v}").alias(v) for v in values))


def forward(bars: DataFrame, n: int) -> DataFrame:
    """bars with an array of the next n bars of the code, in order, those without a day last; none without a code."""
    w = Window.partitionBy("code").orderBy(F.asc_nulls_last("day")).rowsBetween(1, n)
    ahead = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("day", "high", "low", "close"))).over(w)
    return bars.withColumn("ahead", ahead)


def outcome(change: Column, direction: Column, band: float) -> Column:
    """win, loss or neutral of a change in percent, for up, down, not_down and flat; null for null."""
    up = F.when(change >= band, "win").when(change <= -band, "loss").otherwise("neutral")
    down = F.when(change <= -band, "win").when(change >= band, "loss").otherwise("neutral")
    not_down = F.when(change >= 0, "win").when(change <= -band, "loss").otherwise("neutral")
    flat = F.when(F.abs(change) <= band, "win").otherwise("loss")
    return F.when(change.isNotNull(), F.when(direction == "up", up).when(direction == "down", down).when(direction == "not_down", not_down).otherwise(flat))


def evaluate(advice: DataFrame, n: int, band: float = 2.0, priced: bool = True) -> DataFrame:
    """Evaluates rows (start, position, direction, stop, target, ahead) on the first n bars ahead.

    Where stop and target are touched by one bar, the order within it is unknown: it is called ambiguous, and the exit is the
    stop. Rows with fewer bars ahead are insufficient_data, those without a positive start error; where `priced` is False, these
    are evaluated too, and what changes from 0 does so without end.
    """
    bars = F.slice("ahead", 1, n)
    end = F.get(bars, F.lit(n - 1))["close"]
    low_hit = lambda b: F.coalesce(b["low"] <= F.col("stop"), F.lit(False))
    high_hit = lambda b: F.coalesce(b["high"] >= F.col("target"), F.lit(False))
    touched = F.transform(bars, lambda b: low_hit(b) | high_hit(b))
    status = F.when(F.lit(priced) & ~F.coalesce(F.col("start") > 0, F.lit(False)), "error").when(F.size("ahead") < n, "insufficient_data").otherwise("completed")
    done = advice.withColumn("status", status).withColumn("hit", F.when(F.col("status") == "completed", F.array_position(touched, True).cast("int")))
    bar = F.when(F.col("hit") > 0, F.get("ahead", F.col("hit") - 1))
    done = done.withColumn("_bar", bar).withColumn("_low", low_hit(F.col("_bar"))).withColumn("_high", high_hit(F.col("_bar")))
    ok, long = F.col("status") == "completed", F.col("position") == "long"
    first = F.when(ok, F.when(~long, "not_applicable").when(F.col("hit") == 0, "neither").when(F.col("_low") & F.col("_high"), "ambiguous").when(F.col("_low"), "stop_loss").otherwise("take_profit"))
    done = done.withColumn("first_hit", first).withColumn("end_close", F.when(ok, end))
    exit_price = F.when(F.col("first_hit").isin("ambiguous", "stop_loss"), F.col("stop")).when(F.col("first_hit") == "take_profit", F.col("target")).when(F.col("first_hit") == "neither", F.col("end_close"))
    change = quotient(F.col("end_close") - F.col("start"), F.col("start")) * 100
    done = done.withColumn("change", change).withColumn("outcome", outcome(F.col("change"), F.col("direction"), abs(band)))
    gain = F.when(~long, 0.0).otherwise(quotient(exit_price - F.col("start"), F.col("start")) * 100)
    return done.select(
        "*", F.when(ok, F.array_max(F.transform(bars, lambda b: b["high"]))).alias("max_high"), F.when(ok, F.array_min(F.transform(bars, lambda b: b["low"]))).alias("min_low"),
        exit_price.alias("exit_price"), F.when(ok, gain).alias("gain"), F.when(ok & long & (F.col("hit") > 0), F.col("_bar.day")).alias("hit_day"), F.when(F.col("outcome") != "neutral", F.col("outcome") == "win").alias("correct"),
    ).drop("_bar", "_low", "_high")


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts, rates and mean returns of evaluated rows; rates over nothing are null."""
    done = F.col("status") == "completed"
    n = lambda test: F.count_if(F.coalesce(done & test, F.lit(False)))
    wins, losses = n(F.col("outcome") == "win"), n(F.col("outcome") == "loss")
    # returns are summed as integers of a millionth, so that the order of rows doesn't matter
    mean = lambda c: quantise(F.avg(F.when(done, F.floor(F.col(c) * 1e6 + 0.5).cast("decimal(20,0)"))).cast("double") / 1e6, 3)
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "insufficient_data").alias("insufficient"),
        n(F.col("position") == "long").alias("longs"), n(F.col("position") == "cash").alias("cash"), wins.alias("wins"), losses.alias("losses"), n(F.col("outcome") == "neutral").alias("neutrals"),
        quantise(ratio(wins, wins + losses) * 100, 2).alias("win_rate"), quantise(ratio(n(F.col("correct")), n(F.col("correct").isNotNull())) * 100, 2).alias("accuracy"),
        n(F.col("first_hit") == "stop_loss").alias("stops"), n(F.col("first_hit") == "take_profit").alias("targets"), n(F.col("first_hit") == "ambiguous").alias("ambiguous"),
        mean("change").alias("mean_change"), mean("gain").alias("mean_gain"),
    )
