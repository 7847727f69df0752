"""Grouped summaries: sessions, usage, votes, calibration, indexes of topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise, ratio


def sessions(turns: DataFrame, session: str, turn: str, role: str, text: str, n: int = 60) -> DataFrame:
    """(session, messages, first, last, title): the title is the start of the first user message; one shuffle of partial aggregates."""
    user = F.col(role) == "user"
    return turns.groupBy(session).agg(
        F.count("*").alias("messages"), F.min(turn).alias("first"), F.max(turn).alias("last"), F.min_by(F.when(user, F.substring(text, 1, n)), F.when(user, F.col(turn))).alias("title")
    )


def usage(calls: DataFrame, levels: list[str], measures: list[str]) -> DataFrame:
    """Calls and summed measures over all and by each level, in one pass over grouping sets; `level` names the level."""
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
    sets = [[], *[[F.col(x)] for x in levels]]
    grouped = calls.groupingSets(sets, *levels).agg(F.grouping_id().alias("_id"), F.count("*").alias("calls"), *sums)
    full = (1 << len(levels)) - 1
    level = F.when(F.col("_id") == full, "all")
    for k, name in enumerate(levels):
        level = level.when(F.col("_id") == full - (1 << (len(levels) - 1 - k)), name)
    return grouped.select(level.alias("level"), F.coalesce(*levels, F.lit("all")).alias("value"), "calls", *measures)


def histogram(rows: DataFrame, value: Column, empty: str = "(none)") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(empty)).alias("value")).agg(F.count("*").alias("n"))


def weights(results: DataFrame, by: str, won: Column, least: int) -> DataFrame:
    """(by, samples, win_rate, weight): half plus the win rate where there are enough samples, else 1."""
    n, wins = F.count("*"), F.count_if(won)
    rate = ratio(wins, n)
    return results.groupBy(by).agg(n.alias("samples"), quantise(rate, 4).alias("win_rate"), F.when(n >= least, quantise(0.5 + rate, 4)).otherwise(1.0).alias("weight"))


def calibrated(results: DataFrame, by: str, won: Column, least: int, confidence: float = 0.6) -> DataFrame:
    """(by, factor): win rate over the mean confidence, between one half and one and a half; 1 for few samples."""
    rate = ratio(F.count_if(won), F.count("*"))
    return results.groupBy(by).agg(F.when(F.count("*") >= least, quantise(F.least(F.lit(1.5), F.greatest(F.lit(0.5), rate / confidence)), 4)).otherwise(1.0).alias("factor"))


def consensus(votes: DataFrame, by: str, score: str, weight: str) -> DataFrame:
    """(by, consensus, signal): the weighted mean of scores, in whole units of a millionth so that order doesn't matter."""
    unit = lambda c: F.floor(c * 1e6 + 0.5).cast("decimal(24,0)")
    mean = ratio(F.sum(unit(F.col(score) * F.col(weight))).cast("double"), F.sum(unit(F.col(weight))).cast("double"))
    found = votes.groupBy(by).agg(quantise(mean, 4).alias("consensus"))
    c = F.col("consensus")
    return found.withColumn("signal", F.when(c >= 4.5, "strong_buy").when(c >= 3.5, "buy").when(c >= 2.5, "hold").when(c >= 1.5, "sell").otherwise("strong_sell"))


def temperature(breadth: DataFrame) -> DataFrame:
    """breadth (up, down, flat, limit_up, limit_down) with a temperature of 0 to 100: whole points of each part, weighted."""
    moved = F.col("up") + F.col("down") + F.col("flat")
    part = F.coalesce(ratio(F.col("up"), moved), F.lit(0.5)) * 100
    limits = F.coalesce(ratio(F.col("limit_up"), F.col("limit_up") + F.col("limit_down")), F.lit(0.5)) * 100
    return breadth.withColumn("temperature", F.bround(0.6 * part.cast("int") + 0.4 * limits.cast("int")).cast("int"))
