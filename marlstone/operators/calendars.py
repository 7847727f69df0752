"""Trading calendars as tables of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The time zones of markets.
ZONES = {"cn": "Asia/Shanghai", "hk": "Asia/Hong_Kong", "us": "America/New_York"}
#: Days for which a calendar's last session stays the latest.
STALE = 31


def local_date(at: Column, market: Column) -> Column:
    """The date at a market; that of UTC for unknown ones."""
    out = F.to_date(at)
    for name, zone in ZONES.items():
        out = F.when(market == name, F.to_date(F.from_utc_timestamp(at, zone))).otherwise(out)
    return out


def effective_dates(asked: DataFrame, sessions: DataFrame, market: str = "market", at: str = "at") -> DataFrame:
    """asked with `effective`, the day of the market's last session that had closed by then.

    sessions is (market, day, close), close a time in UTC as is asked's. Where the calendar knows no session, or ended more
    than STALE days before, it is the market's own date; null for a null time. A session is laid out over the days until the next
    close, so that rows meet on market and day: an equality join that spreads, where a sort by market would make a task each.
    """
    following = F.lead("close").over(Window.partitionBy("market").orderBy("close"))
    lasting = sessions.select("market", "day", "close", F.coalesce(following, F.col("close") + F.make_interval(days=F.lit(STALE))).alias("until")).filter("until > close")
    laid = lasting.select(F.col("market").alias("_market"), F.explode(F.sequence(F.to_date("close"), F.to_date("until"))).alias("_on"), F.col("day").alias("_day"), F.col("close").alias("_close"), F.col("until").alias("_until"))
    met = (F.col(market) == F.col("_market")) & (F.to_date(at) == F.col("_on")) & (F.col(at) >= F.col("_close")) & (F.col(at) < F.col("_until"))
    return asked.join(laid, met, "left").select(asked["*"], F.coalesce("_day", local_date(F.col(at), F.coalesce(market, F.lit("")))).alias("effective"))
