"""Indicators and states over daily bars (code, day, open, high, low, close, volume), all windows by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise
from marlstone.operators.folds import fold


def by_code():
    return Window.partitionBy("code").orderBy("day")


#: Fixed values of the signal score: points by state.
TREND_POINTS = {"strong_bull": 30, "bull": 26, "weak_bull": 18, "consolidation": 12, "weak_bear": 8, "bear": 4, "strong_bear": 0}
VOLUME_POINTS = {"shrink_down": 15, "heavy_up": 12, "normal": 10, "shrink_up": 6, "heavy_down": 0}
MACD_POINTS = {"golden_cross_zero": 15, "golden_cross": 12, "crossing_up": 10, "bullish": 8, "bearish": 2, "crossing_down": 0, "death_cross": 0}
RSI_POINTS = {"oversold": 10, "strong": 8, "neutral": 5, "weak": 3, "overbought": 0}
HEAVY, SHRINK, SUPPORT, BIAS = 1.5, 0.7, 0.02, 5.0


def daily(events: DataFrame, code: str = "user_id", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of a value by code and day. Partial aggregates go through the shuffle, not events."""
    at = F.struct(ts, tie)
    return events.groupBy(F.col(code).alias("code"), F.col(ts).cast("date").alias("day")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("volume")
    )


def mean(column: str, n: int, full: bool = False) -> Column:
    """Mean of the last n rows; null before there are n, if full."""
    w = by_code().rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) == n, F.avg(column).over(w)) if full else F.avg(column).over(w)


def clean(bars: DataFrame) -> DataFrame:
    """Days and numbers cast, rows without a close or volume dropped."""
    cast = bars.select("code", F.col("day").try_cast("date").alias("day"), *(F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")))
    return cast.dropna(subset=["close", "volume"])


def averages(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """bars with means of what rows there are, and the volume against the mean of the five days before."""
    before = F.avg("volume").over(by_code().rowsBetween(-5, -1))

    def cents(n: int) -> Column:
        """A mean of prices in cents: summed as integers, so that every engine gets the same."""
        w = by_code().rowsBetween(-(n - 1), 0)
        return F.sum(F.floor(F.col("close") * 100 + 0.5)).over(w) / (F.count("close").over(w) * 100.0)

    return bars.select("*", *(quantise(cents(n), 2).alias(f"ma{n}") for n in periods), F.when(before > 0, quantise(F.col("volume") / before, 2)).otherwise(1.0).alias("volume_ratio"))


def full_averages(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    return bars.select("*", *(mean("close", n, True).alias(f"ma{n}") for n in periods))


def rsi(bars: DataFrame, periods: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """bars with RSI from plain means of gains and losses; 50 without a full window or any change, 100 without losses."""
    moved = bars.withColumn("_delta", F.coalesce(F.col("close") - F.lag("close").over(by_code()), F.lit(0.0)))
    moved = moved.withColumn("_gain", F.greatest("_delta", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_delta"), F.lit(0.0)))

    def one(n: int) -> Column:
        gain, loss = mean("_gain", n, True), mean("_loss", n, True)
        return F.when(gain.isNull() | ((gain == 0) & (loss == 0)), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))

    return moved.select(*bars.columns, *(one(n).alias(f"rsi{n}") for n in periods))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """bars with dif, dea and bar: recursive averages of a code's closes in order, streamed; days without a close are skipped."""
    a, b, c = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)

    def step(state: tuple | None, close: float | None) -> tuple[tuple | None, tuple]:
        if close is None:
            return state, (None, None)
        if state is None:
            state = close, close, 0.0
        else:
            f, s = state[0] * (1 - a) + close * a, state[1] * (1 - b) + close * b
            state = f, s, state[2] * (1 - c) + (f - s) * c
        return state, (state[0] - state[1], state[2])

    return fold(bars, ["code"], ["day"], ["close"], lambda: None, step, "dif double, dea double").withColumn("bar", (F.col("dif") - F.col("dea")) * 2)


def trend(bars: DataFrame) -> DataFrame:
    """full_averages(bars) with the state of their order: strong ones spread by more than 5 %, and more than four rows before."""
    up = (F.col("ma5") - F.col("ma20")) / F.col("ma20") * 100
    down = (F.col("ma20") - F.col("ma5")) / F.col("ma5") * 100
    spread = bars.withColumn("_up", up).withColumn("_down", down)
    grown = lambda c: (F.col(c) > F.lag(c, 4).over(by_code())) & (F.col(c) > 5)
    m5, m10, m20 = F.col("ma5"), F.col("ma10"), F.col("ma20")
    state = (
        F.when(m20.isNull(), "consolidation")
        .when((m5 > m10) & (m10 > m20), F.when(F.coalesce(grown("_up"), F.lit(False)), "strong_bull").otherwise("bull"))
        .when(m5 > m10, "weak_bull")
        .when((m5 < m10) & (m10 < m20), F.when(F.coalesce(grown("_down"), F.lit(False)), "strong_bear").otherwise("bear"))
        .when(m5 < m10, "weak_bear")
        .otherwise("consolidation")
    )
    return spread.withColumn("trend", state).drop("_up", "_down")


def volume_state(bars: DataFrame) -> DataFrame:
    """bars with the volume against the five days before, and whether it is heavy or shrinks on a rise or fall."""
    ratio = F.col("volume") / F.avg("volume").over(by_code().rowsBetween(-5, -1))
    rise = F.col("close") > F.lag("close").over(by_code())
    state = F.when(F.col("ratio5") >= HEAVY, F.when(F.col("_rise"), "heavy_up").otherwise("heavy_down")).when(F.col("ratio5") <= SHRINK, F.when(F.col("_rise"), "shrink_up").otherwise("shrink_down")).otherwise("normal")
    return bars.withColumn("ratio5", ratio).withColumn("_rise", F.coalesce(rise, F.lit(False))).withColumn("volume_state", state).drop("_rise")


def macd_state(bars: DataFrame) -> DataFrame:
    now, before = F.col("dif") - F.col("dea"), F.lag(F.col("dif") - F.col("dea")).over(by_code())
    zero = F.lag("dif").over(by_code())
    crossed = bars.withColumn("_gold", (before <= 0) & (now > 0)).withColumn("_death", (before >= 0) & (now < 0)).withColumn("_up", (zero <= 0) & (F.col("dif") > 0)).withColumn("_down", (zero >= 0) & (F.col("dif") < 0))
    state = (
        F.when(F.col("_gold") & (F.col("dif") > 0), "golden_cross_zero").when(F.col("_up"), "crossing_up").when(F.col("_gold"), "golden_cross").when(F.col("_death"), "death_cross")
        .when(F.col("_down"), "crossing_down").when((F.col("dif") < 0) & (F.col("dea") < 0), "bearish").otherwise("bullish")
    )
    return crossed.withColumn("macd_state", state).drop("_gold", "_death", "_up", "_down")


def rsi_state(value: Column) -> Column:
    return F.when(value > 70, "overbought").when(value > 60, "strong").when(value >= 40, "neutral").when(value >= 30, "weak").otherwise("oversold")


def _points(state: Column, points: dict[str, int], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for name, value in points.items():
        out = F.when(state == name, value).otherwise(out)
    return out


def signal(bars: DataFrame) -> DataFrame:
    """Each bar's states, composite score of 100 and signal; days before the averages are full score as they can."""
    full = volume_state(trend(full_averages(macd_state(rsi(macd(bars))))))
    bias = F.coalesce((F.col("close") - F.col("ma5")) / F.col("ma5") * 100, F.lit(0.0))
    strong = F.col("trend") == "strong_bull"
    bias_points = F.when(bias < 0, F.when(bias > -3, 20).when(bias > -5, 16).otherwise(8)).when(bias < 2, 18).when(bias < BIAS, 14).when(bias > F.when(strong, BIAS * 1.5).otherwise(BIAS), 4).when((bias > BIAS) & strong, 10).otherwise(4)
    supported = lambda m: F.when((F.col("close") >= F.col(m)) & ((F.col("close") - F.col(m)) / F.col(m) <= SUPPORT), 5).otherwise(0)
    score = (
        _points(F.col("trend"), TREND_POINTS, 12) + bias_points + _points(F.col("volume_state"), VOLUME_POINTS, 8)
        + F.coalesce(supported("ma5"), F.lit(0)) + F.coalesce(supported("ma10"), F.lit(0)) + _points(F.col("macd_state"), MACD_POINTS, 5) + _points(rsi_state(F.col("rsi12")), RSI_POINTS, 5)
    )
    scored = full.withColumn("rsi_state", rsi_state(F.col("rsi12"))).withColumn("score", score)
    bull = F.col("trend").isin("strong_bull", "bull")
    advice = F.when((F.col("score") >= 75) & bull, "strong_buy").when((F.col("score") >= 60) & (bull | (F.col("trend") == "weak_bull")), "buy").when(F.col("score") >= 45, "hold").when(F.col("score") >= 30, "wait").when(F.col("trend").isin("bear", "strong_bear"), "strong_sell").otherwise("sell")
    return scored.withColumn("signal", advice)


def patterns(bars: DataFrame) -> DataFrame:
    """(code, day, pattern) of candles: doji, hammer, shooting star, engulfing, and closes out of the range of 19 days before."""
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    low_wick, high_wick = F.least("open", "close") - F.col("low"), F.col("high") - F.greatest("open", "close")
    o1, c1 = F.lag("open").over(by_code()), F.lag("close").over(by_code())
    before = by_code().rowsBetween(-19, -1)
    flags = {
        "doji": (span > 0) & (body <= 0.1 * span),
        "hammer": (body > 0) & (low_wick >= 2 * body) & (high_wick <= 0.3 * body),
        "shooting_star": (body > 0) & (high_wick >= 2 * body) & (low_wick <= 0.3 * body),
        "bullish_engulfing": (c1 < o1) & (F.col("close") > F.col("open")) & (F.col("open") <= c1) & (F.col("close") >= o1),
        "bearish_engulfing": (c1 > o1) & (F.col("close") < F.col("open")) & (F.col("open") >= c1) & (F.col("close") <= o1),
        "breakout": F.col("close") > F.max("high").over(before),
        "breakdown": F.col("close") < F.min("low").over(before),
    }
    found = bars.select("code", "day", F.array_compact(F.array(*(F.when(flag, F.lit(name)) for name, flag in flags.items()))).alias("p"))
    return found.select("code", "day", F.explode("p").alias("pattern"))


def drawdown(series: DataFrame, value: str = "close") -> DataFrame:
    """series with the running peak and the loss from it in percent."""
    peak = F.max(value).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak") * 100).otherwise(0.0))


def breadth(bars: DataFrame, limit: float = 0.10) -> DataFrame:
    """By day: codes up, down and flat against their bar before, and at the limits, whose prices are rounded to cents."""
    before = F.lag("close").over(by_code())
    cents = lambda x: F.floor(x * 100 + 0.5) / 100.0
    moved = bars.withColumn("before", before).filter("before IS NOT NULL")
    up, down = cents(F.col("before") * (1 + limit)), cents(F.col("before") * (1 - limit))
    return moved.groupBy("day").agg(
        F.count_if(F.expr("close > before")).alias("up"), F.count_if(F.expr("close < before")).alias("down"), F.count_if(F.expr("close = before")).alias("flat"),
        F.count_if(F.col("close") >= up).alias("limit_up"), F.count_if(F.col("close") <= down).alias("limit_down"),
    )


def volume_analysis(bars: DataFrame) -> DataFrame:
    """By code over its last 20 bars: mean volumes, of up and down days, days over twice the mean, and correlation with closes."""
    back = Window.partitionBy("code").orderBy(F.desc("day"))
    moved = bars.withColumn("_before", F.lag("close").over(by_code())).withColumn("_n", F.row_number().over(back)).filter("_n <= 20")
    moved = moved.withColumn("_mean", F.avg("volume").over(Window.partitionBy("code")))
    last = lambda n: quantise(F.avg(F.when(F.col("_n") <= n, F.col("volume")))).alias(f"volume{n}")
    return moved.groupBy("code").agg(
        last(5), last(10), last(20), quantise(F.avg(F.when(F.col("close") > F.col("_before"), F.col("volume")))).alias("up_volume"),
        quantise(F.avg(F.when(F.col("close") < F.col("_before"), F.col("volume")))).alias("down_volume"), F.count_if(F.col("volume") > 2 * F.col("_mean")).alias("spikes"),
    )
