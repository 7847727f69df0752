"""Market queries: events of a user are ticks of a code, its days are bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import bands, quantise
from marlstone.operators import bars as B
from marlstone.plans import sql as S
from marlstone.sources.tables import table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.daily(table(spark, sf_dir, "events"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir)


def clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.clean(_bars(spark, sf_dir)).filter("volume > 1")


def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.averages(_bars(spark, sf_dir)).select("code", "day", "ma5", "ma10", "ma20", "volume_ratio")


def full_moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.full_averages(_bars(spark, sf_dir)).select("code", "day", *(quantise(F.col(f"ma{n}"), 4).alias(f"ma{n}") for n in (5, 10, 20)))


def bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = B.full_averages(_bars(spark, sf_dir))
    return full.select("code", "day", *(quantise((F.col("close") - F.col(f"ma{n}")) / F.col(f"ma{n}") * 100, 3).alias(f"bias{n}") for n in (5, 10, 20)))


def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rsi(_bars(spark, sf_dir)).select("code", "day", *(quantise(F.col(f"rsi{n}"), 4).alias(f"rsi{n}") for n in (6, 12, 24)))


def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.macd(_bars(spark, sf_dir)).select("code", "day", *(quantise(F.col(c), 6).alias(c) for c in ("dif", "dea", "bar")))


def trend_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.trend(B.full_averages(_bars(spark, sf_dir))).select("code", "day", "trend")


def volume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.volume_state(_bars(spark, sf_dir)).select("code", "day", quantise(F.col("ratio5"), 4).alias("ratio5"), "volume_state")


def signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.signal(_bars(spark, sf_dir)).select("code", "day", "trend", "volume_state", "macd_state", "rsi_state", "score", "signal")


def candle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.patterns(_bars(spark, sf_dir))


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.drawdown(_bars(spark, sf_dir)).groupBy("code").agg(F.max("drawdown").alias("worst"), F.max_by("drawdown", "day").alias("now"))
    return found.select("code", quantise(F.col("worst"), 4).alias("worst"), quantise(F.col("now"), 4).alias("now"))


def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.breadth(_bars(spark, sf_dir))


def volume_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.volume_analysis(_bars(spark, sf_dir))


def today_and_yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each code against the one before."""
    both = _bars(spark, sf_dir).withColumn("close1", F.lag("close").over(B.by_code())).withColumn("volume1", F.lag("volume").over(B.by_code()))
    last = both.groupBy("code").agg(F.max_by(F.struct("day", "close", "close1", "volume", "volume1"), "day").alias("r")).select("code", "r.*")
    return last.select("code", "day", F.when(F.col("close1") > 0, quantise((F.col("close") / F.col("close1") - 1) * 100, 4)).alias("change"), F.when(F.col("volume1") > 0, quantise(F.col("volume") / F.col("volume1"), 4)).alias("volume_change"))


def moving_average_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = B.averages(_bars(spark, sf_dir))
    c, m5, m10, m20 = (F.col(x) for x in ("close", "ma5", "ma10", "ma20"))
    status = F.when((c > m5) & (m5 > m10) & (m10 > m20), "long").when((c < m5) & (m5 < m10) & (m10 < m20), "short").when((c > m5) & (m5 > m10), "short-term rise").when((c < m5) & (m5 < m10), "short-term fall").otherwise("sideways")
    return m.select("code", "day", status.alias("status"))


def volume_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = bands(F.col("volume_ratio"), (0.5, "very low"), (0.8, "low"), (1.2, "normal"), (2.0, "raised"), (3.0, "high"), otherwise="very high")
    return B.averages(_bars(spark, sf_dir)).groupBy(label.alias("band")).agg(F.count("*").alias("n"))


def support_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = B.full_averages(_bars(spark, sf_dir))
    near = lambda m: F.coalesce((F.col("close") >= F.col(m)) & ((F.col("close") - F.col(m)) / F.col(m) <= B.SUPPORT), F.lit(False))
    w = B.by_code().rowsBetween(-19, 0)
    high = F.when(F.count("*").over(w) == 20, F.max("high").over(w))
    return full.select("code", "day", near("ma5").alias("support5"), near("ma10").alias("support10"), high.alias("_high"), "close").select("code", "day", "support5", "support10", F.when(F.col("_high") > F.col("close"), F.col("_high")).alias("resistance"))


def latest_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a code: its last tick."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("code")).agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("code", "r.*")


def realtime_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the last day's taken from a fresher source: of two rows of a day, that of the better source stays."""
    bars = _bars(spark, sf_dir)
    fresh = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("code")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    fresh = fresh.withColumn("day", F.lit("2024-01-31").cast("date")).withColumn("rank", F.lit(0)).select("code", "day", "close", "rank")
    both = bars.select("code", "day", "close", F.lit(1).alias("rank")).unionByName(fresh)
    first = F.row_number().over(Window.partitionBy("code", "day").orderBy("rank"))
    return both.withColumn("n", first).filter("n = 1").select("code", "day", "close")


QUERIES = {
    f.__name__: f
    for f in (daily_bars, clean_bars, moving_averages, full_moving_averages, bias, rsi, macd, trend_state, volume_state, signal_score, candle_patterns, drawdown, market_breadth, volume_analysis, today_and_yesterday, moving_average_status, volume_bands, support_resistance, latest_quote, realtime_bar)
}

_W = "PARTITION BY code ORDER BY day"


def _full(n: int, x: str = "close") -> str:
    w = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN avg({x}) {w} END"


def _cents(n: int) -> str:
    w = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CAST(sum(CAST(floor(close * 100 + 0.5) AS BIGINT)) {w} AS DOUBLE) / (count(close) {w} * 100.0)"


_AVERAGES = f"""averages AS (SELECT *, {", ".join(f"{S.q(_cents(n), 2)} AS ma{n}" for n in (5, 10, 20))},
    CASE WHEN avg(volume) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) > 0 THEN {S.q(f"volume / avg(volume) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", 2)} ELSE 1.0 END AS volume_ratio FROM bars)"""
_FULL = f"full_ma AS (SELECT *, {', '.join(f'{_full(n)} AS ma{n}' for n in (5, 10, 20))} FROM bars)"
_RSI = f"""moved AS (SELECT *, coalesce(close - lag(close) OVER ({_W}), 0.0) AS delta FROM bars), sides AS (SELECT *, greatest(delta, 0.0) AS gain, greatest(-delta, 0.0) AS loss FROM moved),
    means AS (SELECT code, day, {", ".join(f"{_full(n, 'gain')} AS g{n}, {_full(n, 'loss')} AS l{n}" for n in (6, 12, 24))} FROM sides),
    rsis AS (SELECT code, day, {", ".join(f"CASE WHEN g{n} IS NULL OR (g{n} = 0 AND l{n} = 0) THEN 50.0 WHEN l{n} = 0 THEN 100.0 ELSE 100 - 100 / (1 + g{n} / l{n}) END AS rsi{n}" for n in (6, 12, 24))} FROM means)"""
_MACD = f"""numbered AS (SELECT code, day, close, row_number() OVER ({_W}) AS rn FROM bars),
    folded AS (SELECT code, day, rn, close AS f, close AS s, close - close AS dif, close - close AS dea FROM numbered WHERE rn = 1
      UNION ALL SELECT n.code, n.day, n.rn, p.f * (1 - {2 / 13}) + n.close * {2 / 13}, p.s * (1 - {2 / 27}) + n.close * {2 / 27},
        (p.f * (1 - {2 / 13}) + n.close * {2 / 13}) - (p.s * (1 - {2 / 27}) + n.close * {2 / 27}),
        p.dea * (1 - 0.2) + ((p.f * (1 - {2 / 13}) + n.close * {2 / 13}) - (p.s * (1 - {2 / 27}) + n.close * {2 / 27})) * 0.2
      FROM folded p JOIN numbered n ON n.code = p.code AND n.rn = p.rn + 1)"""
_TREND = f"""spread AS (SELECT *, (ma5 - ma20) / ma20 * 100 AS up, (ma20 - ma5) / ma5 * 100 AS down FROM full_ma), earlier AS (SELECT *, lag(up, 4) OVER ({_W}) AS up4, lag(down, 4) OVER ({_W}) AS down4 FROM spread),
    trends AS (SELECT *, CASE WHEN ma20 IS NULL THEN 'consolidation' WHEN ma5 > ma10 AND ma10 > ma20 THEN CASE WHEN up > up4 AND up > 5 THEN 'strong_bull' ELSE 'bull' END WHEN ma5 > ma10 THEN 'weak_bull'
      WHEN ma5 < ma10 AND ma10 < ma20 THEN CASE WHEN down > down4 AND down > 5 THEN 'strong_bear' ELSE 'bear' END WHEN ma5 < ma10 THEN 'weak_bear' ELSE 'consolidation' END AS trend FROM earlier)"""
_VOLUME = f"""ratios AS (SELECT code, day, volume / avg(volume) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ratio5, coalesce(close > lag(close) OVER ({_W}), false) AS rise FROM bars),
    volumes AS (SELECT code, day, ratio5, CASE WHEN ratio5 >= 1.5 THEN CASE WHEN rise THEN 'heavy_up' ELSE 'heavy_down' END WHEN ratio5 <= 0.7 THEN CASE WHEN rise THEN 'shrink_up' ELSE 'shrink_down' END ELSE 'normal' END AS volume_state FROM ratios)"""
_MACD_STATE = f"""crosses AS (SELECT *, lag(dif - dea) OVER ({_W}) AS before, lag(dif) OVER ({_W}) AS zero FROM folded),
    macds AS (SELECT code, day, CASE WHEN before <= 0 AND dif - dea > 0 AND dif > 0 THEN 'golden_cross_zero' WHEN zero <= 0 AND dif > 0 THEN 'crossing_up' WHEN before <= 0 AND dif - dea > 0 THEN 'golden_cross'
      WHEN before >= 0 AND dif - dea < 0 THEN 'death_cross' WHEN zero >= 0 AND dif < 0 THEN 'crossing_down' WHEN dif < 0 AND dea < 0 THEN 'bearish' ELSE 'bullish' END AS macd_state FROM crosses)"""


def _case(column: str, points: dict[str, int], otherwise: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in points.items()) + f" ELSE {otherwise} END"


_BIAS = "(close - ma5) / ma5 * 100"
_SCORE = f"""{_case("trend", B.TREND_POINTS, 12)}
  + coalesce(CASE WHEN {_BIAS} < 0 THEN CASE WHEN {_BIAS} > -3 THEN 20 WHEN {_BIAS} > -5 THEN 16 ELSE 8 END WHEN {_BIAS} < 2 THEN 18 WHEN {_BIAS} < 5 THEN 14
      WHEN {_BIAS} > CASE WHEN trend = 'strong_bull' THEN 7.5 ELSE 5.0 END THEN 4 WHEN {_BIAS} > 5 AND trend = 'strong_bull' THEN 10 WHEN ma5 IS NOT NULL THEN 4 END, 18)
  + {_case("volume_state", B.VOLUME_POINTS, 8)} + CASE WHEN close >= ma5 AND (close - ma5) / ma5 <= 0.02 THEN 5 ELSE 0 END + CASE WHEN close >= ma10 AND (close - ma10) / ma10 <= 0.02 THEN 5 ELSE 0 END
  + {_case("macd_state", B.MACD_POINTS, 5)} + {_case("rsi_state", B.RSI_POINTS, 5)}"""

ORACLE = {
    "daily_bars": f"WITH {S.BARS} SELECT * FROM bars",
    "clean_bars": f"WITH {S.BARS} SELECT code, day, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM bars WHERE volume > 1",
    "moving_averages": f"WITH {S.BARS}, {_AVERAGES} SELECT code, day, ma5, ma10, ma20, volume_ratio FROM averages",
    "full_moving_averages": f"WITH {S.BARS}, {_FULL} SELECT code, day, {', '.join(f'{S.q(f"ma{n}", 4)} AS ma{n}' for n in (5, 10, 20))} FROM full_ma",
    "bias": f"WITH {S.BARS}, {_FULL} SELECT code, day, {', '.join(f'{S.q(f"(close - ma{n}) / ma{n} * 100", 3)} AS bias{n}' for n in (5, 10, 20))} FROM full_ma",
    "rsi": f"WITH {S.BARS}, {_RSI} SELECT code, day, {', '.join(f'{S.q(f"rsi{n}", 4)} AS rsi{n}' for n in (6, 12, 24))} FROM rsis",
    "macd": f"WITH RECURSIVE {S.BARS}, {_MACD} SELECT code, day, {S.q('dif', 6)} AS dif, {S.q('dea', 6)} AS dea, {S.q('(dif - dea) * 2', 6)} AS bar FROM folded",
    "trend_state": f"WITH {S.BARS}, {_FULL}, {_TREND} SELECT code, day, trend FROM trends",
    "volume_state": f"WITH {S.BARS}, {_VOLUME} SELECT code, day, {S.q('ratio5', 4)} AS ratio5, volume_state FROM volumes",
    "signal_score": f"""WITH RECURSIVE {S.BARS}, {_FULL}, {_TREND}, {_VOLUME}, {_RSI}, {_MACD}, {_MACD_STATE},
        joined AS (SELECT t.*, volume_state, macd_state, CASE WHEN rsi12 > 70 THEN 'overbought' WHEN rsi12 > 60 THEN 'strong' WHEN rsi12 >= 40 THEN 'neutral' WHEN rsi12 >= 30 THEN 'weak' ELSE 'oversold' END AS rsi_state
          FROM trends t JOIN volumes USING (code, day) JOIN macds USING (code, day) JOIN rsis USING (code, day)),
        scored AS (SELECT code, day, trend, volume_state, macd_state, rsi_state, {_SCORE} AS score FROM joined)
        SELECT *, CASE WHEN score >= 75 AND trend IN ('strong_bull', 'bull') THEN 'strong_buy' WHEN score >= 60 AND trend IN ('strong_bull', 'bull', 'weak_bull') THEN 'buy' WHEN score >= 45 THEN 'hold' WHEN score >= 30 THEN 'wait'
          WHEN trend IN ('bear', 'strong_bear') THEN 'strong_sell' ELSE 'sell' END AS signal FROM scored""",
    "candle_patterns": f"""WITH {S.BARS}, x AS (SELECT *, abs(close - open) AS body, high - low AS span, least(open, close) - low AS lw, high - greatest(open, close) AS hw, lag(open) OVER ({_W}) AS o1, lag(close) OVER ({_W}) AS c1,
        max(high) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS mh, min(low) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS ml FROM bars)
        SELECT code, day, 'doji' AS pattern FROM x WHERE span > 0 AND body <= 0.1 * span
        UNION ALL SELECT code, day, 'hammer' FROM x WHERE body > 0 AND lw >= 2 * body AND hw <= 0.3 * body
        UNION ALL SELECT code, day, 'shooting_star' FROM x WHERE body > 0 AND hw >= 2 * body AND lw <= 0.3 * body
        UNION ALL SELECT code, day, 'bullish_engulfing' FROM x WHERE c1 < o1 AND close > open AND open <= c1 AND close >= o1
        UNION ALL SELECT code, day, 'bearish_engulfing' FROM x WHERE c1 > o1 AND close < open AND open >= c1 AND close <= o1
        UNION ALL SELECT code, day, 'breakout' FROM x WHERE close > mh UNION ALL SELECT code, day, 'breakdown' FROM x WHERE close < ml""",
    "drawdown": f"""WITH {S.BARS}, p AS (SELECT *, max(close) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS peak FROM bars), d AS (SELECT code, day, CASE WHEN peak > 0 THEN (peak - close) / peak * 100 ELSE 0.0 END AS dd FROM p)
        SELECT code, {S.q("max(dd)", 4)} AS worst, {S.q("max_by(dd, day)", 4)} AS now FROM d GROUP BY code""",
    "market_breadth": f"""WITH {S.BARS}, m AS (SELECT *, lag(close) OVER ({_W}) AS before FROM bars) SELECT day, count(*) FILTER (WHERE close > before) AS up, count(*) FILTER (WHERE close < before) AS down, count(*) FILTER (WHERE close = before) AS flat,
        count(*) FILTER (WHERE close >= floor(before * 1.1 * 100 + 0.5) / 100.0) AS limit_up, count(*) FILTER (WHERE close <= floor(before * 0.9 * 100 + 0.5) / 100.0) AS limit_down FROM m WHERE before IS NOT NULL GROUP BY day""",
    "volume_analysis": f"""WITH {S.BARS}, m AS (SELECT *, lag(close) OVER ({_W}) AS before, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM bars), l AS (SELECT *, avg(volume) OVER (PARTITION BY code) AS mean FROM m WHERE n <= 20)
        SELECT code, {", ".join(f"{S.q(f'avg(volume) FILTER (WHERE n <= {k})')} AS volume{k}" for k in (5, 10, 20))}, {S.q("avg(volume) FILTER (WHERE close > before)")} AS up_volume, {S.q("avg(volume) FILTER (WHERE close < before)")} AS down_volume,
        count(*) FILTER (WHERE volume > 2 * mean) AS spikes FROM l GROUP BY code""",
    "today_and_yesterday": f"""WITH {S.BARS}, b AS (SELECT *, lag(close) OVER ({_W}) AS c1, lag(volume) OVER ({_W}) AS v1, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM bars)
        SELECT code, day, CASE WHEN c1 > 0 THEN {S.q("(close / c1 - 1) * 100", 4)} END AS change, CASE WHEN v1 > 0 THEN {S.q("volume / v1", 4)} END AS volume_change FROM b WHERE n = 1""",
    "moving_average_status": f"""WITH {S.BARS}, {_AVERAGES} SELECT code, day, CASE WHEN close > ma5 AND ma5 > ma10 AND ma10 > ma20 THEN 'long' WHEN close < ma5 AND ma5 < ma10 AND ma10 < ma20 THEN 'short' WHEN close > ma5 AND ma5 > ma10 THEN 'short-term rise'
        WHEN close < ma5 AND ma5 < ma10 THEN 'short-term fall' ELSE 'sideways' END AS status FROM averages""",
    "volume_bands": f"WITH {S.BARS}, {_AVERAGES} SELECT CASE WHEN volume_ratio < 0.5 THEN 'very low' WHEN volume_ratio < 0.8 THEN 'low' WHEN volume_ratio < 1.2 THEN 'normal' WHEN volume_ratio < 2 THEN 'raised' WHEN volume_ratio < 3 THEN 'high' ELSE 'very high' END AS band, count(*) AS n FROM averages GROUP BY 1",
    "support_resistance": f"""WITH {S.BARS}, {_FULL}, h AS (SELECT *, CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN max(high) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS top FROM full_ma)
        SELECT code, day, coalesce(close >= ma5 AND (close - ma5) / ma5 <= 0.02, false) AS support5, coalesce(close >= ma10 AND (close - ma10) / ma10 <= 0.02, false) AS support10, CASE WHEN top > close THEN top END AS resistance FROM h""",
    "latest_quote": "SELECT user_id AS code, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "realtime_bar": f"WITH {S.BARS} SELECT code, day, close FROM bars UNION ALL SELECT user_id, DATE '2024-01-31', last(value ORDER BY ts, event_id) FROM events GROUP BY user_id",
}
