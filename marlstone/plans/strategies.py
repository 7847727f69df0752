"""Declared strategies on the daily bars of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise
from marlstone.operators import bars as B
from marlstone.operators.strategies import Condition as C
from marlstone.operators.strategies import signals
from marlstone.plans import sql as S
from marlstone.plans.market import _AVERAGES
from marlstone.sources.tables import table

#: What strategies ask of bars.
STRATEGIES = [
    C("golden_cross", "all", "ma5", "crosses_above", other="ma10", within=3), C("golden_cross", "all", "volume_ratio", ">", 1.2), C("golden_cross", "all", "close", "<", other="ma5", factor=1.05),
    C("slow_golden_cross", "all", "ma10", "crosses_above", other="ma20"),
    C("bottom_volume", "all", "volume_ratio", ">", 3.0), C("bottom_volume", "all", "close", ">", other="open"), C("bottom_volume", "all", "close", "<", other="high20", factor=0.85),
    C("shrink_pullback", "all", "ma5", ">", other="ma10"), C("shrink_pullback", "all", "ma10", ">", other="ma20"), C("shrink_pullback", "all", "volume_ratio", "<", 0.7),
    C("shrink_pullback", "any", "gap5", "<=", 1.0), C("shrink_pullback", "any", "gap10", "<=", 2.0),
    C("bull_trend", "all", "ma5", ">=", other="ma10"), C("bull_trend", "all", "ma10", ">=", other="ma20"), C("bull_trend", "all", "ma20", ">", other="ma20", other_back=1), C("bull_trend", "all", "close", ">=", other="ma20"),
    C("one_yang_three_yin", "all", "close", ">", other="open", factor=1.02, back=4, other_back=4), C("one_yang_three_yin", "all", "close", ">", other="open"), C("one_yang_three_yin", "all", "close", ">", other="close", other_back=4),
    *(C("one_yang_three_yin", "all", "low", ">=", other="open", back=k, other_back=4) for k in (3, 2, 1)), *(C("one_yang_three_yin", "all", "close", "<=", other="close", back=k, other_back=4) for k in (3, 2, 1)),
]


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.averages(B.daily(table(spark, sf_dir, "events")))
    gap = lambda n: F.when(F.col(f"ma{n}") > 0, quantise(F.abs(F.col("close") - F.col(f"ma{n}")) / F.col(f"ma{n}") * 100, 3))
    return bars.select("*", F.max("high").over(B.by_code().rowsBetween(-19, 0)).alias("high20"), gap(5).alias("gap5"), gap(10).alias("gap10"))


def strategy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies that each bar meets."""
    return signals(_marked(spark, sf_dir), STRATEGIES).select("code", "day", F.array_join("strategies", ",").alias("strategies"))


def strategy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each strategy by code: how many, and the longest row of bars in turn."""
    bars = signals(_marked(spark, sf_dir), STRATEGIES).select("code", "day", "strategies", F.row_number().over(B.by_code()).alias("k"))
    hits = bars.select("code", "day", "k", F.explode("strategies").alias("strategy"))
    turn = hits.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("code", "strategy").orderBy("day")))
    runs = turn.groupBy("code", "strategy", "run").agg(F.count("*").alias("n"), F.min("day").alias("first"))
    return runs.groupBy("code", "strategy").agg(F.sum("n").alias("days"), F.max("n").alias("longest"), F.min("first").alias("first"))


QUERIES = {f.__name__: f for f in (strategy_signals, strategy_days)}

_LAG = lambda x, k: f"lag({x}, {k}) OVER w"
_SIGNALS = f"""{S.BARS}, {_AVERAGES}, x AS (SELECT *, max(high) OVER (PARTITION BY code ORDER BY day ROWS 19 PRECEDING) AS high20, CASE WHEN ma5 > 0 THEN {S.q("abs(close - ma5) / ma5 * 100", 3)} END AS gap5, CASE WHEN ma10 > 0 THEN {S.q("abs(close - ma10) / ma10 * 100", 3)} END AS gap10 FROM averages),
    y AS (SELECT *, coalesce(ma5 > ma10 AND {_LAG("ma5 <= ma10", 1)}, false) AS up5, coalesce(ma10 > ma20 AND {_LAG("ma10 <= ma20", 1)}, false) AS up10, row_number() OVER w AS k, {_LAG("ma20", 1)} AS before20, {_LAG("close", 4)} AS c4, {_LAG("open", 4)} AS o4,
      {", ".join(f"{_LAG('close', k)} AS c{k}, {_LAG('low', k)} AS l{k}" for k in (3, 2, 1))} FROM x WINDOW w AS (PARTITION BY code ORDER BY day)),
    z AS (SELECT *, bool_or(up5) OVER (PARTITION BY code ORDER BY day ROWS 2 PRECEDING) AS recent FROM y),
    m AS (SELECT code, day, k, list_filter([CASE WHEN volume_ratio > 3 AND close > open AND close < high20 * 0.85::DOUBLE THEN 'bottom_volume' END, CASE WHEN ma5 >= ma10 AND ma10 >= ma20 AND ma20 > before20 AND close >= ma20 THEN 'bull_trend' END,
      CASE WHEN recent AND volume_ratio > 1.2::DOUBLE AND close < ma5 * 1.05::DOUBLE THEN 'golden_cross' END, CASE WHEN c4 > o4 * 1.02::DOUBLE AND close > open AND close > c4 AND least(l1, l2, l3) >= o4 AND greatest(c1, c2, c3) <= c4 THEN 'one_yang_three_yin' END,
      CASE WHEN ma5 > ma10 AND ma10 > ma20 AND volume_ratio < 0.7::DOUBLE AND (gap5 <= 1 OR gap10 <= 2) THEN 'shrink_pullback' END, CASE WHEN up10 THEN 'slow_golden_cross' END], lambda s: s IS NOT NULL) AS names FROM z)"""

ORACLE = {
    "strategy_signals": f"WITH {_SIGNALS} SELECT code, day, array_to_string(names, ',') AS strategies FROM m",
    "strategy_days": f"""WITH {_SIGNALS}, h AS (SELECT code, day, k, unnest(names) AS strategy FROM m), t AS (SELECT *, k - row_number() OVER (PARTITION BY code, strategy ORDER BY day) AS run FROM h),
        r AS (SELECT code, strategy, count(*) AS n, min(day) AS first FROM t GROUP BY code, strategy, run) SELECT code, strategy, CAST(sum(n) AS BIGINT) AS days, max(n) AS longest, min(first) AS first FROM r GROUP BY code, strategy""",
}
