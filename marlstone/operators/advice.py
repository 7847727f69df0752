"""Advice in words: what it asks for, unless it is denied, the direction and position that follow, and prices written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.arrays import let

#: Words of each intent, words that deny what follows, and words that may stand between.
INTENTS = {
    "bearish": ("卖出", "减仓", "强烈卖出", "清仓", "strong sell", "sell", "reduce"),
    "bullish": ("买入", "加仓", "强烈买入", "增持", "建仓", "strong buy", "buy", "add"),
    "hold": ("持有", "震荡观望", "洗盘观察", "持有观察", "hold", "range-bound watch", "shakeout watch", "hold and watch"),
    "wait": ("观望", "等待", "wait"),
}
NEGATIONS = ("not", "don't", "do not", "no", "never", "avoid", "不要", "不", "别", "勿", "没有")
BETWEEN = ("建议", "应", "应当", "宜", "先", "再", "暂", "不必", "必须", "无需")

_GAP = r"(?:\s{0,3}[^，,。；;:!?！？一-鿿]{0,6}|\s{0,2}(?:" + "|".join(BETWEEN) + r")\s{0,2})"
_DENIED = "(?<!(?:" + "|".join(NEGATIONS) + ")" + _GAP + ")"


def _pattern(intent: str) -> str:
    words = [rf"(?<![a-z0-9_]){w}(?![a-z0-9_])" if w.isascii() else w for w in INTENTS[intent]]
    # what denies a word is looked for only where a word stands
    said = f"(?:{'|'.join(words)})"
    return f"(?={said}){_DENIED}{said}"


def intent_place(text: Column, intent: str) -> Column:
    """Where, from 1, an intent is first asked for without being denied; null where it isn't. A text that is just a word asks for it."""

    def of(low: Column) -> Column:
        # a split would compile its pattern for each row, which takes longer than the search
        rest = F.length(F.regexp_extract(low, f"(?s)(?:{_pattern(intent)}).*", 0))
        return F.when(low.isin(*INTENTS[intent]), 1).otherwise(let(rest, lambda n: F.when(n > 0, F.length(low) - n + 1)))

    return let(F.trim(F.lower(F.coalesce(text, F.lit("")))), of)


def stance(text: Column) -> Column:
    """bearish, else wait where that is said before bullish and hold, else bullish, hold or wait; null where nothing is asked for. Each intent is sought once."""

    def told(place: Column) -> Column:
        first = place["wait"].isNotNull() & F.coalesce(place["wait"] < place["bullish"], F.lit(True)) & F.coalesce(place["wait"] < place["hold"], F.lit(True))
        asked = lambda name: place[name].isNotNull()
        return F.when(asked("bearish"), "bearish").when(first, "wait").when(asked("bullish"), "bullish").when(asked("hold"), "hold").when(asked("wait"), "wait")

    return let(F.struct(*(intent_place(text, name).alias(name) for name in INTENTS)), told)


def expected(asked: Column) -> Column:
    """up, down, not_down or flat: what a stance expects of the price."""
    return F.when(asked == "bearish", "down").when(asked == "bullish", "up").when(asked == "hold", "not_down").otherwise("flat")


def held(asked: Column) -> Column:
    """long for a stance to buy or hold, else cash."""
    return F.when(F.coalesce(asked, F.lit("wait")).isin("bullish", "hold"), "long").otherwise("cash")


def direction(text: Column) -> Column:
    """up, down, not_down or flat: what advice expects of the price."""
    return let(stance(text), expected)


def position(text: Column) -> Column:
    """long for advice to buy or hold, else cash."""
    return held(stance(text))


def price(text: Column) -> Column:
    """A price written as text: a plain number, the last number before 元 (after the last colon), or the last one before a bracket; the
    numbers of averages (MA5) don't count. Null for none."""
    low = F.trim(F.regexp_replace(text, "[,，]", ""))
    plain = low.try_cast("double")
    numbers = lambda x, pattern: F.try_element_at(F.regexp_extract_all(F.regexp_replace(x, r"(?i)MA\d+(?:\.\d+)?", "MA"), F.lit(pattern), F.lit(0)), F.lit(-1)).try_cast("double")
    tail = F.regexp_replace(low, r"(?s)^.*[：:]", "")
    money = F.when(F.contains(tail, F.lit("元")), F.abs(numbers(F.substring_index(tail, "元", 1), r"-?\d+(?:\.\d+)?")))
    head = F.trim(F.regexp_replace(low, r"(?s)[(（].*$", ""))
    return F.when(~low.isin("", "-", "—", "N/A"), F.coalesce(plain, money, numbers(F.when(head == "", low).otherwise(head), r"\d+(?:\.\d+)?")))
