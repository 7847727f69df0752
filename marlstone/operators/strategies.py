"""Strategies that are declared as conditions on bars, not programmed: checked by name, then one Column for all bars."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.bars import by_code

TESTS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "=": Column.__eq__}
CROSSINGS = {"crosses_above": 1, "crosses_below": -1}
#: Conditions at most: a set of strategies is what somebody has written.
MOST = 1_000


class Condition(NamedTuple):
    """A field some bars back against a value, or against another field times a factor, plus the value. `all` conditions of a strategy must hold together, and of its `any` ones at least one; crossings may be some bars old."""

    strategy: str
    need: str
    field: str
    test: str
    value: float = 0.0
    other: str | None = None
    factor: float = 1.0
    back: int = 0
    other_back: int = 0
    within: int = 1


def told(rows: DataFrame) -> list[Condition]:
    """Conditions of a table whose columns are `Condition`'s, where null is what a condition has by itself; more than MOST are an error."""
    found = rows.select(*Condition._fields).orderBy(*Condition._fields).limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} conditions")
    return [Condition(**{k: v for k, v in r.asDict().items() if v is not None}) for r in found]


def checked(conditions: list[Condition], columns: list[str]) -> list[Condition]:
    """The conditions; a ValueError names all that can't be: fields that bars don't have, tests and needs that there aren't, bars that are yet to come."""
    wrong = []
    for c in conditions:
        wrong += [f"{c.strategy}: no field {name}" for name in (c.field, c.other) if name is not None and name not in columns]
        wrong += [f"{c.strategy}: no test {c.test}"] if c.test not in TESTS and c.test not in CROSSINGS else []
        wrong += [f"{c.strategy}: no need {c.need}"] if c.need not in ("all", "any") else []
        wrong += [f"{c.strategy}: bars to come"] if min(c.back, c.other_back) < 0 or c.within < 1 else []
    if wrong:
        raise ValueError("; ".join(wrong))
    return conditions


def _held(c: Condition) -> Column:
    def at(name: str, back: int) -> Column:
        return F.lag(F.col(name), back).over(by_code()) if back else F.col(name)

    def against(more: int) -> Column:
        return F.lit(float(c.value)) if c.other is None else at(c.other, c.other_back + more) * float(c.factor) + float(c.value)

    if c.test in TESTS:
        return F.coalesce(TESTS[c.test](at(c.field, c.back), against(0)), F.lit(False))
    sign = CROSSINGS[c.test]
    gap = lambda more: (at(c.field, c.back + more) - against(more)) * sign
    crossed = [F.coalesce((gap(k) > 0) & (gap(k + 1) <= 0), F.lit(False)) for k in range(c.within)]
    out = crossed[0]
    for one in crossed[1:]:
        out = out | one
    return out


def signals(bars: DataFrame, conditions: list[Condition]) -> DataFrame:
    """bars (code, day, ...) with `strategies`: the names of those whose conditions a bar meets, in order.

    All conditions look back by one window of a code's days, so bars are shuffled and sorted once, however many strategies there are. What isn't known (a null, a day before
    the first) meets no condition; a strategy without conditions is none. A code's days are unique.
    """
    checked(conditions, bars.columns)
    names = sorted({c.strategy for c in conditions})
    met = []
    for name in names:
        every = [_held(c) for c in conditions if c.strategy == name and c.need == "all"]
        some = [_held(c) for c in conditions if c.strategy == name and c.need == "any"]
        whole = F.lit(True)
        for one in every:
            whole = whole & one
        if some:
            one_of = some[0]
            for one in some[1:]:
                one_of = one_of | one
            whole = whole & one_of
        met.append(F.when(whole, name))
    return bars.withColumn("strategies", F.array_compact(F.array(*met)) if met else F.array().cast("array<string>"))
