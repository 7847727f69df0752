"""Arrays as Column functions: values computed once, and running folds in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that a running fold takes at a time.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: it is the variable of a lambda, which a plan can't inline again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind>: what step(state, item) -> (state, out) puts out for each item in turn.

    A fold copies its state, and all that it has appended to, for each item. Here a first fold finds the state at the start of
    each chunk of items, and a second puts out a chunk's items from there, so that only short arrays are copied.
    """

    def chunk(k: Column) -> Column:
        return F.slice(items, k * CHUNK + 1, F.lit(CHUNK))

    def started(done: Column, k: Column) -> Column:
        after = F.aggregate(chunk(k), done["state"], lambda state, item: step(state, item)[0])
        return F.struct(after.alias("state"), F.array_append(done["starts"], done["state"]).alias("starts"))

    def one(done: Column, item: Column) -> Column:
        state, out = step(done["state"], item)
        return F.struct(state.alias("state"), F.array_append(done["out"], out).alias("out"))

    def put_out(state: Column, k: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(chunk(k), begin, one, lambda done: done["out"])

    chunks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    starts = F.aggregate(chunks, F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts")), started, lambda done: done["starts"])
    return F.flatten(F.transform(starts, put_out))
