"""Stateful suppression of events: repeats within a time to live, failing sources, alerts that fire once.

Batch forms are folds over a key's events in order; the streaming form keeps the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.folds import fold

FAILURES, COOLDOWN = 3, 300.0
#: Groups that the keys of a stream are dealt to; as long as a stream's state lives, it stays.
GROUPS = 4096


def _timed(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("_at", F.col(at).cast("timestamp").cast("double"))


def ttl_dedup(events: DataFrame, keys: list[str], at: str, tie: str, ttl: float) -> DataFrame:
    """events with `sent`: false within `ttl` seconds of the last of the key that was sent, not of the last that was seen.

    No event is late here: all are taken in the order of their times. The streaming form drops those later than its `late`.
    """

    def step(last: float | None, when: float) -> tuple[float | None, tuple]:
        sent = last is None or when - last >= ttl
        return (when if sent else last), (sent,)

    return fold(_timed(events, at), keys, [at, tie], ["_at"], lambda: None, step, "sent boolean").drop("_at")


def ttl_dedup_stream(events: DataFrame, keys: list[str], at: str, tie: str, ttl: float, late: str = "1 hour") -> DataFrame:
    """The sent events of a stream; the state of a key is when it was last sent, and it goes once the watermark is `ttl` past that.

    A micro-batch's events of a key are taken in order of time; what comes later than `late` after its time is dropped. Keys are dealt to GROUPS groups
    by their hash, and a group is called once for all its keys: what a call costs doesn't grow with the keys.
    """
    names = [f.name for f in events.schema]

    def over(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        sent = dict(zip(*state.get, strict=True)) if state.exists else {}
        kept = None
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            times = rows[at].to_numpy().astype("int64") / {"ns": 1e9, "us": 1e6}[rows[at].dt.unit]
            own, chosen = rows["_key"].tolist(), []
            for k in rows[[at, tie]].sort_values([at, tie]).index.tolist():
                key, when = own[k], times[k]
                last = sent.get(key)
                if last is None or when - last >= ttl:
                    sent[key] = float(when)
                    chosen.append(k)
            kept = rows.iloc[chosen][names]
        sent = {key: last for key, last in sent.items() if int((last + ttl) * 1000) > passed}
        if sent:
            state.update((list(sent), list(sent.values())))
            state.setTimeoutTimestamp(int((min(sent.values()) + ttl) * 1000))
        elif state.exists:
            state.remove()
        if kept is not None:
            yield kept

    key = F.to_json(F.struct(*keys), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    dealt = events.withWatermark(at, late).withColumn("_key", key).withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(GROUPS)))
    return dealt.groupBy("_group").applyInPandasWithState(over, events.schema, "keys array<string>, last array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def circuit(calls: DataFrame, source: str, at: str, tie: str, ok: str, failures: int = FAILURES, cooldown: float = COOLDOWN) -> DataFrame:
    """calls with `circuit`: passed, or rejected while a source is open: after so many failures in a row, for so many seconds;
    then one trial call passes, which closes the circuit or opens it anew."""

    def step(state: tuple, when: float, good: bool) -> tuple[tuple, tuple]:
        n, opened = state
        if opened is not None and when - opened < cooldown:
            return state, ("rejected",)
        if good:
            return (0, None), ("passed",)
        return (n + 1, when if opened is not None or n + 1 >= failures else None), ("passed",)

    return fold(_timed(calls, at), [source], [at, tie], ["_at", ok], lambda: (0, None), step, "circuit string").drop("_at")


def severe(events: DataFrame, severity: str, least: str, ranks: tuple[str, ...] = ("info", "notice", "warning", "error")) -> DataFrame:
    """Events of at least a severity; unknown ones are the lowest."""
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranks)), x), F.lit(0).cast("long")), F.lit(1).cast("long"))
    return events.filter(rank(F.col(severity)) >= ranks.index(least) + 1)


def fired(events: DataFrame, rules: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """The first event that meets each rule (key, rule, above, expires): a rule fires once, and not after it has expired."""
    met = events.join(rules, key).filter((F.col(value) > F.col("above")) & (F.col(at) < F.col("expires")))
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy(at, tie))).filter("_n = 1").drop("_n")


def windowed_counts(events: DataFrame, at: str, by: str, length: str, late: str) -> DataFrame:
    """Counts by tumbling window of a stream or a table; a stream drops what comes later than `late` after its time."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    found = timed.groupBy(F.window("_at", length).alias("w"), by).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), by, "n")
