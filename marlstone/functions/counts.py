"""Words counted within their rows: a task counts a batch of texts at once, and no word moves."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def word_counts(rows: DataFrame, words: str, term: str = "term", tf: str = "tf", length: str = "length") -> DataFrame:
    """A row for each word that an array holds, with how often, and the array's length, beside the other columns; one with nulls and 0 for an array without words.

    Rows of a batch are in the order of their words. Null arrays are empty; arrays hold no nulls.
    """
    kept = [c for c in rows.columns if c != words]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.fill_null(batch.column(len(kept)).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = batch.column(len(kept)).flatten().dictionary_encode()
            names = coded.dictionary
            order = pc.sort_indices(names).to_numpy()
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            owner = np.repeat(np.arange(len(batch), dtype=np.int64), held)
            both, n = np.unique(place[coded.indices.to_numpy(zero_copy_only=False)] * len(batch) + owner, return_counts=True)
            empty = np.flatnonzero(held == 0)
            row = np.concatenate([empty, both % max(1, len(batch))])
            said = pa.concat_arrays([pa.nulls(len(empty), names.type), names.take(pa.array(order)).take(pa.array(both // max(1, len(batch))))])
            given = [batch.column(k).take(pa.array(row)) for k in range(len(kept))]
            counts = np.concatenate([np.zeros(len(empty), np.int64), n])
            yield pa.RecordBatch.from_arrays([*given, said, pa.array(counts, pa.int32()), pa.array(held[row], pa.int32())], [*kept, term, tf, length])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.select(*kept, words).mapInArrow(over, ", ".join([*fields, f"{term} string", f"{tf} int", f"{length} int"]))


def commonest(rows: DataFrame, words: str, n: int, top: str = "top") -> DataFrame:
    """rows with the n commonest words of an array as an array<struct<n, t>>, n negative, ties by word, in place of it. Null arrays are empty; a row's words are counted in one pass."""
    kept = [c for c in rows.columns if c != words]
    kind = pa.list_(pa.struct([("n", pa.int32()), ("t", pa.string())]))

    def best(held: pa.ListScalar) -> list[dict]:
        counts = Counter(held.values.to_pylist() if held.is_valid else ())
        least = sorted(counts.values(), reverse=True)[n - 1] if len(counts) > n else 1
        return [{"n": k, "t": t} for k, t in sorted((-k, t) for t, k in counts.items() if k >= least)[:n]]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([best(x) for x in batch.column(len(kept))], kind)], [*kept, top])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.select(*kept, words).mapInArrow(over, ", ".join([*fields, f"{top} array<struct<n:int,t:string>>"]))
