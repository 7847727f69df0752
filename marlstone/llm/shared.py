"""What several operators need: tables in the shared folder, and word hashes of Arrow text in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import materialize as materialize
from marlstone.sources.tables import shared_dir as shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a key beyond which it is hot; in a large table one in so many rows, so that there are at most so many hot keys.
HOT, HOT_SHARE = 2000, 100_000


def extent(sizes: DataFrame) -> tuple[int, int]:
    """All rows that keys have together, and those of the largest key."""
    row = sizes.agg(F.sum("n"), F.max("n")).first()
    return row[0] or 0, row[1] or 0


def attach(rows: DataFrame, sizes: DataFrame, key: str, known: tuple[int, int] | None = None) -> DataFrame:
    """rows joined with the row of their key in sizes (key, n, more), where n is how many rows have the key; keys must not repeat.

    Rows of hot keys stay where they are: of keys with so large a share of all rows there can't be more than HOT_SHARE, so that
    theirs are broadcast. All others are shuffled by key, and none has many rows. `known` is the extent of sizes, or of more than them.
    """
    total, most = known or extent(sizes)
    least = max(HOT, total // HOT_SHARE)
    if most <= least:
        return rows.join(sizes, key)
    few, rest = sizes.filter(F.col("n") > least), sizes.filter(F.col("n") <= least)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


# --- Arrow text -------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about `most` bytes, with the row where each begins."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)] if len(column) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, column.slice(a, b - a)


#: Word characters: digits, lower-case letters and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS = {p: np.ones(1, np.uint64) for p in (_P, _P_INVERSE)}


def _powers(p: int, n: int) -> np.ndarray:
    if len(_POWERS[p]) < n:
        grown = np.full(max(n, 1 << 21), p, np.uint64)
        grown[0] = 1
        _POWERS[p] = np.cumprod(grown, dtype=np.uint64)
    return _POWERS[p][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts in order: a 64-bit hash of each, and the words' offsets by text.

    Words are runs of digits, lower-cased letters and characters beyond ASCII.
    """

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
        inside = _WORD[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = offsets[1:-1]
            before[edges[edges < len(data)]] = False
            after[edges[edges > 0] - 1] = False
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _powers(_P_INVERSE, len(data) + 1)[self.start])
        self.offsets = np.searchsorted(self.start, offsets)
        self.data, self.bytes = data, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """The row of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value a word, by text."""
        total = np.zeros(len(values) + 1, values.dtype)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each text's sequence of words, as two columns."""
        place = np.arange(len(self.hash)) - np.repeat(self.offsets[:-1], self.counts)
        place = _powers(_P, int(self.counts.max(initial=0)) + 1)[place]
        return tuple(mix(self.sums(mix(self.hash + np.uint64(k)) * place) + self.counts.astype(np.uint64)) for k in (11, 23))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each text's runs of `width` words, and their offsets by text.

        A text of fewer words has one shingle of all of them; one without words has none.
        """
        rolled, multiplier = np.zeros(max(0, len(self.hash) - width + 1), np.uint64), np.uint64(0x9FB21C651E98DF25)
        for k in range(width):
            rolled = rolled * multiplier + self.hash[k : k + len(rolled)]
        counts = self.counts
        made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        offsets = np.concatenate([[0], np.cumsum(made)])
        out = np.zeros(offsets[-1], np.uint64)
        whole = np.repeat(counts >= width, made)
        at = np.arange(len(out)) - np.repeat(offsets[:-1] - self.offsets[:-1], made)
        out[whole] = rolled[at[whole]]
        short = np.flatnonzero((counts > 0) & (counts < width))
        value = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            value[has] = value[has] * multiplier + self.hash[self.offsets[short[has]] + k]
        out[offsets[short]] = value + np.uint64(0x51ED27)
        return mix(out), offsets


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def without_nulls(column: str):
    return F.coalesce(F.col(column), F.lit(""))
