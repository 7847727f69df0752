"""Language identification by rank-order profiles.

A language's profile ranks the n-grams (1 to 3 letters, words parted by one space) that its training
texts use most. A text's own most frequent n-grams are ranked alike, and its distance to a profile
is the sum of how far each is out of place; an n-gram that a profile lacks counts as furthest out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.shared import byte_slices

#: N-grams ranked in a profile, and in a text.
PROFILE, RANKED = 600, 300
#: Languages at most: a column with more values than that isn't one of languages.
MOST = 2000
#: Counts that a task holds before it gives them on.
HELD = 1 << 20

#: N-grams are numbered by their letters' code points: first those of one letter, then of two, then of three.
_BASE = 0x110000 + 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter, or a mark upon one."""
    return np.array([unicodedata.category(chr(k))[0] in "LM" for k in range(0x110000)])


def _grams(column: pa.Array) -> Iterator[np.ndarray]:
    """The n-grams of each text of a slice, in order, without those of only spaces; a space is 0."""
    letters = _letters()
    for text in pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())).to_pylist():
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        c = np.concatenate([[0], np.where(letters[code], code, 0), [0]])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        two = c[:-1] * _BASE + c[1:]
        three = two[:-1] * _BASE + c[2:] if len(c) > 2 else two[:0]
        yield np.concatenate([c[c > 0], _BASE + two[two > 0], _BASE + _BASE**2 + three])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts of a task, added up as far as memory for HELD of them allows."""
    held: dict[str, pd.Series] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(n.index.to_numpy()), pa.array(n.to_numpy())], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for at, texts in byte_slices(batch.column(1)):
            own: dict[str, list[np.ndarray]] = {}
            for lang, grams in zip(batch.column(0).slice(at, len(texts)).to_pylist(), _grams(texts), strict=True):
                own.setdefault(lang, []).append(grams)
            for lang, parts in own.items():
                n = pd.Series(np.concatenate(parts)).value_counts(sort=False)
                held[lang] = held[lang].add(n, fill_value=0).astype(np.int64) if lang in held else n.astype(np.int64)
            if sum(map(len, held.values())) > HELD:
                yield from out()
    yield from out()


def profiles(texts: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The ranked n-grams of each language of (lang, text); all texts count, and `size` n-grams a language come back.

    Ties are broken by the n-grams' numbers. More than MOST languages are an error.
    """
    counts = texts.filter("lang IS NOT NULL").select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    found: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").limit(MOST * size + 1).collect():
        found.setdefault(row.lang, []).append(row.gram)
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} languages")
    return found


class Profiles:
    """Ranks of n-grams in the languages that have them: for each n-gram, in order, a stretch of (language, rank)."""

    def __init__(self, profile: dict[str, list[int]]) -> None:
        self.langs = sorted(profile)
        self.worst = max((len(p) for p in profile.values()), default=1)
        gram = np.array([g for lang in self.langs for g in profile[lang]], np.int64)
        lang = np.repeat(np.arange(len(self.langs)), [len(profile[x]) for x in self.langs])
        rank = np.concatenate([np.arange(len(profile[x])) for x in self.langs] or [np.zeros(0, np.int64)])
        order = np.argsort(gram, kind="stable")
        self.lang, self.rank = lang[order], rank[order]
        self.gram, first = np.unique(gram[order], return_index=True)
        self.start = np.append(first, len(gram))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """How far out of place the ranked n-grams are in each language, in all."""
        at = np.minimum(np.searchsorted(self.gram, top), len(self.gram) - 1)
        place = np.flatnonzero(self.gram[at] == top)
        first = self.start[at[place]]
        n = self.start[at[place] + 1] - first
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        off = np.abs(self.rank[entry] - np.repeat(place, n)) - self.worst
        return self.worst * len(top) + np.bincount(self.lang[entry], off, minlength=len(self.langs))


def ranked(grams: np.ndarray, most: int = RANKED) -> np.ndarray:
    """The most frequent n-grams in order, ties by number."""
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first[np.argsort(-np.diff(np.append(first, len(grams))), kind="stable")[:most]]]


def _identify(profile: dict[str, list[int]], most: int):
    held = Profiles(profile)

    def over(texts: pa.Array) -> pa.Array:
        best, score, size = [], [], []
        for _, some in byte_slices(texts):
            for grams in _grams(some):
                top = ranked(grams, most)
                size.append(len(top))
                if not len(top) or not held.langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                distance = held.distances(top)
                k = int(distance.argmin())
                best.append(held.langs[k])
                score.append(max(0.0, 1 - float(distance[k]) / (held.worst * len(top))))
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64())], ["lang", "score", "grams"])

    return over


def identified(text: Column, profile: dict[str, list[int]], most: int = RANKED) -> Column:
    """struct(lang, score, grams) of a text: the nearest profile (ties: the first by name), 1 less the share of the worst
    distance, and how many n-grams were ranked. A null text, one without a letter, and any text where there are no profiles, is
    `und` with score 0."""
    predict = partial(F.arrow_udf, returnType=StructType().add("lang", "string").add("score", "double").add("grams", "long"))(_identify(profile, most))
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("grams"))
    return F.when(text.isNull() | ~text.rlike("\\p{L}"), none).otherwise(predict.asNondeterministic()(text))


def level(grams: Column) -> Column:
    """Texts with about as many ranked n-grams: 0 for none, and one more for twice as many."""
    return F.floor(F.log2(grams + 1)).cast("int")


def middle_scores(texts: DataFrame, profile: dict[str, list[int]]) -> dict[int, float]:
    """The median score of texts (text) by level: what a text of that size in a known language scores. Texts without letters don't count.

    Scores are counted by level in steps of a thousandth, at most some thousand numbers a level, so that a rerun gives the same medians whatever the order; of two in the middle the lower
    one counts.
    """
    scored = texts.select(identified(F.col("text"), profile).alias("x")).select("x.*").filter("lang <> 'und'")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in scored.groupBy(level(F.col("grams")).alias("level"), F.floor(F.col("score") * 1000).alias("step")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.level, []).append((r.step, r.n))
    found = {}
    for size, steps in counts.items():
        left = (sum(n for _, n in steps) + 1) // 2
        for step, n in sorted(steps):
            left -= n
            if left <= 0:
                found[size] = step / 1000
                break
    return found


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, with profiles learnt from the rows that aren't held out.

    Rows with a null id, language or text don't teach. Repeated rows stay. Letters are code points, so texts of all scripts
    teach and are told apart; a very long text is read whole. Other columns are not looked at, whatever their names. An
    empty table gives no rows.
    """
    known = docs.filter(F.col(id_column).isNotNull() & F.col(text_column).isNotNull() & ~held_out(id_column))
    profile = profiles(known.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")))
    found = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), identified(F.col(text_column), profile).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
