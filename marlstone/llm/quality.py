"""Quality classifier without hand labels.

Heuristic labellers each call a text good, bad, or abstain. Expectation-maximisation over the counts of
vote patterns estimates how often each labeller is right, and gives every pattern a probability of
good. Those posterior labels train a linear scorer over hashed byte trigrams and hashed bins of the
text's statistics, which then scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.shared import Words, byte_slices, text_bytes

#: The scorer's hash buckets, those of the statistics' bins among them.
BUCKETS, BINS = 4096, 512
#: Texts at most that train the scorer.
SAMPLE = 4000
#: A text is kept from this score on; short texts show little, and score near one half.
LEAST = 0.3

# --- statistics of texts ------------------------------------------------------------------------

_UPPER, _LOWER, _DIGIT, _PLAIN, _MARK, _SPACE, _WIDE = range(7)
_CLASS = np.full(256, _MARK)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = _PLAIN

STATISTICS = ("words", "upper", "marks", "plain", "digits", "distinct", "adjacent", "commonest", "length", "exclaims", "pipes", "letters", "signs", "runs")


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Vectors of statistics of a slice of texts; null counts as empty."""
    words = Words(texts)
    raw, offsets = text_bytes(texts)
    n, rows = words.counts, len(texts)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(row * 7 + _CLASS[raw], minlength=rows * 7).reshape(rows, 7)
    letters, size, some = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER], 1), np.maximum(np.diff(offsets), 1), np.maximum(n, 1)
    of = words.text_of()
    order = np.lexsort((words.hash, of))
    word, text = words.hash[order], of[order]
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])]) if len(word) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times, owner = np.diff(np.append(first, len(word))), text[first]
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, owner, times)
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])) if len(of) else np.zeros(0, np.int64)
    return {
        "words": n,
        "upper": kinds[:, _UPPER] / letters,
        "marks": kinds[:, _MARK] / size,
        "plain": kinds[:, _PLAIN] / some,
        "digits": kinds[:, _DIGIT] / size,
        "distinct": np.bincount(owner, minlength=rows) / some,
        "adjacent": np.bincount(of[same], minlength=rows) / some,
        "commonest": most / some,
        "length": words.sums((words.end - words.start).astype(np.int64)) / some,
        "exclaims": np.bincount(row[raw == ord("!")], minlength=rows) / some,
        "pipes": np.bincount(row[raw == ord("|")], minlength=rows) / some,
        "letters": (kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _WIDE]) / np.maximum(np.diff(offsets) - kinds[:, _SPACE], 1),
        "signs": kinds[:, _MARK] / some,
        "runs": np.bincount(row[1:][(raw[1:] == raw[:-1]) & (_CLASS[raw[1:]] == _MARK)], minlength=rows) / some,
    }


# --- labellers ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Labeller:
    """Calls a text bad where the statistic is in one of the bad ranges, good where in the good one, else abstains;
    it abstains from texts of fewer words than `least`."""

    name: str
    statistic: str
    good: tuple[float, float]
    bad: tuple[tuple[float, float], ...]
    least: int = 0

    def vote(self, found: dict[str, np.ndarray]) -> np.ndarray:
        """0 bad, 1 abstains, 2 good."""
        value, out = found[self.statistic], np.ones(len(found["words"]), np.int8)
        out[(value >= self.good[0]) & (value < self.good[1])] = 2
        for low, high in self.bad:
            out[(value >= low) & (value < high)] = 0
        out[found["words"] < self.least] = 1
        return out


_ALL = float("inf")
LABELLERS = (
    Labeller("shouting", "upper", (0, 0.15), ((0.4, _ALL),), 6),
    Labeller("odd marks", "marks", (0, 0.01), ((0.03, _ALL),), 3),
    Labeller("table", "pipes", (0, 0.02), ((0.08, _ALL),), 6),
    Labeller("exclaiming", "exclaims", (0, 0.1), ((0.25, _ALL),), 6),
    Labeller("loops", "distinct", (0.5, 1.01), ((0, 0.4),), 30),
    Labeller("stutter", "adjacent", (0, 0.06), ((0.15, _ALL),), 6),
    Labeller("one word", "commonest", (0, 0.2), ((0.35, _ALL),), 12),
    Labeller("punctuated", "plain", (0.05, 0.45), ((0, 0.01), (0.8, _ALL)), 20),
    Labeller("word length", "length", (3, 9), ((0, 2), (14, _ALL)), 6),
    Labeller("numbers", "digits", (0, 0.1), ((0.3, _ALL),), 3),
    Labeller("few letters", "letters", (0.93, 1.01), ((0, 0.87),), 6),
    Labeller("signs", "signs", (0, 0.1), ((0.25, _ALL),), 6),
    Labeller("runs of marks", "runs", (0, 0.05), ((0.15, _ALL),), 6),
)


def votes(texts: pa.Array, found: dict[str, np.ndarray] | None = None, labellers: tuple[Labeller, ...] = LABELLERS) -> np.ndarray:
    """Votes of each labeller by text, from the texts' statistics, which are made where they aren't given."""
    found = statistics(texts) if found is None else found
    return np.stack([x.vote(found) for x in labellers], axis=1)


@dataclass
class LabelModel:
    """Good, and a kind of bad for each labeller: how common each class is, and by labeller and class the
    chance that a vote, where it is cast, is bad, -, or good.

    A bad text is often bad in one way only, so that one class of bad would take the commonest way for
    all of them. To abstain says nothing of the class: labellers abstain from short texts and doubtful values.
    """

    prior: np.ndarray  # (1 + labellers,); the first is good
    chance: np.ndarray  # (labellers, 1 + labellers, 3); 1 for an abstention

    def classes(self, cast: np.ndarray) -> np.ndarray:
        """Probability of each class for rows of votes."""
        log = np.log(self.prior) + sum(np.log(self.chance[k, :, cast[:, k]]) for k in range(cast.shape[1]))
        share = np.exp(log - log.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        return self.classes(cast)[:, 0]

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right where it votes."""
        return self.chance[:, 0, 2] * self.prior[0] + (self.chance[:, 1:, 0] * self.prior[1:]).sum(axis=1)


def estimate(cast: np.ndarray, counts: np.ndarray, rounds: int = 50, false_alarms: float = 0.01) -> LabelModel:
    """Expectation-maximisation over distinct rows of votes and how often each was cast.

    It begins with texts that some labeller calls bad as bad, in the kinds of those labellers. The labellers are made
    to be sure when they say bad: they say so of at most `false_alarms` of the good, and of half of their own kind.
    """
    bad = cast == 0
    share = np.where(bad.any(axis=1)[:, None], np.concatenate([np.full((len(cast), 1), 0.1), 0.9 * bad / np.maximum(bad.sum(axis=1), 1)[:, None]], axis=1), 0)
    share[~bad.any(axis=1), 0] = 1
    for _ in range(rounds):
        weight = share * counts[:, None]
        chance = np.ones((cast.shape[1], 1 + cast.shape[1], 3))
        for k in range(cast.shape[1]):
            no, yes = weight[bad[:, k]].sum(axis=0) + 0.5, weight[cast[:, k] == 2].sum(axis=0) + 0.5
            says = no / (no + yes)
            says[0] = min(says[0], false_alarms)
            says[1 + k] = max(says[1 + k], 0.5)
            chance[k, :, 0], chance[k, :, 2] = says, 1 - says
        model = LabelModel((weight.sum(axis=0) + 1) / (counts.sum() + 1 + cast.shape[1]), chance)
        share = model.classes(cast)
    return model


# --- scorer ---------------------------------------------------------------------------------------

_SCALE = 25.0


def _hashed(texts: pa.Array, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each byte trigram, its row, the trigrams by row, and the buckets of the statistics' bins by row."""
    raw, offsets = text_bytes(texts)
    wide = raw.astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = rows[2:] == rows[:-2]
    bucket = BINS + ((wide[:-2] * 7919 + wide[1:-1] * 104729 + wide[2:] * 15485863) >> 4) % (BUCKETS - BINS)
    bins = []
    for k, name in enumerate(STATISTICS):
        value = found[name]
        level = np.log2(value + 1) if name in ("words", "length") else np.minimum(value, 1) * 15
        bins.append(k * 16 + np.minimum(level.astype(np.int64), 15))
    return bucket[inside], rows[2:][inside], np.maximum(np.bincount(rows[2:][inside], minlength=len(texts)), 1), np.stack(bins, axis=1)


def vectors(texts: pa.Array, found: dict[str, np.ndarray]) -> np.ndarray:
    """Dense features of a few texts: scaled shares of trigrams by bucket, and ones for bins."""
    bucket, row, n, bins = _hashed(texts, found)
    out = np.bincount(row * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS) * (_SCALE / n)[:, None]
    out[np.arange(len(texts))[:, None], bins] = 1
    return out


def train(x: np.ndarray, good: np.ndarray, rounds: int = 300, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels; both classes weigh the same."""
    weight, bias, speed, turn = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3) if len(good) else 0.5
    matter = np.where(good > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(rounds if len(good) else 0):
        off = (1 / (1 + np.exp(-(x @ weight + bias))) - good) * matter / len(good)
        speed = 0.9 * speed - rate * (x.T @ off.astype(np.float32) + decay * weight)
        turn = 0.9 * turn - rate * float(off.sum())
        weight, bias = weight + speed, bias + turn
    return weight, bias


@dataclass
class Classifier:
    model: LabelModel
    weight: np.ndarray
    bias: float

    def apply(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes, posterior and score of a slice of texts."""
        found = statistics(texts)
        cast = votes(texts, found)
        bucket, row, n, bins = _hashed(texts, found)
        total = np.bincount(row, self.weight[bucket], minlength=len(texts)) * _SCALE / n + self.weight[bins].sum(axis=1) + self.bias
        return cast, self.model.posterior(cast), 1 / (1 + np.exp(-np.clip(total, -500, 500)))


_SIGNS = {c: k for k, c in enumerate("-0+")}


def _pattern(cast: np.ndarray) -> pa.Array:
    return pa.array(["".join(x) for x in np.array(["-", "0", "+"])[cast]], pa.string())


def _cast(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_pattern(votes(some)) for _, some in byte_slices(texts)] or [pa.array([], pa.string())])


def _taught(texts: pa.Array) -> pa.Array:
    """Votes and vector of each text."""
    cast, made = [], []
    for _, some in byte_slices(texts, 1 << 18):
        found = statistics(some)
        cast.append(_pattern(votes(some, found)))
        made += [x.astype(np.float16).tobytes() for x in vectors(some, found)]
    return pa.StructArray.from_arrays([pa.concat_arrays(cast or [pa.array([], pa.string())]), pa.array(made, pa.binary())], ["votes", "vector"])


#: What nothing has been learnt from says good.
NO_MODEL = LabelModel(np.eye(1 + len(LABELLERS))[0] * 0.99 + 1e-4, np.ones((len(LABELLERS), 1 + len(LABELLERS), 3)))


def _learn(model: LabelModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights and bias of the scorer, from the sample's votes and vectors."""
    held = list(batches)
    cast, x, at = [], np.empty((sum(b.num_rows for b in held), BUCKETS), np.float32), 0
    for batch in held:
        for votes_, vector in zip(*(batch.column(c) for c in ("votes", "vector")), strict=True):
            x[at] = np.frombuffer(vector.as_buffer(), np.float16)
            cast.append([_SIGNS[c] for c in votes_.as_py()])
            at += 1
    good = model.posterior(np.array(cast, int).reshape(len(x), -1)) if at else np.zeros(0)
    weight, bias = train(x, good.astype(np.float32))
    yield pa.RecordBatch.from_pydict({"weight": pa.array([weight.tobytes()], pa.binary()), "bias": pa.array([float(bias)], pa.float64())})


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Classifier:
    """Learn from texts alone: votes of all of them, and the scorer from at most `sample` of them by a hash.

    At most 3 ** len(LABELLERS) vote patterns, and the weights, come to the driver; the sample's vectors (8 kB each) go to one task. Null texts count as
    empty; repeated rows count, and are drawn together. From an empty table nothing is learnt, and all is good.
    """
    text, drawn = F.col(text_column), F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(1 << 40))
    cast = F.arrow_udf(_cast, "string")
    patterns = docs.select(cast(text).alias("votes")).groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not patterns:
        return Classifier(NO_MODEL, np.zeros(BUCKETS, np.float32), 0.0)
    rows, counts = np.array([[_SIGNS[c] for c in r.votes] for r in patterns]), np.array([r.n for r in patterns], float)
    model = estimate(rows, counts)
    share = min(1.0, 1.25 * sample / counts.sum() + 1e-9)
    taught = F.arrow_udf(_taught, StructType().add("votes", "string").add("vector", "binary"))
    some = docs.select(text.alias("text"), drawn.alias("drawn")).filter(F.col("drawn") <= F.lit(int(share * (1 << 40))))
    # vectors are made where the texts are; ties of `drawn` are texts of one id, whose votes and vectors decide
    taken = some.select("drawn", taught("text").alias("x")).select("drawn", "x.votes", "x.vector").orderBy("drawn", "votes", "vector").limit(sample)
    learnt = taken.mapInArrow(partial(_learn, model), "weight binary, bias double").first()
    weight, bias = (np.frombuffer(learnt.weight, np.float32), learnt.bias) if learnt else (np.zeros(BUCKETS, np.float32), 0.0)
    return Classifier(model, weight, bias)


_SCORED = StructType().add("votes", "string").add("posterior", "double").add("score", "double")


def scored(text: Column, classifier: Classifier) -> Column:
    """struct(votes, posterior, score) of a text: one sign a labeller (- bad, 0 abstains, + good), the label model's
    probability of good, and the scorer's. A null text counts as an empty one."""

    def over(texts: pa.Array) -> pa.Array:
        parts = [classifier.apply(some) for _, some in byte_slices(texts)]
        columns = [
            pa.concat_arrays([_pattern(p[0]) for p in parts] or [pa.array([], pa.string())]),
            *(pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.float64()) for k in (1, 2)),
        ]
        return pa.StructArray.from_arrays(columns, ["votes", "posterior", "score"])

    return F.arrow_udf(over, _SCORED).asNondeterministic()(text)


def accuracies(spark: SparkSession, model: LabelModel, labellers: tuple[Labeller, ...] = LABELLERS) -> DataFrame:
    """(labeller, accuracy, false_alarms, share): how often each labeller is right where it votes, how often it calls a good text
    bad, and the share of texts that are bad in its way."""
    right, alarms, share = model.accuracy(), model.chance[:, 0, 0], model.prior[1:]
    return spark.createDataFrame([(x.name, float(a), float(f), float(p)) for x, a, f, p in zip(labellers, right, alarms, share, strict=True)], "labeller string, accuracy double, false_alarms double, share double")


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) of each row; keep where score reaches `least`.

    Repeated rows stay and score alike; a null or empty text is judged by what an empty text shows (no labeller votes), a
    very long one whole. A score of exactly `least` is kept. Other columns are not looked at, whatever their names. An empty
    table gives no rows.
    """
    classifier = fit(docs, id_column, text_column)
    found = docs.select(F.col(id_column).alias("doc_id"), scored(F.col(text_column), classifier).alias("found"))
    return found.select("doc_id", "found.votes", "found.posterior", "found.score", (F.col("found.score") >= least).alias("keep"))
