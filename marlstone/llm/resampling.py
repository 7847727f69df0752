"""Resampling of documents towards a target's distribution of hashed word runs.

A document is scanned once. Its words stream past a ring of CRC-32 states, one for each of the last n starts: a word extends every
state by a blank and itself, and opens one of its own, so each run of 1 to n words costs one step and is never built as text. A
state's value picks the run's bucket. Buckets are written once; what all documents and the target hold of each bucket gives its gain,
and a document weighs the mean gain of its runs. Gumbel noise that hangs on the id alone makes the highest scores a draw without
replacement in proportion to the weights' exponentials.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import byte_slices, materialize, text_bytes

#: Words of a run at most, buckets, the percentage of documents that is drawn, the words that a drawn one has at least, and the seed of the noise.
RUN, BUCKETS, PERCENT, WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20

#: Letters and digits of ASCII, in lower case, and all that is beyond ASCII; the rest parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time."""
    low, at = text.translate(_WORDS), 0
    while at < len(low):
        end = low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def hashes(text: bytes, n: int = RUN) -> tuple[int, np.ndarray]:
    """How many words a text has, and the CRC-32 of each of its runs of 1 to n words, in the order of their ends."""
    words, ring, out = 0, [], [np.zeros(0, np.uint32)]
    for piece in pieces(text):
        words += len(piece)
        if n == 1:
            out.append(np.fromiter(map(crc32, piece), np.uint32, len(piece)))
            continue
        made: list[int] = []
        for word in piece:
            ring = [crc32(word, crc32(b" ", state)) for state in ring[1 - n :]]
            ring.append(crc32(word))
            made += ring
        out.append(np.array(made, np.uint32))
    return words, np.concatenate(out)


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def featured(docs: DataFrame, n: int = RUN, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, buckets): a document's runs by bucket, as little-endian numbers end to end. Null texts have none."""
    kind = _kind(buckets)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in byte_slices(batch.column(1)):
                data, offsets = text_bytes(texts)
                whole = data.tobytes()
                found = [hashes(whole[a:b], n) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([words for words, _ in found], pa.int64()),
                        pa.array([len(runs) for _, runs in found], pa.int64()),
                        pa.array([(runs % np.uint32(buckets)).astype(kind).tobytes() for _, runs in found], pa.binary()),
                    ],
                    ["key", "n_words", "n_features", "buckets"],
                )

    kind_of_key = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(over, f"key {kind_of_key}, n_words long, n_features long, buckets binary").withColumnRenamed("key", key)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all rows each bucket holds: tasks add up their own, Spark the tasks', and `buckets` numbers at most come to the driver."""
    kind = _kind(buckets)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, _ = _numbers(batch.column(0), kind)
            total += np.bincount(values, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.select("buckets").mapInArrow(over, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column end to end, and n + 1 offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) and data is not None else np.zeros(0, kind)
    return values, (offsets - offsets[0]) // kind.itemsize if len(column) else np.zeros(1, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the log of its share of the target over that of the source, each count one more, rounded down."""
    n = len(source)
    share = ((target + 1.0) * (float(source.sum()) + n)) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight): the mean gain of a row's runs, rounded down; 0 without any."""
    kind = _kind(len(gain))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _numbers(batch.column(3), kind)
            total = np.concatenate([[0], np.cumsum(gain[values])])
            runs = np.diff(offsets)
            weight = (total[offsets[1:]] - total[offsets[:-1]]) // np.maximum(runs, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["key", "n_words", "n_features", "weight"])

    kind_of_key = rows.schema[key].dataType.simpleString()
    return rows.select(key, "n_words", "n_features", "buckets").mapInArrow(over, f"key {kind_of_key}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def ranked(rows: DataFrame, percent: int = PERCENT, least: int = WORDS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """rows (key, n_words, weight) with `score` and `rank`: of those with so many words the highest scores, ties to the smaller key.

    Scores are whole numbers within some 120,000, whatever the table's size: gains lie within 1000 ln of all runs there can be, the noise
    between -3,114 and 22,874. So rows are counted by score, and the counts tell at which rank a score begins; only rows of one
    score are put in order together, and no task holds them all.
    """
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = materialize(rows.withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= least
    counts = scored.filter(enough).groupBy("score").agg(F.count("*").alias("n")).collect()
    quota, before, starts = percent * sum(c.n for c in counts) // 100, 0, []
    for c in sorted(counts, key=lambda c: -c.score):
        if before >= quota:
            break
        starts.append((c.score, before))
        before += c.n
    spark = rows.sparkSession
    begin = F.broadcast(spark.createDataFrame(starts, "score long, _before long"))
    lowest = starts[-1][0] if starts else None
    drawn = enough & (F.col("score") >= lowest) if starts else F.lit(False)
    order = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(key)))
    placed = scored.filter(drawn).join(begin, "score").withColumn("rank", F.col("_before") + order).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).drop("_before")
    return placed.select(*scored.columns, "rank").union(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, n: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least: int = WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): a draw of documents by how much likelier their runs are in the target.

    A null text is empty: no words, weight 0. A very long text is scanned whole, a piece at a time. A null key is hashed as `null` and comes
    last among ties. Of rows with the same key and score any order counts. An empty table gives no rows; an empty target has no runs, so
    that gains favour what is rare. Other columns of either table are ignored.
    """
    runs = materialize(featured(docs, n, buckets, key, text), "runs")
    wanted = featured(target.select(F.lit(0).alias("_"), F.col(target_text).alias("_text")), n, buckets, "_", "_text")
    gain = gains(bucket_counts(runs, buckets), bucket_counts(wanted, buckets))
    return ranked(weighed(runs, gain, key), percent, least, seed, key)


def drawn(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that were drawn, with all their columns."""
    return docs.join(ranks.filter("rank IS NOT NULL").select(key).distinct(), key, "left_semi")


def oracle(n: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least: int = WORDS, seed: int = SEED) -> str:
    """DuckDB SQL of the same rows for runs of single words; CRC-32 is worked out from its polynomial, by word."""
    assert n == 1
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda table, key: f"SELECT {key} AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    rounds = ", ".join(f"t{k + 1} AS MATERIALIZED (SELECT i, {bit} AS c FROM t{k})" for k in range(8))
    code = lambda digit: f"(instr('0123456789ABCDEF', {digit}) - 1)"
    return f"""WITH t0 AS (SELECT i, i AS c FROM (SELECT unnest(range(256)) AS i)), {rounds}, crc AS (SELECT list(c ORDER BY i) AS t FROM t8),
        a AS MATERIALIZED ({words("documents", "doc_id")}), b AS MATERIALIZED ({words("benchmark", "item_id")}),
        distinct_words AS (SELECT DISTINCT w FROM (SELECT w FROM a UNION ALL SELECT w FROM b)),
        bytes AS (SELECT w, list_transform(range(CAST(length(hex(encode(w))) / 2 AS BIGINT)), lambda k: {code("substr(hex(encode(w)), k * 2 + 1, 1)")} * 16 + {code("substr(hex(encode(w)), k * 2 + 2, 1)")}) AS x FROM distinct_words),
        hashed AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(x, lambda v: v::BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS bucket FROM bytes, crc),
        s AS (SELECT bucket, count(*) AS n FROM a JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (w) GROUP BY bucket),
        totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS ss, coalesce((SELECT sum(n) FROM t), 0) AS tt),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (ss + {buckets})::DOUBLE) / ((s.n + 1)::DOUBLE * (tt + {buckets})::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), totals),
        per AS (SELECT k, count(*) AS n, sum(g) AS g FROM a JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY k),
        d AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE CAST((g - (((g % n) + n) % n)) // n AS BIGINT) END AS weight, sha256('{seed}:' || doc_id) AS sha FROM documents LEFT JOIN per ON doc_id = k),
        h AS (SELECT *, list_reduce(list_transform(range(1, 9), lambda k: (instr('0123456789abcdef', substr(sha, k, 1)) - 1)::BIGINT), lambda x, y: x * 16 + y) AS h FROM d),
        scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
        drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {least} QUALIFY rank <= (SELECT {percent} * count(*) // 100 FROM scored WHERE n_features >= {least}))
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, rank FROM scored LEFT JOIN drawn USING (doc_id)"""
