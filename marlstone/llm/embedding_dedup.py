"""Near duplicates among vectors of a label: sign hashes in several tables, exact cosines, connected components.

A table hashes a vector to the signs of its products with some random hyperplanes. Vectors at an angle share a sign with the probability
1 - angle / pi, and so a table's code with that to the power of its bits; tables are as many as find a pair at the threshold with the
wanted recall. Bits grow with the logarithm of the largest label, so that by chance few vectors share a code at any size.

Equal vectors are one vector with a count. Codes are counted first, and only vectors that share one with another are sent to its bucket; there
each pair is decided by its exact cosine, and counts in the first table that both share alone. A bucket beyond BLOCK vectors is dealt out as pairs of
blocks. What leaves a task is a count for each vector and the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.shared import attach, extent, materialize

LEAST, RECALL, SEED = 0.93, 0.999, 7
#: Vectors of a block; buckets up to SMALL are compared many at a time, by distance of rows.
BLOCK, SMALL = 1024, 48
#: Bits of a code at least and at most, and how many there are beyond one code for each vector of the largest label: with them few vectors are
#: sent to a bucket for nothing.
BITS, MORE = (6, 30), 3
#: Pairs whose codes are compared at a time.
PAIRS = 1 << 17


def bits_for(largest: int) -> int:
    """Bits of a code: as many as give each vector of the largest label 2^MORE codes."""
    return min(max(BITS[0], int(math.log2(max(largest, 1))) + MORE), BITS[1])


def tables_for(bits: int, least: float = LEAST, recall: float = RECALL) -> int:
    """Tables after which a pair at the threshold has shared a code with this probability."""
    one = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def comparable(vector: Column) -> Column:
    """Whether a vector can be compared: it has components, all there and finite, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of norm 1; shorter ones end in zeros, which no cosine minds."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    out /= np.maximum(np.abs(out).max(1, initial=0), 1e-300)[:, None]  # so that no square overflows
    return out / np.sqrt((out * out).sum(1))[:, None]


def _planes(dimensions: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimensions]).normal(size=(dimensions, n))


def _coded(bits: int, tables: int):
    weight = 1 << np.arange(bits, dtype=np.int64)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            unit, codes = _matrix(batch.column(2)), np.zeros((len(batch), tables), np.int32)
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = _planes(size, bits * tables)
                rows = np.flatnonzero(sizes == size)
                signs = unit[rows][:, :size] @ planes[size] > 0
                codes[rows] = signs.reshape(len(rows), tables, bits) @ weight
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, held], [*batch.schema.names, "codes"])

    return over


_BUCKET = ["space", "place", "code"]
_TILE = [*_BUCKET, "low", "high"]


def _near_rows(unit: np.ndarray, bucket: np.ndarray, small: np.ndarray, least: float) -> tuple[list, list]:
    """Pairs within small buckets, of which rows stand together: row i is compared with row i + k while both are of one bucket."""
    left, right = [], []
    for k in range(1, SMALL):
        i = np.flatnonzero((bucket[:-k] == bucket[k:]) & small[:-k])
        if not len(i):
            break
        for part in np.array_split(i, len(i) // PAIRS + 1):
            alike = np.einsum("ij,ij->i", unit[part], unit[part + k]) >= least
            left.append(part[alike])
            right.append(part[alike] + k)
    return left, right


def _near_block(unit: np.ndarray, low: np.ndarray, high: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within one block of a large bucket, or between two blocks of it."""
    i, j = np.nonzero(unit[low] @ unit[low if high is None else high].T >= least)
    once = (i < j) if high is None else slice(None)
    return low[i[once]], (low if high is None else high)[j[once]]


def _first(codes: np.ndarray, i: np.ndarray, j: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether this is the first table whose code both rows of a pair share."""
    earlier = np.arange(codes.shape[1])[None, :] < place[:, None]
    return ~((codes[i] == codes[j]) & earlier).any(1)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _linked(least: float):
    """Tiles that stand together -> (uid, links, other): how many vectors a row is linked with here, and an edge of the forest."""

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda name: rows.column(rows.schema.get_field_index(name))
        keys = np.stack([column(k).to_numpy().astype(np.int64) for k in _TILE], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        size = np.diff(np.append(starts, len(keys)))
        crossed = keys[starts, 3] != keys[starts, 4]
        large = crossed | (size > SMALL)
        bucket, unit, copies = np.repeat(np.arange(len(starts)), size), _matrix(column("v")), column("copies").to_numpy()
        codes = column("codes").flatten().to_numpy().reshape(len(rows), -1)
        i, j = _near_rows(unit, bucket, ~large[bucket], least)
        block = column("block").to_numpy()
        for k in np.flatnonzero(large):
            one = np.arange(starts[k], starts[k] + size[k])
            a, b = _near_block(unit, *((one[block[one] == keys[starts[k], c]] for c in (3, 4)) if crossed[k] else (one, None)), least)
            i.append(a)
            j.append(b)
        left, right = np.concatenate([np.zeros(0, np.int64), *i]), np.concatenate([np.zeros(0, np.int64), *j])
        place = keys[:, 1]
        kept = [at[_first(codes, left[at], right[at], place[left[at]])] for at in np.array_split(np.arange(len(left)), len(left) // PAIRS + 1)]
        left, right = left[np.concatenate(kept)], right[np.concatenate(kept)]
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        root, some = _forest(len(rows), left, right), np.flatnonzero(links)
        uid = column("uid").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(uid[root[some]])], ["uid", "links", "other"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy().astype(np.int64) for k in _TILE], 1)
            last = np.flatnonzero((keys != keys[-1]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on in the next batch
            if held and not cut:
                first = np.array([held[-1].column(held[-1].schema.get_field_index(k))[len(held[-1]) - 1].as_py() for k in _TILE])
                if (first != keys[0]).any():
                    yield of(_together(held))
                    held = []
            if cut:
                yield of(_together([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield of(_together(held))

    return over


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def near_duplicates(embeddings: DataFrame, least: float = LEAST, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): with how many others of its label a vector has a cosine of `least` or more, and the smallest id that such links lead to.

    Null, empty and zero vectors, those with null or not finite components, those without a label and those of another length link with
    nothing: no links, their own component, kept. Each row is a vector: rows that repeat an id and its vector are linked copies of each other,
    and a row follows its own vector's links. A vector with a null id links with nothing, and is kept. What has a cosine of exactly `least` is
    linked. An empty table gives no rows. Other columns are ignored. Links are exact; of those at the threshold a share of `recall` is found, of nearer ones more.
    """
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & comparable(F.col("v"))
    own = ["space", "h1", "h2"]
    hashed = rows.filter(fit).select("vec_id", F.xxhash64("label", F.size("v")).alias("space"), F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"), "v")
    groups = materialize(hashed.groupBy(*own).agg(F.count("*").alias("n"), F.min("vec_id").alias("node")), "groups")
    known = extent(groups)
    vectors = attach(hashed, groups, own, known).filter("vec_id = node").dropDuplicates(own).select("v", "space", "h1", "h2", "node", F.col("n").alias("copies"))
    largest = groups.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    bits = bits_for(largest)
    tables = tables_for(bits, least, recall)
    numbered = vectors.select(F.monotonically_increasing_id().alias("uid"), "copies", "v", *own, "node")
    coded = materialize(numbered.mapInArrow(_coded(bits, tables), f"uid long, copies long, v {vectors.schema['v'].dataType.simpleString()}, space long, h1 long, h2 long, node {vectors.schema['node'].dataType.simpleString()}, codes array<int>"), "coded")

    keys = coded.select("uid", "space", F.posexplode("codes").alias("place", "code"))
    shared = materialize(keys.groupBy(*_BUCKET).agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = attach(keys, shared, _BUCKET).select("uid", *_BUCKET, blocks.alias("blocks"), F.pmod(F.xxhash64("uid"), blocks).cast("int").alias("block"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("uid", *_BUCKET, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    sent = dealt.join(coded.select("uid", "copies", "v", "codes"), "uid")
    tiles = sent.repartition(*_TILE).sortWithinPartitions(*_TILE)
    links = materialize(tiles.mapInArrow(_linked(least), "uid long, links long, other long"), "links")

    counts = links.groupBy("uid").agg(F.sum("links").alias("links"))
    labels = components(links.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    found = materialize(coded.select("uid", *own, "node", F.col("copies").alias("n")).join(counts, "uid", "left").join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid")), "found")
    smallest = found.groupBy("label").agg(F.min("node").alias("component_id"), F.count("*").alias("n"))
    told = attach(found.select("label", *own, F.col("n").alias("copies"), "links"), smallest, "label").select(*own, F.col("copies").alias("n"), "links", "component_id")
    linked = attach(hashed.select("vec_id", *own), told, own, known).select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle(least: float = LEAST) -> str:
    """DuckDB SQL of the same rows by comparing all pairs of a label, for unique ids."""
    return f"""WITH RECURSIVE fit AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {least}),
        reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
        parts AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a), counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN parts ON vec_id = parts.a LEFT JOIN counts ON vec_id = counts.a"""
