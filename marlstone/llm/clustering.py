"""Clustering of vectors around centroids, exactly as a full search would, with Hamerly's bounds.

Vectors are whole numbers, and so are centroids and squared distances. Beside its cluster each vector keeps two numbers: a bound
that its own centroid is not farther than, and one that no other centroid is nearer than. When centroids have moved, the first grows by
its own centroid's drift and the second shrinks by the largest drift of the others. Where the first is still below the second (or below half
of the way from its centroid to the nearest other one), the cluster can't have changed. Of the rest the distance to its own centroid is worked out, and
only what is ambiguous then is held against all centroids, in whole numbers. Bounds are floating point and are compared
with a margin, so that they only ever save a search and never decide a tie.

Vectors and bounds are written between rounds. What changes hands is added up as differences of sums, so a later round reads
few vectors for them, and the driver gets one number for each cluster and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import materialize

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components beyond this would give squared distances that a long can't hold.
LIMIT = 1 << 27
#: Relative margin of bounds: far above what rounding adds in as many rounds as anyone runs.
MARGIN = 1e-11

_STATE = "vec_id {}, q array<int>, cluster int, before int, upper double, lower double, scans int, distance long"


def whole(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, q): vectors of so many components, none null or not finite, as whole numbers floor(scale * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    number = lambda x: F.floor(x.cast("double") * scale)
    inside = lambda x: F.when(F.abs(x.cast("double") * scale) <= LIMIT, number(x).cast("int")).otherwise(F.raise_error(F.lit(f"components beyond {LIMIT / scale}")).cast("int"))
    kept = F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite), F.lit(False))
    return vectors.filter(kept).select(F.col(key).alias("vec_id"), F.transform(vector, inside).alias("q"))


def chosen(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of their ids, in their order; null ids come last, and of one id the smaller vector first."""
    order = [F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)), F.asc("q")]
    return np.array([r.q for r in rows.orderBy(*order).limit(clusters).collect()], np.int64)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def _squared(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    return (q * q).sum(1)[:, None] - 2 * (q @ centres.T) + (centres * centres).sum(1)[None, :]


def _searched(q: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid, ties to the smaller number, and the distances of it and of the next one."""
    squared = _squared(q, centres)
    nearest = squared.argmin(1)
    rows = np.arange(len(q))
    upper = np.sqrt(squared[rows, nearest].astype(float))
    others = squared.astype(float)
    others[rows, nearest] = np.inf
    return nearest, upper, np.sqrt(others.min(1))


def _assign(centres: np.ndarray, drift: np.ndarray | None, last: bool):
    """A step over batches of the state: whose cluster may have changed is searched. Without drift there are no bounds yet."""
    k, dimensions = centres.shape
    apart = np.sqrt(_squared(centres, centres).astype(float))
    np.fill_diagonal(apart, np.inf)
    half = apart.min(1) / 2
    away = np.array([np.delete(drift, c).max(initial=0) for c in range(k)]) if drift is not None else None

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1), dimensions)
            if drift is None:
                cluster, upper, lower = _searched(q, centres)
                before, scans = np.full(len(q), -1), np.ones(len(q), np.int64)
            else:
                before, upper, lower, scans = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in (2, 4, 5, 6))
                cluster = before.copy()
                upper, lower = upper + drift[cluster], lower - away[cluster]
                safe = np.maximum(lower, half[cluster]) * (1 - MARGIN)
                maybe = np.flatnonzero(upper * (1 + MARGIN) >= safe)
                own = q[maybe] - centres[cluster[maybe]]
                upper[maybe] = np.sqrt((own * own).sum(1).astype(float))
                maybe = maybe[upper[maybe] * (1 + MARGIN) >= safe[maybe]]
                cluster[maybe], upper[maybe], lower[maybe] = _searched(q[maybe], centres)
                scans[maybe] += 1
            own = q - centres[cluster] if last else None
            distance = (own * own).sum(1) if last else np.zeros(len(q), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans.astype(np.int32)), pa.array(distance)],
                ["vec_id", "q", "cluster", "before", "upper", "lower", "scans", "distance"],
            )

    return over


def _moved(k: int, dimensions: int):
    """Of the vectors that changed hands: what each cluster gains, by dimension; dimension -1 is the count."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, dimensions + 1), np.int64)  # the last row is for what had no cluster before
        for batch in batches:
            q = _matrix(batch.column(0), dimensions)
            for column, sign in ((1, 1), (2, -1)):
                cluster = batch.column(column).to_numpy()
                for c in np.unique(cluster):
                    rows = cluster == c
                    total[c, :dimensions] += sign * q[rows].sum(0)
                    total[c, dimensions] += sign * rows.sum()
        c, d = np.nonzero(total[:k])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d])], ["cluster", "dimension", "total"])

    return over


def grouped(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, q, cluster, distance, scans) of the kept vectors, and the final centroids, whole numbers by cluster.

    Vectors that are null, have another length, or null or not finite components are left out. Ties go to the smaller cluster; a cluster
    that is left without vectors keeps its centroid. Repeated rows are vectors of their own. A null id is kept. Fewer vectors than clusters
    give fewer clusters; an empty table gives no rows and no centroids. Components beyond LIMIT / scale are an error, as distances wouldn't fit a long.
    `scans` is how often a vector was held against all centroids. Other columns are ignored.
    """
    state = materialize(whole(vectors, dimensions, scale, key, vector), "whole")
    centres = chosen(state, clusters, seed).reshape(-1, dimensions)
    schema = _STATE.format(state.schema["vec_id"].dataType.simpleString())
    if not len(centres):
        return state.sparkSession.createDataFrame([], schema).select("vec_id", "q", "cluster", "distance", "scans"), centres
    k, total, drift = len(centres), np.zeros((len(centres), dimensions + 1), np.int64), None
    for n in range(rounds + 1):
        state = materialize(state.mapInArrow(_assign(centres, drift, n == rounds), schema), "assigned")
        if n == rounds:
            break
        moved = state.filter("cluster <> before").select("q", "cluster", "before").mapInArrow(_moved(k, dimensions), "cluster int, dimension int, total long")
        for row in moved.groupBy("cluster", "dimension").agg(F.sum("total").alias("total")).collect():
            total[row.cluster, row.dimension] += row.total
        some = total[:, dimensions] > 0
        after = centres.copy()
        after[some] = total[some, :dimensions] // total[some, dimensions :]
        step = after - centres
        drift, centres = np.sqrt((step * step).sum(1).astype(float)) * (1 + MARGIN), after
    return state.select("vec_id", "q", "cluster", "distance", "scans"), centres


def summary(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of what `grouped` gives."""
    spark = assigned.sparkSession
    inertia = {r.cluster: r.n for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), s) for c, s in enumerate(sha)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL of the same rows by full search."""
    distance = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS cluster, q AS c FROM kept QUALIFY cluster < {clusters})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, q, cluster, distance FROM (SELECT vec_id, q, cluster, CAST({distance} AS BIGINT) AS distance FROM kept, c{n}) QUALIFY row_number() OVER (PARTITION BY vec_id, q ORDER BY distance, cluster) = 1)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT cluster, i, sum(q[i]) AS total, count(*) AS n FROM (SELECT cluster, q, unnest(range(1, {dimensions} + 1)) AS i FROM a{n}) GROUP BY ALL)")
            parts.append(f"m{n} AS (SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY cluster)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, p.c) AS c FROM c{n} p LEFT JOIN m{n} m USING (cluster))")
    last = rounds
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (cluster)"""
