"""Lexical, vector and graph retrieval over documents, and the fusion of their scores."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.counts import word_counts
from marlstone.functions.numeric import cosine, quantise
from marlstone.functions.text import tokens
from marlstone.sources.tables import materialize, shared_dir

K1, B, TITLE_BOOST = 1.2, 0.75, 0.25
EMBEDDING_WEIGHT, EMBEDDING_ONLY, EMBEDDING_LEAST = 0.35, 0.2, 0.15
SOURCE_BOOST = 0.05
RRF_K, ORIGINAL_WEIGHT, EXPANDED_WEIGHT = 60, 1.0, 0.7
GRAPH_CAP = 0.22
#: Hits of a page of results at most.
PAGE = 10_000
#: Vectors of a block, and blocks of queries whose best a task holds at once.
BLOCK, HELD = 1024, 256
#: Rows of numbers up to which they are broadcast.
BROADCAST = 100_000


def lexical_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, df, tf) of a corpus. Terms are counted within documents before they are shuffled."""
    words = docs.select(key, F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("term", key).agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@dataclass(frozen=True)
class Index:
    """A written inverted index: postings (term, key, tf, length), in order of terms within each batch of a file, and what a score needs of the corpus."""

    postings: DataFrame
    key: str
    path: str
    n: int
    average: float


def index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """The index of a corpus: one scan of its texts, whose terms are counted where they are, so that nothing is shuffled.

    Rows of a batch of texts are in the order of their terms, so that a question reads the pages of its terms alone; a frequent term's rows lie in all files alike. A
    document without terms counts, with a length of 1. Null keys are kept, null texts are empty.
    """
    counted = word_counts(docs.select(key, tokens(F.col(text)).alias("_words")), "_words").select(key, "term", F.greatest("length", F.lit(1)).alias("length"), "tf")
    path = f"{shared_dir(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    counted.write.parquet(path)
    postings, n = docs.sparkSession.read.schema(counted.schema).parquet(path), docs.count()
    words, empty = postings.agg(F.sum("tf"), F.count_if(F.col("term").isNull())).first()
    return Index(postings, key, path, max(1, n), max(1.0, ((words or 0) + empty) / max(1, n)))


def bm25(found: Index, query: list[str], titles: DataFrame | None = None) -> DataFrame:
    """(key, score, terms) of the documents that hold a query term; with titles (key, title), a term that one holds adds TITLE_BOOST.

    Reads the query's terms twice: once for how many documents hold each, of which the driver gets a number, and once for the scores.
    """
    key, terms = found.key, list(dict.fromkeys(query))
    hits = found.postings.filter(F.col("term").isin(*terms)).select(key, "term", "tf", "length")
    df = {r.term: r.n for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}
    if titles is not None:
        hits = hits.join(titles.select(key, F.lower("title").alias("_title")), key, "left")
    own, score, met = [], F.lit(0.0), []
    for k, term in enumerate(terms):
        idf = math.log(1 + (found.n - df.get(term, 0) + 0.5) / (df.get(term, 0) + 0.5))
        tf = F.col("tf").cast("double")
        part = F.lit(idf) * ((tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * (F.col("length") / F.lit(found.average)))))
        if titles is not None:
            part = part + F.when(F.contains("_title", F.lit(term)), TITLE_BOOST).otherwise(0.0)
        own.append(F.max(F.when(F.col("term") == term, part)).alias(f"s{k}"))
        score = score + F.coalesce(f"s{k}", F.lit(0.0))
        met.append(F.when(F.col(f"s{k}").isNotNull(), F.lit(term)))
    return hits.groupBy(key).agg(F.count("*"), *own).select(key, quantise(score, 6).alias("score"), F.array_compact(F.array(*met)).alias("terms"))


def top(scored: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows, ties by key."""
    return scored.orderBy(F.desc(score), key).limit(k)


def similar(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) to a query vector; what is below the least similarity counts 0."""
    found = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, F.when(found >= EMBEDDING_LEAST, found).otherwise(0.0).alias("similarity"))


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of norm 1 and their sizes: zeros where one is null, has a null or no norm; shorter ones end in zeros."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    out[~np.isfinite(out).all(1)] = 0.0
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1.0)[:, None], sizes


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """rows (key long, weight double, v array<double>) as blocks of BLOCK rows: their keys, weights, sizes and unit vectors as bytes. No row moves."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                unit, sizes = _unit(part.column(2))
                made = [part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1).to_numpy(zero_copy_only=False).astype(float), sizes, unit]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], [f"{name}_{c}" for c in ("key", "weight", "size", "unit")])

    return rows.mapInArrow(over, ", ".join(f"{name}_{c} binary" for c in ("key", "weight", "size", "unit")))


def _matched(rows: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], positive: bool) -> DataFrame:
    """(query, key, weight, similarity, score) of the k rows (key, weight, v) that score best for each query (key, v), ties by weight and key.

    A stated set of queries is held against all rows, block by block, as products of matrices of bounded size. Blocks of queries are written, so that Spark knows
    how few they are: it broadcasts them or, beyond that, pairs partitions. A task keeps the k best of each query of HELD blocks at most, in whatever order blocks meet, sorts only what is better than
    the last of these, and only those are shuffled.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list[np.ndarray]] = {}
        for batch in batches:
            for r in range(len(batch)):
                q, x = ([column[r].as_buffer() for column in batch.columns[at : at + 4]] for at in (0, 4))
                asked, keys, weight = q[0].to_pybytes(), np.frombuffer(x[0], np.int64), np.frombuffer(x[1], float)
                n = len(asked) // 8
                if asked not in kept:
                    if len(kept) >= HELD:
                        first = next(iter(kept))
                        yield told(first, kept.pop(first))
                    kept[asked] = [np.empty(0, t) for t in (np.int64, np.int64, float, float, float)]
                left, right = (np.frombuffer(s[3], float).reshape(m, -1) for s, m in ((q, n), (x, len(keys))))
                width = min(left.shape[1], right.shape[1])
                alike = left[:, :width] @ right[:, :width].T
                sizes = [np.frombuffer(s[2], np.int64) for s in (q, x)]
                if sizes[0].min() != sizes[0].max() or (sizes[1] != sizes[0][0]).any():
                    alike[sizes[0][:, None] != sizes[1][None, :]] = 0.0
                alike[alike < EMBEDDING_LEAST] = 0.0
                kept[asked] = joined(kept[asked], n, keys, weight, alike, score(alike, weight))
        for asked, held in kept.items():
            yield told(asked, held)

    def joined(held: list[np.ndarray], n: int, keys: np.ndarray, weight: np.ndarray, alike: np.ndarray, now: np.ndarray) -> list[np.ndarray]:
        """The k best (query's place, key, weight, similarity, score) of each query, of those held, in order, and a block's."""
        last = np.full(n, -1)
        last[held[0]] = np.arange(len(held[0]))
        full = np.bincount(held[0], minlength=n) >= k
        least = np.full(n, -np.inf)
        least[full] = held[4][last[full]]
        row, col = np.nonzero(now >= least[:, None])
        level = full[row] & (now[row, col] == least[row])
        heavy, small = held[2][last[row[level]]], held[1][last[row[level]]]
        worse = np.zeros(len(row), bool)
        worse[level] = (weight[col[level]] < heavy) | ((weight[col[level]] == heavy) & (keys[col[level]] >= small))
        row, col = row[~worse], col[~worse]
        if not len(row):
            return held
        every = [np.concatenate([a, b]) for a, b in zip(held, (row, keys[col], weight[col], alike[row, col], now[row, col]), strict=True)]
        order = np.lexsort((every[1], -every[2], -every[4], every[0]))
        every = [a[order] for a in every]
        place = np.arange(len(order)) - np.searchsorted(every[0], every[0])
        return [a[place < k] for a in every]

    def told(asked: bytes, held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asked, np.int64)[held[0]]), *(pa.array(a) for a in held[1:])], ["query", "key", "weight", "similarity", "score"])

    # full blocks of queries in few files: a product runs a task for each pair of partitions, and makes one side's blocks anew in each
    asked = materialize(_blocks(queries.hint("rebalance"), "q"), "asked")
    pairs = asked.crossJoin(_blocks(rows, "x"))
    found = pairs.mapInArrow(best, "query long, key long, weight double, similarity double, score double").filter("score > 0" if positive else "true")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("weight"), "key"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _vectors(rows: DataFrame, key: str, vector: str, weight: Column | float = 0.0) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight"), F.col(vector).cast("array<double>").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, similarity, place) of the k vectors most similar to each query (key, vector), ties by key; what is below the least similarity counts 0.

    Null vectors, and those of another length or no norm, are 0 from all; rows without a key are none.
    """
    rounded = lambda alike, weight: np.floor(alike * 1e6 + 0.5) / 1e6
    return _matched(_vectors(vectors, key, vector), _vectors(queries, key, vector), k, rounded, False).select("query", F.col("key").alias(key), F.col("score").alias("similarity"), "place")


def hybrid_nearest(lexical: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(query, key, lexical, embedding, graph, taxonomy, metadata, total, place): the k best of each query (key, vector) by lexical scores (key, score) and vectors (key, vector).

    The best lexical score counts 1; embeddings alone count at most EMBEDDING_ONLY. The lexical scores are those of one question in words, asked with each vector.
    """
    lexical = materialize(lexical.select(key, "score"), "lexical")
    best = lexical.agg(F.max("score")).first()[0] or 0.0
    rows = lexical.select(key, ((F.col("score") / best) if best > 0 else F.lit(0.0)).alias("_share")).join(vectors.select(key, vector), key, "full").withColumn("_share", F.coalesce("_share", F.lit(0.0)))

    def total(alike: np.ndarray, share: np.ndarray) -> np.ndarray:
        weighed = alike * EMBEDDING_WEIGHT
        return share + np.where(share > 0, weighed, np.minimum(weighed, EMBEDDING_ONLY)) + 0.0 + 0.0 + np.where(share > 0, SOURCE_BOOST, 0.0)

    rounded = lambda alike, share: np.floor(total(alike, share) * 1e6 + 0.5) / 1e6
    found = _matched(_vectors(rows, key, vector, F.col("_share")), _vectors(queries, key, vector), k, rounded, True)
    return found.select(
        "query", F.col("key").alias(key), quantise(F.col("weight"), 6).alias("lexical"), quantise(F.col("similarity"), 6).alias("embedding"), F.lit(0.0).alias("graph"), F.lit(0.0).alias("taxonomy"),
        F.when(F.col("weight") > 0, SOURCE_BOOST).otherwise(0.0).alias("metadata"), F.col("score").alias("total"), "place",
    )


def hybrid(lexical: DataFrame, vectors: DataFrame, graph: DataFrame | None = None, taxonomy: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, lexical, embedding, graph, taxonomy, metadata, total), from (key, score), (key, similarity) and (key, boost)s.

    The best lexical score counts 1. Embeddings alone count at most EMBEDDING_ONLY. Lexical scores, a key and a number each, are written
    once, so that texts aren't scanned again for the best of them.
    """
    lexical = materialize(lexical.select(key, "score"), "lexical")
    best = lexical.agg(F.max("score")).first()[0] or 0.0
    share = (F.col("score") / best) if best > 0 else F.lit(0.0)
    joined = lexical.select(key, share.alias("_lexical")).join(vectors, key, "full")
    for name, side in (("graph", graph), ("taxonomy", taxonomy)):
        joined = joined.join(side.select(key, F.col("boost").alias(f"_{name}")), key, "full") if side is not None else joined.withColumn(f"_{name}", F.lit(0.0))
    got = joined.select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_lexical", "similarity", "_graph", "_taxonomy")))
    weighted = F.col("similarity") * EMBEDDING_WEIGHT
    embedding = F.when(F.col("_lexical") > 0, weighted).otherwise(F.least(weighted, F.lit(EMBEDDING_ONLY)))
    metadata = F.when(F.col("_lexical") > 0, SOURCE_BOOST).otherwise(0.0)
    total = F.col("_lexical") + embedding + F.col("_graph") + F.col("_taxonomy") + metadata
    return got.select(
        key, quantise(F.col("_lexical"), 6).alias("lexical"), quantise(F.col("similarity"), 6).alias("embedding"), quantise(F.col("_graph"), 6).alias("graph"),
        quantise(F.col("_taxonomy"), 6).alias("taxonomy"), metadata.alias("metadata"), quantise(total, 6).alias("total"),
    ).filter("total > 0")


def placed(hits: DataFrame, *order) -> DataFrame:
    """hits, a page of PAGE rows at most, with their `place` from 1; more rows are an error, since a page is ranked in one task."""
    n = F.row_number().over(Window.orderBy(*order))
    few = F.when(n <= PAGE, n).otherwise(F.raise_error(F.lit(f"a page has at most {PAGE} hits")).cast("int"))
    return hits.orderBy(*order).limit(PAGE + 1).withColumn("place", few)


def fuse(variants: list[DataFrame], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """(key, score) by reciprocal ranks from 0, of scored variants, each a page; the first weighs ORIGINAL_WEIGHT."""
    ranked = []
    for n, scored in enumerate(variants):
        weight = ORIGINAL_WEIGHT if n == 0 else EXPANDED_WEIGHT
        ranked.append(placed(scored.select(key, "score"), F.desc("score"), key).select(key, (F.lit(weight) / (k + F.col("place") - 1)).alias("part")))
    return reduce(DataFrame.union, ranked).groupBy(key).agg(quantise(F.sum(F.col("part").cast("decimal(20,15)")).cast("double"), 9).alias("score"))


def coverage(found: DataFrame, query: list[str], terms: str = "terms") -> DataFrame:
    """found with `allowed` and `reason`: whether enough of the query is met."""
    asked, matched = len(set(query)), F.size(F.array_distinct(terms))
    column = lambda name: F.col(name) if name in found.columns else F.lit(0.0)
    more = (column("graph") > 0) | (column("taxonomy") > 0)
    reason = F.when(F.lit(asked < 3), "short-query").when(column("embedding") > 0, "semantic-signal").when(matched >= 2, "lexical-coverage").when((matched >= 1) & more, "semantic-signal").otherwise("insufficient-lexical-coverage")
    return found.withColumn("reason", reason).withColumn("allowed", F.col("reason") != "insufficient-lexical-coverage")


def evidence_budget(chunks: int, limit: int | None = None) -> tuple[int, int]:
    """Citations and characters that an answer may take, by the size of the corpus."""
    for below, citations, characters in ((100, 4, 6000), (501, 6, 12000), (2001, 8, 20000), (5001, 10, 30000)):
        if chunks < below:
            break
    else:
        citations, characters = 12, 40000
    return (max(1, limit) if limit is not None else citations), characters


def within_budget(ranked: DataFrame, characters: int, each: int = 360, order: tuple = ("rank",), text: str = "text") -> DataFrame:
    """The first rows of a page whose texts, cut to `each`, fit in so many characters together."""
    cut = placed(ranked.withColumn(text, F.substring(text, 1, each)), *order)
    so_far = F.sum(F.length(text)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("so_far", so_far).drop("place").filter(F.col("so_far") <= characters)


def _few(rows: DataFrame) -> DataFrame:
    """Rows of numbers to be broadcast if they are no more than BROADCAST; else as they are."""
    return F.broadcast(rows) if rows.limit(BROADCAST + 1).count() <= BROADCAST else rows


def graph_boosts(seeds: DataFrame, edges: DataFrame, cap: float = GRAPH_CAP) -> DataFrame:
    """(node, boost) of the neighbours of seeds (node) over edges (a, b), two hops out: .12 along an edge, .08 against it,
    .04 and .025 on the second hop; sums over seeds are capped, seeds get none. Repeated edges count once.

    Edges are sought out by the nodes of a hop before repeated ones go, so that no task holds edges that nothing leads to.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(True).alias("out")).union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), F.lit(False).alias("out")))
    begun = _few(seeds.distinct())
    first = both.join(begun.withColumnRenamed("node", "x"), "x").distinct().select(F.col("x").alias("seed"), F.col("y").alias("node"), F.when(F.col("out"), 12).otherwise(8).alias("near"))
    first = materialize(first.join(begun, "node", "left_anti").select("seed", "node", "near"), "graph-hop")
    met = _few(first.select("seed", "node").distinct())
    hop = both.join(_few(first.select(F.col("node").alias("x")).distinct()), "x", "left_semi").join(begun, F.col("y") == F.col("node"), "left_anti").distinct()
    second = hop.join(met.withColumnRenamed("node", "x"), "x").select("seed", F.col("y").alias("node"), F.when(F.col("out"), 4).otherwise(2.5).alias("near")).join(met, ["seed", "node"], "left_anti")
    summed = first.select("node", "near").union(second.select("node", "near")).groupBy("node").agg(F.sum(F.col("near").cast("decimal(12,3)")).alias("points"))
    return summed.select("node", F.least(F.lit(cap), F.col("points").cast("double") / 100).alias("boost"))


def rerank(hits: DataFrame, scores: DataFrame, n: int, key: str = "doc_id", total: str = "total") -> DataFrame:
    """hits in a new order: the first n by total + half their rerank score (squashed where it isn't in 0..1), the rest as before.

    hits are a page.
    """
    squashed = F.when(F.col("rerank").between(0, 1), F.col("rerank")).otherwise(1 / (1 + F.exp(-F.col("rerank"))))
    ranked = placed(hits, F.desc(total), key).join(scores.withColumnRenamed("score", "rerank"), key, "left")
    new = F.when(F.col("place") <= n, quantise(F.col(total) + 0.5 * F.coalesce(squashed, F.lit(0.0)), 6))
    return ranked.withColumn("reranked", new).withColumn("position", F.row_number().over(Window.orderBy((F.col("place") > n).cast("int"), F.desc_nulls_last("reranked"), F.desc(total), key))).drop("place", "rerank")
