"""Intake of content that may be known: what new records repeat, what to do about them, merges of records, and indexes made anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import fingerprint, normal_title
from marlstone.operators.dedup import normal_url, title_pairs
from marlstone.operators.retrieval import nearest

#: Similarity of vectors that is taken for a copy, that makes a candidate, and of titles that does.
SAME, CANDIDATE, TITLE = 0.98, 0.88, 0.85


def checked(new: DataFrame, known: DataFrame, key: str, text: str, url: str, title: str, vectors: tuple[DataFrame, DataFrame] | None = None, vector_key: str = "vec_id") -> DataFrame:
    """(key, reason, of, similarity) of new records: exact or semantic copies of a known one, else semantic_match, url_match or title_match
    candidates, else new. Of several known records the most similar counts, then the smallest key.

    Hashes, addresses and titles are joined on equal keys, titles that are only alike on their rarest tokens; vectors of new records go to
    all known ones in blocks. vectors are those of new and of known records.
    """
    marks = lambda rows: rows.select(F.col(key).cast("long").alias(key), fingerprint(F.col(text)).alias("exact"), normal_url(F.col(url)).alias("url"), normal_title(F.coalesce(F.col(title), F.lit(""))).alias("title"))
    mine, theirs = marks(new), marks(known)

    def first(kind: str) -> DataFrame:
        firsts = theirs.filter(F.col(kind) != "").groupBy(kind).agg(F.min(key).alias("of"))
        return mine.filter(F.col(kind) != "").join(firsts, kind).select(key, "of")

    found = [first("exact").select(key, F.lit(1).alias("rank"), F.lit("exact").alias("reason"), "of", F.lit(1.0).alias("similarity"))]
    if vectors is not None:
        best = nearest(vectors[1], vectors[0], 1, vector_key).select(F.col("query").alias(key), F.col(vector_key).alias("of"), "similarity").filter(F.col("similarity") >= CANDIDATE)
        same = F.col("similarity") >= SAME
        found.append(best.select(key, F.when(same, 2).otherwise(3).alias("rank"), F.when(same, "semantic").otherwise("semantic_match").alias("reason"), "of", "similarity"))
    found.append(first("url").select(key, F.lit(4).alias("rank"), F.lit("url_match").alias("reason"), "of", F.lit(1.0).alias("similarity")))
    found.append(first("title").select(key, F.lit(5).alias("rank"), F.lit("title_match").alias("reason"), "of", F.lit(1.0).alias("similarity")))
    pairs = title_pairs(mine.select("title").union(theirs.select("title")), "title", TITLE)
    both = pairs.select(F.col("a").alias("title"), F.col("b").alias("other"), "similarity").union(pairs.select(F.col("b").alias("title"), F.col("a").alias("other"), "similarity"))
    of_title = theirs.groupBy(F.col("title").alias("other")).agg(F.min(key).alias("of"))
    alike = mine.join(both, "title").join(of_title, "other").groupBy(key).agg(F.max_by(F.struct("of", "similarity"), F.struct("similarity", -F.col("of"))).alias("x"))
    found.append(alike.select(key, F.lit(6).alias("rank"), F.lit("title_match").alias("reason"), "x.of", "x.similarity"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    one = every.groupBy(key).agg(F.min_by(F.struct("reason", "of", "similarity"), F.struct("rank", "of")).alias("x"))
    return mine.select(key).distinct().join(one, key, "left").select(key, F.coalesce("x.reason", F.lit("new")).alias("reason"), "x.of", "x.similarity")


def phase(reason: Column, decision: Column) -> Column:
    """skip for copies, bypass for what is new or was decided to be kept, skip for what was decided to be a duplicate, confirm for candidates that nobody has decided on."""
    return F.when(reason.isin("exact", "semantic"), "skip").when(reason == "new", "bypass").when(decision == "keep", "bypass").when(decision == "duplicate", "skip").otherwise("confirm")


def merged(records: DataFrame, merges: DataFrame, page: str = "page") -> DataFrame:
    """records with pages of merges (source, target) pointed to their targets; a source merged twice goes to the smallest target."""
    one = merges.filter("source <> target").groupBy("source").agg(F.min("target").alias("_target"))
    return records.join(one, F.col(page) == F.col("source"), "left").withColumn(page, F.coalesce("_target", page)).drop("source", "_target")


def backfill(manifest: DataFrame, contents: DataFrame, known: DataFrame) -> DataFrame:
    """(source, status): manifest (source, page, hash) rows whose record is to be made, and why others are not: no-source-page, no-content,
    already-current, or duplicate-doc-hash, where a smaller source has the same hash. contents are (page, n_chars), known are (source, hash)."""
    joined = manifest.join(contents, "page", "left").join(known.select("source", F.col("hash").alias("_known")), "source", "left")
    firsts = manifest.groupBy("hash").agg(F.min("source").alias("_first"))
    status = F.when(F.col("page").isNull(), "no-source-page").when(F.coalesce("n_chars", F.lit(0)) == 0, "no-content").when(F.col("_known") == F.col("hash"), "already-current").when(F.col("_first") < F.col("source"), "duplicate-doc-hash").otherwise("made")
    return joined.join(firsts, "hash", "left").select("source", status.alias("status"))
