"""Duplicate content: by fingerprint, address and title."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import fingerprint, normal_title, title_similarity, title_tokens

TITLE_LEAST = 0.85


def exact(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint, first): the smallest key of the same canonical text. Only hashes are grouped."""
    hashed = docs.select(key, fingerprint(F.col(text)).alias("fingerprint"))
    first = hashed.groupBy("fingerprint").agg(F.min(key).alias("first"))
    return hashed.join(first, "fingerprint").select(key, "fingerprint", "first")


def normal_url(url: Column) -> Column:
    """Host in lower case without www, no scheme, fragment, query or slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z]+://(www\\.)?", "")
    host, path = F.lower(F.regexp_extract(bare, "^[^/]*", 0)), F.regexp_extract(bare, "/.*$", 0)
    return F.regexp_replace(F.concat(host, path), "/+$", "")


def title_pairs(pages: DataFrame, title: str, least: float = TITLE_LEAST) -> DataFrame:
    """(a, b, similarity) of different normal titles that are alike; pages of the same title aren't paired with each other.

    Titles meet where they share one of their rarest tokens: of n tokens, two alike titles share one of the first
    n - ceil(least n) + 1 in a common order. Tokens are ordered by how many titles have them, so no list of a frequent token is joined
    unless a title has none but frequent ones.
    """
    titles = pages.select(normal_title(F.col(title)).alias("t")).filter("t <> ''").distinct().withColumn("tokens", title_tokens(F.col("t")))
    words = titles.select("t", F.size("tokens").alias("n"), F.explode("tokens").alias("w"))
    rarity = words.groupBy("w").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("t").orderBy("df", "w"))
    rare = words.join(rarity, "w").withColumn("k", place).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("w", "t")
    left, right = rare.select("w", F.col("t").alias("a")), rare.select("w", F.col("t").alias("b"))
    met = left.join(right, "w").filter("a < b").select("a", "b").distinct()
    return met.withColumn("similarity", title_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least)


def reason(pages: DataFrame, key: str, text: str, url: str, title: str) -> DataFrame:
    """(key, reason, of): the first of exact, url and title by which a page repeats one of a smaller key, else new."""
    marked = pages.select(key, fingerprint(F.col(text)).alias("exact"), normal_url(F.col(url)).alias("url"), normal_title(F.col(title)).alias("title"))
    for kind in ("exact", "url", "title"):
        first = marked.groupBy(kind).agg(F.min(key).alias(f"_{kind}"))
        marked = marked.join(first, kind, "left")
    kinds = [(kind, F.coalesce(F.col(f"_{kind}") < F.col(key), F.lit(False)) & (F.col(kind) != "")) for kind in ("exact", "url", "title")]
    why, of = F.lit("new"), F.lit(None).cast("long")
    for kind, test in reversed(kinds):
        why, of = F.when(test, kind).otherwise(why), F.when(test, F.col(f"_{kind}")).otherwise(of)
    return marked.select(key, why.alias("reason"), of.alias("of"))


def similar_names(asked: DataFrame, known: DataFrame, least: float = 0.8) -> DataFrame:
    """(asked, name, ratio): the known name nearest to each distinct asked name (column `name` of both), of a ratio of `least` or more.

    Of ties the last name counts. Names as alike as that share least / (2 - least) of the characters of either, repeated ones counted,
    and so one of the rarest; only those that do are compared. known is a dictionary of names: what shares a rare character with
    a name is a small part of it. Null and empty names match nothing.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    def signs(names: DataFrame) -> DataFrame:
        chars = names.select("name").filter("name <> ''").distinct().select("name", F.length("name").alias("n"), F.posexplode(F.split("name", "")).alias("p", "c")).filter("c <> ''")
        again = F.row_number().over(Window.partitionBy("name", "c").orderBy("p"))
        return chars.select("name", "n", F.concat("c", again.cast("string")).alias("sign"))

    mine, theirs = signs(asked), signs(known)
    rarity = theirs.groupBy("sign").agg(F.count("*").alias("df"))

    def rare(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("name").orderBy("df", "sign"))
        ranked = rows.join(rarity, "sign", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("place", place)
        return ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (least / (2 - least)) - 1e-9) + 1).select("sign", "name", "n")

    left = rare(mine).select("sign", F.col("name").alias("asked"), F.col("n").alias("m"))
    met = left.join(rare(theirs), "sign").filter(2 * F.least("m", "n") >= least * (F.col("m") + F.col("n")) - 1e-9).select("asked", "name").distinct()
    alike = met.withColumn("ratio", ratio("name", "asked")).filter(F.col("ratio") >= least)
    return alike.groupBy("asked").agg(F.max(F.struct("ratio", "name")).alias("best")).select("asked", "best.name", "best.ratio")
