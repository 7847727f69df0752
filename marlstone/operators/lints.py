"""Checks of a knowledge base: taxonomies, raw sources, titles, manifests, assets; natural keys; pages of a history; bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import bands
from marlstone.operators.graphs import cycle_nodes
from marlstone.operators.relational import last_n

#: Kinds of edges that make a taxonomy's hierarchy.
HIERARCHY = ("is-a", "part-of", "subcategory-of", "parent")
#: How the share of holders in profit, and the concentration of holdings, are put in words, by their least and below values.
PROFITS = ((0.9, "获利盘极高(获利盘>90%)"), (0.7, "获利盘较高(获利盘70-90%)"), (0.5, "获利盘中等(获利盘50-70%)"), (0.3, "套牢盘中等(套牢盘50-70%)"), (0.1, "套牢盘较高(套牢盘70-90%)"))
SPREADS = ((0.08, "筹码高度集中"), (0.15, "筹码较集中"), (0.25, "筹码分散度中等"))


def taxonomy(edges: DataFrame, redirects: DataFrame) -> DataFrame:
    """(issue, node) of edges (a, b, type) without a type, nodes on cycles of the hierarchy, and of redirects (a, b) that are empty, lead to themselves or in a circle."""
    untyped = edges.filter(F.coalesce("type", F.lit("")) == "").select(F.lit("taxonomy-edge-missing-type").alias("issue"), F.col("a").alias("node"))
    hierarchy = cycle_nodes(edges.filter(F.col("type").isin(*HIERARCHY))).select(F.lit("taxonomy-cycle").alias("issue"), "node")
    empty = redirects.filter("b IS NULL").select(F.lit("taxonomy-empty-redirect").alias("issue"), F.col("a").alias("node"))
    own = redirects.filter("a = b").select(F.lit("taxonomy-self-redirect").alias("issue"), F.col("a").alias("node"))
    round_trips = cycle_nodes(redirects.filter("a <> b")).select(F.lit("taxonomy-redirect-cycle").alias("issue"), "node")
    return untyped.union(hierarchy).union(empty).union(own).union(round_trips).distinct()


def raw_integrity(pages: DataFrame, raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """(issue, source) of pages (source, sha), raw files (source, sha, has_meta) and manifest entries (source): what a page names must be there,
    unchanged, with front matter, and listed."""
    joined = pages.join(raw.select("source", F.col("sha").alias("_sha"), "has_meta"), "source", "left").join(manifest.select("source", F.lit(True).alias("_listed")).distinct(), "source", "left")
    there = F.col("_sha").isNotNull()
    tests = {"missing-raw-source": ~there, "raw-source-drift": there & (F.col("_sha") != F.col("sha")), "raw-missing-frontmatter": there & ~F.coalesce("has_meta", F.lit(False)), "raw-missing-manifest-entry": F.col("_listed").isNull()}
    return joined.select("source", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))).alias("issue"))


def repeated(rows: DataFrame, key: Column, page: str) -> DataFrame:
    """(title, pages) of what stands on more than one page; distinct pages are counted."""
    return rows.groupBy(key.alias("title")).agg(F.count_distinct(page).alias("pages")).filter("pages > 1")


def natural_key(url: Column, code: Column, *parts: Column) -> Column:
    """A record's address, or where it has none a key of its code and a digest of it and of its title, source and date; null parts are empty."""
    return F.when(F.trim(F.coalesce(url, F.lit(""))) != "", F.trim(url)).otherwise(F.concat(F.lit("no-url:"), code, F.lit(":"), F.md5(F.concat_ws("|", code, *(F.coalesce(p, F.lit("")) for p in parts)))))


def news(rows: DataFrame, url: str, code: Column, title: str, source: str, published: str) -> DataFrame:
    """rows with their `key`; those with neither a title nor an address are left out. Dates are told as yyyy-MM-ddTHH:mm:ss."""
    at = F.date_format(F.col(published).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    some = F.coalesce(F.trim(title), F.lit("")) != ""
    return rows.filter(some | (F.coalesce(F.trim(url), F.lit("")) != "")).withColumn("key", natural_key(F.col(url), code, F.trim(title), F.trim(source), at))


def history(rows: DataFrame, at: str, since: Column, until: Column, order: list[Column], page: int, size: int, **where: object) -> tuple[int, DataFrame]:
    """How many rows of a half-open stretch of time have the given values, and one page of them; a value of None asks for nothing."""
    some = rows.filter((F.col(at) >= since) & (F.col(at) < until))
    for name, value in where.items():
        some = some if value is None else some.filter(F.col(name) == F.lit(value))
    return some.count(), some.orderBy(*order).offset((page - 1) * size).limit(size)


def preferred_first(rows: DataFrame, keys: list[str], preferred: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, preferred ones before others, each kind in the order given."""
    return last_n(rows, keys, n, (~F.coalesce(preferred, F.lit(False))).cast("int"), *order)


def best_source(rows: DataFrame, key: str, source: str, preferred: Column) -> DataFrame:
    """(key, source): the source with the most preferred rows, then with the most rows, then the first by name."""
    counts = rows.groupBy(key, source).agg(F.count_if(preferred).alias("_p"), F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min_by(source, F.struct(-F.col("_p"), -F.col("_n"), source)).alias(source))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of the keys that new has, and new: positions and lots of a snapshot are taken out and put in together."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def page_ranges(n: Column, size: int) -> Column:
    """array<struct<first, last>> of pages 1 to n, `size` at a time."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n, F.lit(size)), lambda k: F.struct(k.alias("first"), F.least(k + size - 1, n).alias("last"))))


def regime(alignment: Column, score: Column, volume: Column, hot: Column) -> Column:
    """trending_up, trending_down, sideways or volatile, in this order, from how averages stand, a trend's score and the volume; else sector_hot where that is so."""
    first = F.when((alignment == "bullish") & (score >= 70), "trending_up").when((alignment == "bearish") & (score <= 30), "trending_down")
    return first.when((alignment == "neutral") | score.between(35, 65), "sideways").when((volume == "heavy") & (score > 30) & (score < 70), "volatile").when(hot, "sector_hot")


def chip_status(profit: Column, concentration: Column) -> Column:
    """How many holders are in profit, and how concentrated holdings are, in words."""
    told = F.when(profit >= PROFITS[0][0], PROFITS[0][1])
    for least, label in PROFITS[1:]:
        told = told.when(profit >= least, label)
    return F.concat_ws("，", told.otherwise("套牢盘极高(套牢盘>90%)"), bands(concentration, *SPREADS, otherwise="筹码较分散"))
