"""Knowledge pages: claims, term graphs, taxonomies, page scores, heading paths, subtitles, symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.counts import commonest
from marlstone.functions.numeric import quantise
from marlstone.functions.text import tokens

TOPIC_BOOST = {"direct": 12, "alias": 16, "redirect": 16, "category": 8}
CLAIM_STRONG, CLAIM_PARTIAL = 0.65, 0.35


def term_graph(chunks: DataFrame, key: str, text: str, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """Nodes (term, weight) and edges (a, b, weight) of the n commonest terms of each chunk; a chunk gives at most n (n - 1) / 2 edges.

    Each chunk's terms are counted and chosen within its row, in one pass, so that only chosen terms are exploded.
    """
    found = commonest(chunks.select(key, tokens(F.col(text)).alias("_words")), "_words", n)
    nodes = found.select(F.explode("top").alias("x")).groupBy(F.col("x.t").alias("term")).agg(F.sum(-F.col("x.n")).alias("weight"))
    pairs = F.flatten(F.transform("top", lambda a: F.transform(F.filter("top", lambda b: b["t"] > a["t"]), lambda b: F.struct(a["t"].alias("a"), b["t"].alias("b")))))
    edges = found.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))
    return nodes, edges


def claim_support(claims: DataFrame, claim: str, evidence: str) -> DataFrame:
    """claims with `matched`, `coverage` and `level` of their tokens in the evidence: strong, partial or weak."""
    own, held = F.array_distinct(tokens(F.col(claim))), F.array_distinct(tokens(F.col(evidence)))
    sized = claims.withColumn("_own", own).withColumn("matched", F.size(F.array_intersect("_own", held)))
    share = F.when(F.size("_own") > 0, F.col("matched") / F.least(F.size("_own"), F.lit(16)))
    level = F.when(F.col("coverage") >= CLAIM_STRONG, "strong").when(F.col("coverage") >= CLAIM_PARTIAL, "partial").otherwise("weak")
    return sized.withColumn("coverage", F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))).withColumn("level", level).drop("_own")


def merged_claims(claims: DataFrame, claim: Column, source: str, score: str) -> DataFrame:
    """Claims of the same normal text as one: their sources, how many, and the best score."""
    return claims.groupBy(claim.alias("claim")).agg(F.sort_array(F.collect_set(source)).alias("sources"), F.count("*").alias("n"), F.max(score).alias("score"))


def topic_boosts(pages: DataFrame, query: list[str], topics: str, aliases: DataFrame, redirects: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, boost): topics (an array column of pages) that the query names count directly, by an alias (alias, topic), by a redirect
    (a, b), or over a category edge (a, b) either way; the kinds add up, and repeat for each topic of a page."""
    wanted = lambda c: F.col(c).isin(*query)
    kinds = pages.select("page", F.explode(topics).alias("topic"))
    direct = kinds.filter(wanted("topic")).select("page", F.lit(TOPIC_BOOST["direct"]).alias("p"))
    alias = kinds.join(aliases.filter(wanted("alias")).select("topic", "alias").distinct(), "topic").select("page", F.lit(TOPIC_BOOST["alias"]).alias("p"))
    redirect = kinds.join(redirects.filter(wanted("a")).select(F.col("b").alias("topic"), "a").distinct(), "topic").select("page", F.lit(TOPIC_BOOST["redirect"]).alias("p"))
    both = edges.select("a", "b").union(edges.select("b", "a")).filter(wanted("a")).select(F.col("b").alias("topic"), "a").distinct()
    category = kinds.join(both, "topic").select("page", F.lit(TOPIC_BOOST["category"]).alias("p"))
    return direct.union(alias).union(redirect).union(category).groupBy("page").agg((F.sum("p") / 100.0).alias("boost"))


def page_score(title: Column, text: Column, source: Column, query: list[str]) -> Column:
    """Two points for each query token in the title, one for each in the text, one for a source page that has any."""
    asked = F.array(*map(F.lit, dict.fromkeys(query)))
    points = 2 * F.size(F.array_intersect(asked, tokens(title))) + F.size(F.array_intersect(asked, tokens(text)))
    return points + F.when(source & (points > 0), 1).otherwise(0)


def heading_paths(lines: DataFrame, key: str) -> DataFrame:
    """lines (key, line, text) that are headings, with `path`: the titles of the headings above that are of a higher level, and their own.

    The last heading of each level is carried on; one of a level counts only if no higher one came after it.
    """
    level = F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))
    found = lines.withColumn("level", level).filter("level > 0").withColumn("title", F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("line", "title")), ignorenulls=True).over(w) for k in range(1, 7)]
    held = found.withColumn("_last", F.array(*last))
    # a level stands while nothing of its own or a higher level came after it
    stands = F.filter(F.transform("_last", lambda h, k: F.struct(h.alias("h"), k.alias("k"))), lambda x: x["h"].isNotNull() & (x["k"] + 1 < F.col("level")) & ~F.exists(F.slice("_last", 1, x["k"]), lambda o: F.coalesce(o["line"] > x["h"]["line"], F.lit(False))))
    return held.select(key, "line", "level", "title", F.array_append(F.transform(stands, lambda x: x["h"]["title"]), F.col("title")).alias("path"))


def subtitle_text(text: Column) -> Column:
    """Spoken lines of WEBVTT or SRT: no headers, notes, cue numbers, times or tags; a line repeated at once is said once."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|NOTE|STYLE|REGION)|^[0-9]+$|-->"))
    once = F.get(F.transform(F.array(spoken), lambda s: F.filter(s, lambda x, k: (k == 0) | (x != F.coalesce(F.get(s, k - 1), F.lit(""))))), F.lit(0))
    return F.array_join(once, "\n")


def symbol(code: Column) -> Column:
    """A symbol without exchange marks: SH600519, 600519.SS and sh.600519 are 600519; HK700 is 00700."""
    up = F.upper(F.trim(code))
    digits = F.regexp_extract(up, r"^(?:(?:SH|SZ|BJ|SS)\.?)?([0-9]{6})(?:\.(?:SH|SZ|SS|BJ))?$", 1)
    hk = F.regexp_extract(up, r"^(?:HK\.?([0-9]{1,5})|([0-9]{1,5})\.HK)$", 1)
    hk2 = F.regexp_extract(up, r"^(?:HK\.?([0-9]{1,5})|([0-9]{1,5})\.HK)$", 2)
    return F.when(digits != "", digits).when(F.concat(hk, hk2) != "", F.lpad(F.concat(hk, hk2), 5, "0")).otherwise(up)


def market(code: Column) -> Column:
    """cn for six digits, hk for five, us for letters; else unknown."""
    return F.when(code.rlike("^[0-9]{6}$"), "cn").when(code.rlike("^[0-9]{5}$"), "hk").when(code.rlike(r"^[A-Z]{1,5}(\.[A-Z])?$"), "us").otherwise("unknown")


def one_typo(a: Column, b: Column) -> Column:
    """Whether two words of the same length, three at least, differ in one character."""
    off = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return (F.length(a) == F.length(b)) & (F.length(a) >= 3) & (off == 1)


def trailing_sum(rows: DataFrame, key: str, at: str, value: str, days: int) -> DataFrame:
    """rows with the sum of a key's values of the last days, in whole cents."""
    stamp = F.datediff(F.col(at), F.lit("1970-01-01"))
    w = Window.partitionBy(key).orderBy(stamp).rangeBetween(-(days - 1), 0)
    return rows.withColumn("trailing", quantise(F.sum(F.floor(F.col(value) * 100 + 0.5)).over(w) / 100.0, 2))
