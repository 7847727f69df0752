"""Catalogues: which series of a code is best, which pages count, how links across wikis stand, what a page's terms are, and what is asked in other words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.arrays import let
from marlstone.functions.text import link_stem

#: Sections whose pages are cut into chunks, and what marks a page that was generated.
CHUNKED, GENERATED = ("sources", "syntheses", "comparisons", "queries"), 'generatedBy: "llm-wiki-semantic-overview"'


#: Words that don't relate one source to another.
LINK_STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "the", "to", "using", "use", "with",
    "complete", "official", "documentation", "document", "docs", "reference", "overview", "guide", "saved", "date", "source", "author", "title",
)
#: Current pages that are held against candidates at a time, and candidates whose scores are held at a time.
BLOCK, STEP = 4096, 256
DIGITS = frozenset("0123456789")


def best_series(bars: DataFrame, aliases: DataFrame) -> DataFrame:
    """(code, alias, latest, rows): of the aliases (code, alias, canonical) of each code the one with the latest bar, then with the most
    bars, then the canonical one, then the last by name. Bars (alias, day) are counted before they are joined."""
    counted = bars.groupBy("alias").agg(F.max("day").alias("latest"), F.count("*").alias("rows"))
    best = aliases.join(counted, "alias").groupBy("code").agg(F.max(F.struct("latest", "rows", "canonical", "alias")).alias("x"))
    return best.select("code", "x.alias", "x.latest", "x.rows")


def covered(series: DataFrame, end: Column, days: int, least: int = 30) -> DataFrame:
    """series (latest, rows) with `start`, from where bars are read so that there are enough trading days, and `cached`: whether what is there will do."""
    return series.withColumn("start", F.date_sub(end, int(days * 1.8) + 10)).withColumn("cached", (F.col("latest") >= end) & (F.col("rows") >= max(min(days, least), 1)))


def routed(providers: DataFrame, market: Column) -> DataFrame:
    """providers (name, markets, available) that are asked for a market: those that are available, and that support it or name no markets; unknown
    markets are everyone's."""
    supported = F.col("markets").isNull() | ~market.isin("cn", "hk", "us") | F.array_contains("markets", market)
    return providers.filter(supported & F.col("available"))


def priced_at(positions: DataFrame, history: DataFrame, quotes: DataFrame, day: Column, today: Column) -> DataFrame:
    """positions (symbol) with `price` and `price_from`: the last close of history (symbol, day, close) up to the day, else, for today alone, a
    quote (symbol, price), else missing."""
    last = history.filter((F.col("day") <= day) & (F.col("close") > 0)).groupBy("symbol").agg(F.max_by("close", "day").alias("_close"))
    live = quotes.filter(F.col("price") > 0).select("symbol", F.col("price").alias("_quote")).dropDuplicates(["symbol"])
    joined = positions.join(last, "symbol", "left").join(live, "symbol", "left")
    quote = F.when(day == today, F.col("_quote"))
    kind = F.when(F.col("_close").isNotNull(), "history_close").when(quote.isNotNull(), "realtime_quote").otherwise("missing")
    return joined.withColumn("price", F.coalesce("_close", quote)).withColumn("price_from", kind).drop("_close", "_quote")


def chunkable(section: Column, text: Column) -> Column:
    """Whether a page is cut into chunks: pages of four sections, but for generated overviews."""
    return section.isin(*CHUNKED) & ~((section == "syntheses") & F.contains(text, F.lit(GENERATED)))


def link_status(target: Column, wiki: Column, page: Column, path: Column, edge_path: Column) -> Column:
    """How a link to a page of another wiki stands; wiki, page and path are null where there is none, edge_path is where the link was last seen to lead."""
    return (
        F.when(target.rlike("[<>]"), "placeholder-target").when(wiki.isNull(), "unknown-wiki").when(page.isNull(), "missing-page")
        .when(edge_path.isNotNull() & (edge_path != path), "stale-edge").otherwise("resolved")
    )


def key_terms(text: Column, stop: tuple[str, ...] = LINK_STOP) -> Column:
    """The stems of a text's plain words of three letters or more, each once; stop words are none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))
    return F.array_distinct(F.transform(words, link_stem))


def related(current: DataFrame, candidates: DataFrame, key: str, title: str, text: str, n: int = 3, least: int = 3) -> DataFrame:
    """(key, other, score, place): for each current page the n others that share most key terms of title and text, those of the titles counted once more.

    `least` terms are enough, or a single long one, or one with a digit. Ties go to the smaller key. Current pages in blocks of some BLOCK meet candidates in slices
    of twice as many: a task has the lists of one block's terms, adds up those of a candidate's terms, and only the n best of a page in each slice are shuffled.
    Null titles and texts are empty; null keys are no pages.
    """
    both = F.concat_ws("\n", title, text)
    made = lambda rows, name: rows.filter(F.col(key).isNotNull()).select(F.col(key).alias(name), *(F.array_join(key_terms(c), " ").alias(to) for c, to in ((both, "terms"), (F.col(title), "head"))))
    parts = lambda rows, size: F.lit(max(1, -(-rows.count() // size)))
    blocks, slices = parts(current, BLOCK), parts(candidates, 2 * BLOCK)
    of = lambda name, size: F.pmod(F.xxhash64(name), size).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), size - 1))
    asked = made(current, "key").select("*", of("key", blocks).alias("_block"), every(slices).alias("_slice"))
    others = made(candidates, "other").select("*", of("other", slices).alias("_slice"), every(blocks).alias("_block"))
    kind, kind_other = current.schema[key].dataType.simpleString(), candidates.schema[key].dataType.simpleString()
    found = asked.groupBy("_block", "_slice").cogroup(others.groupBy("_block", "_slice")).applyInPandas(lambda q, x: _best(q, x, n, least), f"key {kind}, other {kind_other}, score int")
    return found.withColumnRenamed("key", key).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "other"))).filter(F.col("place") <= n)


def _postings(texts: pd.Series, kept: Callable[[str], bool] = bool) -> dict[str, np.ndarray]:
    """Where each of the words stands that are kept, among some lists of words."""
    out: dict[str, list[int]] = {}
    for k, words in enumerate(texts):
        for word in filter(kept, words.split(" ")):
            out.setdefault(word, []).append(k)
    return {word: np.array(at) for word, at in out.items()}


def _best(asked: pd.DataFrame, others: pd.DataFrame, n: int, least: int) -> pd.DataFrame:
    """The n best others of each page asked for, of a block and a slice: terms in common are counted for a candidate and all pages asked for at once."""
    others = others.sort_values("other", ignore_index=True)
    size, telling = len(others), lambda t: len(t) >= 7 or any(c in DIGITS for c in t)
    terms, head = _postings(asked["terms"]), _postings(asked["head"])
    own = asked.groupby("key").indices
    none = np.empty(0, np.int64)

    def counted(held: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
        met = [held[w] for w in words if w in held]
        return np.bincount(np.concatenate(met) if met else none, minlength=len(asked))

    best = np.full((len(asked), n), -1, np.int64)  # score and, the first the greatest, number of a candidate in one number
    for at in range(0, size if len(asked) else 0, STEP):
        part = others.iloc[at : at + STEP]
        codes = np.full((len(asked), len(part)), -1, np.int64)
        for k, (other, text, title) in enumerate(zip(part["other"], part["terms"], part["head"], strict=True)):
            words = text.split(" ")
            score = counted(terms, words) + counted(head, title.split(" "))
            fits = (score >= least) | (counted(terms, [w for w in words if telling(w)]) > 0)
            fits[own.get(other, none)] = False
            codes[fits, k] = score[fits] * size + (size - 1 - at - k)
        best = np.partition(np.concatenate([best, codes], axis=1), -n, axis=1)[:, -n:]
    q, place = np.nonzero(best >= 0)
    code = best[q, place]
    return pd.DataFrame({"key": asked["key"].to_numpy()[q], "other": others["other"].to_numpy()[size - 1 - code % max(1, size)], "score": (code // max(1, size)).astype(np.int32)})


def mismatch(hint: Column, title: Column, evidence: Column) -> Column:
    """Whether what an address says of a source, of two words at least, is found neither in a title of two words at least, nor in the evidence."""
    none = lambda x: ~F.arrays_overlap(hint, x)
    return (F.size(hint) >= 2) & (F.size(title) >= 2) & none(title) & none(evidence)


def grams(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Plain words of two letters or more, then runs of Han characters (up to eight long) and their 2-, 3- and 4-grams, each once."""
    def cut(run: Column) -> Column:
        of = lambda n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda k: F.substr(run, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        whole = F.when(F.length(run) <= 8, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.concat(whole, of(2), of(3), of(4))

    def every(low: Column) -> Column:
        plain = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0))
        han = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"[\p{IsHan}]{2,}"), F.lit(0)), cut))
        return F.when(F.octet_length(low) > F.length(low), F.concat(plain, han)).otherwise(plain)

    # The text is made ready once: what explodes an array doesn't share what its parts have in common.
    out = let(F.lower(F.coalesce(text, F.lit(""))), every)
    return F.array_except(out, F.array(*map(F.lit, stop))) if stop else F.array_distinct(out)


def criteria(fit: Column, score: Column, terms: Column, excerpt: Column, kind: Column, strong: float) -> Column:
    """struct<satisfied, enough>: of five criteria for a new collection those that a source meets; three are enough."""
    met = [F.when(~fit, "no-fit"), F.when(F.size(terms) >= 8, "terms"), F.when(F.length(excerpt) >= 160, "length"), F.when(~fit & (score < strong), "pollution"), F.when(kind != "unknown", "readable")]
    return let(F.array_compact(F.array(*met)), lambda x: F.struct(x.alias("satisfied"), (F.size(x) >= 3).alias("enough")))


def rephrased(questions: DataFrame, question: str, synonyms: DataFrame, n: int = 3) -> DataFrame:
    """(question, variant): a question with a term replaced by its synonyms (term, synonym, place), the first n in order, without what it says itself.

    A plain term must stand as a word; others anywhere. Synonyms are a dictionary of known size, told to each question's row.
    """
    rows = synonyms.select("place", F.trim("term").alias("term"), F.trim("synonym").alias("synonym")).filter("term <> '' AND synonym <> ''").orderBy("place", "term", "synonym").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} synonyms")
    asked = F.trim(F.regexp_replace(F.col(question), r"\s+", " "))
    made = []
    for r in rows:
        plain = all(c.isascii() and (c.isalnum() or c == " ") for c in r.term)
        pattern = rf"(?i)(?<=^|\s)\Q{r.term}\E(?=\s|$)" if plain else rf"\Q{r.term}\E"
        first = rf"(?s)^(.*?){pattern}"
        made.append(F.when(asked.rlike(pattern), F.regexp_replace(asked, first, "$1" + r.synonym.replace("\\", "\\\\").replace("$", "\\$"))))
    variants = F.slice(F.array_distinct(F.filter(F.array_compact(F.array(*made)), lambda v: F.lower(v) != F.lower(asked))), 1, n)
    return questions.select(question, F.explode(variants).alias("variant")) if made else questions.select(question, F.lit("").alias("variant")).limit(0)


#: Synonyms that `rephrased` takes at most.
MOST = 500


def integrity(chunks: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(issue, id) of chunks (id, first_line, last_line, ...): missing fields, ids that are there twice, lines that end before they begin."""
    tests = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing-{c}")) for c in required]
    tests.append(F.when((F.col("first_line") < 1) | (F.col("last_line") < F.col("first_line")), F.lit("bad-range")))
    own = chunks.select(F.col("id"), F.explode(F.array_compact(F.array(*tests))).alias("issue")).select("issue", "id")
    twice = chunks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated-id").alias("issue"), "id")
    return own.union(twice)


def undeclared(text: Column, declared: Column) -> Column:
    """The assets that a text refers to, as `asset:name`, that aren't declared, each once, in order of their names."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit("asset:([A-Za-z0-9_-]+)"), F.lit(1))), declared))
