"""What retrieval may use, and how sure it may be: filters of chunks and boosts, passages around a hit, signals and confidence, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.arrays import let
from marlstone.functions.numeric import quantise
from marlstone.functions.text import tokens

#: Folders of chunks that need a review first, and of those that are never shown.
REVIEWED = ("review/", "taxonomy/proposals/", "taxonomy/evidence-proposals/")
SECRET = ("/private/", "/secrets/", "/sensitive/")
#: The least score of a boost without other reasons, and the shares of a confidence's signals.
BOOST_LEAST = 0.045
SHARES = {"top": 0.35, "hits": 0.15, "signals": 0.2, "raw": 0.15, "coverage": 0.15}
COVERED = {"semantic-signal": 1.0, "lexical-coverage": 0.85, "short-query": 0.45}


#: Signals of a hit, modes of an answer that have no score and how they are told, how strong a part must be to be told, and the score below which
#: boilerplate is weak.
SIGNALS = ("lexical", "embedding", "graph", "taxonomy", "metadata", "rerank")
UNKNOWN = {"fallback": "retrieval-index-unavailable", "stale-index": "retrieval-index-stale", "no-match": "no-retrieval-hits"}
REASONS = (("top", 0.7, "strong-top-score"), ("hits", 0.67, "multiple-supporting-hits"), ("signals", 0.67, "multi-signal-retrieval"), ("raw", 0.5, "raw-evidence-backed"), ("coverage", 0.85, "query-coverage-supported"))
WEAK = 0.55


def retrievable(chunks: DataFrame, path: str, target: str, privacy: Column, source: Column, include_review: bool = False) -> DataFrame:
    """chunks with `kept` and the reason why not: review or sensitive."""
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    at, to = slashed(F.col(path)), slashed(F.col(target))
    review, hidden = F.lit(False), F.lower(privacy).isin("private", "sensitive")
    for part in REVIEWED:
        review = review | F.contains(at, F.lit(f"/{part}")) | to.startswith(part)
    for part in SECRET:
        hidden = hidden | F.contains(F.lower(F.concat_ws("\n", at, slashed(source))), F.lit(part))
    reason = F.when(F.lit(not include_review) & review, "review").when(F.coalesce(hidden, F.lit(False)), "sensitive").otherwise("kept")
    return chunks.withColumn("reason", reason).withColumn("kept", F.col("reason") == "kept")


def strong_boosts(boosts: DataFrame, lexical: DataFrame, key: str, strong: Column) -> DataFrame:
    """Boosts of what has a lexical score too, a strong reason, or a score of BOOST_LEAST at least."""
    hit = lexical.filter("score > 0").select(key, F.lit(True).alias("_hit")).distinct()
    joined = boosts.join(hit, key, "left")
    return joined.filter(F.col("_hit") | strong | (F.col("boost") >= BOOST_LEAST)).drop("_hit")


def joined_passages(a: Column, b: Column, least: int = 40, most: int = 180) -> Column:
    """Two passages in a row as one: what the first ends and the second begins with stands once, if it has 40 to 180 characters; else an empty line parts them."""

    def longest(tail: Column, head: Column) -> Column:
        """How much of the tail's end is the head's beginning. It begins where the head's first `least` characters stand; mostly that is one place, other places are tried where it isn't."""
        fits = lambda n: F.right(tail, n) == F.left(head, n)
        others = lambda n: F.get(F.filter(F.sequence(n, F.lit(least), F.lit(-1)), fits), F.lit(0))
        at = F.when(F.length(head) >= least, F.position(F.left(head, F.lit(least)), tail))
        return let(F.when(at > 0, F.length(tail) - at + 1), lambda n: F.when(fits(n), n).when(n > least, others(n)))

    def one(x: Column, y: Column) -> Column:
        ends = F.struct(F.right(x, F.lit(most)).alias("tail"), F.left(y, F.lit(most)).alias("head"))
        return let(let(ends, lambda e: longest(e["tail"], e["head"])), lambda n: F.when(n.isNull(), F.concat(x, F.lit("\n\n"), y)).otherwise(F.concat(x, F.substr(y, n + 1))))

    return F.when(F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit(""))).when(F.coalesce(b, F.lit("")) == "", a).otherwise(one(a, b))


def stitched(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """chunks with `passage`: a chunk with those before and after it of the same key, overlaps said once."""
    w = Window.partitionBy(key).orderBy(order)
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n{4,}", "\n\n\n"), r"^\s+|\s+$", "")
    around = chunks.withColumn("_own", trimmed(F.col(text))).withColumn("_before", F.lag("_own").over(w)).withColumn("_after", F.lead("_own").over(w))
    return around.withColumn("passage", let(joined_passages(F.col("_before"), F.col("_own")), lambda x: joined_passages(x, F.col("_after")))).drop("_own", "_before", "_after")


def sentence_contexts(found: Column, k: int = 1) -> Column:
    """array<struct<place, context>>: each sentence of an array, with k sentences on either side."""
    around = lambda all_, n: F.array_join(F.slice(all_, F.greatest(F.lit(1), n + 1 - k), F.lit(k) + 1 + F.least(n, F.lit(k))), " ")
    # what a lambda names is computed for each item, so that the array is made ready before
    return let(found, lambda all_: F.transform(all_, lambda s, n: F.struct(n.alias("place"), around(all_, n).alias("context"))))


def signals(hits: DataFrame, query: str, names: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(query, signal, hits): how many hits of a query each signal speaks for."""
    names = tuple(n for n in names if n in hits.columns)
    counts = hits.groupBy(query).agg(*(F.count_if(F.col(n) > 0).alias(n) for n in names))
    return counts.select(query, F.inline(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("hits")) for n in names))))


def confidence(queries: DataFrame, hits: DataFrame, query: str, order: Column, raw: Column, reason: Column, boilerplate: Column | None = None, threshold: float = 0.35, names: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(query, score, level, low, reasons) of each query (query, mode), by its hits; partial aggregates only.

    The score adds up the best total, the number of hits, the signals that speak, the share of hits with a raw source and how the query was covered, less
    a penalty where a hit is boilerplate and one where the best hit is known by its embedding alone. Queries without hits, and those of a mode in
    UNKNOWN, score 0 and have no level; an overview is no evidence. Little confidence is what scores below the threshold, what rests on a single
    hit without a raw source and with few signals, and boilerplate without any raw source that scores below WEAK. A null order comes last.
    """
    if not 0 <= threshold <= 1:
        raise ValueError(f"a threshold lies between 0 and 1, not at {threshold}")
    covered = F.lit(0.0)
    for name, value in reversed(COVERED.items()):
        covered = F.when(reason == name, value).otherwise(covered)
    names = tuple(n for n in names if n in hits.columns)
    alone = (F.col("lexical") <= 0) & (F.col("embedding") > 0)
    found = hits.groupBy(query).agg(
        F.min_by(F.struct("total", alone.alias("alone")), order).alias("best"), F.count("*").alias("n"), (F.count_if(raw) / F.count("*")).alias("raw"), F.max(covered).alias("coverage"),
        sum((F.max(F.when(F.col(n) > 0, 1).otherwise(0)) for n in names), F.lit(0)).alias("signals"), F.max(boilerplate if boilerplate is not None else F.lit(False)).alias("plain"),
    )
    one, c = F.lit(1.0), F.col
    parts = {"top": F.least(one, F.greatest(F.lit(0.0), c("best.total")) / 1.2), "hits": F.least(one, c("n") / 3.0), "signals": F.least(one, c("signals") / 3.0), "raw": c("raw"), "coverage": c("coverage")}
    penalties = {"plain": F.when(c("plain"), 0.25).otherwise(0.0), "alone": F.when(c("best.alone"), 0.1).otherwise(0.0)}
    sums = queries.select(query, "mode").join(found.select(query, "n", "plain", "best", *(p.alias(f"_{k}") for k, p in [*parts.items(), *((f"less_{k}", p) for k, p in penalties.items())])), query, "left")
    scored = quantise(F.least(one, F.greatest(F.lit(0.0), sum((c(f"_{k}") * share for k, share in SHARES.items()), F.lit(0.0)) - c("_less_plain") - c("_less_alone"))), 3)
    none = c("n").isNull() | c("mode").isin(*UNKNOWN)
    overview = c("mode") == "overview"
    score = F.when(none, 0.0).when(overview, 0.35).otherwise(scored)
    level = F.when(none, "none").when(overview, "low").when(c("score") >= 0.75, "high").when(c("score") >= 0.45, "medium").otherwise("low")
    weak = ((c("n") == 1) & (c("_raw") == 0) & (c("_signals") < 0.67)) | (c("plain") & (c("_raw") == 0) & (c("score") < WEAK))
    low = F.when(none, ~(c("mode") == "no-match")).when(overview, F.lit(True)).otherwise((c("score") < threshold) | weak)
    said = F.array_compact(F.array(*(F.when(c(f"_{k}") >= least, F.lit(name)) for k, least, name in REASONS), *(F.when(c(f"_less_{k}") > 0, F.lit(name)) for k, name in (("plain", "boilerplate-penalty"), ("alone", "embedding-only-penalty")))))
    why = (
        F.when(none, F.array(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in UNKNOWN.items() for x in pair)), F.when(c("mode").isin(*UNKNOWN), c("mode")).otherwise("no-match")), F.lit(""))))
        .when(overview, F.array(F.lit("overview-fallback-not-answer-evidence"))).when(F.size(said) > 0, said).otherwise(F.array(F.lit("weak-retrieval-signals")))
    )
    return sums.withColumn("score", score).select(query, "score", level.alias("level"), low.alias("low"), why.alias("reasons"))


def recall(found: DataFrame, query: str, text: str, expected: DataFrame) -> DataFrame:
    """(query, covered, expected, recall): how many of a query's expected terms (query, term) stand in what was found for it."""
    told = found.groupBy(query).agg(F.array_distinct(F.flatten(F.collect_set(tokens(F.col(text))))).alias("words"))
    asked = expected.select(query, F.lower("term").alias("term")).distinct()
    met = asked.join(told, query, "left").withColumn("met", F.coalesce(F.array_contains("words", F.col("term")), F.lit(False)))
    return met.groupBy(query).agg(F.count_if("met").alias("covered"), F.count("*").alias("expected")).withColumn("recall", quantise(F.col("covered") / F.col("expected"), 4))


def variants(token: Column) -> Column:
    """A route token and its shorter forms, each once: cities and city, logs and log, metrics and metr, basic and bas."""
    n = F.length(token)
    cut = lambda k: F.left(token, n - k)
    forms = [F.when(token.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))), F.when(token.endswith("s") & (n > 4), cut(1)), F.when(token.endswith("ics") & (n > 5), cut(3)), F.when(token.endswith("ic") & (n > 4), cut(2))]
    return F.array_distinct(F.array_compact(F.array(token, *forms)))
