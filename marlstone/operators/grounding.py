"""Claims of evidence: their sentences, how well a question meets them, how an excerpt supports them, and where evidence disagrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.arrays import let
from marlstone.functions.numeric import quantise
from marlstone.functions.text import tokens

#: The least length of a claim, the words that part one sentence's claims, and words that show nothing.
LEAST = 24
CONNECTIVES = r"\b(?:however|therefore|because|although|whereas|while)\b|[；;]"
PLAIN = ("about", "also", "and", "are", "because", "cannot", "does", "from", "have", "into", "more", "that", "the", "this", "with", "without")
#: Kinds of disagreement in the order in which they are looked for, how grave each is, and what tells of it.
CONFLICTS = (
    ("contradictory", "high", r"\b(contradictory|contradicts|contradiction)\b|矛盾"),
    ("conflict", "high", r"\b(conflict|inconsistent)\b|冲突|不一致"),
    ("stale", "medium", r"\b(deprecated|outdated|stale|obsolete)\b|过时|废弃"),
    ("uncertain", "low", r"\b(uncertain|unknown|low confidence|ambiguous)\b|不确定|未知|低置信|歧义"),
)


def _compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def claims(text: Column) -> Column:
    """The claims of an excerpt, each once: its sentences, parted at connectives, of LEAST characters; where none is, all of it is one."""
    ended = F.regexp_replace(_compact(text), r"([.!?。！？]) +|[；;]", "$1\n")
    sentences = F.filter(F.transform(F.split(ended, "\n"), lambda x: F.trim(x)), lambda s: F.length(s) >= LEAST)
    whole = F.filter(F.array(_compact(text)), lambda s: s != "")

    def parts(sentence: Column) -> Column:
        some = F.filter(F.transform(F.split(sentence, f"(?i){CONNECTIVES}"), _compact), lambda p: F.length(p) >= LEAST)
        return F.when(F.size(some) > 0, some).otherwise(F.array(sentence))

    return let(sentences, lambda s: F.array_distinct(F.flatten(F.transform(F.when(F.size(s) > 0, s).otherwise(whole), parts))))


def claim_score(claim: Column, question: list[str]) -> Column:
    """Three points for each token of the question that the claim has, and up to one for its own tokens."""
    asked = F.array(*map(F.lit, dict.fromkeys(question)))
    return let(F.array_distinct(tokens(claim)), lambda own: F.size(F.array_intersect(own, asked)) * 3 + F.least(F.size(own), F.lit(20)) / 20.0)


def ranked_claims(text: Column, question: list[str], n: int = 2) -> Column:
    """The n claims of an excerpt that meet the question best, the earlier first of equal ones."""
    scored = F.transform(claims(text), lambda c, k: F.struct((-claim_score(c, question)).alias("below"), k.alias("place"), c.alias("claim")))
    return F.transform(F.slice(F.array_sort(scored), 1, n), lambda x: x["claim"])


def meaning(claim: Column) -> Column:
    """The first 24 tokens of a claim that show something, each once."""
    return F.slice(F.filter(F.array_distinct(tokens(claim)), lambda t: ~t.isin(*PLAIN)), 1, 24)


def validation(claim: Column, evidence: Column, question: list[str], chunk: Column, lines: Column) -> Column:
    """struct<matched, coverage, level, confidence> of a claim by its evidence; chunk and lines tell whether the evidence names its chunk and its lines."""
    asked = F.array(*map(F.lit, dict.fromkeys(question)))

    def judged(own: Column, held: Column) -> Column:
        matched = F.array_intersect(own, held)
        coverage = quantise(F.size(matched) / F.greatest(F.lit(1), F.least(F.size(own), F.lit(16))), 2)
        level = F.when((coverage >= 0.65) & chunk, "strong").when(coverage >= 0.35, "partial").otherwise("weak")
        overlap = F.least(F.lit(1.0), F.size(F.array_intersect(own, asked)) / F.greatest(F.lit(1), F.least(F.size(asked), F.lit(8))))
        backed = F.when((coverage >= 0.65) & chunk, 0.2).when(coverage >= 0.35, 0.1).otherwise(0.0)
        sure = quantise(F.least(F.lit(1.0), F.lit(0.35) + overlap * 0.2 + F.when(chunk, 0.2).otherwise(0.0) + F.when(lines, 0.1).otherwise(0.0) + backed), 2)
        return F.struct(F.slice(F.array_sort(matched), 1, 10).alias("matched"), coverage.alias("coverage"), level.alias("level"), sure.alias("confidence"))

    return let(F.struct(meaning(claim).alias("own"), F.array_distinct(tokens(evidence)).alias("held")), lambda x: judged(x["own"], x["held"]))


def conflict(text: Column) -> Column:
    """struct<kind, severity, matched>: the first kind of disagreement that an excerpt tells of; null where there is none."""
    out = F.lit(None).cast("struct<kind:string,severity:string,matched:string>")
    for kind, severity, pattern in reversed(CONFLICTS):
        found = F.regexp_extract(text, f"(?i){pattern}", 0)
        out = F.when(found != "", F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), found.alias("matched"))).otherwise(out)
    return out
