"""Text as Column functions: tokens, titles, slugs, fingerprints, HTML, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.arrays import let

#: Words that aren't searched for.
STOP_WORDS = (
    "what", "which", "when", "where", "who", "why", "how", "is", "are", "was", "were", "the", "a", "an",
    "for", "to", "of", "and", "or", "in", "on", "from", "with", "about", "summarize", "summary", "new",
    "does", "did", "do", "this", "that", "these", "those", "into", "onto", "than", "then", "has", "have",
    "had", "been", "current", "wiki", "tell", "give", "show", "explain", "say", "says", "present", "not",
    "topic", "topics",
)


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Search tokens in order: runs of letters and numbers in lower case; of a run with ASCII parts, these parts and
    what is left of it; at least `least` long and no stop words. Null counts as empty."""

    def parts(run: Column) -> Column:
        left = F.trim(F.regexp_replace(run, "[a-z0-9]+", " "))
        plain = F.regexp_extract_all(run, F.lit("[a-z0-9]+"), F.lit(0))
        more = F.when((left != "") & (F.length(left) != F.length(run)), F.array(left)).otherwise(F.array().cast("array<string>"))
        ascii_only = F.octet_length(run) == F.length(run)  # of letters and numbers in lower case: a-z and 0-9
        return F.when(ascii_only, F.array(run)).otherwise(F.when(F.size(plain) == 0, F.array(run)).otherwise(F.concat(plain, more)))

    def sought(words: Column) -> Column:
        return F.filter(words, lambda t: (F.length(t) >= least) & ~t.isin(*stop))

    def runs(low: Column) -> Column:
        # a text of ASCII characters has no mixed runs
        return F.when(F.octet_length(low) == F.length(low), F.split(low, "[^a-z0-9]+")).otherwise(F.flatten(F.transform(F.split(low, r"[^\p{L}\p{N}]+"), parts)))

    return sought(let(F.lower(F.coalesce(text, F.lit(""))), runs))


def normal_title(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and Han characters, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", " "))


def title_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_title(text), " "), lambda t: t != ""))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of title tokens: 1 for equal normal titles, 0 where one is empty."""
    x, y = title_tokens(a), title_tokens(b)
    both = F.size(F.array_union(x, y))
    return F.when((normal_title(a) == "") | (normal_title(b) == ""), 0.0).when(normal_title(a) == normal_title(b), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.when(both > 0, both))


def slug(text: Column, empty: str = "chunk") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", empty).otherwise(made)


def concept(text: Column) -> Column:
    """A slug that also parts camelCase words."""
    return slug(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1-$2"), "")


def canonical(text: Column) -> Column:
    """Line ends as \\n, no blanks at line ends, at most one empty line in a row, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def link_stem(word: Column) -> Column:
    """Plural endings taken off longer words: ies to y, es, s."""
    n = F.length(word)
    return F.when((n > 5) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y"))).when((n > 5) & word.endswith("es"), F.left(word, n - 2)).when((n > 4) & word.endswith("s"), F.left(word, n - 1)).otherwise(word)


def readable(html: Column) -> Column:
    """Text of HTML: no scripts or styles, block ends as line ends, other tags as spaces, entities decoded."""
    out = F.regexp_replace(html, "(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    out = F.regexp_replace(out, "(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table|blockquote)>|<br */?>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name, mark in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.regexp_replace(out, name, mark)
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    """The first of og:title, the h1, the title; null where all are empty."""
    tag = lambda pattern: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]+>", "")), F.lit(""))
    return F.coalesce(tag('(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"'), tag("(?is)<h1[^>]*>(.*?)</h1>"), tag("(?is)<title[^>]*>(.*?)</title>"))


#: What a secret looks like: keys by their first letters, long names in capitals, and tokens of three parts.
SECRETS = (r"\b(?:sk|pk|ghp|github_pat|xox[baprs]?|ya29|AIza)[A-Za-z0-9_\-]{8,}\b", r"\b[A-Z][A-Z0-9_]{11,}\b", r"\b[A-Za-z0-9_\-]{24,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{12,}\b")


#: A word's edge among ASCII characters: an engine's own may count other letters as parts of a word.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def secrets(seed: str) -> list[str]:
    """The secrets of a question, each once, in the order in which patterns find them."""
    return list(dict.fromkeys(m[0] for pattern in SECRETS for m in re.finditer(pattern, seed, re.ASCII)))


def redacted(text: Column, seed: str = "") -> Column:
    """A text without the secrets of a seed text, wherever they stand, and without what looks like one."""
    for secret in secrets(seed):
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern.replace(r"\b", _EDGE), "[REDACTED]")
    return text


def sentences(text: Column) -> Column:
    """Sentences in order: up to a mark of their end, or a line's end."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?。！？\n]+[.!?。！？]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<number, start, text>>: windows of `size` characters that share `overlap`; none for an empty text."""
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / F.lit(step)).cast("int") - 1)
    cut = lambda k: F.struct(k.alias("number"), (k * step).alias("start"), F.substring(text, k * step + 1, F.lit(size)).alias("text"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), cut)).otherwise(F.array().cast("array<struct<number:int,start:int,text:string>>"))


def effective_length(text: Column, special: int = 2) -> Column:
    """Length where each character beyond the basic plane counts `special`."""
    return F.length(text) + (special - 1) * F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote, blanks and capitals aside."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return F.contains(flat(text), flat(quote))
