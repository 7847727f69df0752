"""License scans by ordered signature rules, with DataFrame functions only.

A text becomes its words, parted by single spaces. Rules are regexes over that form; each has keywords
that gate it, and a text is scanned at all only where it holds a gate of any. Where a detection
lies within another of the same or a better priority, it is suppressed; the earlier rule of two with
the same place and priority stays.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.arrays import let, running
from marlstone.llm.license_rules import PRIORITIES, gates, rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: What stands before and after a match: neither is a word's character.
_OPEN, _CLOSE = "\x01", "\x02"


def word_form(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each between single spaces: ` a b `; two spaces where there are none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), SEPARATORS, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


_RULES = "array<struct<label:string,keywords:array<string>,priority:int,weight:double,regex:string,base:boolean,number:int>>"
FOUND = "struct<start:int,end:int,label:string,priority:int,weight:double,base:boolean,kept:boolean>"


def _places(form: Column, rule: Column) -> Column:
    """The first and last word of each match of a rule, in order: matches are marked in the text, and marked words numbered."""
    marked = F.regexp_replace(form, F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )")), F.lit(f"{_OPEN}$0{_CLOSE}"))

    def numbered(words: Column) -> Column:
        starts = F.array_compact(F.transform(words, lambda w, k: F.when(F.startswith(w, F.lit(_OPEN)), k)))
        ends = F.array_compact(F.transform(words, lambda w, k: F.when(F.endswith(w, F.lit(_CLOSE)), k)))
        return F.zip_with(starts, ends, lambda a, b: F.struct((a - 1).alias("start"), (1 - b).alias("back"), rule["priority"].alias("priority"), rule["number"].alias("rule")))

    return let(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), let(F.split(m, " "), numbered)))


def detections(form: Column) -> Column:
    """array of FOUND of a word form, by start, then the longest; places are the numbers of the first and last word, from 0.

    Rules are rows of a literal, so that the plan stays small however many there are; only those whose keywords stand in the text are tried.
    """
    held = F.from_json(F.lit(json.dumps([asdict(r) | {"number": k} for k, r in enumerate(rules())])), _RULES)
    gated = F.filter(held, lambda r: F.forall(r["keywords"], lambda k: F.contains(form, k)))
    found = F.array_sort(F.flatten(F.array_compact(F.transform(gated, lambda r: _places(form, r)))))  # by start, end downwards, priority, order of rules

    def step(ends: Column, d: Column) -> tuple[Column, Column]:
        """ends: how far detections of at most each priority reach; one that doesn't reach further than those of its own or a better lies within one of them."""
        after = [F.when(d["priority"] <= p, F.greatest(ends[f"p{p}"], -d["back"])).otherwise(ends[f"p{p}"]).alias(f"p{p}") for p in range(PRIORITIES)]
        furthest = ends[f"p{PRIORITIES - 1}"]
        for p in range(PRIORITIES - 1):
            furthest = F.when(d["priority"] == p, ends[f"p{p}"]).otherwise(furthest)
        return F.struct(*after), furthest < -d["back"]

    def told(rule: Column, d: Column, kept: Column) -> Column:
        return F.struct(
            d["start"].alias("start"), (-d["back"]).alias("end"), rule["label"].alias("label"), d["priority"].alias("priority"), rule["weight"].alias("weight"), rule["base"].alias("base"), kept.alias("kept")
        )

    none = F.struct(*(F.lit(-1).alias(f"p{p}") for p in range(PRIORITIES)))
    return let(found, lambda some: F.zip_with(some, running(some, none, step, "boolean"), lambda d, kept: let(F.get(held, d["rule"]), lambda rule: told(rule, d, kept))))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, form, found) of each row: the number of words, the word form and its detections, suppressed ones too.

    Repeated rows stay, ids may be null; a null or empty text has no words and no detections. Other columns are not
    looked at, whatever their names. An empty table gives no rows. Each row is scanned by itself, so nothing is shuffled;
    the time of a text grows with its words and detections.
    """
    formed = docs.select(F.col(id_column).alias("doc_id"), word_form(F.col(text_column)).alias("form"))
    gate = reduce(Column.__or__, (F.contains("form", F.lit(word)) for word in gates()))
    n = F.when(F.col("form") == "  ", F.lit(0)).otherwise(_spaces(F.col("form")) - 1)
    return formed.select("doc_id", n.cast("long").alias("n_words"), "form", F.when(gate, let(F.col("form"), detections)).otherwise(F.array().cast(f"array<{FOUND}>")).alias("found"))


def summary(found: DataFrame) -> DataFrame:
    """Per row of a scan: n_base, first_word, last_word, base_labels, labels, n_detections, score."""
    base, kept = F.filter("found", lambda d: d["base"]), F.filter("found", lambda d: d["kept"])
    starts = F.transform(base, lambda d: d["start"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        join(F.transform(base, lambda d: d["label"])).alias("base_labels"),
        join(F.concat(F.transform(base, lambda d: d["label"]), F.transform(kept, lambda d: d["label"]))).alias("labels"),
        F.size(kept).cast("long").alias("n_detections"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
