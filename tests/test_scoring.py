"""Scores of templates against a plain program, with nulls, repeated rows, clashing columns and empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import scoring as T

FIELD = "target string, part string, item string, field string, text string"
WORDS = ["blue", "chart", "图表", "架构图", "a+b", "note", "the", "neon", "art", "party", "x"]


def said(text):
    return re.sub(r"\s+", " ", (text or "").lower()).strip()


def tokens(text):
    plain = [t for w in re.findall(r"[a-z0-9][a-z0-9+-]*", said(text)) for t in re.split("[+-]", w) if len(t) >= 2]
    runs = re.findall(r"[一-鿿]{2,}", said(text))
    return {t for t in plain + [r[i : i + n] for r in runs for n in range(2, 9) if n <= 4 or n == len(r) for i in range(len(r) - n + 1)] if t not in T.STOP}


def field_points(question, part, field, text):
    """(points, phrase, words in common) or None."""
    a, b, cap = T.FIELDS[part, field]
    q, t = said(question), said(text)
    n = len(tokens(q) & tokens(t))
    phrase = (len(t) > 1 and t in q) or (a > 0 and len(q) > 1 and q in t)
    if not n and not phrase:
        return None
    if a < 0:
        return (a if phrase else max(cap, b * n)), phrase, n
    first = a if phrase else 0
    return min(cap, first + max(0, min(cap - first, b * n))), phrase, n


def made(seed, n=40):
    rng = random.Random(seed)
    say = lambda most: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, most)))
    questions = [(k, say(6)) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "图表")]
    fields = []
    for target in ("t1", "t2", "t3", "t4", "t5", "t6", "t7"):
        for part, field in rng.sample(sorted(T.FIELDS), 9):
            fields.append((target, part, "" if part == "own" else rng.choice("ab"), field, say(4)))
    return questions, list(dict.fromkeys(fields))


@pytest.fixture(scope="module")
def case(spark):
    questions, fields = made(3)
    asked = spark.createDataFrame(questions, "id long, q string").withColumn("text", F.lit("clash")).withColumn("target", F.lit("clash"))
    told = spark.createDataFrame([*fields, *fields[:5], ("t1", "own", "", "tag", None), ("t1", "own", "", "unknown", "blue"), (None, None, None, None, None)], FIELD)
    return questions, fields, asked, told


def test_points(spark, case):
    questions, fields, asked, told = case
    found = {(r.id, r.target, r.part, r.item, r.field, r.points, r.phrase, len(r.tokens)) for r in T.points(asked, "id", "q", told).collect()}
    wanted = {(k, *f[:4], *p) for k, q in questions if said(q) for f in fields if (p := field_points(q, f[1], f[3], f[4]))}
    assert found == wanted and {f[1] for f in wanted if f[1]} and any(w[5] < 0 for w in wanted)


def test_ranks(spark, case):
    questions, fields, asked, told = case
    rules = [("t1", "route", "neon", 9), ("t1", "route", "note", 9), ("t2", "guard", "ART", 15), ("t2", "guard", "图表", 15)]
    templates = [(f"t{k}", "high" if k == 6 else None) for k in range(1, 9)]
    items = sorted({(f[0], f[1], f[2], 5 if f[1] == "candidate" else None) for f in fields if f[1] != "own"}, key=str)
    entries = T.catalogue(spark.createDataFrame(templates, "target string, confidence string"), spark.createDataFrame(items, "target string, part string, item string, prior int"))
    scored = T.item_scores(T.points(asked, "id", "q", told), "id").union(T.rule_points(asked, "id", "q", spark.createDataFrame(rules, "target string, rule string, term string, points int")))
    found = {(r.id, r.place, r.target, r.score) for r in T.ranked(asked, "id", scored, entries, 4).collect()}
    wanted = set()
    for k, q in questions:
        sums = []
        for target, sure in templates:
            own = [i for i in items if i[0] == target]
            score = (4 if sure else 0) + sum(min(most, sum(i[1] == part for i in own)) for part, most in T.COUNTS.items())
            score += sum(p[0] for f in fields if f[0] == target and f[1] == "own" and said(q) and (p := field_points(q, f[1], f[3], f[4])))
            score += sum({r: n for t, r, term, n in rules if t == target and said(term) in said(q)}.values())
            for part, (top, most, least) in T.PARTS.items():
                each = []
                for i in own:
                    if i[1] == part:
                        held = [f for f in fields if f[:3] == i[:3]]
                        more = sum(p[0] for f in held if said(q) and (p := field_points(q, f[1], f[3], f[4])))
                        same = part in T.SAME and any(said(q) and said(q) == said(f[4]) and f[3] in ("title", "preview", "prompt") for f in held)
                        each.append(max(least, min(most, {"exact": 8, "candidate": 7}.get(part, 0) + more + (T.SAME[part] if same else 0))))
                score += sum(sorted(each, reverse=True)[:top])
            sums.append((-score, target))
        wanted |= {(k, place, t, -s) for place, (s, t) in enumerate(sorted(x for x in sums if x[0] < 0)[:4], 1)}
    assert found == wanted


def test_no_rows(spark, case):
    _, _, asked, told = case
    none = told.limit(0)
    assert T.points(asked, "id", "q", none).count() == 0 and T.points(asked.limit(0), "id", "q", told).count() == 0
    entries = T.catalogue(spark.createDataFrame([], "target string, confidence string"), none.select("target", "part", "item", F.lit(1).alias("prior")))
    assert T.ranked(asked, "id", T.item_scores(T.points(asked, "id", "q", none), "id"), entries, 3).count() == 0


def test_contained(spark):
    texts = ["party art", "x" * 3000 + "needle-in-a-haystack" + "y" * 3000, "", None, "a😀b longer words here", "short"]
    needles = ["art", "par", "needle-in-a-haystack", "needle-in-a-field", "😀b", "b longer words", "s", "", None, "ty ar", "?b longer words"]
    t = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    n = spark.createDataFrame([(x,) for x in needles] * 2, "n string")
    found = sorted((r.k, r.n) for r in T.contained(t, "k", "t", n, "n").collect())
    assert found == sorted((k, x) for k, text in enumerate(texts) if text for x in set(needles) if x and len(x) > 1 and x in text)


def test_profiles(spark):
    """Plain terms stand as words, signs and spaces within them count, weak terms don't; the role is the best of those allowed."""
    profiles = [
        ("p", ["primary", "style"], ["n"], [("purpose", "AP"), ("content", "api gateway"), ("structure", "user"), ("positive", "架构")]),
        ("s", ["supporting"], [], [("content", "gate-way"), ("purpose", "AP"), ("content", None)]),
        ("none", [], [], [("style", "neon")]),
    ]
    p = spark.createDataFrame(profiles, "target string, roles array<string>, negative_for array<string>, terms array<struct<dimension: string, term: string>>")
    asked = spark.createDataFrame([(1, "An AP, map of 架构图"), (2, "infographic apical user"), (3, "API gateway"), (4, "api, gateway gate-way"), (5, None), (6, "neon")], "id long, q string")
    found = {(r.id, r.target): (r.score, r.assigned, r.primary_score, r.hits) for r in T.profile_scores(asked, "id", "q", p).collect()}
    assert found == {
        (1, "p"): (12 * 1.4 + 14 + 8 + 2, "primary", 40.8, 2), (1, "s"): (9.6, "supporting", 16.8, 1),
        (3, "p"): (27.2, "primary", 27.2, 1), (4, "s"): (14.4, "supporting", 19.2, 1), (6, "none"): (0.0, "supporting", 7.2, 1),
    }
