"""Queries on templates: evidence, items, ranks and roles for the turns of conversations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import composition
from marlstone.operators import scoring as T
from marlstone.plans import catalog
from marlstone.plans import sql as S
from marlstone.sources.tables import materialize, table

#: Which of a source's commonest words tell a field of its template: part, item, field, from which place, and how many.
SLOTS = (
    ("own", "", "template-title", 0, 2), ("own", "", "tag", 2, 4), ("own", "", "use-when", 6, 4), ("own", "", "guidance", 10, 6), ("own", "", "style-keyword", 4, 3), ("own", "", "scene", 16, 1),
    ("variant", "v1", "label", 3, 1), ("variant", "v1", "notes", 5, 2), ("variant", "v1", "prompt", 7, 4), ("variant", "v2", "label", 9, 1), ("variant", "v2", "prompt", 11, 3), ("variant", "v3", "label", 17, 2),
    ("variant", "v4", "notes", 19, 2), ("exact", "a", "title", 0, 3), ("exact", "a", "prompt", 12, 6), ("exact", "b", "preview", 18, 4), ("candidate", "c", "title", 14, 2), ("candidate", "d", "style", 20, 2),
    ("canonical", "x", "title", 1, 2), ("canonical", "x", "negative", 21, 1), ("canonical", "y", "path", 22, 1), ("canonical", "y", "redirect", 8, 2), ("canonical", "z", "snippet", 4, 5),
)
#: Rules of templates: name, the place of a word that each asks for, and its points.
RULES = (("route", 15, 10), ("route", 23, 10), ("guard", 13, 12))
#: Terms of a profile by dimension: from which place, and how many.
TERMS = {"purpose": (0, 2), "content": (2, 4), "structure": (6, 3), "style": (9, 4), "constraints": (13, 2), "positive": (15, 5)}
CONFIDENCES, PRIOR = ("high", "medium", "low"), 5


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, asked, text): each text of a turn once, written, as it is read for words and for phrases. Rows in between go by the number, not by the digest."""
    said = table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("text"))
    return materialize(said.select(F.sha2("text", 256).alias("asked"), "text").distinct().withColumn("id", F.monotonically_increasing_id()), "template-questions")


def _told(found: DataFrame, asked: DataFrame) -> DataFrame:
    return found.join(asked.select("id", "asked"), "id").drop("id")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, k, term): the 24 commonest words of each source's documents, from 0."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    counted = docs.select(F.col("source").alias("target"), F.explode(T.query_tokens(F.col("text"))).alias("term")).groupBy("target", "term").agg(F.count("*").alias("n"))
    # Places are compared as they are numbered: then each task passes on the first 24 of a source, not all of its words.
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "term"))).filter("place <= 24")
    return materialize(ranked.select("target", (F.col("place") - 1).alias("k"), "term"), "template-words")


def _fields(words: DataFrame) -> DataFrame:
    own = words.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("ws"))
    slots = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(item).alias("item"), F.lit(field).alias("field"), F.array_join(F.slice("ws", at + 1, n), " ").alias("text")) for part, item, field, at, n in SLOTS))
    named = words.select("target").distinct().select("target", F.lit("own").alias("part"), F.lit("").alias("item"), F.lit("template-id").alias("field"), F.col("target").alias("text"))
    return own.select("target", F.inline(slots)).union(named)


def _entries(words: DataFrame) -> DataFrame:
    names = words.select("target").distinct()
    sure = F.element_at(F.array(*map(F.lit, CONFIDENCES)), (F.length("target") % 3 + 1).cast("int"))
    items = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(item).alias("item"), F.lit(PRIOR).alias("prior")) for part, item in dict.fromkeys((p, i) for p, i, *_ in SLOTS if p != "own")))
    return T.catalogue(names.select("target", sure.alias("confidence")), names.select("target", F.inline(items)))


def template_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of sources, by their commonest words."""
    # Nothing of it is shuffled or sorted, so rows go by the digest from the start.
    found = T.points(_questions(spark, sf_dir), "asked", "text", _fields(_words(spark, sf_dir)))
    return found.withColumn("points", F.col("points").cast("long")).withColumn("tokens", F.array_join("tokens", ","))


def _scored(spark: SparkSession, asked: DataFrame, words: DataFrame) -> DataFrame:
    places = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("k"), F.lit(n).alias("points")) for rule, k, n in RULES))
    rules = words.join(F.broadcast(spark.range(1).select(F.inline(places))), "k").select("target", "rule", "term", "points")
    return T.item_scores(T.points(asked, "id", "text", _fields(words), reasons=False), "id").union(T.rule_points(asked, "id", "text", rules))


def template_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best templates of each turn."""
    words, asked = _words(spark, sf_dir), _questions(spark, sf_dir)
    return _told(T.ranked(asked, "id", _scored(spark, asked, words), _entries(words), 5), asked)


def _items(part: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = _words(spark, sf_dir)
        asked = _questions(spark, sf_dir)
        scored = T.item_scores(T.points(asked, "id", "text", _fields(words), reasons=False), "id")
        found = _told(T.item_ranks(asked, "id", scored, _entries(words), part), asked)
        return found.withColumn("place", F.col("place").cast("long"))

    return run


def profile_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of sources' profiles in an answer to each turn."""
    words = _words(spark, sf_dir)
    dims = F.coalesce(*(F.when((F.col("k") >= at) & (F.col("k") < at + n), name) for name, (at, n) in TERMS.items()))
    own = words.withColumn("dimension", dims).filter("dimension IS NOT NULL").groupBy("target").agg(F.collect_list(F.struct("dimension", "term")).alias("terms"), F.min("term").alias("least"))
    kinds = F.filter(F.array(F.when(F.length("target") % 2 == 0, "primary"), F.lit("supporting"), F.when(F.ascii("least") % 2 == 0, "style")), lambda r: r.isNotNull())
    profiles = own.select("target", kinds.alias("roles"), F.array(F.substring("target", -1, 1)).alias("negative_for"), "terms")
    asked = _questions(spark, sf_dir)
    found = materialize(T.profile_scores(asked, "id", "text", profiles), "profile-scores")
    placed = composition.compose(found, "id").withColumn("place", F.col("place").cast("long")).join(found.select("id", "target", "score", "assigned"), ["id", "target"])
    return _told(placed, asked)


QUERIES = {f.__name__: f for f in (template_points, template_ranks, profile_roles)} | {"prompt_variants": _items("variant"), "matched_cases": _items("exact")}

_STOP = ", ".join(f"'{w}'" for w in T.STOP)


def _said(x: str) -> str:
    return f"trim(regexp_replace(translate(lower(coalesce({x}, '')), '‘’“”', '''''\"\"'), '[\\s ]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    found = re.sub(r"\blow\b", lambda _: x, catalog._GRAMS)
    return f"list_distinct(list_filter({found}, lambda t: t NOT IN ({_STOP})))"


_WORDS = f"""n AS (SELECT source AS target, term, count(*) AS n FROM (SELECT source, unnest({_tokens(_said("text"))}) AS term FROM documents WHERE source IS NOT NULL) GROUP BY ALL),
    w AS MATERIALIZED (SELECT target, term, row_number() OVER (PARTITION BY target ORDER BY n DESC, term) - 1 AS k FROM n QUALIFY k < 24),
    q AS MATERIALIZED (SELECT asked, q, {_tokens("q")} AS qt FROM (SELECT DISTINCT sha256(coalesce(text, '')) AS asked, {_said("text")} AS q FROM conversations))"""
_SLOTS = " UNION ALL ".join(
    f"SELECT target, '{part}' AS part, '{item}' AS item, '{field}' AS field, array_to_string(ws[{at + 1}:{at + n}], ' ') AS text, {' , '.join(f'{v} AS {c}' for v, c in zip(T.FIELDS[part, field], ('a', 'b', 'cap'), strict=True))} FROM ws"
    for part, item, field, at, n in SLOTS
)
_POINTS = f"""{_WORDS}, ws AS (SELECT target, list(term ORDER BY k) AS ws FROM w GROUP BY target),
    f0 AS (SELECT DISTINCT target, part, item, field, {_said("text")} AS t, a, b, cap FROM ({_SLOTS} UNION ALL SELECT target, 'own', '', 'template-id', target, 12, 5, 12 FROM ws)), f AS MATERIALIZED (SELECT *, {_tokens("t")} AS ft FROM f0 WHERE t <> ''),
    m AS (SELECT asked, target, part, item, field, a, b, cap, (length(t) > 1 AND contains(q, t)) OR (a > 0 AND length(q) > 1 AND contains(t, q)) AS phrase, q = t AND part IN ('exact', 'candidate') AND field IN ('title', 'preview', 'prompt') AS same,
      list_sort(list_filter(qt, lambda x: list_contains(ft, x))) AS tokens FROM q, f WHERE q <> ''),
    p AS MATERIALIZED (SELECT asked, target, part, item, field, CASE WHEN a < 0 THEN CASE WHEN phrase THEN a ELSE greatest(cap, b * len(tokens)) END
      ELSE least(cap, CASE WHEN phrase THEN a ELSE 0 END + greatest(0, least(cap - CASE WHEN phrase THEN a ELSE 0 END, b * len(tokens)))) END AS points, phrase, same, tokens FROM m WHERE phrase OR same OR len(tokens) > 0)"""
_COUNTS = {part: len({i for p, i, *_ in SLOTS if p == part}) for part in T.PARTS}
_OWN = sum(min(most, _COUNTS[part]) for part, most in T.COUNTS.items())
_SURE = "CASE length(target) % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END"
_ITEMS = " UNION ALL ".join(f"SELECT target, '{part}' AS part, '{item}' AS item, {dict(exact=8, candidate=2 + PRIOR).get(part, 0)} AS base FROM t" for part, item in dict.fromkeys((p, i) for p, i, *_ in SLOTS if p != "own"))
_BASE = f"""t AS (SELECT DISTINCT target FROM w), e AS MATERIALIZED (SELECT target, 'own' AS part, '' AS item, {_OWN} + {_SURE} AS base FROM t UNION ALL {_ITEMS}),
    i AS MATERIALIZED (SELECT asked, target, part, item, sum(points) + max(CASE WHEN same THEN CASE part WHEN 'exact' THEN 24 ELSE 14 END ELSE 0 END) AS more FROM p GROUP BY ALL)"""


def _best(part: str) -> str:
    return f"""WITH {_POINTS}, {_BASE}, s AS (SELECT DISTINCT asked, target FROM i WHERE part = '{part}')
        SELECT asked, target, item, base + coalesce(more, 0) AS score, row_number() OVER (PARTITION BY asked, target ORDER BY base + coalesce(more, 0) DESC, item) AS place
        FROM s JOIN (SELECT * FROM e WHERE part = '{part}') USING (target) LEFT JOIN i USING (asked, target, part, item) QUALIFY place <= {T.PARTS[part][0]}"""


_CAPS = "CASE part " + " ".join(f"WHEN '{part}' THEN greatest({least}, least({most}, {{0}}))" for part, (_, most, least) in T.PARTS.items()) + " ELSE {0} END"
_TOPS = "CASE part " + " ".join(f"WHEN '{part}' THEN {top}" for part, (top, _, _) in T.PARTS.items()) + " ELSE 1000 END"
_DIMS = ", ".join(f"least({56 if d == 'positive' else 36}, count(DISTINCT term) FILTER (WHERE dimension = '{d}') * {14 if d == 'positive' else 12}) AS \"{d}\"" for d in TERMS)
_ROLES = ", ".join(
    f"{S.q(' + '.join(f'{chr(34)}{d}{chr(34)} * {w}::DOUBLE' for d, w in weights.items()) + (' + CASE WHEN length(target) % 2 = 0 THEN 8 ELSE 0 END' if role == 'primary' else '') + ' + least(12, (hits - 1) * 2)', 1)} AS s_{role}" for role, weights in T.ROLES.items()
)

ORACLE = {
    "template_points": f"WITH {_POINTS} SELECT * REPLACE (array_to_string(tokens, ',') AS tokens) FROM p",
    "template_ranks": f"""WITH {_POINTS}, {_BASE}, rules AS (SELECT target, rule, term, points FROM w JOIN (VALUES {", ".join(f"('{r}', {k}, {n})" for r, k, n in RULES)}) v(rule, k, points) USING (k)),
        r AS (SELECT asked, target, sum(points) AS more FROM (SELECT DISTINCT asked, target, rule, points FROM q, rules WHERE (length(term) > 1 AND contains(q, term)) OR list_contains(qt, term)) GROUP BY ALL),
        a AS (SELECT asked, target, part, item, base + coalesce(i.more, 0) + CASE WHEN part = 'own' THEN coalesce(r.more, 0) ELSE 0 END AS score FROM (SELECT asked FROM q) CROSS JOIN e LEFT JOIN i USING (asked, target, part, item) LEFT JOIN r USING (asked, target)),
        b AS (SELECT asked, target, {_CAPS.format("score")} AS score, row_number() OVER (PARTITION BY asked, target, part ORDER BY score DESC) AS k, part FROM a QUALIFY k <= {_TOPS}), c AS (SELECT asked, target, sum(score) AS score FROM b GROUP BY ALL)
        SELECT asked, target, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, target) AS place FROM c WHERE score > 0 QUALIFY place <= 5""",
    "prompt_variants": _best("variant"),
    "matched_cases": _best("exact"),
    "profile_roles": f"""WITH {_WORDS}, d AS (SELECT target, term, CASE {" ".join(f"WHEN k >= {at} AND k < {at + n} THEN '{name}'" for name, (at, n) in TERMS.items())} END AS dimension FROM w),
        pr AS (SELECT target, min(term) AS least_ FROM d WHERE dimension IS NOT NULL GROUP BY target),
        h AS (SELECT asked, target, dimension, term FROM q, d WHERE dimension IS NOT NULL AND term NOT IN ({", ".join(f"'{w}'" for w in T.WEAK)}) AND CASE WHEN regexp_matches(term, '^[a-z0-9]+$') THEN regexp_matches(q, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') ELSE length(term) > 1 AND contains(q, term) END),
        g AS (SELECT asked, target, {_DIMS}, count(*) AS hits FROM h GROUP BY asked, target), s AS (SELECT asked, target, {_ROLES}, length(target) % 2 = 0 AS is_p, ascii(least_) % 2 = 0 AS is_t, right(target, 1) AS neg FROM g JOIN pr USING (target)),
        c AS (SELECT *, greatest(s_supporting, CASE WHEN is_p THEN s_primary ELSE 0 END, CASE WHEN is_t THEN s_style ELSE 0 END) AS score FROM s),
        z AS MATERIALIZED (SELECT *, CASE WHEN score = s_supporting THEN 'supporting' WHEN is_p AND score = s_primary THEN 'primary' ELSE 'style' END AS assigned FROM c WHERE score > 0),
        b AS (SELECT asked, first(target ORDER BY is_p DESC, CASE WHEN is_p THEN -s_primary END, score DESC, target) AS best, first(neg ORDER BY is_p DESC, CASE WHEN is_p THEN -s_primary END, score DESC, target) AS against FROM z GROUP BY asked),
        r AS (SELECT asked, target, score, assigned, 'primary' AS role FROM z JOIN b USING (asked) WHERE target = best UNION ALL SELECT asked, target, score, assigned, 'rejected' FROM z JOIN b USING (asked) WHERE target <> best AND neg = against
          UNION ALL SELECT asked, target, score, assigned, 'supporting' FROM z JOIN b USING (asked) WHERE target <> best AND neg <> against AND score >= 18 UNION ALL SELECT asked, target, score, assigned, 'style' FROM z JOIN b USING (asked) WHERE target <> best AND neg <> against AND is_t AND score >= 14)
        SELECT asked, target, score, assigned, role, row_number() OVER (PARTITION BY asked, role ORDER BY score DESC, target) AS place FROM r QUALIFY place <= CASE role WHEN 'supporting' THEN 3 WHEN 'style' THEN 2 ELSE place END""",
}
