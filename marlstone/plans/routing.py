"""Queries on routes of pages to wikis, and on domains of questions and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.arrays import let
from marlstone.operators import routing as G
from marlstone.plans import content
from marlstone.plans import sql as S
from marlstone.sources.tables import materialize, table

#: Words of a profile's phrases, by kind: from where in a title, and how many.
SLICES = {"core": (1, 3), "adjacent": (4, 2), "alias": (6, 1), "negative": (7, 2)}
#: How often the words of a domain are in its texts: from which place, and how many.
RANKS = {"core": (0, 2), "support": (2, 4), "generic": (6, 4), "focus": (10, 3)}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), F.concat_ws("\n", X.html_title(F.col("html")), X.readable(F.col("html"))).alias("text"))


def wiki_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources; every 20th page's title tells the scope of a wiki: its core, what is near it, another name, and what is out of it."""
    pages = _pages(spark, sf_dir)
    kinds = let(G.words(F.col("title")), lambda ws: F.array(*(F.struct(F.lit(kind).alias("kind"), F.array_join(F.slice(ws, at, n), " ").alias("phrase")) for kind, (at, n) in SLICES.items())))
    titles = materialize(pages.filter("page_id % 20 = 0").select("page_id", "title"), "titles")  # else a filter on what is inlined reads the titles of all pages
    profiles = titles.select(F.concat(F.lit("wiki-"), F.col("page_id").cast("string")).alias("wiki"), F.inline(kinds))
    found = G.ranked(pages, "page_id", "text", "title", profiles)
    return found.select("page_id", "wiki", "score", "quality", "hint", F.array_join("terms", ",").alias("terms"), F.array_join("negatives", ",").alias("negatives"), F.col("place").cast("long").alias("place"))


def route_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = G.route_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(own).cast("long").alias("n"), F.sha2(F.array_join(own, " "), 256).alias("sha"))


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as questions, each with the document of its conversation's number; languages as domains, known by the words that most of their texts have."""
    docs = table(spark, sf_dir, "documents")
    counted = docs.filter("lang IS NOT NULL").select("lang", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).filter(F.col("k") <= 13)
    own = lambda at, n: F.array_sort(F.collect_list(F.when((F.col("k") > at) & (F.col("k") <= at + n), F.col("term"))))
    profiles = ranked.groupBy(F.col("lang").alias("domain")).agg(*(own(*place).alias(name) for name, place in RANKS.items()))
    names = profiles.agg(F.array_sort(F.collect_set("domain")).alias("all"))
    profiles = profiles.crossJoin(F.broadcast(names)).withColumn("negative", F.filter("all", lambda d: d != F.col("domain"))).drop("all")
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return G.intents(asked, "question", profiles).join(docs.select(F.col("doc_id").alias("conv_id"), "source", F.col("text").alias("excerpt")), "conv_id", "left")


def question_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array_join(F.transform("scores", lambda x: F.concat(x["domain"], F.lit(":"), F.format_number(x["score"], 2))), ",")
    return _intents(spark, sf_dir).select("conv_id", "turn", scores.alias("scores"), F.array_join("dominant", ",").alias("dominant"), "crossing", F.array_join("focused", ",").alias("focused"))


def evidence_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evidence_fit(_intents(spark, sf_dir), F.col("source"), F.col("excerpt")).select("conv_id", "turn", "fit.*")


QUERIES = {f.__name__: f for f in (wiki_routes, route_token_counts, question_domains, evidence_fits)}

_GENERIC = ", ".join(f"'{w}'" for w in G.GENERIC)
_TOKENS = lambda x: S.tokens(x, 2, G.STOP)
_WORDS = lambda x: f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_FORMS = lambda t: f"list_distinct(list_filter(flatten(list_transform({t}, lambda w: [w, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' END, CASE WHEN w LIKE '%s' AND length(w) > 4 THEN left(w, length(w) - 1) END, CASE WHEN w LIKE '%ics' AND length(w) > 5 THEN left(w, length(w) - 3) END, CASE WHEN w LIKE '%ic' AND length(w) > 4 THEN left(w, length(w) - 2) END])), lambda x: x IS NOT NULL))"
_NORMAL = lambda x: f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[_/|:：,，.。;；()（）\\[\\]{{}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_HOLDS = lambda text, terms: f"len(list_filter({terms}, lambda t: contains({text}, t)))"


def _evidence(name: str, text: str) -> str:
    """CTEs that end in `name` (page_id, wiki, kind, term, phrase, generic)."""
    return f"""{name}_t AS (SELECT page_id, ' ' || array_to_string({_WORDS(text)}, ' ') || ' ' AS flat, {_FORMS(_TOKENS(text))} AS forms FROM p),
        {name} AS MATERIALIZED (SELECT page_id, wiki, kind, phrase AS term, true AS phrase, false AS generic FROM {name}_t JOIN phrases ON contains(flat, ' ' || phrase || ' ') UNION ALL
          SELECT page_id, wiki, kind, term, false, term IN ({_GENERIC}) FROM (SELECT page_id, unnest(forms) AS term FROM {name}_t) JOIN own USING (term))"""


_PAGES = f"p AS MATERIALIZED (SELECT page_id, {content._html_title('html')} AS title, concat_ws(chr(10), {content._html_title('html')}, {content._readable('html')}) AS text FROM pages)"
_INTENTS = f"""c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_distinct({S.tokens("text")})) AS term FROM documents WHERE lang IS NOT NULL) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS k FROM c QUALIFY k <= 13),
    prof AS MATERIALIZED (SELECT lang AS domain, {", ".join(f"coalesce(list(term ORDER BY term) FILTER (WHERE k > {at} AND k <= {at + n}), []) AS {name}" for name, (at, n) in RANKS.items())} FROM r GROUP BY lang),
    q AS (SELECT conv_id, turn, {_NORMAL("text")} AS q FROM conversations),
    n AS (SELECT conv_id, turn, q, domain, focus, {_HOLDS("q", "core")} AS a, {_HOLDS("q", "support")} AS b, {_HOLDS("q", "generic")} AS g FROM q, prof),
    sc AS MATERIALIZED (SELECT conv_id, turn, q, domain, focus, CASE WHEN a > 0 OR b >= 2 OR (b >= 1 AND g >= 2) THEN {S.q("greatest(0.0, least(1.0, a * 0.75::DOUBLE + b * 0.35::DOUBLE + least(g, 2) * 0.12::DOUBLE))", 6)} ELSE 0.0 END AS score FROM n),
    one AS MATERIALIZED (SELECT conv_id, turn, max(score) AS best, count(*) FILTER (WHERE score >= 0.35) > 1 AND bool_or({" OR ".join(f"contains(q, '{t}')" for t in G.CROSSING)}) AS crossing FROM sc GROUP BY conv_id, turn),
    dom AS MATERIALIZED (SELECT sc.*, crossing, CASE WHEN crossing THEN score >= 0.35 ELSE best > 0 AND score >= greatest(0.35, {S.q("best - 0.15::DOUBLE", 6)}) END AS dominant, score >= 0.35 AND {_HOLDS("q", "focus")} > 0 AS focused FROM sc JOIN one USING (conv_id, turn))"""

ORACLE = {
    "wiki_routes": f"""WITH {_PAGES}, prof AS (SELECT 'wiki-' || page_id AS wiki, kind, array_to_string(phrase, ' ') AS phrase FROM (SELECT page_id, unnest([{", ".join(f"'{k}'" for k in SLICES)}]) AS kind, unnest([{", ".join(f"{_WORDS('title')}[{at}:{at + n - 1}]" for at, n in SLICES.values())}]) AS phrase FROM p WHERE page_id % 20 = 0) WHERE len(phrase) > 0),
        own AS (SELECT DISTINCT wiki, kind, unnest({_TOKENS("phrase")}) AS term FROM prof), phrases AS (SELECT DISTINCT * FROM prof WHERE kind = 'negative' OR (len({_TOKENS("phrase")}) > 0 AND NOT (len({_TOKENS("phrase")}) = 1 AND {_TOKENS("phrase")}[1] IN ({_GENERIC})))),
        {_evidence("m", "text")}, {_evidence("f", "title")},
        s AS (SELECT page_id, wiki, sum(CASE kind WHEN 'core' THEN CASE WHEN phrase THEN 5 WHEN generic THEN 0 ELSE 0.8 END WHEN 'alias' THEN CASE WHEN phrase THEN 5 WHEN generic THEN 0 ELSE 0.7 END WHEN 'adjacent' THEN CASE WHEN phrase THEN 2.5 WHEN generic THEN 0 ELSE 0.3 END ELSE CASE WHEN phrase THEN -4 WHEN generic THEN -0.5 ELSE -2 END END) AS x,
          count(DISTINCT CASE WHEN kind <> 'negative' AND generic THEN term END) AS g, bool_or(kind <> 'negative' AND phrase) AS strong, coalesce(list(DISTINCT term ORDER BY term) FILTER (WHERE kind <> 'negative'), []) AS terms, coalesce(list(DISTINCT term ORDER BY term) FILTER (WHERE kind = 'negative'), []) AS negatives FROM m GROUP BY page_id, wiki),
        j AS (SELECT s.*, greatest(0.0, x::DOUBLE + g * 0.1::DOUBLE) AS sc, coalesce(n, 0) AS near FROM s LEFT JOIN (SELECT page_id, wiki, count(*) AS n FROM f WHERE kind <> 'negative' AND NOT generic GROUP BY ALL) USING (page_id, wiki)),
        o AS (SELECT page_id, wiki, {S.q("sc", 2)} AS score, CASE WHEN sc <= 0 THEN 'none' WHEN sc >= 5 AND strong THEN 'strong' WHEN sc >= 2 THEN 'moderate' ELSE 'weak' END AS quality,
          CASE WHEN sc <= 0 THEN 'unrelated' WHEN sc >= 5 AND strong THEN 'same_scheme' WHEN near >= 1 AND sc >= 4 THEN 'possible_child_profile' WHEN near >= 1 AND sc >= 2 THEN 'adjacent_family' ELSE 'generic_overlap' END AS hint, array_to_string(terms, ',') AS terms, array_to_string(negatives, ',') AS negatives FROM j)
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, wiki) AS place FROM o""",
    "route_token_counts": f"SELECT doc_id, len({_TOKENS('text')}) AS n, sha256(array_to_string({_TOKENS('text')}, ' ')) AS sha FROM documents",
    "question_domains": f"""WITH {_INTENTS} SELECT conv_id, turn, string_agg(domain || ':' || printf('%.2f', score), ',' ORDER BY score DESC, domain) AS scores, coalesce(string_agg(domain, ',' ORDER BY score DESC, domain) FILTER (WHERE dominant), '') AS dominant, bool_or(crossing) AS crossing,
        coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (WHERE focused), '') AS focused FROM dom GROUP BY conv_id, turn""",
    "evidence_fits": f"""WITH {_INTENTS}, e AS (SELECT dom.*, core, support, generic, {_NORMAL("source")} AS own, {_NORMAL(f"{_NORMAL('source')} || ' ' || coalesce(text, '')")} AS whole FROM dom JOIN prof USING (domain) LEFT JOIN documents ON doc_id = conv_id),
        k AS (SELECT e.*, {_HOLDS("own", "core")} AS ic, {_HOLDS("whole", "core")} AS fc, {_HOLDS("own", "support")} AS isu, {_HOLDS("whole", "support")} AS fs, {_HOLDS("whole", "generic")} AS g, {_HOLDS("whole", "focus")} > 0 AS has_focus FROM e),
        press AS (SELECT x.conv_id, x.turn, x.domain, sum(y.ic * 0.5::DOUBLE + greatest(0, y.fc - y.ic) * 0.25::DOUBLE) AS pressure FROM k x JOIN k y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.domain <> y.domain GROUP BY ALL),
        v AS (SELECT k.conv_id, k.turn, k.domain, {S.q("greatest(0.0, least(1.0, ic * 0.7::DOUBLE + greatest(0, fc - ic) * 0.4::DOUBLE + isu * 0.25::DOUBLE + greatest(0, fs - isu) * 0.15::DOUBLE + least(g, 2) * 0.05::DOUBLE))", 6)} AS positive,
          {S.q("greatest(0.0, least(1.0, greatest(0.0, least(1.0, coalesce(pressure, 0.0))) + CASE WHEN focused AND NOT has_focus THEN 0.35::DOUBLE ELSE 0.0 END))", 6)} AS negative, ic > 0 OR fc > 0 OR isu + fs >= 2 AS known FROM k LEFT JOIN press USING (conv_id, turn, domain) WHERE dominant),
        w AS (SELECT conv_id, turn, domain, positive, negative, {S.q("positive - negative", 6)} AS margin, known AND {S.q("positive - negative", 6)} >= 0.25 AND positive >= 0.45 AS strong, {S.q("greatest(0.0, least(1.0, positive - negative))", 6)} AS score FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY margin DESC, score DESC, strong DESC, domain) = 1)
        SELECT conv_id, turn, domain, coalesce(positive, 0.5) AS positive, coalesce(negative, 0.0) AS negative, coalesce(margin, 0.5) AS margin, coalesce(strong, true) AS strong, coalesce(score, 0.5) AS score FROM conversations LEFT JOIN w USING (conv_id, turn)""",
}
