"""Knowledge queries: documents as pages, parts and lines as topics and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.numeric import quantise
from marlstone.functions.text import normal_title, sentences
from marlstone.operators import graphs
from marlstone.operators import knowledge as N
from marlstone.plans import sql as S
from marlstone.sources.tables import table

ASKED = ["thing", "eden", "tion", "ist", "src7"]
TOPICS = ["STEEL", "BRUSHED", "en"]


def term_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.term_graph(table(spark, sf_dir, "documents"), "doc_id", "text")[0]


def term_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.term_graph(table(spark, sf_dir, "documents"), "doc_id", "text")[1]


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each document as a claim, all the rest as its evidence."""
    said = sentences(F.coalesce(F.col("text"), F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.get(said, F.lit(0)), F.lit("")).alias("claim"), F.array_join(F.slice(said, 2, F.greatest(F.size(said), F.lit(1))), "\n").alias("evidence"))
    return N.claim_support(rows, "claim", "evidence").select("doc_id", F.col("matched").cast("long").alias("matched"), quantise(F.col("coverage"), 6).alias("coverage"), "level")


def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Titles are made within the array: a filter on them after the explode would make each twice.
    claims = F.filter(F.transform(sentences(F.col("text")), normal_title), lambda c: F.length(c) >= 24)
    rows = table(spark, sf_dir, "documents").select("source", "n_chars", F.explode_outer(claims).alias("claim")).filter("claim IS NOT NULL")
    found = N.merged_claims(rows, F.col("claim"), "source", "n_chars").filter("n > 1")
    return found.select("claim", F.array_join("sources", ",").alias("sources"), "n", "score")


def topic_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pages = part.select(F.col("p_partkey").alias("page"), F.split("p_type", " ").alias("topics"))
    words = part.select(F.explode(F.split("p_type", " ")).alias("topic")).distinct()
    aliases = words.select("topic", F.reverse("topic").alias("alias"))
    redirects = words.select(F.substring("topic", 1, 5).alias("a"), F.col("topic").alias("b"))
    edges = words.select(F.lit("STEEL").alias("a"), F.col("topic").alias("b")).filter("b <> 'STEEL'")
    return N.topic_boosts(pages, [*TOPICS, "DEHSURB", "BRUSH"], "topics", aliases, redirects, edges)


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = N.page_score(F.col("source"), F.col("text"), F.col("lang") == "en", ASKED)
    return table(spark, sf_dir, "documents").select("doc_id", score.cast("long").alias("score")).filter("score > 0")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    form = F.when(F.col("p_size") < 10, F.concat(F.lit("sh"), six)).when(F.col("p_size") < 20, F.concat(six, F.lit(".SS"))).when(F.col("p_size") < 30, F.concat(F.lit("hk"), F.substring(six, 3, 4))).when(F.col("p_size") < 40, F.lit("brk.b")).otherwise(F.col("p_brand"))
    code = N.symbol(form)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("market", N.market(F.col("code")))


def subtitle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues of a subtitle file, read back as text."""
    cue = F.concat(F.lit("WEBVTT\r\n\r\n1\n00:01.000 --> 00:02.000\n<b>"), F.col("text"), F.lit("</b>\n\n2\n00:02.000 --> 00:03.000\nend\nend\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(N.subtitle_text(cue), 256).alias("sha"))


def redirect_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    return graphs.cycle_nodes(n)


def trailing_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return N.trailing_sum(o, "o_custkey", "day", "o_totalprice", 365).select("o_orderkey", "trailing")


def typo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands against the brand of the next key, a character off."""
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("other"))
    return p.join(other, "p_partkey").filter(N.one_typo(F.col("p_brand"), F.col("other"))).select("p_partkey", "p_brand", "other")


QUERIES = {f.__name__: f for f in (term_nodes, term_edges, claim_support, merged_claims, topic_boosts, page_scores, symbols, subtitle_texts, redirect_cycles, trailing_spend, typo_pairs)}

_TOP = f"""w AS (SELECT doc_id, unnest({S.tokens("text")}) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY 1, 2),
    top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) <= 8)"""
_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\\n]+[.!?。！？]*'), lambda s: trim(s)), lambda s: s <> '')"
_TITLE = "trim(regexp_replace(lower(s), '[^a-z0-9一-鿿]+', ' ', 'g'))"
_LIST = "[" + ", ".join(f"'{t}'" for t in ASKED) + "]"
_POINTS = f"2 * len(list_intersect({_LIST}, {S.tokens('source')})) + len(list_intersect({_LIST}, {S.tokens('text')}))"
_WANTED = "('" + "', '".join([*TOPICS, "DEHSURB", "BRUSH"]) + "')"
_UP = "upper(trim(form))"

ORACLE = {
    "term_nodes": f"WITH {_TOP} SELECT t AS term, sum(n) AS weight FROM top GROUP BY t",
    "term_edges": f"WITH {_TOP} SELECT x.t AS a, y.t AS b, count(*) AS weight FROM top x JOIN top y ON x.doc_id = y.doc_id AND x.t < y.t GROUP BY 1, 2",
    "claim_support": f"""WITH s AS (SELECT doc_id, coalesce({_SENTENCES}, []) AS s FROM documents), c AS (SELECT doc_id, list_distinct({S.tokens("coalesce(s[1], '')")}) AS own, list_distinct({S.tokens("array_to_string(s[2:], chr(10))")}) AS held FROM s),
        m AS (SELECT doc_id, len(list_intersect(own, held)) AS matched, least(1.0, CASE WHEN len(own) > 0 THEN CAST(len(list_intersect(own, held)) AS DOUBLE) / least(len(own), 16) ELSE 0.0 END) AS coverage FROM c)
        SELECT doc_id, matched, {S.q("coverage", 6)} AS coverage, CASE WHEN coverage >= 0.65 THEN 'strong' WHEN coverage >= 0.35 THEN 'partial' ELSE 'weak' END AS level FROM m""",
    "merged_claims": f"""WITH s AS (SELECT source, n_chars, unnest({_SENTENCES}) AS s FROM documents), c AS (SELECT source, n_chars, {_TITLE} AS claim FROM s)
        SELECT claim, array_to_string(list_sort(list_distinct(array_agg(source))), ',') AS sources, count(*) AS n, max(n_chars) AS score FROM c WHERE length(claim) >= 24 GROUP BY claim HAVING count(*) > 1""",
    "topic_boosts": f"""WITH k AS (SELECT p_partkey AS page, unnest(string_split(p_type, ' ')) AS topic FROM part), words AS (SELECT DISTINCT topic FROM k),
        p AS (SELECT page, 12 AS p FROM k WHERE topic IN {_WANTED} UNION ALL SELECT page, 16 FROM k WHERE reverse(topic) IN {_WANTED} UNION ALL SELECT page, 16 FROM k WHERE substr(topic, 1, 5) IN {_WANTED}
          UNION ALL SELECT page, 8 FROM k WHERE topic <> 'STEEL' UNION ALL SELECT page, 8 FROM k JOIN words w ON w.topic IN {_WANTED} AND w.topic <> 'STEEL' WHERE k.topic = 'STEEL')
        SELECT page, sum(p) / 100.0 AS boost FROM p GROUP BY page""",
    "page_scores": f"SELECT doc_id, score FROM (SELECT doc_id, {_POINTS} + CASE WHEN lang = 'en' AND {_POINTS} > 0 THEN 1 ELSE 0 END AS score FROM documents) WHERE score > 0",
    "symbols": f"""WITH f AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'sh' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN p_size < 20 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.SS' WHEN p_size < 30 THEN 'hk' || substr(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 3, 4) WHEN p_size < 40 THEN 'brk.b' ELSE p_brand END AS form FROM part),
        c AS (SELECT p_partkey, CASE WHEN regexp_matches({_UP}, '^((SH|SZ|BJ|SS)\\.?)?[0-9]{{6}}(\\.(SH|SZ|SS|BJ))?$') THEN regexp_extract({_UP}, '[0-9]{{6}}') WHEN regexp_matches({_UP}, '^HK\\.?[0-9]{{1,5}}$|^[0-9]{{1,5}}\\.HK$') THEN lpad(regexp_extract({_UP}, '[0-9]+'), 5, '0') ELSE {_UP} END AS code FROM f)
        SELECT p_partkey, code, CASE WHEN regexp_matches(code, '^[0-9]{{6}}$') THEN 'cn' WHEN regexp_matches(code, '^[0-9]{{5}}$') THEN 'hk' WHEN regexp_matches(code, '^[A-Z]{{1,5}}(\\.[A-Z])?$') THEN 'us' ELSE 'unknown' END AS market FROM c""",
    "subtitle_texts": """WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^(WEBVTT|NOTE|STYLE|REGION)|^[0-9]+$|-->')) AS s FROM conversations),
        o AS (SELECT conv_id, turn, list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]) AS s FROM l) SELECT conv_id, turn, sha256(array_to_string(list_append(s, 'end'), chr(10))) AS sha FROM o""",
    "redirect_cycles": "WITH RECURSIVE r AS (SELECT n_nationkey AS node, n_regionkey AS place, 1 AS hop FROM nation UNION SELECT r.node, n_regionkey, hop + 1 FROM r JOIN nation ON place = n_nationkey WHERE node <> place AND hop < 100) SELECT DISTINCT node FROM r WHERE node = place",
    "trailing_spend": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders)
        SELECT o_orderkey, floor(CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 364 PRECEDING AND CURRENT ROW) AS DOUBLE) / 100.0 * 100.0 + 0.5) / 100.0 AS trailing FROM o""",
    "typo_pairs": "SELECT a.p_partkey, a.p_brand, b.p_brand AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE length(a.p_brand) = length(b.p_brand) AND hamming(a.p_brand, b.p_brand) = 1",
}
