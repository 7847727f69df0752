"""Queries on walks over graphs, links and lines of pages, and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import bars as B
from marlstone.operators import walks as W
from marlstone.plans import market
from marlstone.plans import sql as S
from marlstone.sources.tables import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that share order lines, by how many."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(name("p", "l_partkey").alias("a"), name("s", "l_suppkey").alias("b")).agg(F.count("*").alias("weight"))


def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), (F.col("p_size") - 45).alias("score"))
    return W.walk(seeds, _edges(spark, sf_dir))


def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size as cited nodes."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_size").alias("weight"))
    found = W.context(parts.filter("weight = 7").select("node"), parts, _edges(spark, sf_dir))
    return found.select("node", "score", F.array_join("neighbours", ",").alias("neighbours"))


def index_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("[["), F.col("p_brand"), F.lit("]] [[ "), F.col("p_name"), F.lit("|x]] [["), F.col("p_brand"), F.lit("|again]] [[]]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(W.wiki_links(said), ";").alias("targets"))


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the windows of documents."""
    cut = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(X.windows(F.col("text"), 512, 64)).alias("w"))
    found = cut.select("doc_id", "w.number", W.line_range(F.col("text"), F.col("w.start"), F.col("w.start") + F.length("w.text")).alias("r"))
    return found.select("doc_id", "number", F.col("r.first").cast("long").alias("first_line"), F.col("r.last").cast("long").alias("last_line"))


def merged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("alias"), F.date_format("ts", "EEEE").alias("source"), (F.col("value") / 100).alias("confidence"), F.col("ts").alias("at"))
    found = W.merged_proposals(rows, "user_id")
    return found.select("user_id", "confidence", F.array_join("aliases", ",").alias("aliases"), F.array_join("sources", ",").alias("sources"), "updated")


def last_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each pattern was last seen, by code."""
    return B.patterns(B.daily(table(spark, sf_dir, "events"))).groupBy("code", "pattern").agg(F.max("day").alias("day"))


QUERIES = {f.__name__: f for f in (graph_walk, graph_context, index_links, line_ranges, merged_proposals, last_patterns)}

_EDGES = """g AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, count(*) AS w FROM lineitem GROUP BY ALL), e AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g), top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS rk FROM e)"""
_NUMBERED = "SELECT doc_id, k AS number, k * 448 AS start, length(substr(text, k * 448 + 1, 512)) AS n, text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 64) / 448.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0)"
_BREAKS = "(length(left(text, {0})) - length(replace(left(text, {0}), chr(10), '')))"

ORACLE = {
    "graph_walk": f"""WITH {_EDGES}, s AS (SELECT 'p' || p_partkey AS node, row_number() OVER (ORDER BY p_size DESC, 'p' || p_partkey) AS place FROM part WHERE p_size > 45 QUALIFY place <= 6),
        m1 AS (SELECT b AS node, place, rk, a AS via, w FROM s JOIN top ON a = s.node AND rk <= 18 WHERE b NOT IN (SELECT node FROM s) QUALIFY row_number() OVER (PARTITION BY b ORDER BY place, rk) = 1), f1 AS (SELECT *, row_number() OVER (ORDER BY place, rk) AS p FROM m1),
        m2 AS (SELECT b AS node, p, t.rk, a AS via, t.w FROM f1 JOIN top t ON a = f1.node AND t.rk <= 18 WHERE p <= 18 AND b NOT IN (SELECT node FROM s) AND b NOT IN (SELECT node FROM f1) QUALIFY row_number() OVER (PARTITION BY b ORDER BY p, t.rk) = 1)
        SELECT node, 1 AS hop, via, {S.q("w * 0.07::DOUBLE", 6)} AS boost FROM f1 UNION ALL SELECT node, 2, via, {S.q("w * 0.02::DOUBLE", 6)} FROM m2""",
    "graph_context": f"""WITH {_EDGES}, n AS (SELECT a, sum(w) AS w, string_agg(b, ',' ORDER BY rk) AS names FROM top WHERE rk <= 6 GROUP BY a), c AS (SELECT 'p' || p_partkey AS node, p_size FROM part WHERE p_size = 7)
        SELECT node, CAST(p_size + coalesce(w, 0) AS DOUBLE) AS score, coalesce(names, '') AS neighbours FROM c LEFT JOIN n ON a = node ORDER BY score DESC, node LIMIT 8""",
    "index_links": "SELECT p_partkey, p_brand || CASE WHEN trim(p_name) <> p_brand THEN ';' || trim(p_name) ELSE '' END AS targets FROM part",
    "line_ranges": f"SELECT doc_id, number, {_BREAKS.format('start')} + 1 AS first_line, {_BREAKS.format('greatest(start, start + n - 1)')} + 1 AS last_line FROM ({_NUMBERED})",
    "merged_proposals": f"SELECT user_id, {S.q('max(value / 100)', 2)} AS confidence, array_to_string(list_sort(list_distinct(array_agg(event_type))), ',') AS aliases, array_to_string(list_sort(list_distinct(array_agg(dayname(ts)))), ',') AS sources, max(ts) AS updated FROM events GROUP BY user_id",
    "last_patterns": f"SELECT code, pattern, max(day) AS day FROM ({market.ORACLE['candle_patterns']}) GROUP BY 1, 2",
}
