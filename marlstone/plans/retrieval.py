"""Retrieval queries: documents as chunks, embeddings as their vectors, order lines as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.operators import retrieval as R
from marlstone.plans import sql as S
from marlstone.sources.tables import exists, table

QUERY = ["thing", "eden", "tion", "ist"]
VARIANT = ["heit", "eden", "ion"]
K = 20


#: Indexes that this process has written, by application and folder of tables.
_INDEXES: dict[tuple[str, str], R.Index] = {}


def lexical(spark: SparkSession, sf_dir: str) -> R.Index:
    """The index of the documents: written once for a folder of tables, and again only if it has been cleared away."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES or not exists(spark, _INDEXES[at].path):
        _INDEXES[at] = R.index(table(spark, sf_dir, "documents"))
    return _INDEXES[at]


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(R.bm25(lexical(spark, sf_dir), QUERY), K).select("doc_id", "score", F.array_join("terms", ",").alias("terms"))


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(lexical(spark, sf_dir), QUERY, table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"))).select("doc_id", "score")


def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_index(table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.size(words)).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to each whose number is divisible by 20, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return R.nearest(vectors, vectors.filter("vec_id % 20 = 0"), K).select("query", "vec_id", F.col("similarity").alias("score"), "place")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K best documents by words and vector for each vector whose number is divisible by 20, asked with the same question in words."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return R.hybrid_nearest(R.bm25(lexical(spark, sf_dir), QUERY), vectors, vectors.filter("doc_id % 20 = 0"), K)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).withColumn("place", F.col("place").cast("long"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical(spark, sf_dir)
    return R.top(R.fuse([R.top(R.bm25(found, QUERY), 200), R.top(R.bm25(found, VARIANT), 200)]), 50)


def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.coverage(R.bm25(lexical(spark, sf_dir), QUERY), QUERY)
    return found.groupBy("reason", "allowed").agg(F.count("*").alias("n"))


def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    citations, characters = R.evidence_budget(docs.count())
    best = R.top(R.bm25(lexical(spark, sf_dir), QUERY), citations).join(docs.select("doc_id", "text"), "doc_id")
    return R.within_budget(best, characters, order=(F.desc("score"), "doc_id")).select("doc_id", "score", F.length("text").cast("long").alias("n_chars"), F.col("so_far").cast("long").alias("so_far"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).filter("a <> b")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).distinct()


def graph_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(1, 6).withColumnRenamed("id", "node")
    return R.graph_boosts(seeds, _links(spark, sf_dir))


def rerank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.top(R.bm25(lexical(spark, sf_dir), QUERY), 40).withColumnRenamed("score", "total").drop("terms")
    scores = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 3.0 - F.col("toxic")).alias("score"))
    return R.rerank(hits, scores, 20).select("doc_id", "total", "reranked", "position")


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    back = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("backlinks"))
    return out.join(back, "node", "full").select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("backlinks", F.lit(0)).alias("backlinks"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_all, lexical_index, token_counts, vector_search, hybrid_search, rrf_fusion, query_coverage, evidence_pack, graph_boosts, rerank_search, link_counts)}


def _bm25(name: str, query: list[str], title: bool = False) -> str:
    """CTEs that end in `name` (doc_id, score, terms)."""
    terms = list(dict.fromkeys(query))
    tf = lambda t: f"CAST(len(list_filter(words, lambda w: w = '{t}')) AS DOUBLE)"
    length = "greatest(1, len(words))"
    dfs = ", ".join(f"count(*) FILTER (WHERE list_contains(words, '{t}')) AS df{k}" for k, t in enumerate(terms))
    parts = []
    for k, t in enumerate(terms):
        idf = f"ln(1 + (greatest(1, n) - df{k} + 0.5) / (df{k} + 0.5))"
        boost = f" + CASE WHEN contains(title, '{t}') THEN 0.25 ELSE 0.0 END" if title else ""
        parts.append(f"CASE WHEN {tf(t)} > 0 THEN {idf} * (({tf(t)} * 2.2) / ({tf(t)} + 1.2 * (0.25 + 0.75 * ({length} / average)))){boost} ELSE 0.0 END")
    hits = ", ".join(f"CASE WHEN {tf(t)} > 0 THEN '{t}' END" for t in terms)
    some = " OR ".join(f"list_contains(words, '{t}')" for t in terms)
    return f"""
    {name}_parsed AS (SELECT doc_id, lower(source) AS title, {S.tokens("text")} AS words FROM documents),
    {name}_stats AS (SELECT count(*) AS n, greatest(1.0, sum({length}) / count(*)) AS average, {dfs} FROM {name}_parsed),
    {name} AS (SELECT doc_id, {S.q(" + ".join(parts), 6)} AS score, list_filter([{hits}], lambda t: t IS NOT NULL) AS terms FROM {name}_parsed, {name}_stats WHERE {some})"""


#: CTEs that end in hits (query, doc_id, lexical, ...), ranked.
_HITS = f"""{_bm25("s", QUERY)}, best AS (SELECT max(score) AS m FROM s),
    asked AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
    docs AS (SELECT coalesce(doc_id, vec_id) AS doc_id, coalesce(score / m, 0.0) AS lex, CAST(embedding AS DOUBLE[]) AS x FROM (SELECT * FROM s, best) l FULL JOIN embeddings ON doc_id = vec_id),
    alike AS (SELECT query, doc_id, lex, CASE WHEN x IS NULL THEN 0.0 WHEN list_cosine_similarity(v, x) >= 0.15 THEN list_cosine_similarity(v, x) ELSE 0.0 END AS emb FROM asked, docs),
    t AS (SELECT query, doc_id, lex, {S.q("lex", 6)} AS lexical, {S.q("emb", 6)} AS embedding, 0.0 AS graph, 0.0 AS taxonomy, CASE WHEN lex > 0 THEN 0.05 ELSE 0.0 END AS metadata,
          {S.q("lex + CASE WHEN lex > 0 THEN emb * 0.35 ELSE least(emb * 0.35, 0.2) END + 0.0 + 0.0 + CASE WHEN lex > 0 THEN 0.05 ELSE 0.0 END", 6)} AS total FROM alike),
    hits AS (SELECT query, doc_id, lexical, embedding, graph, taxonomy, metadata, total, row_number() OVER (PARTITION BY query ORDER BY total DESC, lex DESC, doc_id) AS place FROM t WHERE total > 0 QUALIFY place <= {K})"""
_EDGES = "edges AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey)"

ORACLE = {
    "bm25_search": f"WITH {_bm25('s', QUERY)} SELECT doc_id, score, array_to_string(terms, ',') AS terms FROM s ORDER BY score DESC, doc_id LIMIT {K}",
    "bm25_all": f"WITH {_bm25('s', QUERY, True)} SELECT doc_id, score FROM s",
    "lexical_index": f"WITH w AS (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY term",
    "token_counts": f"SELECT doc_id, greatest(1, len(w)) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {S.tokens('text')} AS w FROM documents)",
    "vector_search": f"""WITH c AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0),
        s AS (SELECT query, vec_id, {S.q("CASE WHEN c >= 0.15 THEN c ELSE 0.0 END", 6)} AS score FROM c) SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s QUALIFY place <= {K}""",
    "hybrid_search": f"WITH {_HITS} SELECT * FROM hits",
    "rrf_fusion": f"""WITH {_bm25("a", QUERY)}, {_bm25("b", VARIANT)},
        ra AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id) - 1) AS part FROM (SELECT * FROM a ORDER BY score DESC, doc_id LIMIT 200)),
        rb AS (SELECT doc_id, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, doc_id) - 1) AS part FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 200))
        SELECT doc_id, {S.q("CAST(sum(CAST(part AS DECIMAL(20,15))) AS DOUBLE)", 9)} AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""",
    "query_coverage": f"WITH {_bm25('s', QUERY)}, r AS (SELECT CASE WHEN len(terms) >= 2 THEN 'lexical-coverage' ELSE 'insufficient-lexical-coverage' END AS reason FROM s) SELECT reason, reason = 'lexical-coverage' AS allowed, count(*) AS n FROM r GROUP BY 1, 2",
    "evidence_pack": f"""WITH {_bm25("s", QUERY)}, size AS (SELECT count(*) AS n FROM documents),
        ranked AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s),
        cut AS (SELECT doc_id, score, r, length(substr(text, 1, 360)) AS n_chars FROM ranked JOIN documents USING (doc_id), size WHERE r <= CASE WHEN n < 100 THEN 4 WHEN n <= 500 THEN 6 WHEN n <= 2000 THEN 8 WHEN n <= 5000 THEN 10 ELSE 12 END),
        sums AS (SELECT doc_id, score, n_chars, sum(n_chars) OVER (ORDER BY r) AS so_far FROM cut)
        SELECT doc_id, score, n_chars, so_far FROM sums, size WHERE so_far <= CASE WHEN n < 100 THEN 6000 WHEN n <= 500 THEN 12000 WHEN n <= 2000 THEN 20000 WHEN n <= 5000 THEN 30000 ELSE 40000 END""",
    "graph_boosts": f"""WITH {_EDGES}, seeds AS (SELECT unnest(range(1, 6)) AS node),
        both_ways AS (SELECT a AS x, b AS y, true AS out FROM edges UNION SELECT b, a, false FROM edges),
        first AS (SELECT node AS seed, y AS node, CASE WHEN out THEN 12.0 ELSE 8.0 END AS near FROM seeds JOIN both_ways ON node = x WHERE y NOT IN (SELECT node FROM seeds)),
        second AS (SELECT f.seed, y AS node, CASE WHEN out THEN 4.0 ELSE 2.5 END AS near FROM (SELECT DISTINCT seed, node FROM first) f JOIN both_ways ON f.node = x
                   WHERE y NOT IN (SELECT node FROM seeds) AND NOT EXISTS (SELECT 1 FROM first g WHERE g.seed = f.seed AND g.node = y))
        SELECT node, least(0.22, CAST(sum(near) AS DOUBLE) / 100) AS boost FROM (SELECT node, near FROM first UNION ALL SELECT node, near FROM second) GROUP BY node""",
    "rerank_search": f"""WITH {_bm25("s", QUERY)}, page AS (SELECT doc_id, score AS total, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s ORDER BY score DESC, doc_id LIMIT 40),
        j AS (SELECT page.*, quality * 3.0 - toxic AS r FROM page LEFT JOIN labels USING (doc_id)),
        n AS (SELECT doc_id, total, place, CASE WHEN place <= 20 THEN {S.q("total + 0.5 * coalesce(CASE WHEN r BETWEEN 0 AND 1 THEN r ELSE 1 / (1 + exp(-r)) END, 0.0)", 6)} END AS reranked FROM j)
        SELECT doc_id, total, reranked, row_number() OVER (ORDER BY place > 20, reranked DESC NULLS LAST, total DESC, doc_id) AS position FROM n""",
    "link_counts": f"WITH {_EDGES}, o AS (SELECT a AS node, count(*) AS links FROM edges GROUP BY a), i AS (SELECT b AS node, count(*) AS backlinks FROM edges GROUP BY b) SELECT coalesce(o.node, i.node) AS node, coalesce(links, 0) AS links, coalesce(backlinks, 0) AS backlinks FROM o FULL JOIN i ON o.node = i.node",
}
