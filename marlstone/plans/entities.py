"""Queries on the graph of concepts: documents as chunks of the pages that their sources are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import entities as E
from marlstone.operators import retrieval as R
from marlstone.operators import walks as W
from marlstone.plans import retrieval
from marlstone.plans import sql as S
from marlstone.sources.tables import exists, table

#: Graphs that this process has built, by application and folder of tables, with a folder by which to tell whether they are still there.
_GRAPHS: dict[tuple[str, str], E.Graph] = {}


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; pages of concepts, and some slugs that stand in two sections."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL AND source IS NOT NULL")
    section = F.when(F.col("source").endswith("0"), "concepts").when(F.col("source").endswith("3") & (F.col("doc_id") % 2 == 0), "queries").otherwise("sources")
    link = F.concat(F.lit("sources/src"), F.pmod(F.col("doc_id") * 7, F.lit(60)).cast("string"), F.lit("#part"))
    return docs.select(F.col("doc_id").alias("chunk"), F.col("source").alias("page"), F.concat(F.lit("Source "), "source").alias("title"), section.alias("section"), F.col("source").alias("slug"), F.array(F.concat("source", F.lit(" Notes"))).alias("headings"), F.array(link).alias("links"), "text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first labelled document of each source says of it."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", F.col("source").alias("page"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("page").agg(F.min_by(F.struct("quality", "toxic"), "doc_id").alias("x")).select("page", "x.quality", "x.toxic")


def _graph(spark: SparkSession, sf_dir: str) -> E.Graph:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at in _GRAPHS and all(exists(spark, f) for frame in (_GRAPHS[at].nodes, _GRAPHS[at].mentions) for f in frame.inputFiles()[:1]):
        return _GRAPHS[at]
    chunks, records = _chunks(spark, sf_dir), _records(spark, sf_dir)
    sources = chunks.select("page").distinct()
    links = chunks.select(F.col("page").alias("from"), F.regexp_extract(F.get("links", F.lit(0)), "^sources/([^#]*)", 1).alias("to")).distinct().join(sources.select(F.col("page").alias("to")), "to", "left_semi")
    number = F.regexp_extract("page", "[0-9]+$", 0).try_cast("int")
    topics = sources.filter(number % 2 == 0).select(F.col("page").alias("from"), F.concat(F.lit("src"), (number + 1).cast("string")).alias("to"))
    named = lambda kind: F.concat(F.lit(f"{kind} Level "), F.col(kind.lower()).cast("string"))
    entities = records.select("page", F.explode(F.array(named("Quality"), named("Toxic"))).alias("name"))
    relations = records.select("page", named("Quality").alias("source"), named("Toxic").alias("target"))
    _GRAPHS[at] = E.build(chunks, links, topics, entities, relations)
    return _GRAPHS[at]


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes.withColumn("aliases", F.array_join("aliases", "|"))


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).mentions


def _walked(spark: SparkSession, sf_dir: str) -> tuple[E.Graph, DataFrame, DataFrame]:
    graph = _graph(spark, sf_dir)
    lexical = R.bm25(retrieval.lexical(spark, sf_dir), retrieval.QUERY).select(F.col("doc_id").alias("chunk"), "score")
    return graph, lexical, W.walk(E.seeds(graph, retrieval.QUERY, lexical), graph.edges.select("a", "b", "weight"))


def entity_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir)[2]


def entity_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a question doesn't hit, but reaches over the graph."""
    graph, lexical, walked = _walked(spark, sf_dir)
    return E.chunk_boosts(graph, walked, lexical)


def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that the best hit of a question names, with their neighbours."""
    graph, lexical, _ = _walked(spark, sf_dir)
    best = lexical.orderBy(F.desc("score"), "chunk").limit(1).select("chunk")
    cited = graph.mentions.join(F.broadcast(best), "chunk").select(F.col("id").alias("node"))
    found = W.context(cited, graph.nodes.select(F.col("id").alias("node"), "weight"), graph.edges.select("a", "b", "weight"))
    return found.select("node", "score", F.array_join("neighbours", ",").alias("neighbours"))


def supplemental_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _records(spark, sf_dir).select("page", F.inline(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("key"), F.col(name).cast("string").alias("value")) for k, name in enumerate(("quality", "toxic"))))))
    return E.supplements(values, _chunks(spark, sf_dir))


QUERIES = {f.__name__: f for f in (entity_nodes, entity_edges, entity_mentions, entity_walk, entity_boosts, entity_context, supplemental_texts)}

_STOP = ", ".join(f"'{w}'" for w in E.STOP)


def _name(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '^concepts/', ''), '^sources/', '')"
    return f"regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace({bare}, '[#_]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'))), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


_LABELS = lambda labels, kind, weight, base: f"SELECT chunk, page, {base} + generate_subscripts({labels}, 1) AS seq, unnest({labels}) AS label, '{kind}' AS kind, {weight} AS weight FROM kept"
_BARE = "regexp_replace(coalesce(text, ''), '`[^`]+`', ' ', 'g')"
_RECORDS = "records AS (SELECT source AS page, arg_min(quality, doc_id) AS quality, arg_min(toxic, doc_id) AS toxic FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source)"
_CHUNKS = """chunks AS (SELECT doc_id AS chunk, source AS page, 'Source ' || source AS title, CASE WHEN source LIKE '%0' THEN 'concepts' WHEN source LIKE '%3' AND doc_id % 2 = 0 THEN 'queries' ELSE 'sources' END AS section, source AS slug,
    [source || ' Notes'] AS headings, ['sources/src' || (doc_id * 7) % 60 || '#part'] AS links, text FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL)"""
_GRAPH = f"""{_CHUNKS}, {_RECORDS},
    kept AS MATERIALIZED (SELECT *, {_BARE} AS said FROM chunks WHERE slug NOT IN (SELECT slug FROM chunks GROUP BY slug HAVING count(DISTINCT section) > 1)),
    told AS (SELECT chunk, page, 0 AS seq, title AS label, CASE WHEN section = 'concepts' THEN 'concept' ELSE 'topic' END AS kind, 2.5 AS weight FROM kept UNION ALL {_LABELS("headings", "concept", 1.5, 10)} UNION ALL {_LABELS("list_transform(links, lambda x: split_part(x, '#', 1))", "concept", 1.25, 20)}
      UNION ALL {_LABELS("regexp_extract_all(said, '" + chr(92) + "b[A-Z][A-Za-z0-9]*(?:[- ][A-Z][A-Za-z0-9]*){0,4}" + chr(92) + "b')", "entity", 1.0, 1000)}
      UNION ALL {_LABELS(f"list_filter({S.tokens("title || ' ' || headings[-1] || ' ' || said")}, lambda t: length(t) >= 4 AND t NOT IN ({_STOP}))", "concept", 0.25, 100000000)}),
    named AS (SELECT chunk, page, seq, trim(label) AS label, kind, weight, {_name("label")} AS name FROM told),
    counted AS (SELECT chunk, page, CASE WHEN kind = 'topic' THEN 'topic:' ELSE 'concept:' END || name AS id, name, sum(weight)::DOUBLE AS weight, arg_min(label, seq) AS label, arg_min(kind, seq) AS kind FROM named WHERE length(name) >= 3 AND name NOT IN ({_STOP}) GROUP BY 1, 2, 3, 4),
    found AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY weight DESC, name, id) AS rank FROM counted QUALIFY rank <= 8),
    firsts AS (SELECT page, min(chunk) AS first, count(DISTINCT chunk) AS n FROM chunks GROUP BY page),
    extracted AS (SELECT first AS chunk, page, 'entity:' || name AS id, name, 2.0::DOUBLE AS weight, label, 'entity' AS kind, 9 AS rank FROM (SELECT page, label, {_name("label")} AS name FROM (SELECT page, unnest(['Quality Level ' || quality, 'Toxic Level ' || toxic]) AS label FROM records)) JOIN firsts USING (page)),
    every AS MATERIALIZED (SELECT chunk, page, id, name, weight, label, kind, rank FROM found UNION ALL SELECT chunk, page, id, name, weight, label, kind, rank FROM extracted),
    mentions AS MATERIALIZED (SELECT DISTINCT chunk, page, id FROM every),
    firstly AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk, rank, label) = 1),
    nodes AS MATERIALIZED (SELECT f.id, f.kind, f.label, f.name, {S.q("w", 3)} AS weight, chunks, pages, coalesce(aliases, []) AS aliases, f.chunk AS at_chunk, f.rank AS at_rank FROM firstly f JOIN (SELECT id, sum(weight) AS w FROM every GROUP BY id) USING (id)
      JOIN (SELECT id, count(DISTINCT chunk) AS chunks, count(DISTINCT page) AS pages FROM mentions GROUP BY id) USING (id) LEFT JOIN (SELECT e.id, list(DISTINCT e.label ORDER BY e.label) AS aliases FROM every e JOIN firstly f ON e.id = f.id AND e.label <> f.label GROUP BY e.id) USING (id)),
    heads AS (SELECT page, id FROM (SELECT DISTINCT page, id FROM found) JOIN nodes USING (id) QUALIFY row_number() OVER (PARTITION BY page ORDER BY at_chunk, at_rank) <= 5),
    links AS (SELECT DISTINCT page AS f, regexp_extract(links[1], '^sources/([^#]*)', 1) AS t FROM chunks WHERE regexp_extract(links[1], '^sources/([^#]*)', 1) IN (SELECT page FROM chunks)),
    crossed AS (SELECT f, t, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM links JOIN heads x ON x.page = f JOIN heads y ON y.page = t WHERE x.id <> y.id),
    near AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS times FROM (SELECT 'concept:' || {_name("page")} AS a, 'concept:' || {_name("'src' || (CAST(regexp_extract(page, '[0-9]+$') AS INTEGER) + 1)")} AS b FROM (SELECT DISTINCT page FROM chunks WHERE TRY_CAST(regexp_extract(page, '[0-9]+$') AS INTEGER) % 2 = 0))
      WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes) GROUP BY 1, 2),
    related AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS times, count(DISTINCT first) AS chunks, count(DISTINCT page) AS pages FROM (SELECT page, 'entity:' || {_name("'Quality Level ' || quality")} AS a, 'entity:' || {_name("'Toxic Level ' || toxic")} AS b FROM records) JOIN firsts USING (page) GROUP BY 1, 2),
    edges AS MATERIALIZED (
      SELECT x.id AS a, y.id AS b, 'cooccurs' AS kind, count(*)::DOUBLE AS weight, count(*) AS chunks, count(DISTINCT x.page) AS pages, false AS routing_only FROM found x JOIN found y ON x.chunk = y.chunk AND x.id < y.id GROUP BY 1, 2
      UNION ALL SELECT a, b, 'page-link', {S.q("times * 0.75::DOUBLE", 3)}, chunks, pages, true FROM (SELECT a, b, count(*) AS times FROM crossed GROUP BY a, b) JOIN (SELECT a, b, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS pages FROM (SELECT DISTINCT a, b, unnest([f, t]) AS page FROM crossed) JOIN firsts USING (page) GROUP BY a, b) USING (a, b)
      UNION ALL SELECT a, b, 'topic-related', {S.q("times * 0.6::DOUBLE", 3)}, chunks, pages, true FROM near JOIN (SELECT a, b, count(DISTINCT chunk) AS chunks, count(DISTINCT page) AS pages FROM near JOIN mentions ON id IN (a, b) GROUP BY a, b) USING (a, b)
      UNION ALL SELECT a, b, 'llm-relation', {S.q("times * 1.25::DOUBLE", 3)}, chunks, pages, false FROM related)"""
_ASKED = "[" + ", ".join(f"'{t}'" for t in dict.fromkeys(retrieval.QUERY)) + "]"
_WALK = f"""{_GRAPH}, {retrieval._bm25("s", retrieval.QUERY)},
    support AS (SELECT id, CAST(sum(CAST(least(score, 1.0) AS DECIMAL(18, 6))) AS DOUBLE) AS support FROM (SELECT DISTINCT chunk, id FROM mentions) JOIN s ON chunk = doc_id GROUP BY id),
    matched AS (SELECT id, len(list_intersect(list_distinct({S.tokens("label || ' ' || name || ' ' || array_to_string(aliases, ' ')")}), {_ASKED})) AS m, coalesce(support, 0.0) AS support FROM nodes LEFT JOIN support USING (id)),
    seeds AS (SELECT id AS node, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT id, {S.q("CASE WHEN m >= 2 OR support > 0 THEN m * 2.0 ELSE 0.0 END + support", 6)} AS score FROM matched) WHERE score > 0 QUALIFY place <= 6),
    e AS (SELECT a, b, weight AS w FROM edges UNION ALL SELECT b, a, weight FROM edges), top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS rk FROM e),
    one AS (SELECT b AS node, min(struct_pack(place := place, rk := rk, via := a, w := w)) AS x FROM seeds JOIN top ON node = a AND rk <= 18 WHERE b NOT IN (SELECT node FROM seeds) GROUP BY b),
    front AS (SELECT node, row_number() OVER (ORDER BY x.place, x.rk) AS place FROM one QUALIFY place <= 18),
    two AS (SELECT b AS node, min(struct_pack(place := place, rk := rk, via := a, w := w)) AS x FROM front JOIN top ON node = a AND rk <= 18 WHERE b NOT IN (SELECT node FROM seeds) AND b NOT IN (SELECT node FROM one) GROUP BY b),
    walked AS (SELECT node, 1 AS hop, x.via AS via, {S.q("x.w * 0.07::DOUBLE", 6)} AS boost FROM one UNION ALL SELECT node, 2, x.via, {S.q("x.w * 0.02::DOUBLE", 6)} FROM two)"""

ORACLE = {
    "entity_nodes": f"WITH {_GRAPH} SELECT id, kind, label, name, weight, chunks, pages, array_to_string(aliases, '|') AS aliases FROM nodes",
    "entity_edges": f"WITH {_GRAPH} SELECT * FROM edges",
    "entity_mentions": f"WITH {_GRAPH} SELECT * FROM mentions",
    "entity_walk": f"WITH {_WALK} SELECT * FROM walked",
    "entity_boosts": f"WITH {_WALK} SELECT chunk, least(0.14, CAST(sum(CAST(boost AS DECIMAL(18, 6))) AS DOUBLE)) AS boost FROM (SELECT DISTINCT chunk, id FROM mentions) JOIN walked ON id = node WHERE chunk NOT IN (SELECT doc_id FROM s WHERE score > 0) GROUP BY chunk HAVING sum(boost) > 0",
    "entity_context": f"""WITH {_WALK}, best AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 1), cited AS (SELECT DISTINCT id FROM mentions JOIN best ON chunk = doc_id),
        n AS (SELECT a, sum(w) AS more, string_agg(b, ',' ORDER BY rk) AS neighbours FROM top JOIN cited ON a = id WHERE rk <= 6 GROUP BY a)
        SELECT id AS node, {S.q("weight + coalesce(more, 0)", 3)} AS score, coalesce(neighbours, '') AS neighbours FROM nodes JOIN cited USING (id) LEFT JOIN n ON a = id ORDER BY score DESC, node LIMIT 8""",
    "supplemental_texts": f"WITH {_CHUNKS}, {_RECORDS} SELECT min(chunk) AS chunk, 'quality: ' || min(quality) || chr(10) || 'toxic: ' || min(toxic) AS text FROM chunks JOIN records USING (page) GROUP BY page",
}
