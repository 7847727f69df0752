"""Queries that write tables and files to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.numeric import quantise
from marlstone.operators import relational as R
from marlstone.plans import content
from marlstone.plans import sql as S
from marlstone.sources import files, stored
from marlstone.sources.stored import Store, absent, replaced, whole
from marlstone.sources.tables import shared_dir, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession) -> Store:
    return Store(spark, _folder(spark, "store"))


# --- stored tables -----------------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(which).groupBy(F.col("l_partkey").alias("code"), F.year("l_shipdate").alias("year"))
    return rows.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by code and year: a batch, one that replaces what is there, retried, and one that keeps it."""
    store = _store(spark)
    store.commit({"results": whole(_results(spark, sf_dir, "l_linestatus = 'F'"), "code", "year")}, "first")
    for _ in range(2):
        store.commit({"results": replaced(_results(spark, sf_dir, "l_linestatus = 'O' AND l_partkey % 3 = 0"), "code", "year")}, "again")
    store.commit({"results": absent(_results(spark, sf_dir, "l_returnflag = 'A' OR l_partkey % 2 = 0"), "code", "year")}, "more")
    return store.read("results")


def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, lots and snapshots of accounts and years, replaced together for some accounts."""
    lots = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(50)).alias("account"), F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("lot"), F.col("l_quantity").alias("qty"), "l_linestatus")

    def state(some: DataFrame) -> dict[str, DataFrame]:
        positions = some.groupBy("account", "year", "symbol").agg(F.sum("qty").alias("qty"))
        return {"positions": positions, "lots": some.select("account", "year", "lot", "qty"), "snapshots": positions.groupBy("account", "year").agg(F.sum("qty").alias("total"), F.count("*").alias("symbols"))}

    store, keys = _store(spark), ("account", "year")
    store.commit({name: whole(rows, *keys) for name, rows in state(lots.filter("l_linestatus = 'F'")).items()}, "first")
    later = lots.filter("l_linestatus = 'O' AND account % 5 = 0")
    scope = later.select(*keys).distinct()
    store.commit({name: replaced(rows, *keys, scope=scope) for name, rows in state(later).items()}, "second")
    held = store.read("lots").groupBy(*keys).agg(F.count("*").alias("lots"), F.sum("qty").alias("lot_qty"))
    return store.read("snapshots").join(held, [*keys]).join(store.read("positions").groupBy(*keys).agg(F.count("*").alias("positions")), [*keys])


def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of pages, what is to be decided and what was done, written anew together."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.fingerprint(F.col("html")).alias("hash"))
    first = pages.groupBy("hash").agg(F.min("page_id").alias("page_id"))
    pending = pages.join(first.withColumnRenamed("page_id", "of"), "hash").filter("page_id <> of")
    store = _store(spark)
    store.commit({"index": whole(pages, "hash"), "pending": whole(pages.limit(0), "page_id"), "log": whole(pages.select(F.lit("seen").alias("action"), "page_id"))}, "first")
    store.commit({"index": whole(first, "hash"), "pending": whole(pending, "page_id"), "log": whole(pages.select(F.lit("kept").alias("action"), "page_id"))}, "second")
    of = lambda name, said: store.read(name).select(F.lit(name).alias("name"), "page_id", said.alias("said"))
    return of("index", F.col("hash")).union(of("pending", F.col("of").cast("string"))).union(of("log", F.col("action")))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of vectors by key, of which some are made anew."""
    key = F.sha2(F.concat(F.lit("model:"), F.col("vec_id").cast("string")), 256)
    vectors = table(spark, sf_dir, "embeddings").select(key.alias("key"), "vec_id", "embedding")
    store = _store(spark)
    store.commit({"vectors": whole(vectors, "key")}, "first")
    store.commit({"vectors": replaced(vectors.filter("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "key")}, "second")
    return store.read("vectors").select("key", F.size("embedding").cast("long").alias("dims"), quantise(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events appended to a log; an epoch that comes again is in it once."""
    store = _store(spark)
    sink = stored.appends(store, "log", "events")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", "user_id", "event_type")

    def twice(rows: DataFrame, epoch: int) -> None:
        sink(rows, epoch)
        sink(rows, epoch)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", _folder(spark, "log")).trigger(availableNow=True).start().awaitTermination()
    return store.read("log")


# --- files -------------------------------------------------------------------------------------


def broker_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a broker's file, with its names, forms of days and thousands, and rows that are no trades."""
    k = F.col("l_linenumber")
    day = F.when(k % 3 == 0, F.date_format("l_shipdate", "yyyyMMdd")).when(k % 3 == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(F.date_format("l_shipdate", "yyyy/MM/dd"))
    side = F.when(k == 1, "B").when(k == 2, "卖出").when(k == 3, " buy ").when(k == 4, "SELL").when(k == 5, "买入").when(k == 6, "dividend")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 9 > 0, F.col("l_partkey").cast("string")).alias("证券代码"), day.alias("成交日期"), side.alias("Side"), F.col("l_quantity").cast("int").cast("string").alias("QTY"),
        F.format_number("l_extendedprice", 2).alias("成交价格"), F.col("l_tax").cast("decimal(12,2)").cast("string").alias("commission"), F.lit("0.5").alias("印花税"), F.col("l_orderkey").cast("string").alias("note"),
    )
    path = _folder(spark, "trades")
    rows.write.csv(path, header=True)
    found = files.trades_from_csv(spark, path)
    return found.groupBy("symbol", "trade_date", "side").agg(F.count("*").alias("n"), quantise(F.sum("quantity"), 2).alias("quantity"), quantise(F.sum(F.col("price").cast("decimal(18,2)")).cast("double"), 2).alias("price"), quantise(F.sum(F.col("fee").cast("decimal(18,2)")).cast("double"), 2).alias("fee"), quantise(F.sum("tax"), 2).alias("tax"))


def _notes(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a markdown file for each source: front matter, a heading, and its documents, each under its own. A page is one file, and so one task's."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND doc_id IS NOT NULL")
    line = lambda n, said: F.struct(F.lit(n).alias("n"), said.alias("value"))
    heads = docs.select("source").distinct().select("source", F.lit(-1).cast("long").alias("doc_id"), F.inline(F.array(*(line(n, s) for n, s in enumerate((F.lit("---"), F.concat(F.lit('title: "On '), "source", F.lit('"')), F.concat(F.lit("type: "), F.when(F.col("source").endswith("1"), "Concept").otherwise("Note")), F.lit("---"), F.concat(F.lit("# Source "), "source")))))))
    bodies = docs.select("source", "doc_id", F.inline(F.array(line(5, F.concat(F.lit("## Document "), F.col("doc_id").cast("string"), F.lit(" ##"))), line(6, F.translate(F.coalesce("text", F.lit("")), "`\r", "''")))))
    path = _folder(spark, "notes")
    heads.unionByName(bodies).repartition("source").sortWithinPartitions("source", "doc_id", "n").select("source", "value").write.partitionBy("source").text(path)
    return path


def _source() -> Column:
    return F.regexp_extract("path", "source=([^/]*)/", 1)


def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.markdown(spark, f"{_notes(spark, sf_dir)}/*")
    return found.select(_source().alias("source"), "title", F.try_element_at("meta", F.lit("type")).alias("kind"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


def heading_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.text(f"{_notes(spark, sf_dir)}/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = raw.select(_source().alias("source"), F.explode(files.headings(F.col("value"))).alias("h"))
    return found.select("source", F.col("h.line").cast("long").alias("line"), F.col("h.level").cast("long").alias("level"), "h.title")


def file_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.manifest(spark, _notes(spark, sf_dir))
    return found.select(_source().alias("source"), "kind", "bytes", F.col("lines").cast("long").alias("lines"), F.col("sha256").alias("sha"))


def imported_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as pages of a bundle: slugs by their paths, told apart from each other and from pages that are there; what has no type is none."""
    found = files.markdown(spark, f"{_notes(spark, sf_dir)}/*").select(F.regexp_extract("path", "(source=[^/]*)/", 1).alias("path"), "title", F.try_element_at("meta", F.lit("type")).alias("type"))
    # paths that differ in a last digit alone share a slug here
    slugged = found.select("path", "title", "type", F.concat(F.lit("okf-"), X.slug(F.regexp_replace("path", "[0-9]$", ""))).alias("slug"))
    there = table(spark, sf_dir, "documents").filter("source LIKE '%0'").select(F.concat(F.lit("okf-"), X.slug(F.concat(F.lit("source="), F.regexp_replace("source", "[0-9]$", "")))).alias("slug")).distinct().withColumn("path", F.lit(""))
    named = R.unique_slugs(slugged.unionByName(there, allowMissingColumns=True), "slug", "path").filter("path <> ''")
    return named.select("path", "title", "type", F.concat(F.lit("sources/"), "unique_slug").alias("page"))


QUERIES = {f.__name__: f for f in (stored_results, stored_snapshots, stored_state, stored_vectors, appended_log, broker_trades, markdown_notes, heading_lists, file_manifests, imported_notes)}

_R = lambda which: f"SELECT l_partkey AS code, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE {which} GROUP BY ALL"
_LOTS = "lots AS (SELECT l_partkey % 50 AS account, CAST(year(l_shipdate) AS INTEGER) AS year, l_partkey AS symbol, l_quantity AS qty, l_linestatus AS st FROM lineitem)"
_HASH = f"sha256({content._canonical('html')})"
_LINES = """docs AS (SELECT source, doc_id, translate(coalesce(text, ''), '`' || chr(13), '''''') AS text FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
    notes AS (SELECT source, '---' || chr(10) || 'title: "On ' || source || '"' || chr(10) || 'type: ' || CASE WHEN source LIKE '%1' THEN 'Concept' ELSE 'Note' END || chr(10) || '---' || chr(10) || '# Source ' || source || chr(10)
      || string_agg('## Document ' || doc_id || ' ##' || chr(10) || text || chr(10), '' ORDER BY doc_id) AS raw FROM docs GROUP BY source)"""
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)\\A---\\r?\\n.*?\\r?\\n---\\r?\\n?', ''), '(?s)```.*?```', ' ', 'g'), '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^\\s{0,3}(#{1,6}|[-*+]|[0-9]+\\.|>)\\s+', '', 'g'), '[*_`]+', '', 'g'), '\\s+', ' ', 'g'))"
_SLUG = "'okf-' || regexp_replace(regexp_replace(lower('source=' || regexp_replace(source, '[0-9]$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

ORACLE = {
    "stored_results": f"""WITH f AS ({_R("l_linestatus = 'F'")}), o AS ({_R("l_linestatus = 'O' AND l_partkey % 3 = 0")}), m AS ({_R("l_returnflag = 'A' OR l_partkey % 2 = 0")}),
        s AS (SELECT * FROM f WHERE (code, year) NOT IN (SELECT (code, year) FROM o) UNION ALL SELECT * FROM o) SELECT * FROM s UNION ALL SELECT * FROM m WHERE (code, year) NOT IN (SELECT (code, year) FROM s)""",
    "stored_snapshots": f"""WITH {_LOTS}, sc AS (SELECT DISTINCT account, year FROM lots WHERE st = 'O' AND account % 5 = 0), l AS (SELECT * FROM lots WHERE st = 'F' AND (account, year) NOT IN (SELECT (account, year) FROM sc) UNION ALL SELECT * FROM lots WHERE st = 'O' AND account % 5 = 0)
        SELECT account, year, sum(qty) AS total, count(DISTINCT symbol) AS symbols, count(*) AS lots, sum(qty) AS lot_qty, count(DISTINCT symbol) AS positions FROM l GROUP BY account, year""",
    "stored_state": f"""WITH p AS (SELECT page_id, {_HASH} AS hash FROM pages), f AS (SELECT hash, min(page_id) AS of FROM p GROUP BY hash)
        SELECT 'index' AS name, of AS page_id, hash AS said FROM f UNION ALL SELECT 'pending', page_id, CAST(of AS VARCHAR) FROM p JOIN f USING (hash) WHERE page_id <> of UNION ALL SELECT 'log', page_id, 'kept' FROM p""",
    "stored_vectors": f"SELECT sha256('model:' || vec_id) AS key, len(embedding) AS dims, {S.q('CASE WHEN vec_id % 3 = 0 THEN -CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END', 6)} AS first FROM embeddings",
    "appended_log": "SELECT event_id, user_id, event_type FROM events",
    "broker_trades": f"""WITH t AS (SELECT CAST(l_partkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_linenumber IN (1, 3, 5) THEN 'buy' ELSE 'sell' END AS side, CAST(l_quantity AS INTEGER)::DOUBLE AS quantity, CAST({S.q("l_extendedprice", 2)} AS DECIMAL(18, 2)) AS price, CAST(l_tax AS DECIMAL(12, 2)) AS fee
        FROM lineitem WHERE l_suppkey % 9 > 0 AND l_linenumber BETWEEN 1 AND 5 AND CAST(l_quantity AS INTEGER) > 0)
        SELECT symbol, trade_date, side, count(*) AS n, sum(quantity) AS quantity, {S.q("sum(price)::DOUBLE", 2)} AS price, {S.q("sum(fee)::DOUBLE", 2)} AS fee, {S.q("count(*) * 0.5", 2)} AS tax FROM t GROUP BY symbol, trade_date, side""",
    "markdown_notes": f"WITH {_LINES} SELECT source, 'On ' || source AS title, CASE WHEN source LIKE '%1' THEN 'Concept' ELSE 'Note' END AS kind, length({_PLAIN}) AS n_chars, sha256({_PLAIN}) AS sha FROM notes",
    "heading_lists": f"""WITH {_LINES}, l AS (SELECT source, unnest(string_split(raw, chr(10))) AS line, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS n FROM notes)
        SELECT source, n AS line, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_replace(line, '^#{{1,6}}\\s+|\\s*#*\\s*$', '', 'g')) AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s')""",
    "file_manifests": f"WITH {_LINES} SELECT source, 'txt' AS kind, strlen(raw) AS bytes, len(string_split(raw, chr(10))) AS lines, sha256(raw) AS sha FROM notes",
    "imported_notes": f"""WITH {_LINES}, s AS (SELECT 'source=' || source AS path, 'On ' || source AS title, CASE WHEN source LIKE '%1' THEN 'Concept' ELSE 'Note' END AS type, {_SLUG} AS slug FROM notes
          UNION ALL SELECT DISTINCT '', NULL, NULL, {_SLUG} FROM documents WHERE source LIKE '%0'), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY path) AS n FROM s)
        SELECT path, title, type, 'sources/' || CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS page FROM n WHERE path <> ''""",
}
