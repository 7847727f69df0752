"""Queries on catalogues: series and providers, pages and links across wikis, terms of pages, questions in other words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import jsonish as J
from marlstone.functions import text as X
from marlstone.operators import bars as B
from marlstone.operators import catalog as C
from marlstone.operators import relational as R
from marlstone.operators import watchlists as WL
from marlstone.plans import content
from marlstone.plans import sql as S
from marlstone.sources.tables import table

SYNONYMS = ((1, "the", "that"), (2, "ist", "war"), (3, "une", "des"), (4, "ción", "tion"))


def best_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of one last digit as names of one code: which has the latest and fullest bars, and whether they will do."""
    bars = B.daily(table(spark, sf_dir, "events")).select(F.col("code").alias("alias"), "day")
    aliases = bars.select("alias").distinct().select(F.pmod("alias", F.lit(10)).alias("code"), "alias", (F.col("alias") < 10).alias("canonical"))
    found = C.covered(C.best_series(bars, aliases), F.lit("2024-01-29").cast("date"), 20)
    return found.select("code", "alias", "latest", F.col("rows").alias("n"), "start", "cached")


def routed_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers of markets by their number, asked for each market of nations."""
    kind = F.col("s_suppkey") % 4
    markets = F.when(kind == 0, F.array(F.lit("cn"))).when(kind == 1, F.array(F.lit("hk"), F.lit("us"))).when(kind == 2, F.array(F.lit("cn"), F.lit("hk")))
    providers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), markets.alias("markets"), (F.col("s_acctbal") > 0).alias("available"))
    parts = [C.routed(providers, F.lit(m)).groupBy().agg(F.count("*").alias("n")).select(F.lit(m).alias("market"), "n") for m in ("cn", "hk", "us", "xx")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def position_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as positions, closes of users' bars up to a day as history, balances as quotes of that day."""
    bars = B.daily(table(spark, sf_dir, "events")).select(F.col("code").alias("symbol"), "day", "close")
    customers = table(spark, sf_dir, "customer")
    day = F.lit("2024-01-10").cast("date")
    found = C.priced_at(customers.select(F.col("c_custkey").alias("symbol")), bars, customers.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("symbol"), F.col("c_acctbal").alias("price")), day, day)
    return found.select("symbol", "price", "price_from")


def chunkable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.element_at(F.array(*map(F.lit, ("sources", "syntheses", "topics", "queries", "comparisons"))), F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, C.GENERATED).otherwise(""))
    return table(spark, sf_dir, "documents").select(section.alias("section"), C.chunkable(section, said).alias("kept")).groupBy("section", "kept").agg(F.count("*").alias("n"))


def bridge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as links to parts in wikis of suppliers: some suppliers, parts and places aren't there."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    wikis = table(spark, sf_dir, "supplier").filter("s_suppkey % 7 > 0").select("s_suppkey", F.lit(True).alias("wiki"))
    pages = table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey", F.lit(True).alias("page"), F.concat(F.lit("w/"), F.col("p_partkey").cast("string")).alias("path"))
    joined = lines.join(wikis, lines.l_suppkey == wikis.s_suppkey, "left").join(pages, lines.l_partkey == pages.p_partkey, "left")
    target = F.when(F.col("l_partkey") % 11 == 0, F.lit("<page>")).otherwise(F.col("l_partkey").cast("string"))
    seen = F.when(F.col("l_linenumber") == 1, F.lit("w/0")).when(F.col("l_linenumber") == 2, F.col("path"))
    return joined.groupBy(C.link_status(target, F.col("wiki"), F.col("page"), F.col("path"), seen).alias("status")).agg(F.count("*").alias("n"))


def related_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pages that are most related to each whose number is divisible by 20, by their titles and readable texts."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), X.readable(F.col("html")).alias("text"))
    found = C.related(pages.filter("page_id % 20 = 0"), pages, "page_id", "title", "text")
    return found.select("page_id", "other", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


def source_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address says of them what neither their title nor their text holds."""
    words = lambda c: F.array_distinct(X.tokens(c))
    pages = table(spark, sf_dir, "pages").select("page_id", words(F.replace(F.col("url"), F.lit("/"), F.lit(" "))).alias("hint"), words(X.html_title(F.col("html"))).alias("title"), words(X.readable(F.col("html"))).alias("evidence"))
    return pages.select("page_id", C.mismatch(F.col("hint"), F.col("title"), F.col("evidence")).alias("mismatch"))


def word_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("贵州茅台股份 a+bc", "数据工程", "x 一 yz-12", "中华人民共和国国务院"))), F.pmod("p_partkey", F.lit(4)).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.grams(F.concat_ws(" ", "p_type", said)), ",").alias("grams"))


def new_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, "unknown").otherwise("text")
    found = docs.select("doc_id", C.criteria(F.col("doc_id") % 2 == 0, F.col("n_chars") / 100.0, F.array_distinct(X.tokens(F.col("text"))), F.col("text"), kind, 6.0).alias("c"))
    return found.select("doc_id", F.array_join("c.satisfied", ",").alias("satisfied"), "c.enough")


def rephrased_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions; the first three ways to say them otherwise."""
    questions = table(spark, sf_dir, "conversations").select("text").distinct()
    synonyms = spark.createDataFrame(list(SYNONYMS), "place int, term string, synonym string")
    return C.rephrased(questions, "text", synonyms).select(F.sha2("text", 256).alias("question"), F.sha2("variant", 256).alias("variant"))


def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as chunks of a manifest, by order and line: quantities as first lines, sizes of shipments as last ones."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_quantity").cast("int").alias("first_line"), F.pmod("l_partkey", F.lit(60)).cast("int").alias("last_line"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_returnflag")).alias("title"))
    return C.integrity(rows, ("id", "title")).groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def undeclared_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("see asset:"), F.col("p_brand"), F.lit(" asset:p_"), F.col("p_size").cast("string"), F.lit(", asset:logo asset:logo"))
    declared = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("logo"))).otherwise(F.array(F.lit("logo"), F.concat(F.lit("p_"), F.col("p_size").cast("string"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.undeclared(F.replace(said, F.lit("#"), F.lit("_")), declared), ",").alias("assets"))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what a model wrote: fenced, bare or no JSON; read back with nested fields."""
    form = F.pmod("event_id", F.lit(3))
    inner = F.concat(F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit('}, "kinds": ["'), F.col("event_type"), F.lit('"]}'))
    said = F.when(form == 0, F.concat(F.lit("Here:\n```json\n"), inner, F.lit("\n```\ndone {}"))).when(form == 1, F.concat(F.lit("I say "), inner, F.lit(" so"))).otherwise("no json")
    return table(spark, sf_dir, "events").select("event_id", J.read_json(said, "user struct<id:long>, kinds array<string>").alias("j")).select("event_id", F.col("j.user.id").alias("user_id"), F.get("j.kinds", F.lit(0)).alias("kind"))


def mended_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects that a model wrote, damaged in nine ways, and read back: fenced, trailing and missing commas, Python's words and quotes, comments, brackets that are missing or too many, a wrapped answer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("-")).alias("source"))
    escaped = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(".*")\}$', 1)
    text, source, id_ = escaped(F.col("text")), escaped(F.col("source")), F.col("doc_id").cast("string")
    own = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    plain = own('{"doc": {"body": ', text, ', "tags": [', source, ', "x"]}, "id": ', id_, ', "ok": true}')
    said = {
        0: own("Here:\n```json\n", plain, "\n```\ndone {}"),
        1: own('{"doc": {"body": ', text, ', "tags": [', source, ', "x",],}, "id": ', id_, ', "ok": true,}'),
        2: own('{"doc": {"body": ', text, ' "tags": [', source, ' "x"]} "id": ', id_, ' "ok": True}'),
        3: own("so {doc: {'body': ", text, ", 'tags': [", source, ", 'x']}, id: ", id_, ", ok: True} it is"),
        4: own('{"doc": /* whole, { */ {"body": ', text, ', // a } here\n "tags": [', source, ', "x"]}, "id": ', id_, ', "ok": true}'),
        5: own('{"doc": {"body": ', text, ', "tags": [', source, ', "x"}, "id": ', id_, ', "ok": true'),
        6: own('{"ok": true, "id": ', id_, ', "doc": {"body": ', text, ', "tags": [', source, ', "x'),
        7: own('{"answer": ', escaped(own("```json\n", plain, "\n```")), "}"),
    }
    out = F.lit("not an object")
    for form, one in said.items():
        out = F.when(F.pmod("doc_id", F.lit(9)) == form, one).otherwise(out)
    read = docs.select("doc_id", F.from_json(J.unwrapped(out), "doc struct<body:string, tags:array<string>>, id long, ok boolean").alias("j"))
    return read.select("doc_id", F.sha2("j.doc.body", 256).alias("sha"), F.length("j.doc.body").cast("long").alias("n"), F.array_join("j.doc.tags", ",").alias("tags"), F.col("j.id").alias("id"), F.col("j.ok").alias("ok"))


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a list whose codes are written in several ways, or are none; names that one part has alone are known."""
    part = table(spark, sf_dir, "part").withColumn("n", F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    kind = F.col("p_partkey") % 8
    written = F.when(kind == 0, F.concat(F.lit("sh"), "n")).when(kind == 1, F.concat("n", F.lit(".SZ"))).when(kind == 2, F.concat(F.lit(" "), "n")).when(kind == 3, F.concat(F.lit("HK"), F.right("n", F.lit(3)))).when(kind == 4, "brk.b").when(kind == 5, "#none").when(kind == 6, "")
    rows = part.select(F.col("p_size").alias("size"), written.alias("Stock_Code"), F.when(F.col("p_partkey") % 5 > 0, F.concat_ws(" ", "p_name", "p_brand")).alias("名称"))
    known = R.unique_names(part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("n").alias("code")), "name", "code")
    return WL.watch_list(rows, known).groupBy("code", "name").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        best_series, routed_providers, position_prices, chunkable_pages, bridge_links, related_sources, source_mismatches, word_grams, new_collections, rephrased_questions, manifest_issues, undeclared_assets, model_outputs, mended_outputs, watch_list,
    )
}

_STOP = ", ".join(f"'{w}'" for w in C.LINK_STOP)
_STEM = content._STEM.replace("word", "w")
_KEYS = f"list_distinct(list_transform(list_filter(string_split_regex(lower(coalesce({{}}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), lambda w: {_STEM}))"
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_HAN = "regexp_extract_all(low, '\\p{Han}{2,}')"


def _runs(n: int) -> str:
    return f"CASE WHEN length(r) >= {n} THEN list_transform(range(1, length(r) - {n - 1} + 1), lambda k: substr(r, k, {n})) ELSE [] END"


_GRAMS = f"list_concat(list_filter(flatten(list_transform(regexp_extract_all(low, '[a-z0-9][a-z0-9+-]*'), lambda t: string_split_regex(t, '[+-]'))), lambda t: length(t) >= 2), flatten(list_transform({_HAN}, lambda r: list_concat(CASE WHEN length(r) <= 8 THEN [r] ELSE [] END, {_runs(2)}, {_runs(3)}, {_runs(4)}))))"


def _variant(term: str, other: str) -> str:
    if term.isascii():
        return f"CASE WHEN regexp_matches(q, '(?i)(^|\\s){term}(\\s|$)') THEN regexp_replace(q, '(?i)(^|\\s){term}(\\s|$)', '\\1{other}\\2') END"
    return f"CASE WHEN contains(q, '{term}') THEN regexp_replace(q, '{term}', '{other}') END"


ORACLE = {
    "best_series": f"""WITH {S.BARS}, c AS (SELECT code AS alias, max(day) AS latest, count(*) AS n FROM bars GROUP BY code), b AS (SELECT alias % 10 AS code, * FROM c QUALIFY row_number() OVER (PARTITION BY alias % 10 ORDER BY latest DESC, n DESC, alias < 10 DESC, alias DESC) = 1)
        SELECT code, alias, latest, n, DATE '2024-01-29' - 46 AS start, latest >= DATE '2024-01-29' AND n >= 20 AS cached FROM b""",
    "routed_providers": "SELECT m AS market, count(*) AS n FROM (SELECT unnest(['cn', 'hk', 'us', 'xx']) AS m) a JOIN supplier ON s_acctbal > 0 AND (m = 'xx' OR s_suppkey % 4 = 3 OR (m = 'cn' AND s_suppkey % 4 IN (0, 2)) OR (m = 'hk' AND s_suppkey % 4 IN (1, 2)) OR (m = 'us' AND s_suppkey % 4 = 1)) GROUP BY m",
    "position_prices": f"""WITH {S.BARS}, l AS (SELECT code, max_by(close, day) AS close FROM bars WHERE day <= DATE '2024-01-10' AND close > 0 GROUP BY code)
        SELECT c_custkey AS symbol, coalesce(close, q) AS price, CASE WHEN close IS NOT NULL THEN 'history_close' WHEN q IS NOT NULL THEN 'realtime_quote' ELSE 'missing' END AS price_from FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 AND c_acctbal > 0 THEN c_acctbal END AS q FROM customer) LEFT JOIN l ON code = c_custkey""",
    "chunkable_pages": "SELECT section, section <> 'topics' AND NOT (section = 'syntheses' AND doc_id % 3 = 0) AS kept, count(*) AS n FROM (SELECT doc_id, ['sources', 'syntheses', 'topics', 'queries', 'comparisons'][doc_id % 5 + 1] AS section FROM documents) GROUP BY ALL",
    "bridge_links": """SELECT status, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 11 = 0 THEN 'placeholder-target' WHEN s_suppkey IS NULL THEN 'unknown-wiki' WHEN p_partkey IS NULL THEN 'missing-page' WHEN l_linenumber = 1 AND p_partkey <> 0 THEN 'stale-edge' ELSE 'resolved' END AS status
        FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 > 0) ON l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey) GROUP BY status""",
    "related_sources": f"""WITH p AS (SELECT page_id, {content._html_title("html")} AS title, {content._readable("html")} AS text FROM pages), k AS (SELECT page_id, {_KEYS.format("concat_ws(chr(10), title, text)")} AS t, {_KEYS.format("title")} AS h FROM p),
        m AS (SELECT a.page_id, b.page_id AS other, list_intersect(a.t, b.t) AS o, len(list_intersect(a.t, b.t)) + len(list_intersect(a.h, b.h)) AS score FROM k a JOIN k b ON a.page_id % 20 = 0 AND a.page_id <> b.page_id)
        SELECT page_id, other, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, other) AS place FROM m WHERE score >= 3 OR len(list_filter(o, lambda t: length(t) >= 7 OR regexp_matches(t, '[0-9]'))) > 0 QUALIFY place <= 3""",
    "source_mismatches": f"""WITH w AS (SELECT page_id, list_distinct({S.tokens("replace(url, '/', ' ')")}) AS h, list_distinct({S.tokens(content._html_title("html"))}) AS t, list_distinct({S.tokens(content._readable("html"))}) AS e FROM pages)
        SELECT page_id, len(h) >= 2 AND len(t) >= 2 AND NOT list_has_any(h, t) AND NOT list_has_any(h, e) AS mismatch FROM w""",
    "word_grams": f"WITH l AS (SELECT p_partkey, lower(p_type || ' ' || ['贵州茅台股份 a+bc', '数据工程', 'x 一 yz-12', '中华人民共和国国务院'][p_partkey % 4 + 1]) AS low FROM part), g AS (SELECT p_partkey, {_GRAMS} AS g FROM l) SELECT p_partkey, array_to_string({_ORDERED.format('g')}, ',') AS grams FROM g",
    "new_collections": f"""WITH c AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 > 0 THEN 'no-fit' END, CASE WHEN len(list_distinct({S.tokens("text")})) >= 8 THEN 'terms' END, CASE WHEN length(text) >= 160 THEN 'length' END, CASE WHEN doc_id % 2 > 0 AND n_chars / 100.0 < 6.0 THEN 'pollution' END, CASE WHEN doc_id % 5 > 0 THEN 'readable' END], lambda x: x IS NOT NULL) AS s FROM documents)
        SELECT doc_id, array_to_string(s, ',') AS satisfied, len(s) >= 3 AS enough FROM c""",
    "rephrased_questions": f"""WITH t AS (SELECT DISTINCT text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations), v AS (SELECT text, list_filter([{", ".join(_variant(t, o) for _, t, o in SYNONYMS)}], lambda v: v IS NOT NULL AND lower(v) <> lower(q)) AS v FROM t)
        SELECT sha256(text) AS question, sha256(unnest({_ORDERED.format("v")}[:3])) AS variant FROM v""",
    "manifest_issues": """WITH c AS (SELECT l_orderkey || '#' || l_linenumber AS id, CAST(l_quantity AS INTEGER) AS f, l_partkey % 60 AS l, l_suppkey % 9 = 0 AS bare FROM lineitem)
        SELECT 'missing-title' AS issue, count(*) AS n, count(DISTINCT id) AS ids FROM c WHERE bare HAVING count(*) > 0 UNION ALL SELECT 'bad-range', count(*), count(DISTINCT id) FROM c WHERE f < 1 OR l < f HAVING count(*) > 0
        UNION ALL SELECT 'repeated-id', count(*), count(*) FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0""",
    "undeclared_assets": "SELECT p_partkey, replace(p_brand, '#', '_') || CASE WHEN p_size % 2 = 0 THEN ',p_' || p_size ELSE '' END AS assets FROM part",
    "watch_list": """WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS n, p_name || ' ' || p_brand AS title FROM part), u AS (SELECT title, min(n) AS code FROM p GROUP BY title HAVING count(DISTINCT n) = 1),
        r AS (SELECT CASE k % 8 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN lpad(right(n, 3), 5, '0') WHEN 4 THEN 'BRK.B' END AS valid, CASE WHEN k % 8 = 5 THEN '#none' END AS odd, CASE WHEN k % 5 > 0 THEN title END AS name FROM p),
        f AS (SELECT coalesce(valid, u.code) AS code, coalesce(name, CASE WHEN valid IS NULL THEN odd END) AS name FROM r LEFT JOIN u ON valid IS NULL AND u.title = coalesce(name, odd) WHERE valid IS NOT NULL OR odd IS NOT NULL OR name IS NOT NULL)
        SELECT code, name, count(*) AS n FROM f GROUP BY ALL""",
    "mended_outputs": """WITH d AS (SELECT doc_id, doc_id % 9 < 8 AS is_json, coalesce(text, '') AS text, coalesce(source, '-') AS source FROM documents)
        SELECT doc_id, CASE WHEN is_json THEN sha256(text) END AS sha, CASE WHEN is_json THEN length(text) END AS n, CASE WHEN is_json THEN source || ',x' END AS tags, CASE WHEN is_json THEN doc_id END AS id, CASE WHEN is_json THEN true END AS ok FROM d""",
    "model_outputs": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS user_id, CASE WHEN event_id % 3 < 2 THEN event_type END AS kind FROM events",
}
