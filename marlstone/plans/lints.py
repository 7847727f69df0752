"""Queries on intake, checks, keys, replacements and pages of a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.numeric import quantise
from marlstone.operators import bars as B
from marlstone.operators import intake as I
from marlstone.operators import lints as L
from marlstone.operators import relational as R
from marlstone.plans import content
from marlstone.plans import sql as S
from marlstone.sources.tables import table


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("title", X.html_title(F.col("html")))
    vectors, asked = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0
    return I.checked(pages.filter("page_id % 20 = 0"), pages.filter("page_id % 20 <> 0"), "page_id", "html", "url", "title", (vectors.filter(asked), vectors.filter(~asked)))


def intake_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose number is divisible by 20, and their vectors, as new ones against all others."""
    return _checked(spark, sf_dir).select("page_id", "reason", "of", quantise(F.col("similarity"), 6).alias("similarity"))


def intake_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = F.when(F.col("page_id") % 3 == 0, "keep").when(F.col("page_id") % 3 == 1, "duplicate")
    return _checked(spark, sf_dir).select("page_id", I.phase(F.col("reason"), decided).alias("phase"))


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of pages named by their source; sources of one last digit are merged into the first by name."""
    records = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("page"))
    digit = F.right("page", F.lit(1))
    firsts = records.groupBy(digit.alias("d")).agg(F.min("page").alias("target"))
    merges = records.select("page", digit.alias("d")).distinct().join(firsts, "d").select(F.col("page").alias("source"), "target")
    return I.merged(records, merges).groupBy("page").agg(F.count("*").alias("n"))


def backfill_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", X.fingerprint(F.col("html")).alias("hash"), F.length("html").alias("n_chars"))
    manifest = pages.select(F.col("page_id").cast("string").alias("source"), F.when(F.col("page_id") % 9 > 0, F.col("page_id")).alias("page"), "hash")
    contents = pages.select(F.col("page_id").alias("page"), F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.col("n_chars")).alias("n_chars"))
    known = pages.filter("page_id % 4 = 0").select(F.col("page_id").cast("string").alias("source"), F.when(F.col("page_id") % 8 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return I.backfill(manifest, contents, known)


def taxonomy_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as topics under regions; regions stand under the nation of their number, so that some go in a circle."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    edges = nation.withColumn("type", F.when(F.col("a") % 5 == 0, "part-of").when(F.col("a") % 5 < 3, "is-a").when(F.col("a") % 5 == 3, "related"))
    redirects = nation.select("a", F.when(F.col("a") % 7 > 0, F.pmod(F.col("a") * 3, F.lit(25))).alias("b"))
    return L.taxonomy(edges, redirects)


def raw_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages and pages as their raw files, by number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.md5("text").alias("sha"))
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source"), F.md5("html").alias("sha"), (F.col("page_id") % 2 == 0).alias("has_meta"))
    found = L.raw_integrity(docs, raw, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source")))
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.min("source").alias("first"))


def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("title", X.html_title(F.col("html"))).filter("title IS NOT NULL")
    return L.repeated(pages, F.concat(F.lit("page:"), F.lower("title")), "page_id")


def news_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as news of a code, some without an address or a date, put in by their natural key: even ones first, odd ones then."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 3 > 0, F.col("url")).alias("url"), X.html_title(F.col("html")).alias("title"), F.regexp_extract("url", "//([^/:?#]+)", 1).alias("source"),
        F.when(F.col("page_id") % 7 > 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(40)).cast("int"))).alias("published"), F.when(F.col("page_id") % 5 > 0, F.sha2(X.readable(F.col("html")), 256)).alias("snippet"),
    )
    rows = L.news(pages, "url", F.lit("600519"), "title", "source", "published")
    fields = ["source", "published", "snippet"]
    first = R.filled(rows.limit(0).select("key", "title", *fields), rows.filter("page_id % 2 = 0"), "key", "page_id", ["title"], fields).drop("state")
    return R.filled(first, rows.filter("page_id % 2 = 1"), "key", "page_id", ["title"], fields)


def replaced_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as lots of accounts; those that ship by air are the new state of their account and day."""
    lots = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(50)).alias("account"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("qty"), F.col("l_linestatus").alias("status"))
    after = L.replaced(lots.filter("status = 'F'"), lots.filter("status <> 'F'"), ["account", "day"])
    return after.groupBy("account", "status").agg(F.count("*").alias("lots"), F.sum("qty").alias("qty"))


def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 purchases of ten days, the latest first, with the number of all."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    total, page = L.history(table(spark, sf_dir, "events"), "ts", day("2024-01-05"), day("2024-01-15"), [F.desc("ts"), F.desc("event_id")], 3, 25, event_type="purchase", user_id=None)
    return page.select("event_id", F.lit(total).cast("long").alias("total"))


def preferred_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source, German ones first, the longest first."""
    found = L.preferred_first(table(spark, sf_dir, "documents"), ["source"], F.col("lang") == "de", [F.desc("n_chars"), F.col("doc_id")], 3)
    return found.select("source", "doc_id", F.col("place").cast("long").alias("place"))


def best_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language the source with the most long documents."""
    return L.best_source(table(spark, sf_dir, "documents").filter("lang IS NOT NULL"), "lang", "source", F.col("n_chars") > 500)


def eval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("window")).distinct().orderBy("window")


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "part").select("p_partkey", F.explode(L.page_ranges(F.col("p_size"), 12)).alias("r"))
    return cut.select("p_partkey", F.col("r.first").alias("first_page"), F.col("r.last").alias("last_page"))


def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.volume_state(B.full_averages(B.daily(table(spark, sf_dir, "events")), (5, 10)))
    alignment = F.when(F.col("ma5") > F.col("ma10"), "bullish").when(F.col("ma5") < F.col("ma10"), "bearish").otherwise("neutral")
    volume = F.when(F.col("volume_state").startswith("heavy"), "heavy").otherwise("normal")
    return bars.select("code", "day", L.regime(alignment, F.floor(F.col("close")).cast("double"), volume, F.col("code") % 5 == 0).alias("regime"))


def chip_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.chip_status(F.col("p_size") / 50.0, F.pmod("p_partkey", F.lit(40)) / 100.0).alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        intake_checks, intake_phases, merged_records, backfill_index, taxonomy_lint, raw_integrity, repeated_titles, news_keys, replaced_lots, event_page, preferred_documents, best_sources, eval_windows, page_ranges, market_regimes, chip_statuses,
    )
}

_TITLE = content._title(f"coalesce({content._html_title('html')}, '')")
_WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda x: x <> ''))"
_CHECKED = f"""m AS (SELECT page_id, sha256({content._canonical("html")}) AS e, {content._url("url")} AS u, {_TITLE} AS t FROM pages), n AS (SELECT * FROM m WHERE page_id % 20 = 0), k AS (SELECT * FROM m WHERE page_id % 20 <> 0),
    v AS (SELECT a.vec_id AS page_id, b.vec_id AS of, {S.q("list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))", 6)} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0),
    tt AS (SELECT n.page_id, k.page_id AS of, len(list_intersect({_WORDS.format("n.t")}, {_WORDS.format("k.t")})) / CAST(len(list_distinct(list_concat({_WORDS.format("n.t")}, {_WORDS.format("k.t")}))) AS DOUBLE) AS s FROM n JOIN k ON n.t <> '' AND k.t <> '' AND n.t <> k.t),
    x AS (SELECT n.page_id, 1 AS rank, 'exact' AS reason, min(k.page_id) AS of, 1.0::DOUBLE AS s FROM n JOIN k USING (e) GROUP BY n.page_id
      UNION ALL (SELECT page_id, CASE WHEN s >= 0.98 THEN 2 ELSE 3 END, CASE WHEN s >= 0.98 THEN 'semantic' ELSE 'semantic_match' END, of, s FROM v WHERE s >= 0.88 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY s DESC, of) = 1)
      UNION ALL SELECT n.page_id, 4, 'url_match', min(k.page_id), 1.0 FROM n JOIN k USING (u) WHERE u <> '' GROUP BY n.page_id UNION ALL SELECT n.page_id, 5, 'title_match', min(k.page_id), 1.0 FROM n JOIN k USING (t) WHERE t <> '' GROUP BY n.page_id
      UNION ALL (SELECT page_id, 6, 'title_match', of, s FROM tt WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY s DESC, of) = 1)),
    best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, of) = 1), checked AS (SELECT n.page_id, coalesce(reason, 'new') AS reason, of, s AS similarity FROM n LEFT JOIN best USING (page_id))"""


def _bands(x: str, steps, otherwise: str, sign: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} {sign} {value} THEN '{label}'" for value, label in steps) + f" ELSE '{otherwise}' END"


ORACLE = {
    "intake_checks": f"WITH {_CHECKED} SELECT page_id, reason, of, {S.q('similarity', 6)} AS similarity FROM checked",
    "intake_phases": f"WITH {_CHECKED} SELECT page_id, CASE WHEN reason IN ('exact', 'semantic') THEN 'skip' WHEN reason = 'new' THEN 'bypass' WHEN page_id % 3 = 0 THEN 'bypass' WHEN page_id % 3 = 1 THEN 'skip' ELSE 'confirm' END AS phase FROM checked",
    "merged_records": "SELECT page, count(*) AS n FROM (SELECT min(source) OVER (PARTITION BY right(source, 1)) AS page FROM documents) GROUP BY page",
    "backfill_index": f"""WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS source, sha256({content._canonical("html")}) AS hash, length(html) AS n FROM pages), f AS (SELECT *, min(source) OVER (PARTITION BY hash) AS first FROM p)
        SELECT source, CASE WHEN page_id % 9 = 0 THEN 'no-source-page' WHEN page_id % 5 = 0 OR n = 0 OR n IS NULL THEN 'no-content' WHEN page_id % 8 = 0 THEN 'already-current' WHEN first < source THEN 'duplicate-doc-hash' ELSE 'made' END AS status FROM f""",
    "taxonomy_lint": """WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation), h AS (SELECT a, b FROM e WHERE a % 5 < 3), r AS (SELECT a, CASE WHEN a % 7 > 0 THEN a * 3 % 25 END AS b FROM e), s AS (SELECT a, b FROM r WHERE a <> b),
        hr AS (SELECT a, b FROM h UNION SELECT hr.a, h.b FROM hr JOIN h ON hr.b = h.a), sr AS (SELECT a, b FROM s UNION SELECT sr.a, s.b FROM sr JOIN s ON sr.b = s.a)
        SELECT 'taxonomy-edge-missing-type' AS issue, a AS node FROM e WHERE a % 5 = 4 UNION SELECT 'taxonomy-cycle', a FROM hr WHERE a = b UNION SELECT 'taxonomy-empty-redirect', a FROM r WHERE b IS NULL UNION SELECT 'taxonomy-self-redirect', a FROM r WHERE a = b UNION SELECT 'taxonomy-redirect-cycle', a FROM sr WHERE a = b""",
    "raw_integrity": """WITH j AS (SELECT doc_id, md5(text) AS sha, page_id, md5(html) AS raw, item_id FROM documents LEFT JOIN pages ON doc_id = page_id LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) ON doc_id = item_id),
        i AS (SELECT doc_id, unnest(list_filter([CASE WHEN raw IS NULL THEN 'missing-raw-source' END, CASE WHEN raw <> sha THEN 'raw-source-drift' END, CASE WHEN raw IS NOT NULL AND page_id % 2 > 0 THEN 'raw-missing-frontmatter' END, CASE WHEN item_id IS NULL THEN 'raw-missing-manifest-entry' END], lambda x: x IS NOT NULL)) AS issue FROM j)
        SELECT issue, count(*) AS n, min(doc_id) AS first FROM i GROUP BY issue""",
    "repeated_titles": f"SELECT title, count(DISTINCT page_id) AS pages FROM (SELECT 'page:' || lower({content._html_title('html')}) AS title, page_id FROM pages) WHERE title IS NOT NULL GROUP BY title HAVING count(DISTINCT page_id) > 1",
    "news_keys": f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS url, {content._html_title("html")} AS title, regexp_extract(url, '//([^/:?#]+)', 1) AS source,
          CASE WHEN page_id % 7 > 0 THEN DATE '2024-01-01' + CAST(page_id % 40 AS INTEGER) END AS published, CASE WHEN page_id % 5 > 0 THEN sha256({content._readable("html")}) END AS snippet FROM pages),
        r AS (SELECT *, CASE WHEN trim(coalesce(url, '')) <> '' THEN trim(url) ELSE 'no-url:600519:' || md5('600519|' || coalesce(trim(title), '') || '|' || coalesce(trim(source), '') || '|' || coalesce(strftime(published, '%Y-%m-%dT%H:%M:%S'), '')) END AS key
          FROM p WHERE trim(coalesce(title, '')) <> '' OR trim(coalesce(url, '')) <> ''),
        one AS (SELECT key, page_id % 2 AS odd, min(page_id) AS first, {", ".join(f"max(CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN page_id END) AS at_{c}" for c in ("source", "published", "snippet"))} FROM r GROUP BY ALL),
        v AS (SELECT o.key, odd, (SELECT title FROM r WHERE page_id = first) AS title, {", ".join(f"(SELECT {c} FROM r WHERE page_id = at_{c}) AS {c}" for c in ("source", "published", "snippet"))} FROM one o)
        SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL THEN a.title ELSE b.title END AS title, {", ".join(f"coalesce(b.{c}, a.{c}) AS {c}" for c in ("source", "published", "snippet"))},
          CASE WHEN b.key IS NULL THEN 'kept' WHEN a.key IS NULL THEN 'inserted' ELSE 'updated' END AS state FROM (SELECT * FROM v WHERE odd = 0) a FULL JOIN (SELECT * FROM v WHERE odd = 1) b ON a.key = b.key""",
    "replaced_lots": """WITH l AS (SELECT l_partkey % 50 AS account, CAST(l_shipdate AS DATE) AS day, l_quantity AS qty, l_linestatus AS status FROM lineitem), n AS (SELECT DISTINCT account, day FROM l WHERE status <> 'F')
        SELECT account, status, count(*) AS lots, sum(qty) AS qty FROM l WHERE status <> 'F' OR NOT EXISTS (SELECT 1 FROM n WHERE n.account = l.account AND n.day = l.day) GROUP BY 1, 2""",
    "event_page": """WITH e AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15') SELECT event_id, (SELECT count(*) FROM e) AS total FROM e ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50""",
    "preferred_documents": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(lang = 'de', false) DESC, n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 3",
    "best_sources": "SELECT lang, source FROM (SELECT lang, source, count(*) FILTER (WHERE n_chars > 500) AS p, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY p DESC, n DESC, source) = 1",
    "eval_windows": 'SELECT DISTINCT l_linenumber AS "window" FROM lineitem',
    "page_ranges": "SELECT p_partkey, f AS first_page, least(f + 11, p_size) AS last_page FROM (SELECT p_partkey, p_size, unnest(range(1, p_size + 1, 12)) AS f FROM part)",
    "market_regimes": f"""WITH {S.BARS}, w AS (SELECT *, CASE WHEN count(close) OVER a = 5 THEN avg(close) OVER a END AS ma5, CASE WHEN count(close) OVER b = 10 THEN avg(close) OVER b END AS ma10, volume / avg(volume) OVER c AS ratio, floor(close) AS score FROM bars
          WINDOW a AS (PARTITION BY code ORDER BY day ROWS 4 PRECEDING), b AS (PARTITION BY code ORDER BY day ROWS 9 PRECEDING), c AS (PARTITION BY code ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT code, day, CASE WHEN ma5 > ma10 AND score >= 70 THEN 'trending_up' WHEN ma5 < ma10 AND score <= 30 THEN 'trending_down' WHEN NOT coalesce(ma5 > ma10 OR ma5 < ma10, false) OR score BETWEEN 35 AND 65 THEN 'sideways' WHEN ratio >= 1.5 AND score > 30 AND score < 70 THEN 'volatile' WHEN code % 5 = 0 THEN 'sector_hot' END AS regime FROM w""",
    "chip_statuses": f"SELECT p_partkey, {_bands('p_size / 50.0', L.PROFITS, '套牢盘极高(套牢盘>90%)', '>=')} || '，' || {_bands('(p_partkey % 40) / 100.0', L.SPREADS, '筹码较分散', '<')} AS status FROM part",
}
