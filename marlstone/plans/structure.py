"""Queries on the structure of texts, calendars, roles and corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import articles
from marlstone.functions.numeric import quantise
from marlstone.operators import calendars, chunking, composition, dedup
from marlstone.operators import ledger as L
from marlstone.plans import sql as S
from marlstone.plans import trading
from marlstone.sources.tables import table

LINES, SPAN, OVERLAP = 3, 300, 40


def _markdown() -> Column:
    """Lines that begin with A to S as headings of levels 1 to 3, level 2 last, so that levels are left out too."""
    out = F.regexp_replace("text", "(?dm)^([A-F])", "# $1")
    return F.regexp_replace(F.regexp_replace(out, "(?dm)^([G-M])", "### $1"), "(?dm)^([N-S])", "## $1")


def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _markdown().alias("md"))
    return chunking.heading_chunks(docs, "doc_id", "md", LINES).select("doc_id", "start_line", "end_line", "heading_path", "sha256")


def parent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks."""
    md = F.replace(F.translate("text", "`~", ""), F.lit("\n"), F.lit("\n\n"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.parent_spans(md, SPAN, OVERLAP)).alias("s")).select("doc_id", "s.*")
    return found.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "kind", F.col("first").alias("first_block"), F.col("last").alias("last_block"))


def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at some hour of their day, in three markets that are closed on two holidays."""
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate") + F.make_interval(hours=F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int"))
    market = F.element_at(F.array(*(F.lit(m) for m in ("cn", "hk", "us"))), (F.pmod(F.col("o_custkey"), F.lit(3)) + 1).cast("int"))
    day = F.explode(F.sequence(F.lit("1990-01-01").cast("date"), F.lit("2026-01-01").cast("date")))
    days = spark.range(1).select(day.alias("day")).filter((F.weekday("day") < 5) & ~F.date_format("day", "MM-dd").isin("01-01", "12-25"))
    closes = F.explode(F.create_map(F.lit("cn"), F.lit(7), F.lit("hk"), F.lit(8), F.lit("us"), F.lit(21))).alias("market", "hour")
    sessions = days.select("day", closes).select("market", "day", (F.col("day").cast("timestamp") + F.make_interval(hours=F.col("hour"))).alias("close"))
    return calendars.effective_dates(orders.select("o_orderkey", market.alias("market"), at.alias("at")), sessions).select("o_orderkey", "market", "effective")


def composition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as templates."""
    key = F.col("p_partkey")
    held = lambda test, name: F.when(test, name)
    roles = F.filter(F.array(held(key % 3 == 0, "primary"), held(key % 2 == 0, "supporting"), held(key % 5 < 2, "style")), lambda r: r.isNotNull())
    scored = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), key.cast("string").alias("target"), (F.col("p_size") - 2).alias("score"), F.col("p_retailprice").alias("primary_score"),
        roles.alias("roles"), F.when(key % 7 == 0, "supporting").otherwise("primary").alias("assigned"), F.array(F.get(F.split("p_type", " "), F.lit(0))).alias("negative_for"),
    )
    return composition.compose(scored, "brand")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of one share to two of some parts, and dividends of others."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), "p_size")
    splits = part.filter("p_size % 2 = 0").select("symbol", F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size")).alias("day"), F.lit("split").alias("id"), F.lit(2.0).alias("ratio"), F.lit(None).cast("double").alias("per_share"))
    paid = part.filter("p_size % 3 = 0").select("symbol", F.date_add(F.lit("1996-01-01").cast("date"), F.col("p_size")).alias("day"), F.lit("dividend").alias("id"), F.lit(None).cast("double").alias("ratio"), F.lit(0.25).alias("per_share"))
    return splits.union(paid)


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.with_actions(trading._trades(spark, sf_dir), _actions(spark, sf_dir)).filter("kind = 0 AND id = 'dividend'")
    return found.select("symbol", "day", "before", "cash")


def split_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all symbols in shares of the end; only sales of more than is held are refused."""
    trades = L.split_adjusted(trading._trades(spark, sf_dir), _actions(spark, sf_dir))
    return L.fifo(L.accepted(trades)).select("symbol", "sell_id", "buy_id", quantise(F.col("qty"), 4).alias("qty"), quantise(F.col("cost"), 3).alias("cost"), quantise(F.col("proceeds"), 3).alias("proceeds"))


def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    body = articles.body(html)
    return table(spark, sf_dir, "pages").select("page_id", articles.field(html, "title", "Untitled Article").alias("title"), articles.field(html, "author").alias("author"), articles.field(html, "site").alias("site"), F.sha2(body, 256).alias("body_sha"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", articles.markdown(articles.body(F.col("html"))).alias("md")).select("page_id", F.length("md").cast("long").alias("n_chars"), F.sha2("md", 256).alias("sha"))


def close_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts with a letter left out, among the types."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    found = dedup.similar_names(types.select(F.regexp_replace("name", "(?<=[A-Z])L", "").alias("name")), types)
    return found.withColumn("ratio", quantise(F.col("ratio"), 6))


QUERIES = {f.__name__: f for f in (article_fields, page_markdown, close_names, heading_chunks, parent_spans, effective_dates, composition_plan, dividends, split_fifo)}

_NL = "chr(10)"
_MD = "regexp_replace(regexp_replace(regexp_replace(text, '(?m)^([A-F])', '# \\1', 'g'), '(?m)^([G-M])', '### \\1', 'g'), '(?m)^([N-S])', '## \\1', 'g')"
_DEPTHS = ", ".join(f"last_value(CASE WHEN depth = {k} THEN title END IGNORE NULLS) OVER w AS p{k}" for k in range(1, 7))
_SPLITS = "splits AS (SELECT p_partkey AS symbol, DATE '1995-01-01' + p_size AS day FROM part WHERE p_size % 2 = 0)"
_ADJUSTED = trading._TRADES.replace("trades AS (", "raw AS (", 1).replace(
    "levels AS (",
    f"{_SPLITS}, trades AS (SELECT r.symbol, r.day, id, side, CASE WHEN s.day > r.day THEN qty * 2.0 ELSE qty END AS qty, CASE WHEN s.day > r.day THEN price / 2.0 ELSE price END AS price FROM raw r LEFT JOIN splits s USING (symbol)),\n    levels AS (",
    1,
)



def _bare(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, sign in articles.ENTITIES.items():
        out = f"replace({out}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _field(name: str, otherwise: str) -> str:
    places = [f"nullif({_bare(f"regexp_extract(html, '{('(?is)' + p).replace(chr(39), chr(39) * 2)}', 1)")}, '')" for p in articles.FIELDS[name]]
    return f"coalesce({', '.join(places)}, '{otherwise}')"


_ARTICLE = f"""a AS (SELECT page_id, html, list_filter(regexp_extract_all(html, '(?is)<article[^>]*>(.*?)</article>', 1), lambda h: length({_bare("h")}) >= {articles.LEAST})[1] AS article,
          list_filter(regexp_extract_all(html, '(?is)<body[^>]*>(.*?)</body>', 1), lambda h: length({_bare("h")}) >= {articles.LEAST})[1] AS whole FROM pages),
        b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(article, whole), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
          '(?is)<(nav|footer|header|aside)[^>]*>.*?</(nav|footer|header|aside)>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM a)"""
_MARKS = ("'<h1[^>]*>', chr(10) || chr(10) || '# '", "'</h1>|</?p>', chr(10) || chr(10)", "'</?b>', '**'", "'<br>', '  ' || chr(10)", "'</?(div|article|main)[^>]*>', ''", "'&lt;', '<'", "'&gt;', '>'", "'&quot;', chr(34)", "'&#(x27|39);', chr(39)", "'&amp;', '&'", "'\\n\\n\\n+', chr(10) || chr(10)")
_MARKDOWN = "body"
for _mark in _MARKS:
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, {_mark}, 'g')"

ORACLE = {
    "article_fields": f"WITH {_ARTICLE} SELECT page_id, {_field('title', 'Untitled Article')} AS title, {_field('author', '')} AS author, {_field('site', '')} AS site, sha256(body) AS body_sha FROM b",
    "page_markdown": f"WITH {_ARTICLE}, m AS (SELECT page_id, regexp_replace({_MARKDOWN}, '^\\s+|\\s+$', '', 'g') || chr(10) AS md FROM b) SELECT page_id, length(md) AS n_chars, sha256(md) AS sha FROM m",
    "heading_chunks": f"""WITH t AS (SELECT doc_id, string_split(regexp_replace({_MD}, '\\n\\z', ''), {_NL}) AS lines FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM t),
        h AS (SELECT doc_id, no, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(regexp_extract(line, '^#+\\s+(.*\\S)', 1), '^#+|#+$', '', 'g')) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S')),
        d AS (SELECT *, i + least(0, min(level - i) OVER (PARTITION BY doc_id ORDER BY no)) AS depth FROM h),
        p AS (SELECT doc_id, no, i, depth, {_DEPTHS} FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
        q AS (SELECT doc_id, no, array_to_string(list_slice([p1, p2, p3, p4, p5, p6], 1, depth), ' > ') AS path FROM p),
        s AS (SELECT l.doc_id, l.no, line, coalesce(last_value(q.no IGNORE NULLS) OVER w, 1) AS begun, coalesce(last_value(path IGNORE NULLS) OVER w, '') AS path, count(q.no) OVER w AS section
          FROM l LEFT JOIN q ON l.doc_id = q.doc_id AND l.no = q.no WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.no ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT doc_id, min(no) AS start_line, max(no) AS end_line, min(path) AS heading_path, regexp_replace(string_agg(line, {_NL} ORDER BY no), '^\\s+|\\s+$', '', 'g') AS body FROM s GROUP BY doc_id, section, (no - begun) // {LINES})
        SELECT doc_id, start_line, end_line, heading_path, sha256(body) AS sha256 FROM c WHERE body <> ''""",
    "parent_spans": f"""WITH RECURSIVE t AS (SELECT doc_id, replace(translate(text, '`~', ''), {_NL}, {_NL} || {_NL}) AS md FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(string_split(md, {_NL})) AS line, generate_subscripts(string_split(md, {_NL}), 1) AS no FROM t),
        o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
        b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS n, CAST(pos + length(line) - length(regexp_replace(line, '^\\s+', '')) AS BIGINT) AS s, CAST(pos + length(regexp_replace(line, '\\s+$', '')) AS BIGINT) AS e FROM o WHERE regexp_matches(line, '\\S')),
        g AS (SELECT doc_id, n, s, e, n AS first, s AS gs, e - s > {SPAN} AS wide FROM b WHERE n = 1
          UNION ALL SELECT b.doc_id, b.n, b.s, b.e, CASE WHEN g.wide OR b.e - b.s > {SPAN} OR b.e - g.gs > {SPAN} THEN b.n ELSE g.first END, CASE WHEN g.wide OR b.e - b.s > {SPAN} OR b.e - g.gs > {SPAN} THEN b.s ELSE g.gs END, b.e - b.s > {SPAN}
          FROM g JOIN b ON b.doc_id = g.doc_id AND b.n = g.n + 1),
        w AS (SELECT doc_id, n, s, e, unnest(generate_series(s, e - 1, {SPAN - OVERLAP})) AS pos FROM g WHERE wide),
        x AS (SELECT w.*, substr(md, pos + 1, least({SPAN}, e - pos)) AS piece FROM w JOIN t USING (doc_id) WHERE pos = s OR pos - {SPAN - OVERLAP} + {SPAN} < e),
        y AS (SELECT doc_id, n, pos + length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS a, length(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) AS size FROM x)
        SELECT doc_id, min(s) AS span_start, max(e) AS span_end, 'blocks' AS kind, first AS first_block, max(n) AS last_block FROM g WHERE NOT wide GROUP BY doc_id, first
        UNION ALL SELECT doc_id, a, a + size, 'window', n, n FROM y WHERE size > 0""",
    "effective_dates": """WITH a AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'cn' WHEN 1 THEN 'hk' ELSE 'us' END AS market, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS at FROM orders),
        d AS (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2026-01-01', INTERVAL 1 DAY)) AS DATE) AS day), m AS (SELECT * FROM (VALUES ('cn', 7), ('hk', 8), ('us', 21)) v(market, hour)),
        s AS (SELECT market, day, CAST(day AS TIMESTAMP) + to_hours(hour) AS close FROM d, m WHERE isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN ('01-01', '12-25'))
        SELECT o_orderkey, a.market, s.day AS effective FROM a ASOF JOIN s ON a.market = s.market AND a.at >= s.close""",
    "composition_plan": """WITH c AS (SELECT p_brand AS brand, CAST(p_partkey AS VARCHAR) AS target, p_size - 2 AS score, p_retailprice AS price, p_partkey % 3 = 0 AS is_p, p_partkey % 2 = 0 OR p_partkey % 7 = 0 AS is_s, p_partkey % 5 < 2 AS is_t, string_split(p_type, ' ')[1] AS neg FROM part WHERE p_size > 2),
        b AS (SELECT brand, first(target ORDER BY is_p DESC, CASE WHEN is_p THEN -price END, score DESC, target) AS best, first(neg ORDER BY is_p DESC, CASE WHEN is_p THEN -price END, score DESC, target) AS against FROM c GROUP BY brand),
        r AS (SELECT brand, target, score, 'primary' AS role FROM c JOIN b USING (brand) WHERE target = best UNION ALL SELECT brand, target, score, 'rejected' FROM c JOIN b USING (brand) WHERE target <> best AND neg = against
          UNION ALL SELECT brand, target, score, 'supporting' FROM c JOIN b USING (brand) WHERE target <> best AND neg <> against AND is_s AND score >= 18 UNION ALL SELECT brand, target, score, 'style' FROM c JOIN b USING (brand) WHERE target <> best AND neg <> against AND is_t AND score >= 14),
        n AS (SELECT brand, target, role, row_number() OVER (PARTITION BY brand, role ORDER BY score DESC, target) AS place FROM r)
        SELECT * FROM n WHERE place <= CASE role WHEN 'supporting' THEN 3 WHEN 'style' THEN 2 ELSE place END""",
    "dividends": f"""WITH {_ADJUSTED}, p AS (SELECT p_partkey AS symbol, DATE '1996-01-01' + p_size AS day FROM part WHERE p_size % 3 = 0),
        h AS (SELECT p.symbol, p.day, coalesce(sum(CASE side WHEN 'sell' THEN -qty ELSE qty END), 0.0) AS before FROM p LEFT JOIN trades t ON t.symbol = p.symbol AND t.day < p.day GROUP BY 1, 2)
        SELECT symbol, day, before, CASE WHEN before > 1e-8 THEN before * 0.25 ELSE 0.0 END AS cash FROM h""",
    "split_fifo": f"WITH RECURSIVE {trading.all_symbols(_ADJUSTED)}, {trading._FIFO} SELECT symbol, sell_id, buy_id, {S.q('qty', 4)} AS qty, {S.q('cost', 3)} AS cost, {S.q('proceeds', 3)} AS proceeds FROM fifo",
}
