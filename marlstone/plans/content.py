"""Content queries: texts, pages, duplicates and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.numeric import quantise
from marlstone.operators import dedup as D
from marlstone.operators import relational as R
from marlstone.plans import sql as S
from marlstone.sources.tables import table


#: A question that holds secrets.
ASKED = "why does sk-thing_0123456789 of ANSTINTHESES9 end in THETHATTHINGS ?"


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.readable(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", out.alias("t"), X.html_title(F.col("html")).alias("title")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("sha"), "title")


def page_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("title", F.coalesce(X.html_title(F.col("html")), F.lit("")))
    return D.reason(pages, "page_id", "html", "url", "title")


def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.normal_url(F.col("url")).alias("address"))


def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all pages that are alike, whole and at the reference's similarity."""
    pages = table(spark, sf_dir, "pages").select(F.coalesce(X.html_title(F.col("html")), F.lit("")).alias("title"))
    return D.title_pairs(pages, "title").select("a", "b", quantise(F.col("similarity"), 6).alias("similarity"))


def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.windows(F.col("text"), 512, 64)).alias("w"))
    return cut.select("doc_id", "w.number", "w.start", F.sha2(F.col("w.text"), 256).alias("sha"))


def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.windows(F.col("text"), 512, 64)).alias("w")).select("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("w.number").cast("string")).alias("chunk"), "w.number")
    w = Window.partitionBy("doc_id").orderBy("number")
    return cut.select("chunk", F.lag("chunk").over(w).alias("before"), F.lead("chunk").over(w).alias("after"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform(found, lambda s: F.length(s))), F.lit(0)).cast("long").alias("longest"), F.sha2(F.array_join(found, "\n"), 256).alias("sha"))


def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence for a question that holds a key."""
    out = X.redacted(F.col("text"), ASKED)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(out, 256).alias("sha"), (out != F.col("text")).alias("changed"))


def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", X.normal_title(name).alias("title"), X.slug(name).alias("slug"), X.concept(F.col("p_brand")).alias("concept"))


def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_type")).alias("slug"))
    return R.unique_slugs(slugs, "slug", "p_partkey").select("p_partkey", "unique_slug")


def link_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", X.link_stem(F.col("word")).alias("stem"))


def effective_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.effective_length(F.concat("text", F.lit("\U0001f600"))).cast("long").alias("n"))


def quote_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(X.holds_quote(F.col("text"), F.lit("Licensed  under the\nApache License"))).select("doc_id")


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the new state of the documents of the same ids."""
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.fingerprint(F.col("text")).alias("sha"))
    new = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), X.fingerprint(F.col("html")).alias("sha"))
    return R.changes(old, new, "id", "sha")


def long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents by size, as a lint sees them."""
    n = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("section")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("lang")).alias("langs"))
    return n.select("section", "n", F.array_join("langs", ",").alias("langs"), F.when(F.col("n") > 200, "too many").when(F.col("n") > 100, "many").when(F.col("n") > 50, "some").otherwise("fine").alias("lint"))


def ambiguous_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(X.slug(F.col("p_name")).alias("slug")).agg(F.count_distinct("p_brand").alias("sections")).filter("sections > 1")


def quality_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's record lacks, rule by rule."""
    rules = [("short", F.length("text") < 40), ("count", F.col("n_chars") != F.length("text")), ("no-language", F.col("lang").isNull()), ("link", F.contains("text", F.lit("http"))), ("digits", F.regexp_count("text", F.lit("[0-9]")) > 20)]
    errors = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(errors, ",").alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (fingerprints, page_texts, page_reasons, page_addresses, title_pairs, text_windows, chunk_neighbours, sentence_counts, redacted_texts, title_forms, unique_slugs, link_stems, effective_lengths, quote_holders, content_changes, long_pages, ambiguous_slugs, quality_errors)
}


def _r(x: str, pattern: str, to: str = "") -> str:
    to, pattern = to.replace("$1", "\\1"), pattern.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _canonical(x: str) -> str:
    lines = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g')"
    return _r(f"regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g')", r"^\s+|\s+$")


def _slug(x: str, empty: str = "chunk") -> str:
    made = _r(_r(f"lower({x})", "[^a-z0-9]+", "-"), "^-+|-+$")
    return f"CASE WHEN {made} = '' THEN '{empty}' ELSE {made} END"


def _title(x: str) -> str:
    return f"trim({_r(f'lower({x})', '[^a-z0-9一-鿿]+', ' ')})"


def _readable(x: str) -> str:
    out = _r(x, "(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    out = _r(out, "(?is)<!--.*?-->", " ")
    out = f"regexp_replace({out}, '(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table|blockquote)>|<br */?>', chr(10), 'g')"
    out = _r(out, "<[^>]+>", " ")
    for name, mark in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{name}', '{mark}')"
    out = f"regexp_replace({_r(out, '[ \\t]+', ' ')}, ' ?\\n ?', chr(10), 'g')"
    return _r(f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')", r"^\s+|\s+$")


def _html_title(x: str) -> str:
    tag = lambda p: f"nullif(trim({_r(f'regexp_extract({x}, ' + chr(39) + p + chr(39) + ', 1)', '<[^>]+>')}), '')"
    return f"coalesce({tag('(?is)<meta[^>]+property=\"og:title\"[^>]+content=\"([^\"]*)\"')}, {tag('(?is)<h1[^>]*>(.*?)</h1>')}, {tag('(?is)<title[^>]*>(.*?)</title>')})"


def _url(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '[?#].*$', ''), '^[A-Za-z]+://(www\\.)?', '')"
    return f"regexp_replace(lower(regexp_extract({bare}, '^[^/]*', 0)) || regexp_extract({bare}, '/.*$', 0), '/+$', '')"


def _redacted(x: str) -> str:
    for secret in ("sk-thing_0123456789", "ANSTINTHESES9", "THETHATTHINGS"):
        x = f"replace({x}, '{secret}', '[REDACTED]')"
    for pattern in (r"\b(?:sk|pk|ghp|github_pat|xox[baprs]?|ya29|AIza)[A-Za-z0-9_\-]{8,}\b", r"\b[A-Z][A-Z0-9_]{11,}\b", r"\b[A-Za-z0-9_\-]{24,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{12,}\b"):
        x = _r(x, pattern, "[REDACTED]")
    return x


_WINDOWS = """windows AS (SELECT doc_id, k AS number, k * 448 AS start, substr(text, k * 448 + 1, 512) AS t
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 64) / 448.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0))"""
_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\\n]+[.!?。！？]*'), lambda s: trim(s)), lambda s: s <> '')"
_STEM = "CASE WHEN length(word) > 5 AND word LIKE '%ies' THEN regexp_replace(word, 'ies$', '') || 'y' WHEN length(word) > 5 AND word LIKE '%es' THEN regexp_replace(word, 'es$', '') WHEN length(word) > 4 AND word LIKE '%s' THEN regexp_replace(word, 's$', '') ELSE word END"

ORACLE = {
    "fingerprints": f"WITH f AS (SELECT doc_id, sha256({_canonical('text')}) AS fingerprint FROM documents) SELECT doc_id, fingerprint, min(doc_id) OVER (PARTITION BY fingerprint) AS first FROM f",
    "page_texts": f"SELECT page_id, length(t) AS n_chars, sha256(t) AS sha, title FROM (SELECT page_id, {_readable('html')} AS t, {_html_title('html')} AS title FROM pages)",
    "page_reasons": f"""WITH m AS (SELECT page_id, sha256({_canonical("html")}) AS e, {_url("url")} AS u, {_title(f"coalesce({_html_title('html')}, '')")} AS t FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY e) AS fe, min(page_id) OVER (PARTITION BY u) AS fu, min(page_id) OVER (PARTITION BY t) AS ft FROM m)
        SELECT page_id, CASE WHEN fe < page_id THEN 'exact' WHEN fu < page_id AND u <> '' THEN 'url' WHEN ft < page_id AND t <> '' THEN 'title' ELSE 'new' END AS reason,
        CASE WHEN fe < page_id THEN fe WHEN fu < page_id AND u <> '' THEN fu WHEN ft < page_id AND t <> '' THEN ft END AS of FROM f""",
    "page_addresses": f"SELECT page_id, {_url('url')} AS address FROM pages",
    "title_pairs": f"""WITH t AS (SELECT DISTINCT {_title(f"coalesce({_html_title('html')}, '')")} AS t FROM pages), w AS (SELECT t, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w FROM t WHERE t <> ''),
        p AS (SELECT a.t AS a, b.t AS b, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS s FROM w a JOIN w b ON a.t < b.t)
        SELECT a, b, {S.q("s", 6)} AS similarity FROM p WHERE s >= 0.85""",
    "text_windows": f"WITH {_WINDOWS} SELECT doc_id, number, start, sha256(t) AS sha FROM windows",
    "chunk_neighbours": f"WITH {_WINDOWS}, c AS (SELECT doc_id, number, doc_id || '#' || number AS chunk FROM windows) SELECT chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY number) AS before, lead(chunk) OVER (PARTITION BY doc_id ORDER BY number) AS after FROM c",
    "sentence_counts": f"SELECT doc_id, len(s) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest, sha256(array_to_string(s, chr(10))) AS sha FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)",
    "redacted_texts": f"SELECT doc_id, sha256(t) AS sha, t <> text AS changed FROM (SELECT doc_id, text, {_redacted('text')} AS t FROM documents)",
    "title_forms": f"SELECT p_partkey, {_title('n')} AS title, {_slug('n')} AS slug, {_slug(_r('p_brand', '([a-z0-9])([A-Z])', '$1-\\2'), '')} AS concept FROM (SELECT *, p_name || ' ' || p_type AS n FROM part)",
    "unique_slugs": f"WITH s AS (SELECT p_partkey, {_slug('p_type')} AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s) SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS unique_slug FROM n",
    "link_stems": f"WITH w AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM documents) SELECT word, {_STEM} AS stem FROM w",
    "effective_lengths": "SELECT doc_id, length(text) + 2 AS n FROM documents",
    "quote_holders": "SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'licensed under the apache license')",
    "content_changes": f"""WITH o AS (SELECT doc_id AS id, sha256({_canonical("text")}) AS a FROM documents), n AS (SELECT page_id AS id, sha256({_canonical("html")}) AS b FROM pages)
        SELECT coalesce(o.id, n.id) AS id, CASE WHEN a IS NULL THEN 'first-seen' WHEN b IS NULL THEN 'gone' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id""",
    "long_pages": "SELECT source AS section, count(*) AS n, array_to_string(list_sort(list_distinct(array_agg(lang) FILTER (WHERE lang IS NOT NULL))), ',') AS langs, CASE WHEN count(*) > 200 THEN 'too many' WHEN count(*) > 100 THEN 'many' WHEN count(*) > 50 THEN 'some' ELSE 'fine' END AS lint FROM documents GROUP BY source",
    "ambiguous_slugs": f"SELECT {_slug('p_name')} AS slug, count(DISTINCT p_brand) AS sections FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "quality_errors": "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN n_chars <> length(text) THEN 'count' END, CASE WHEN lang IS NULL THEN 'no-language' END, CASE WHEN contains(text, 'http') THEN 'link' END, CASE WHEN len(regexp_extract_all(text, '[0-9]')) > 20 THEN 'digits' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents",
}
