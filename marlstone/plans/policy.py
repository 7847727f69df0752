"""Queries on what retrieval may use and how sure it is, on claims, and on advice in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.numeric import quantise
from marlstone.operators import advice as A
from marlstone.operators import grounding as G
from marlstone.operators import policy as Y
from marlstone.operators import portfolio as PF
from marlstone.operators import retrieval as R
from marlstone.plans import retrieval, trading
from marlstone.plans import sql as S
from marlstone.sources.tables import table

#: Percent of loss that is an alert, and the share of it that is near.
STOP, NEAR = 20.0, 0.8
#: Modes of answers, by the number of the question.
MODES = ("matched",) * 7 + ("overview", "stale-index", "no-match", "fallback")
#: Advice by number, and the direction and position that it means.
ADVICE = (
    ("buy", "up", "long"), ("Do not sell; hold", "not_down", "long"), ("strong sell now", "down", "cash"), ("wait, then buy", "flat", "cash"), ("buy, or wait", "up", "long"), ("建议买入", "up", "long"),
    ("不建议买入，观望", "flat", "cash"), ("avoid adding", "flat", "cash"), ("持有观察", "not_down", "long"), ("watchlist only", "flat", "cash"), ("never sell. Reduce", "flat", "cash"), ("", "flat", "cash"),
)
#: Prices as text by number; {p} is a size.
PRICES = ("{p}", "{p}.50元", "止损：MA5 附近 {p}.25元", "{p}-{p}.75 (MA10 99)", "N/A", "about {p}, or 1,0{p}", "MA20 上方", "(see 12) ")


def retrievable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks of folders; how many are kept, and why not."""
    folder = F.when(F.col("page_id") % 7 == 0, "review/").when(F.col("page_id") % 7 == 1, "private/").when(F.col("page_id") % 7 == 2, "taxonomy\\proposals\\").otherwise("sources/")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("wiki/"), folder, F.col("page_id").cast("string")).alias("path"), F.concat(folder, F.lit("x")).alias("target"), F.when(F.col("page_id") % 11 == 0, "Private").alias("privacy"), "url")
    return Y.retrievable(pages, "path", "target", F.col("privacy"), F.col("url")).groupBy("reason", "kept").agg(F.count("*").alias("n"))


def strong_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    boosts = docs.select("doc_id", (F.pmod("n_chars", F.lit(100)) / 1000.0).alias("boost"), F.col("source").endswith("1").alias("linked"))
    return Y.strong_boosts(boosts, R.bm25(retrieval.lexical(spark, sf_dir), retrieval.QUERY), "doc_id", F.col("linked")).select("doc_id", "boost")


def stitched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.windows(F.col("text"), 512, 64)).alias("w")).select("doc_id", "w.number", F.col("w.text").alias("t"))
    return Y.stitched(cut, "doc_id", "number", "t").select("doc_id", "number", F.length("passage").cast("long").alias("n_chars"), F.sha2("passage", 256).alias("sha"))


def sentence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", F.explode(Y.sentence_contexts(X.sentences(F.col("text")), 1)).alias("c"))
    return cut.select("doc_id", F.col("c.place").cast("long").alias("place"), F.sha2("c.context", 256).alias("sha"))


def claim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", G.claims(F.col("text")).alias("c"))
    return found.select("doc_id", F.size("c").cast("long").alias("claims"), F.sha2(F.array_join("c", "\n"), 256).alias("sha"))


def best_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two claims of each document that meet the question best."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.ranked_claims(F.col("text"), retrieval.QUERY)).alias("place", "claim"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), F.sha2("claim", 256).alias("sha"))


def claim_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim of each document against all that follows it; every third document names its chunk, every second its lines."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"), F.get(G.claims(F.col("text")), F.lit(0)).alias("claim")).filter("claim IS NOT NULL")
    rest = F.substr("said", F.expr("locate(claim, said) + length(claim)"))
    found = rows.select("doc_id", G.validation(F.col("claim"), rest, retrieval.QUERY, F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("v"))
    return found.select("doc_id", F.array_join("v.matched", ",").alias("matched"), "v.coverage", "v.level", "v.confidence")


def conflict_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("a Contradiction with conflict", "is inconsistent", "now OBSOLETE", "low confidence, unknown", "nothing", "两者不一致"))), F.pmod("p_partkey", F.lit(6)).cast("int") + 1)
    found = table(spark, sf_dir, "part").select("p_partkey", G.conflict(F.concat_ws(" ", "p_name", said)).alias("c")).filter("c IS NOT NULL")
    return found.select("p_partkey", "c.kind", "c.severity", "c.matched")


def retrieval_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.signals(retrieval.hits(spark, sf_dir), "query")


def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure retrieval is of its hits for each vector whose number is divisible by 20; some are asked of an index that is missing or stale, or for an overview."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("raw"), F.coalesce(F.col("source").endswith("7"), F.lit(False)).alias("card"))
    found = retrieval.hits(spark, sf_dir).join(docs, "doc_id").withColumn("reason", F.when(F.col("embedding") > 0.5, "semantic-signal").when(F.col("lexical") > 0.5, "lexical-coverage").otherwise("short-query"))
    found = found.filter(F.col("query") % 60 > 0).filter((F.col("query") % 80 > 0) | (F.col("place") == 1))
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.element_at(F.array(*map(F.lit, MODES)), F.pmod(F.col("vec_id") / 20, F.lit(len(MODES))).cast("int") + 1).alias("mode"))
    sure = Y.confidence(asked, found, "query", F.col("place"), F.col("raw"), F.col("reason"), F.col("card") & (F.col("place") <= 3))
    return sure.select("query", "score", "level", "low", F.array_join("reasons", ",").alias("reasons"))


def term_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tokens of each benchmark item, the share that the document of its number holds."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.explode(X.tokens(F.col("text"))).alias("term"))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q"), "text")
    return Y.recall(found, "q", "text", items)


def route_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.array_join(Y.variants(F.col("word")), ",").alias("forms"))


def advice_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(a) for a, _, _ in ADVICE)), F.pmod("p_partkey", F.lit(len(ADVICE))).cast("int") + 1)
    asked = table(spark, sf_dir, "part").select("p_partkey", A.stance(said).alias("asked"))
    return asked.select("p_partkey", A.expected(F.col("asked")).alias("direction"), A.held(F.col("asked")).alias("position"))


def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, PRICES)), F.pmod("p_partkey", F.lit(len(PRICES))).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", A.price(F.replace(form, F.lit("{p}"), F.col("p_size").cast("string"))).alias("price"))


def stop_loss_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 positions that are furthest below their average cost, of those near the stop or beyond it."""
    held = PF.valued(PF.positions(trading._portfolio_trades(spark, sf_dir)), trading._prices(spark, sf_dir), trading._rates(spark, sf_dir), F.lit(trading.BASE), F.lit(trading.SNAPSHOT).cast("date"))
    loss = quantise(F.greatest(F.lit(0.0), (F.col("average") - F.coalesce("price", F.lit(0.0))) / F.col("average") * 100), 4)
    near = held.filter("average > 0").select("account", "symbol", loss.alias("loss")).filter(F.col("loss") >= STOP * NEAR)
    return near.withColumn("triggered", F.col("loss") >= STOP).orderBy(F.desc("loss"), "symbol").limit(20)


QUERIES = {
    f.__name__: f
    for f in (retrievable_chunks, strong_boosts, stitched_chunks, sentence_contexts, claim_units, best_claims, claim_validations, conflict_signals, retrieval_signals, retrieval_confidence, term_recall, route_variants, advice_stances, price_texts, stop_loss_near)
}

_ASKED = "[" + ", ".join(f"'{t}'" for t in retrieval.QUERY) + "]"
_SPACES = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\\n]+[.!?。！？]*'), lambda s: trim(s)), lambda s: s <> '')"
_COMPACT = _SPACES.format("coalesce(text, '')")
_ENDED = f"list_filter(list_transform(string_split(regexp_replace({_COMPACT}, '([.!?。！？]) +|[；;]', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: length(s) >= 24)"
_PIECES = "list_filter(list_transform(string_split_regex(s, '(?i)\\b(?:however|therefore|because|although|whereas|while)\\b|[；;]'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: length(p) >= 24)"
_CLAIMS = f"""said AS (SELECT doc_id, text, CASE WHEN len({_ENDED}) > 0 THEN {_ENDED} WHEN {_COMPACT} = '' THEN [] ELSE [{_COMPACT}] END AS said FROM documents),
    rows AS (SELECT doc_id, unnest(said) AS s, unnest(range(len(said))) AS k FROM said), parted AS (SELECT doc_id, k, unnest(CASE WHEN len({_PIECES}) > 0 THEN {_PIECES} ELSE [s] END) AS claim, unnest(range(greatest(1, len({_PIECES})))) AS j FROM rows),
    numbered AS (SELECT doc_id, claim, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS n FROM parted), firsts AS (SELECT doc_id, claim, min(n) AS n FROM numbered GROUP BY ALL),
    claims AS (SELECT doc_id, claim, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS place FROM firsts)"""
_WINDOWS = """w AS (SELECT doc_id, k AS number, regexp_replace(regexp_replace(regexp_replace(substr(text, k * 448 + 1, 512), '\\r\\n?', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 64) / 448.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0)),
    around AS (SELECT doc_id, number, t, lag(t) OVER p AS before, lead(t) OVER p AS after FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY number))"""


def _joined(a: str, b: str) -> str:
    size = f"list_filter(range(180, 39, -1), lambda n: n <= length({a}) AND n <= length({b}) AND right({a}, n) = left({b}, n))[1]"
    return f"CASE WHEN coalesce({a}, '') = '' THEN coalesce({b}, '') WHEN coalesce({b}, '') = '' THEN {a} WHEN {size} IS NULL THEN {a} || chr(10) || chr(10) || {b} ELSE {a} || substr({b}, CAST({size} AS BIGINT) + 1) END"


def _case(values, number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_NAMES = ("lexical", "embedding", "graph", "taxonomy", "metadata")
_PLAIN = ", ".join(f"'{w}'" for w in G.PLAIN)
_CONFLICT = {kind: f"regexp_extract(t, '(?i){pattern}')" for kind, _, pattern in G.CONFLICTS}

ORACLE = {
    "retrievable_chunks": "SELECT reason, reason = 'kept' AS kept, count(*) AS n FROM (SELECT CASE WHEN page_id % 7 IN (0, 2) THEN 'review' WHEN page_id % 7 = 1 OR page_id % 11 = 0 OR regexp_matches(lower(url), '/(private|secrets|sensitive)/') THEN 'sensitive' ELSE 'kept' END AS reason FROM pages) GROUP BY 1, 2",
    "strong_boosts": f"WITH {retrieval._bm25('s', retrieval.QUERY)}, b AS (SELECT doc_id, (n_chars % 100) / 1000.0 AS boost, source LIKE '%1' AS linked FROM documents) SELECT doc_id, boost FROM b WHERE linked OR boost >= 0.045 OR doc_id IN (SELECT doc_id FROM s WHERE score > 0)",
    "stitched_chunks": f"WITH {_WINDOWS}, one AS (SELECT doc_id, number, {_joined('before', 't')} AS x, after FROM around) SELECT doc_id, number, length(passage) AS n_chars, sha256(passage) AS sha FROM (SELECT doc_id, number, {_joined('x', 'after')} AS passage FROM one)",
    "sentence_contexts": f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), n AS (SELECT doc_id, s, unnest(range(len(s))) AS place FROM s) SELECT doc_id, place, sha256(array_to_string(s[greatest(1, place):place + 2], ' ')) AS sha FROM n",
    "claim_units": f"WITH {_CLAIMS} SELECT d.doc_id, count(claim) AS claims, sha256(coalesce(string_agg(claim, chr(10) ORDER BY place), '')) AS sha FROM documents d LEFT JOIN claims c USING (doc_id) GROUP BY d.doc_id",
    "best_claims": f"""WITH {_CLAIMS}, own AS (SELECT doc_id, place, claim, list_distinct({S.tokens("claim")}) AS own FROM claims), scored AS (SELECT doc_id, place, claim, len(list_intersect(own, {_ASKED})) * 3 + least(len(own), 20) / 20.0 AS score FROM own),
        ranked AS (SELECT doc_id, claim, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) - 1 AS place FROM scored) SELECT doc_id, place, sha256(claim) AS sha FROM ranked WHERE place < 2""",
    "claim_validations": f"""WITH {_CLAIMS}, words AS (SELECT doc_id, list_filter({S.tokens("claim")}, lambda t: t NOT IN ({_PLAIN})) AS w, list_distinct({S.tokens(f"substr({_COMPACT}, instr({_COMPACT}, claim) + length(claim))")}) AS held FROM claims JOIN documents USING (doc_id) WHERE place = 0),
        own AS (SELECT doc_id, list_filter(w, lambda t, i: list_position(w, t) = i)[:24] AS own, held FROM words), m AS (SELECT doc_id, own, list_sort(list_intersect(own, held)) AS matched FROM own),
        c AS (SELECT *, {S.q("len(matched) / greatest(1, least(len(own), 16))", 2)} AS coverage, least(1.0, len(list_intersect(own, {_ASKED})) / {float(min(8, len(set(retrieval.QUERY))))}) AS overlap, doc_id % 3 = 0 AS chunk FROM m)
        SELECT doc_id, array_to_string(matched[:10], ',') AS matched, coverage, CASE WHEN coverage >= 0.65 AND chunk THEN 'strong' WHEN coverage >= 0.35 THEN 'partial' ELSE 'weak' END AS level,
          {S.q("least(1.0, 0.35::DOUBLE + overlap * 0.2::DOUBLE + CASE WHEN chunk THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN doc_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0.0 END + CASE WHEN coverage >= 0.65 AND chunk THEN 0.2::DOUBLE WHEN coverage >= 0.35 THEN 0.1::DOUBLE ELSE 0.0 END)", 2)} AS confidence FROM c""",
    "conflict_signals": f"""WITH t AS (SELECT p_partkey, p_name || ' ' || {_case(("a Contradiction with conflict", "is inconsistent", "now OBSOLETE", "low confidence, unknown", "nothing", "两者不一致"), "p_partkey % 6")} AS t FROM part),
        k AS (SELECT p_partkey, t, CASE {" ".join(f"WHEN {x} <> '' THEN '{kind}'" for kind, x in _CONFLICT.items())} END AS kind FROM t)
        SELECT p_partkey, kind, CASE kind WHEN 'stale' THEN 'medium' WHEN 'uncertain' THEN 'low' ELSE 'high' END AS severity, CASE kind {" ".join(f"WHEN '{kind}' THEN {x}" for kind, x in _CONFLICT.items())} END AS matched FROM k WHERE kind IS NOT NULL""",
    "retrieval_signals": f"WITH {retrieval._HITS} " + " UNION ALL ".join(f"SELECT query, '{n}' AS signal, count(*) FILTER (WHERE {n} > 0) AS hits FROM hits GROUP BY query" for n in _NAMES),
    "retrieval_confidence": f"""WITH {retrieval._HITS}, h AS (SELECT hits.*, coalesce(lang = 'en', false) AS raw, coalesce(source LIKE '%7', false) AND place <= 3 AS card FROM hits JOIN documents USING (doc_id) WHERE query % 60 > 0 AND (query % 80 > 0 OR place = 1)),
        g AS (SELECT query, arg_min(total, place) AS top, arg_min(lexical <= 0 AND embedding > 0, place) AS alone, count(*) AS n, count(*) FILTER (WHERE raw) / count(*)::DOUBLE AS raw, max(card) AS card,
          max(CASE WHEN embedding > 0.5 THEN 1.0 WHEN lexical > 0.5 THEN 0.85 ELSE 0.45 END)::DOUBLE AS coverage, {" + ".join(f"max(CASE WHEN {n} > 0 THEN 1 ELSE 0 END)" for n in _NAMES)} AS signals FROM h GROUP BY query),
        p AS (SELECT vec_id AS query, {_case(MODES, f"(vec_id // 20) % {len(MODES)}")} AS mode, least(1.0, greatest(0.0, top) / 1.2::DOUBLE) AS a, least(1.0, n / 3.0::DOUBLE) AS b, least(1.0, signals / 3.0::DOUBLE) AS c, raw, coverage, card, alone, n
          FROM embeddings LEFT JOIN g ON vec_id = query WHERE vec_id % 20 = 0),
        z AS (SELECT *, n IS NULL OR mode IN ('fallback', 'stale-index', 'no-match') AS none, {S.q("least(1.0, greatest(0.0, a * 0.35::DOUBLE + b * 0.15::DOUBLE + c * 0.2::DOUBLE + raw * 0.15::DOUBLE + coverage * 0.15::DOUBLE - CASE WHEN card THEN 0.25::DOUBLE ELSE 0.0 END - CASE WHEN alone THEN 0.1::DOUBLE ELSE 0.0 END))", 3)} AS sc FROM p),
        r AS (SELECT *, list_filter([CASE WHEN a >= 0.7 THEN 'strong-top-score' END, CASE WHEN b >= 0.67 THEN 'multiple-supporting-hits' END, CASE WHEN c >= 0.67 THEN 'multi-signal-retrieval' END, CASE WHEN raw >= 0.5 THEN 'raw-evidence-backed' END,
          CASE WHEN coverage >= 0.85 THEN 'query-coverage-supported' END, CASE WHEN card THEN 'boilerplate-penalty' END, CASE WHEN alone THEN 'embedding-only-penalty' END], lambda x: x IS NOT NULL) AS why FROM z)
        SELECT query, CASE WHEN none THEN 0.0 WHEN mode = 'overview' THEN 0.35 ELSE sc END AS score, CASE WHEN none THEN 'none' WHEN mode = 'overview' THEN 'low' WHEN sc >= 0.75 THEN 'high' WHEN sc >= 0.45 THEN 'medium' ELSE 'low' END AS level,
          CASE WHEN none THEN mode <> 'no-match' WHEN mode = 'overview' THEN true ELSE sc < 0.35 OR (n = 1 AND raw = 0 AND c < 0.67) OR (card AND raw = 0 AND sc < 0.55) END AS low,
          CASE WHEN none THEN CASE mode WHEN 'fallback' THEN 'retrieval-index-unavailable' WHEN 'stale-index' THEN 'retrieval-index-stale' ELSE 'no-retrieval-hits' END WHEN mode = 'overview' THEN 'overview-fallback-not-answer-evidence'
            WHEN len(why) > 0 THEN array_to_string(why, ',') ELSE 'weak-retrieval-signals' END AS reasons FROM r""",
    "term_recall": f"""WITH a AS (SELECT DISTINCT item_id AS q, unnest({S.tokens("text")}) AS term FROM benchmark), d AS (SELECT doc_id AS q, {S.tokens("text")} AS words FROM documents), m AS (SELECT a.q, coalesce(list_contains(words, term), false) AS met FROM a LEFT JOIN d USING (q))
        SELECT q, count(*) FILTER (WHERE met) AS covered, count(*) AS expected, {S.q("CAST(count(*) FILTER (WHERE met) AS DOUBLE) / count(*)")} AS recall FROM m GROUP BY q""",
    "route_variants": f"""WITH w AS (SELECT DISTINCT unnest({S.tokens("text")}) AS word FROM documents), f AS (SELECT word, list_filter([word, CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN left(word, length(word) - 3) || 'y' END, CASE WHEN word LIKE '%s' AND length(word) > 4 THEN left(word, length(word) - 1) END,
        CASE WHEN word LIKE '%ics' AND length(word) > 5 THEN left(word, length(word) - 3) END, CASE WHEN word LIKE '%ic' AND length(word) > 4 THEN left(word, length(word) - 2) END], lambda x: x IS NOT NULL) AS f FROM w)
        SELECT word, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') AS forms FROM f""",
    "advice_stances": f"SELECT p_partkey, {_case([d for _, d, _ in ADVICE], f'p_partkey % {len(ADVICE)}')} AS direction, {_case([p for _, _, p in ADVICE], f'p_partkey % {len(ADVICE)}')} AS position FROM part",
    "price_texts": "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size + 0.25 WHEN 3 THEN p_size + 0.75 WHEN 5 THEN CAST('10' || p_size AS DOUBLE) WHEN 7 THEN 12.0 END AS price FROM part",
    "stop_loss_near": f"""WITH RECURSIVE {trading._PORTFOLIO}, {trading._FIFO}, {trading._HELD}, l AS (SELECT symbol % 50 AS account, symbol, {S.q("greatest(0.0, (cost / held - coalesce(p_retailprice, 0.0)) / (cost / held) * 100)")} AS loss FROM held LEFT JOIN (SELECT * FROM part WHERE p_size % 5 <> 0) ON symbol = p_partkey WHERE cost > 0)
        SELECT *, loss >= {STOP} AS triggered FROM l WHERE loss >= {STOP * NEAR} ORDER BY loss DESC, symbol LIMIT 20""",
}
