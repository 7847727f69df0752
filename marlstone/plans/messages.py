"""Queries on messages: conversations as reports that a channel takes in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import messages as M
from marlstone.sources.tables import table

#: Bytes of a chunk with its mark, and words of one without.
BYTES, WORDS = 240, 120


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, said): a conversation's turns in order, each under its role; users' questions are parted by rules. A conversation is a message, and so one row."""
    turn = F.concat(F.when(F.col("role") == "user", "\n---\n").otherwise("\n"), F.lit("### "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("said")))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("said"))


def _told(reports: DataFrame, chunks: Column) -> DataFrame:
    return reports.select("conv_id", F.posexplode(chunks).alias("place", "chunk")).select("conv_id", F.col("place").cast("long").alias("place"), F.octet_length("chunk").cast("long").alias("n_bytes"), F.sha2("chunk", 256).alias("sha"))


def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_reports(spark, sf_dir), M.chunks_by_bytes(F.col("said"), BYTES, marked=True))


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_reports(spark, sf_dir), M.chunks_by_words(F.col("said"), WORDS))


QUERIES = {f.__name__: f for f in (byte_chunks, word_chunks)}


def _quoted(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


def _oracle(budget: int, words: bool, mark: int) -> str:
    size = (lambda x: f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))") if words else (lambda x: f"strlen({x})")
    suffix = len(M.SUFFIX) if words else len(M.SUFFIX.encode())
    most = budget - mark
    parts = [
        """said AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN chr(10) || '---' || chr(10) ELSE chr(10) END || '### ' || coalesce(role, '') || chr(10) || coalesce(text, ''), '' ORDER BY turn) AS said FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)""",
        f"i0 AS (SELECT conv_id AS id, [0] AS path, said AS text, '' AS tail, {size('said')} AS size, {most} AS most, {most} AS budget, '0' AS run FROM said)",
    ]
    for k, (needle, opens, between) in enumerate(M.SEPARATORS):
        long = f"{size('text')} > budget AND contains(text, {_quoted(needle)})"
        limit = "budget" if words else f"budget - {len(between)}"
        parts.append(f"p{k} AS (SELECT *, len(string_split(text, {_quoted(needle)})) AS n, unnest(string_split(text, {_quoted(needle)})) AS part, unnest(range(len(string_split(text, {_quoted(needle)})))) AS j FROM i{k} WHERE {long})")
        parts.append(f"q{k} AS (SELECT *, CASE WHEN j > 0 THEN {_quoted(opens)} ELSE '' END || part AS own FROM p{k})")
        parts.append(f"""i{k + 1} AS MATERIALIZED (SELECT * FROM i{k} WHERE NOT ({long}) UNION ALL SELECT id, list_append(path, j), own, CASE WHEN j = n - 1 THEN tail ELSE {_quoted(between)} END, {size('own')} + {len(between)}, {limit}, budget - {len(between)},
            run || '/{k}' || CASE WHEN {size('own')} + {len(between)} > {limit} THEN '.' || j ELSE '' END FROM q{k})""")
    last = f"i{len(M.SEPARATORS)}"
    room = f"(CASE WHEN budget > {suffix} THEN budget - {suffix} ELSE greatest(1, budget) END)"
    fit = f"list_filter(range({room}, 0, -1), lambda k: {size(f'substr(text, pos, k)')} <= {room})[1]"
    whole = fit if words else f"({fit} - CASE WHEN strlen(substr(text, pos, {fit})) = {room} AND strlen(substr(text, pos + {fit} - 1, 1)) > 1 AND {fit} > 1 THEN 1 ELSE 0 END)"
    end = _quoted(M.SUFFIX)
    parts += [
        f"cut AS (SELECT id, path, text, tail, budget, run, 1 AS pos, 0 AS n, 0 AS k FROM {last} WHERE {size('text')} > budget UNION ALL SELECT id, path, text, tail, budget, run, CAST(pos + w AS INTEGER), CAST(w AS INTEGER), k + 1 FROM (SELECT *, {whole} AS w FROM cut WHERE pos <= length(text)))",
        "pieces AS (SELECT *, substr(text, pos - n, n) AS piece FROM cut WHERE k > 0)",
        "lasts AS (SELECT id, path, greatest(1, max(CASE WHEN NOT regexp_full_match(piece, '\\s*') THEN k ELSE 1 END)) AS top FROM pieces GROUP BY ALL)",
        f"""items AS (SELECT id, path, text, tail, size, most, run FROM {last} WHERE {size('text')} <= budget UNION ALL
            SELECT id, list_append(path, k), CASE WHEN k = top OR budget <= {suffix} THEN piece ELSE piece || {end} END, CASE WHEN k = top THEN tail ELSE '' END, 0, 0, run || '!' || k FROM pieces JOIN lasts USING (id, path) WHERE k <= top)""",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS rn FROM items)",
        """packed AS (SELECT id, rn, run, size AS used, 0 AS n FROM placed WHERE rn = 1 UNION ALL SELECT x.id, x.rn, x.run, CASE WHEN g.run = x.run AND g.used + x.size <= x.most THEN g.used + x.size ELSE x.size END, CASE WHEN g.run = x.run AND g.used + x.size <= x.most THEN g.n ELSE g.n + 1 END
            FROM packed g JOIN placed x ON x.id = g.id AND x.rn = g.rn + 1)""",
        "joined AS (SELECT id, n, string_agg(text || tail, '' ORDER BY rn) AS chunk FROM packed JOIN placed USING (id, rn) GROUP BY id, n)",
        "filled AS (SELECT id, n, chunk FROM joined j WHERE chunk <> '' OR (n = 0 AND NOT EXISTS (SELECT 1 FROM joined o WHERE o.id = j.id AND o.chunk <> '')))",
        "numbered AS (SELECT id, chunk, row_number() OVER (PARTITION BY id ORDER BY n) AS place, count(*) OVER (PARTITION BY id) AS total FROM filled)",
    ]
    told = f"chunk || {_quoted(M.MARK.split('{}')[0])} || place || '/' || total" if mark else "chunk"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT id AS conv_id, place - 1 AS place, strlen({told}) AS n_bytes, sha256({told}) AS sha FROM numbered"


ORACLE = {"byte_chunks": _oracle(BYTES, False, M.MARK_BYTES), "word_chunks": _oracle(WORDS, True, 0)}
