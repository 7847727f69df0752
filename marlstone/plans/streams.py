"""Suppression of repeated events, failing sources and alerts, as batch folds and as streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.files import source_kind
from marlstone.sources.tables import shared_dir, table
from marlstone.streaming import suppression as U

TTL = 6 * 3600.0


def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return U.ttl_dedup(events, ["user_id", "event_type"], "ts", "event_id", TTL).select("event_id", "sent")


def _drained(frame: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream of the rows that are there now puts out."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/out")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return _drained(U.ttl_dedup_stream(events, ["user_id", "event_type"], "ts", "event_id", TTL), spark).select("event_id")


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return U.circuit(calls, "user_id", "ts", "event_id", "ok", failures=2, cooldown=36 * 3600.0).select("event_id", "circuit")


def severe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "signup", "notice").otherwise("info")
    return U.severe(table(spark, sf_dir, "events").withColumn("severity", kinds), "severity", "warning").groupBy("severity").agg(F.count("*").alias("n"))


def fired_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each customer that is a user: a value above 50, within the first ten days."""
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("rule"), F.lit(50.0).alias("above"), F.lit("2024-01-11").cast("timestamp_ntz").alias("expires"))
    return U.fired(table(spark, sf_dir, "events"), rules, "user_id", "ts", "event_id", "value").select("rule", "event_id", "value")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "6 hours", "1 hour")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat("p_name", F.lit(".MD")).alias("url")))
    return pages.groupBy(source_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ttl_dedup, stream_ttl_dedup, circuit_breaker, severe_events, fired_rules, hourly_counts, source_kinds)}

_SENT = f"""WITH RECURSIVE n AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT event_id, user_id, event_type, rn, us AS last_us, true AS sent FROM n WHERE rn = 1 UNION ALL
      SELECT n.event_id, n.user_id, n.event_type, n.rn, CASE WHEN n.us - last_us >= {int(TTL) * 1000000} THEN n.us ELSE last_us END, n.us - last_us >= {int(TTL) * 1000000} FROM r JOIN n ON n.user_id = r.user_id AND n.event_type = r.event_type AND n.rn = r.rn + 1)"""
ORACLE = {
    "ttl_dedup": f"{_SENT} SELECT event_id, sent FROM r",
    "stream_ttl_dedup": f"{_SENT} SELECT event_id FROM r WHERE sent",
    "circuit_breaker": """WITH RECURSIVE n AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        r AS (SELECT event_id, user_id, rn, CASE WHEN bad THEN 1 ELSE 0 END AS fails, CAST(NULL AS BIGINT) AS opened, 'passed' AS circuit FROM n WHERE rn = 1 UNION ALL
          SELECT n.event_id, n.user_id, n.rn, CASE WHEN opened IS NOT NULL AND us - opened < 129600000000 THEN fails WHEN bad THEN fails + 1 ELSE 0 END,
            CASE WHEN opened IS NOT NULL AND us - opened < 129600000000 THEN opened WHEN bad AND (opened IS NOT NULL OR fails + 1 >= 2) THEN us END,
            CASE WHEN opened IS NOT NULL AND us - opened < 129600000000 THEN 'rejected' ELSE 'passed' END FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
        SELECT event_id, circuit FROM r""",
    "severe_events": "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1",
    "fired_rules": "SELECT user_id AS rule, event_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer) AND value > 50 AND ts < TIMESTAMP '2024-01-11' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "hourly_counts": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "source_kinds": "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(trim(url)), '^(https?://github\\.com/[^/]+/[^/]+/?$|git@)|\\.git/?$') THEN 'repo' WHEN regexp_matches(lower(trim(url)), '^https?://') THEN 'url' ELSE 'md' END AS kind FROM (SELECT url FROM pages UNION ALL SELECT p_name || '.MD' FROM part)) GROUP BY kind",
}
