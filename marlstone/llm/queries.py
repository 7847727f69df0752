"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import chat, clustering, decontaminate, embedding_dedup, gif, language, licenses, packing, quality, resampling, sharding, warc
from marlstone.llm.ngram_join import jaccard_classes
from marlstone.llm.shared import materialize, read, shared_dir

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, where PYTHONPATH doesn't already lead to it."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_marlstone_sent", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted((ROOT / "marlstone").rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    path = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone.zip"
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    context._marlstone_sent = True


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(more)
    return chat.digests(chat.format_conversations(rows))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        warc.page_number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read(spark, sf_dir, "documents")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(gif.store(read(spark, sf_dir, "documents")), "gif")
    frames = F.col("frames")
    total = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.aggregate(frames, F.lit(0).cast("long"), lambda a, f: a + f["histogram"][k]))
    duration = F.aggregate(frames, F.lit(0), lambda a, f: a + f["delay"])
    return gif.features(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.size("frames"), duration, F.array_join(total.cast("array<string>"), ",")).alias("feature"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.summary(*clustering.grouped(read(spark, sf_dir, "embeddings")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def sent(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: sent(f) for f in (op1_quality, op2_chat, op3_decontaminate, op4_warc, op5_licenses, op6_ngram_jaccard, op7_language, op8_packing, op9_sharding, op10_gif, op11_resampling, op12_clustering, op13_embedding_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op9_sharding": sharding.oracle(), "op11_resampling": resampling.oracle(), "op12_clustering": clustering.oracle(), "op13_embedding_dedup": embedding_dedup.oracle()}
