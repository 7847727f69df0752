"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
`documents`; the last returns the packed pieces. Documents with a null id are judged by their texts
alone and are never near copies. Rows of one id are one document: they go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, language, packing, quality
from marlstone.llm.ngram_join import jaccard_classes
from marlstone.llm.queries import ship
from marlstone.llm.shared import materialize, read

#: A text that scores this share of what texts of its size in a known language do is taken as written in one; where no text of its
#: size has taught, this score is enough.
LANGUAGE_SHARE, LANGUAGE_SCORE = 0.5, 0.3


def _named(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got."""
    while name in df.columns:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, or is it, stay.

    Null texts count as empty, and an empty text is judged by what it shows. Very long texts are judged whole. Repeated rows score alike
    and stay or go together. An empty table gives none.
    """
    ship(spark)
    found = _named(docs, "found")
    scored = docs.withColumn(found, quality.scored(F.col("text"), quality.fit(docs)))
    return scored.filter(F.col(f"{found}.score") >= quality.LEAST).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose text is near enough to the profile of a language, for a text of its size.

    Null and empty texts, and those without letters, go. Very long texts are judged whole. Of two profiles as near the first by name
    counts. Documents with a null id or language don't teach, but are judged. Without any that teach all go. Repeated rows stay or go
    together. An empty table gives none.
    """
    ship(spark)
    found = _named(docs, "found")
    taught = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~language.held_out()).select("lang", "text")
    profile = language.profiles(taught)
    least = F.lit(LANGUAGE_SCORE)
    for size, score in language.middle_scores(taught.select("text"), profile).items():
        least = F.when(language.level(F.col(f"{found}.grams")) == size, LANGUAGE_SHARE * score).otherwise(least)
    known = docs.withColumn(found, language.identified(F.col("text"), profile))
    return known.filter((F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= least)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    A group is a connected class: of a chain whose ends aren't copies of each other one stays too. Rows of one id are one document, and go
    where any of its texts is a copy of another's; null ids stay, and null, empty and wordless texts are no copies. Very long
    texts are compared whole. Ties don't arise, as ids of a class differ. An empty table gives none.
    """
    ship(spark)
    others = jaccard_classes(docs).filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay.

    Null and empty texts hold none. Rows of one id, a null one too, are one document and go together. Very long texts are searched
    whole. An empty table gives none; an empty benchmark leaves all.
    """
    held = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(held, docs.doc_id.eqNullSafe(held.doc_id), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token windows that hold the documents.

    A null or empty text is its end id alone; a very long one fills windows of its own. Null ids and repeated rows are packed as they
    are. An empty table gives none.
    """
    ship(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Stages of this pipeline are models and similarity joins, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
