"""The pipeline's stages on small and odd tables, and its queries."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import queries
from tests.conftest import SMALL
from tests.oracle import compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        if name == "quality_classifier":
            assert all(labels.get(i, 1) == 1 or i not in after for i in before)
            assert sum(labels.get(i) == 1 for i in before - after) <= 2
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == before


KIND = "doc_id long, text string, lang string, source string, n_chars long, found string, score double"


def odd_rows():
    """Odd rows beside enough plain ones to learn from: a null text, an empty one, a null id, long ones, repeated rows and rows of one id, near copies and benchmark items."""
    import duckdb

    con = duckdb.connect()
    plain = con.execute(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet' JOIN '{SMALL}/labels.parquet' USING (doc_id) WHERE quality = 1 AND toxic = 0 AND lang = 'en' AND n_chars > 800 ORDER BY doc_id LIMIT 12").fetchall()
    item = con.execute(f"SELECT text FROM '{SMALL}/benchmark.parquet' WHERE length(text) > 80 ORDER BY item_id LIMIT 1").fetchone()[0]
    rows = [(i, t, lang, "s", len(t), "x", 1.0) for i, t, lang in plain]
    first, second, third = (t for _, t, _ in plain[:3])
    rows += [(9001, None, None, None, None, None, None), (9002, "", "en", "s", 0, None, None), (None, third, "en", "s", 9, None, None), (9003, "x" * 300_000, "en", "s", 1, None, None), (9003, "x" * 300_000, "en", "s", 1, None, None)]
    rows += [(9004, first + " and", "en", "s", 1, None, None), (9004, first + " and", "en", "s", 1, None, None), (9005, second, "en", "s", 1, None, None), (9006, f"{item} {third}", "en", "s", 1, None, None), (9006, "no item", "en", "s", 1, None, None), (None, item, "en", "s", 1, None, None)]
    return rows, [i for i, _, _ in plain]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_keep_these_odd_rows(spark, name, stage):
    rows, plain = odd_rows()
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    out = stage(spark, docs, SMALL)
    kept = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
    every = sorted((r[0] for r in rows), key=str)
    without = lambda *gone: [i for i in every if i not in gone]
    if name == "packing":
        assert set(kept) == set(every)  # null ids, null and empty texts, repeated rows: each is packed
        pieces = out.filter("doc_id = 9003").groupBy("doc_id").agg({"length": "sum"}).first()
        assert out.filter("doc_id IN (9001, 9002)").count() == 2 and pieces is not None
    else:
        assert out.columns == docs.columns
    if name == "near_duplicates":
        # the larger ids of near copies go with all their rows; null ids, null and empty texts stay, and so do the repeated rows of one id
        assert kept == without(9004, 9005)
    if name == "benchmark_decontamination":
        # rows of one id are one document, and so are those of the null id
        assert kept == without(9006, None)
    if name == "language_id":
        # no letters, no language; the long run of one letter is like no text of its size
        assert kept == without(9001, 9002, 9003)
    if name == "quality_classifier":
        # learnt from these rows alone, plain texts stay; a null text is judged as an empty one, and repeated rows alike
        assert set(plain) <= set(kept) and (9001 in kept) == (9002 in kept) and kept.count(9003) in (0, 2) and kept.count(9004) == 2
        # and so it is beside a table with junk of its own
        table = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"found": F.lit("x"), "score": F.lit(1.0)})
        more = {r.doc_id for r in stage(spark, docs.union(table.select(docs.columns)), SMALL).select("doc_id").collect()}
        assert set(plain) <= more and (9001 in more) == (9002 in more)
    assert stage(spark, spark.createDataFrame([], KIND), SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    assert compare(spark, duck(SMALL), SMALL, name, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_language_stage_tells_noise_and_unknown_languages(spark):
    """Short clean texts stay; letters at random and a language that nobody taught go."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text IS NOT NULL AND n_chars > 200").select("doc_id", "text", "lang", "source", "n_chars")
    long = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    clean = [" ".join(t.split()[:n]) for t in long for n in (3, 6, 12)]
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10))) for _ in range(n)) for n in (8, 20, 60, 400) for _ in range(5)]
    other = ["kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"] * 3
    more = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate([*clean, *noise, *other])], docs.schema)
    kept = {r.doc_id - 10**6 for r in corpus_pipeline.language_id(spark, docs.union(more), SMALL).filter("doc_id >= 1000000").collect()}
    assert len(kept & set(range(len(clean)))) >= 0.98 * len(clean)
    assert not kept & set(range(len(clean), len(clean) + len(noise) + len(other)))


def test_middle_scores_are_medians(spark):
    from marlstone.llm import language

    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang")
    profile = language.profiles(texts.filter("lang IS NOT NULL AND text IS NOT NULL"))
    rows = texts.select(language.identified(F.col("text"), profile).alias("x")).select("x.*", language.level(F.col("x.grams")).alias("level")).filter("lang <> 'und'").collect()
    found = language.middle_scores(texts.select("text"), profile)
    assert set(found) == {r.level for r in rows}
    for size, score in found.items():
        own = sorted(int(r.score * 1000) for r in rows if r.level == size)
        assert score == own[(len(own) - 1) // 2] / 1000
