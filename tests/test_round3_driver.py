"""What of a fit comes to the driver, and what tasks hold of graphs, streams and JSON."""

from pyspark.sql import DataFrame

from marlstone.llm import quality
from marlstone.llm.queries import ship
from tests.conftest import SMALL


def test_vectors_of_the_sample_stay_off_the_driver(spark, monkeypatch):
    ship(spark)
    docs, sent = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name in ("collect", "first"):
        def counted(self, f=getattr(type(docs), name)):
            out = f(self)
            rows = out if isinstance(out, list) else [out]
            sent.append(sum(len(x) for row in rows if row for x in row if isinstance(x, (bytes, bytearray))))
            return out

        monkeypatch.setattr(type(docs), name, counted)
    found = quality.fit(docs)
    assert isinstance(docs, DataFrame) and found.weight.any() and max(sent) <= 4 * quality.BUCKETS
    assert 0 < docs.select(quality.scored(docs.text, found).alias("x")).filter("x.score < 0.3").count() < docs.count()


def test_a_fit_without_a_drawn_text(spark):
    """Equal rows are drawn together or not at all."""
    docs = spark.range(400).selectExpr("7L AS doc_id", "'plain words of one text' AS text")
    found = quality.fit(docs, sample=1)
    assert found.weight.shape == (quality.BUCKETS,)


def test_only_edges_of_a_hop_are_deduplicated(spark, monkeypatch):
    from marlstone.operators import retrieval as R

    # 1 -> 2 -> 3, 4 -> 2, 1 -> 2 again; 50,000 edges that nothing leads to; a null end counts as a node
    near = [(1, 2), (1, 2), (2, 3), (4, 2), (2, None), (3, 5)]
    edges = spark.createDataFrame(near, "a long, b long").union(spark.range(50_000).selectExpr("id + 100", "id + 100000")).repartition(2)
    seeds = spark.createDataFrame([(1,), (1,)], "node long")
    want = {(2, 0.12), (3, 0.04), (4, 0.025), (None, 0.04)}
    for most in (R.BROADCAST, 0):
        monkeypatch.setattr(R, "BROADCAST", most)
        frame = R.graph_boosts(seeds, edges)
        assert {tuple(r) for r in frame.collect()} == want
    monkeypatch.undo()
    assert "LeftSemi" in R.graph_boosts(seeds, edges)._jdf.queryExecution().optimizedPlan().toString()


def test_sound_json_is_read_as_it_stands(spark):
    from pyspark.sql import functions as F

    from marlstone.functions import jsonish as J

    kind = "a struct<b:array<int>, c:string>, d double, e boolean"
    sound = ['{"a": {"b": [1, 2], "c": "x\\" } {\\u00e9"}, "d": -1.5e3, "e": null} so {', 'Here:\n```json\n{"a": {"b": [], "c": "```"}, "d": 0}\n```\n{}', "{}", '{"e":true\n}', '{"a": {"x": {"y": [1]}}, "e": false}']
    broken = ['{"a": {"b": [1, 2,], "c": "x"}, "d": 1}', '{"a": {"b": [1 2}, "d": 01', "{'d': 2.5, e: True}", '{"d": 1 "e": true}', '{"a": {"b": [[[[[[1]]]]]], "c": "\\x"}, "e": true}', '{"d": 1 /* } */, "e": true}', '[{"d": 1}]', "none", None]
    rows = spark.createDataFrame([(t,) for t in sound + broken], "t string")
    taken = rows.select(F.regexp_extract(J._begun(F.col("t")), J._sound(J._LEVELS), 1).alias("x")).collect()
    assert [bool(r.x) for r in taken] == [True] * len(sound) + [False] * len(broken)
    assert rows.select(J.read_json(F.col("t"), kind).alias("x")).collect() == rows.select(F.from_json(J.mended(F.col("t")), kind).alias("x")).collect()


def test_keys_of_a_stream_are_called_for_in_groups(spark, tmp_path, monkeypatch):
    from marlstone.streaming import suppression as U

    assert U.GROUPS < 10_000
    monkeypatch.setattr(U, "GROUPS", 3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "user long, kind string, ts timestamp, id long"

    def fed(hours):
        """One more file, and the stream run to its end again, from its state."""
        rows = [(u, k, h, u or 0) for h in hours for u, k in ((1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None))]
        frame = spark.createDataFrame(rows, "user long, kind string, h double, n long").selectExpr("user", "kind", "timestamp_seconds(1700000000 + h * 3600) AS ts", "CAST(h * 100 AS LONG) AS id")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = U.ttl_dedup_stream(spark.readStream.schema(kind).parquet(source), ["user", "kind"], "ts", "id", 6 * 3600.0)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    fed([0.0, 5.0, 7.0])
    fed([12.5, 13.0])
    fed([30.0, 31.0])
    found = spark.read.parquet(out).groupBy("user", "kind").agg(F_sorted("id")).collect()
    assert len(found) == 5 and all(r[2] == [0, 700, 1300, 3000] for r in found)


def F_sorted(name):
    from pyspark.sql import functions as F

    return F.sort_array(F.collect_list(name))


def test_titles_of_claims_are_made_once(spark):
    from marlstone.plans import knowledge

    assert knowledge.merged_claims(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
