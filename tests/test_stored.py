"""Changes of stored tables: whole or not at all, safe to retry, and read back."""

import pytest

from pyspark.sql import functions as F

from marlstone.sources import stored
from marlstone.sources.stored import Conflict, Store, absent, added, replaced, whole


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k int, d string, v int")


def held(store, name="t", version=None):
    return sorted((tuple(r) for r in store.read(name, version).collect()), key=repr)


def test_changes_and_versions(spark, store):
    assert store.version() == 0
    with pytest.raises(KeyError):
        store.read("t")
    assert store.commit({"t": whole(rows(spark, (1, "a", 1), (1, "a", 2), (2, "b", 3), (None, None, 4)), "k", "d")}, "one") == 1
    store.commit({"t": replaced(rows(spark, (1, "a", 9), (None, None, 5)), "k", "d")}, "two")
    assert held(store) == sorted([(1, "a", 9), (2, "b", 3), (None, None, 5)], key=repr)
    store.commit({"t": absent(rows(spark, (2, "b", 7), (3, "c", 8), (3, "c", 6), (None, None, 1)), "k", "d")}, "three")
    assert held(store) == sorted([(1, "a", 9), (2, "b", 3), (3, "c", 6), (None, None, 5)], key=repr)
    gone = spark.createDataFrame([(2, "b"), (3, "c")], "k int, d string")
    store.commit({"t": replaced(rows(spark, (3, "c", 0)), "k", "d", scope=gone)}, "four")
    assert held(store) == sorted([(1, "a", 9), (3, "c", 0), (None, None, 5)], key=repr) and len(held(store, version=1)) == 4
    with pytest.raises(ValueError, match="scope"):
        store.commit({"t": replaced(rows(spark, (5, "x", 0)), "k", "d", scope=gone)}, "five")
    with pytest.raises(ValueError, match="keys"):
        store.commit({"t": replaced(rows(spark, (5, "x", 0)), "k")}, "six")
    store.commit({"t": whole(rows(spark).limit(0), "k", "d")}, "seven")
    assert held(store) == []


def test_a_retry_changes_nothing(spark, store):
    for _ in range(3):
        store.commit({"t": added(rows(spark, (1, "a", 1)), "k")}, "same")
    assert store.version() == 1 and len(held(store)) == 1
    for n in range(stored.APPENDS + 3):
        store.commit({"t": added(rows(spark, (1, "a", n)), "k")}, f"n{n}")
    assert len(held(store)) == stored.APPENDS + 4 and len(store._manifest(store.version())["tables"]["t"]["parts"]) == 1


def test_a_writer_killed_halfway_leaves_the_old_state(spark, store, monkeypatch):
    store.commit({"a": whole(rows(spark, (1, "a", 1)), "k"), "b": whole(rows(spark, (2, "b", 2)), "k")}, "first")
    write, calls = store._write, []

    def dies(name, *more):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return write(name, *more)

    monkeypatch.setattr(store, "_write", dies)
    change = {"a": replaced(rows(spark, (1, "a", 10)), "k"), "b": replaced(rows(spark, (2, "b", 20)), "k")}
    with pytest.raises(RuntimeError, match="killed"):
        store.commit(change, "second")
    assert store.version() == 1 and held(store, "a") == [(1, "a", 1)] and held(store, "b") == [(2, "b", 2)]
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed late")))
    with pytest.raises(RuntimeError, match="late"):
        store.commit(change, "second")
    assert held(store, "a") == [(1, "a", 1)]
    monkeypatch.undo()
    assert store.commit(change, "second") == 2 and held(store, "a") == [(1, "a", 10)] and held(store, "b") == [(2, "b", 20)]


def test_of_two_writers_at_a_time_one_fails(spark, store, monkeypatch):
    store.commit({"t": whole(rows(spark, (1, "a", 1)), "k")}, "first")
    publish = store._publish

    def late(version, manifest):
        monkeypatch.undo()
        Store(spark, store.path).commit({"t": added(rows(spark, (2, "b", 2)), "k")}, "other")
        publish(version, manifest)

    monkeypatch.setattr(store, "_publish", late)
    with pytest.raises(Conflict):
        store.commit({"t": added(rows(spark, (3, "c", 3)), "k")}, "mine")
    assert held(store) == [(1, "a", 1), (2, "b", 2)]
    store.commit({"t": added(rows(spark, (3, "c", 3)), "k")}, "mine")
    assert len(held(store)) == 3


def test_only_touched_parts_are_written(spark, store):
    many = spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    store.commit({"t": whole(many, "k")}, "first")
    before = store._manifest(1)["tables"]["t"]["parts"]
    store.commit({"t": replaced(many.filter("k = 7").withColumn("v", F.lit(1)), "k")}, "second")
    after = store._manifest(2)["tables"]["t"]["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and store.read("t").agg(F.sum("v"), F.count("*")).first()[:] == (1, 1000)


def test_an_epoch_is_appended_once(spark, store):
    sink = stored.appends(store, "log", "stream")
    for epoch, values in ((0, [(1, "a", 1)]), (0, [(1, "a", 1)]), (1, [(2, "b", 2)]), (1, [(2, "b", 2)])):
        sink(rows(spark, *values), epoch)
    assert held(store, "log") == [(1, "a", 1), (2, "b", 2)]
