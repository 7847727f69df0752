"""Clustering and near duplicates of vectors, and resampling of documents, against plain programs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from marlstone.llm import clustering, components, embedding_dedup, resampling

# --- resampling ----------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[k : k + m]) for k in range(len(words)) for m in range(1, n + 1) if k + m <= len(words)], len(words)


def plain_resample(docs, target, n, buckets, percent, least, seed):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = Counter(bucket(r) for _, text in docs for r in plain_runs(text, n)[0]), Counter(bucket(r) for text in target for r in plain_runs(text, n)[0])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for key, text in docs:
        runs, words = plain_runs(text, n)
        weight = sum(gain(bucket(r)) for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, words, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ring_gives_the_hashes_of_all_runs(n):
    text = "One two,THREE 4 naïve naïve\tx — ü one"
    words, found = resampling.hashes(text.encode(), n)
    runs, count = plain_runs(text, n)
    assert words == count and sorted(found.tolist()) == sorted(zlib.crc32(r.encode()) for r in runs)
    assert resampling.hashes(b"", n)[0] == 0 and len(resampling.hashes(b" ,", n)[1]) == 0


def test_ring_runs_on_over_pieces(monkeypatch):
    text = ("some words of a long text " * 400).encode()
    whole = resampling.hashes(text, 3)
    monkeypatch.setattr(resampling, "PIECE", 50)
    cut = resampling.hashes(text, 3)
    assert whole[0] == cut[0] == 2400 and np.array_equal(whole[1], cut[1])


@pytest.mark.parametrize("n", [1, 2])
def test_resample_is_that_of_a_plain_program(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "x-y", "你好"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 40, 90])))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " \x00,."), (None, "a null id " * 9), (None, None), (203, docs[5][1]), (3, docs[3][1]), (3, docs[3][1]), (204, "long " * 200_000)]
    target = [" ".join(rng.choices(vocabulary[:10], k=30)) for _ in range(5)] + [None, ""]
    rows = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    aim = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    found = resampling.resample(rows, aim, n, 97, 30, 20, 5).collect()
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found]
    want = plain_resample(docs, target, n, 97, 30, 20, 5)
    assert sorted(map(repr, (r[:5] for r in got))) == sorted(map(repr, (r[:5] for r in want)))
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 1 + len([r for r in want if r[5]])))
    assert sorted((r[5], r[0]) for r in got if r[5]) == sorted((r[5], r[0]) for r in want if r[5])
    picked = resampling.drawn(rows, resampling.resample(rows, aim, n, 97, 30, 20, 5))
    assert picked.columns == rows.columns and {r.doc_id for r in picked.collect()} == {r[0] for r in want if r[5] and r[0] is not None}


def test_resample_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    row = resampling.resample(some, none, least=1, percent=100).first()
    assert (row.n_features, row["rank"]) == (3, 1)


# --- clustering ----------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [q for _, q in first[:k]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c, strict=True))
    nearest = lambda q: min(range(len(centres)), key=lambda c: (far(q, centres[c]), c))
    for _ in range(rounds):
        own = [nearest(q) for _, q in kept]
        for c in range(len(centres)):
            held = [q for (_, q), o in zip(kept, own, strict=True) if o == c]
            if held:
                centres[c] = tuple(sum(x) // len(held) for x in zip(*held, strict=True))
    own = [(i, nearest(q), far(q, centres[nearest(q)])) for i, q in kept]
    by = Counter()
    for _, c, d in own:
        by[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, by[c], sum(by.values()), sha[c]) for i, c, d in own), key=repr)


def vectors(seed, n, dims, groups):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    return (centre[rng.integers(groups, size=n)] + 0.4 * rng.normal(size=(n, dims))).astype(np.float32)


def test_clusters_are_those_of_full_search(spark):
    own = vectors(1, 500, 8, 7)
    rows = [(k, v.tolist()) for k, v in enumerate(own)]
    rows += [(600, None), (601, []), (602, [1.0] * 7), (603, [1.0] * 7 + [None]), (604, [1.0] * 7 + [float("nan")]), (605, [float("inf")] * 8), (606, [0.0] * 8), (None, [0.5] * 8)]
    rows += [rows[3], rows[3], (607, rows[4][1]), (608, rows[4][1])]  # repeated rows, and ties
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, q string").repartition(3)
    assigned, centres = clustering.grouped(table, 5, 6, 8, 4, 1)
    got = sorted((tuple(r) for r in clustering.summary(assigned, centres).collect()), key=repr)
    assert got == plain_clusters(rows, 5, 6, 8, 4, 1)
    assert assigned.agg(F.sum("scans")).first()[0] < 7 * len(got)  # bounds save searches


def test_few_or_no_vectors_to_cluster(spark):
    table = spark.createDataFrame([(5, [0.5] * 4), (6, [0.5] * 4)], "vec_id long, embedding array<float>")
    found = clustering.summary(*clustering.grouped(table, 16, 3, 4)).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in found) == [(5, 0, 0, 0), (6, 0, 0, 0)]
    assert clustering.summary(*clustering.grouped(table.limit(0), 16, 3, 4)).count() == 0
    with pytest.raises(Exception, match="components beyond"):
        clustering.grouped(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<float>"), 2, 1, 4)


# --- near duplicates -----------------------------------------------------------------------------------


def plain_links(rows, least):
    fit = [v is not None and lab is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if f else None for (_, v, _), f in zip(rows, fit, strict=True)]
    linked = [[b for b in range(len(rows)) if a != b and fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least] for a in range(len(rows))]
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least_id = i if len(seen) == 1 else min(rows[b][0] for b in seen)
        out.append((i, len(linked[a]), least_id, i == least_id))
    return sorted(out, key=repr)


def test_links_and_components_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base[rng.integers(60, size=200)] + 0.12 * rng.normal(size=(200, 16)), base[:1] + 0.05 * rng.normal(size=(150, 16))])
    rows = [(k, v.astype(np.float32).tolist(), int(k % 3)) for k, v in enumerate(np.concatenate([base, near]))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None] + [1.0] * 15, 1), (None, rows[0][1], 0), (905, [], 0), (906, [1.0], 0), (907, [2.0], 0)]
    rows += [(908 + k, rows[6][1], 0) for k in range(40)] + [rows[7], rows[7]]  # copies of one vector, and repeated rows
    table = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n int, node string").repartition(5)
    found = sorted((tuple(r) for r in embedding_dedup.near_duplicates(table, recall=0.999999).collect()), key=repr)
    assert found == plain_links(rows, 0.93)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, (np.ones(8) + 0.01 * rng.normal(size=8)).astype(np.float32).tolist(), 1) for k in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    found = embedding_dedup.near_duplicates(table).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(299, 0)} and sum(r.kept for r in found) == 1


def test_no_vectors_to_compare(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_against_all_pairs_on_a_table(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    want = {r[0]: r[1] for r in plain_links(rows, 0.93)}
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert all(found[k] <= want[k] for k in want) and sum(found.values()) >= 0.99 * sum(want.values())


def test_components_of_a_rising_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    write = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(9000, 9001).selectExpr("id AS a", "id + 5 AS b"))
    found = components.components(edges).collect()
    assert {r.label for r in found if r.node <= 2000} == {0} and {r.label for r in found if r.node >= 9000} == {9000} and len(found) == 2003
    assert rounds.count("chosen") <= 20
