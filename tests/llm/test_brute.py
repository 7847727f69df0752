"""The learnt operators and the templates against plain programs of the same rules, and tokens against the library that defines them."""

import math
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from marlstone.llm import chat, decontaminate, gif, language, packing, quality, queries, shared, sharding, warc
from marlstone.llm.ngram_join import jaccard_classes
from tests.conftest import SMALL

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


# --- quality -------------------------------------------------------------------------------------------


def plain_estimate(patterns, rounds):
    """Expectation-maximisation with loops: {votes: count} -> share of good by votes, prior, and chances of a bad vote by labeller and class."""
    m = len(next(iter(patterns)))
    share = {}
    for votes in patterns:
        bad = [k for k in range(m) if votes[k] == "-"]
        share[votes] = [0.1 if bad else 1.0] + [0.9 / len(bad) if k in bad else 0.0 for k in range(m)]
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = [(sum(n * share[v][c] for v, n in patterns.items()) + 1) / (total + 1 + m) for c in range(m + 1)]
        says = [[0.0] * (m + 1) for _ in range(m)]
        for k in range(m):
            for c in range(m + 1):
                no = sum(n * share[v][c] for v, n in patterns.items() if v[k] == "-") + 0.5
                yes = sum(n * share[v][c] for v, n in patterns.items() if v[k] == "+") + 0.5
                says[k][c] = no / (no + yes)
            says[k][0] = min(says[k][0], 0.01)
            says[k][k + 1] = max(says[k][k + 1], 0.5)
        for votes in patterns:
            likely = [prior[c] * math.prod({"-": says[k][c], "+": 1 - says[k][c], "0": 1.0}[votes[k]] for k in range(m)) for c in range(m + 1)]
            share[votes] = [x / sum(likely) for x in likely]
    return {v: s[0] for v, s in share.items()}, prior, says


def test_label_model_is_that_of_a_plain_program():
    rng = random.Random(2)
    patterns = Counter("".join(rng.choices("-0+", (1, 2, 5))[0] for _ in range(5)) for _ in range(600))
    key = {c: k for k, c in enumerate("-0+")}
    cast = np.array([[key[c] for c in v] for v in patterns])
    model = quality.estimate(cast, np.array(list(patterns.values()), float), rounds=7)
    good, prior, says = plain_estimate(patterns, 7)
    assert np.allclose(model.prior, prior) and np.allclose(model.chance[:, :, 0], says)
    assert np.allclose(model.posterior(cast), [good[v] for v in patterns])
    assert np.allclose(model.accuracy(), [(1 - says[k][0]) * prior[0] + sum(says[k][c] * prior[c] for c in range(1, 6)) for k in range(5)])


def test_scorer_is_that_of_a_plain_program():
    rng = np.random.default_rng(1)
    texts = ["A plain sentence, with its marks.", "", None, "é" * 40, "LOUD!!! " * 9]
    weight = rng.normal(size=quality.BUCKETS).astype(np.float32)
    model = quality.Classifier(quality.NO_MODEL, weight, 0.25)
    found = quality.statistics(pa.array(texts, pa.string()))
    for t, text in enumerate(texts):
        raw, total = (text or "").encode(), 0.25
        grams = [quality.BINS + ((a * 7919 + b * 104729 + c * 15485863) >> 4) % (quality.BUCKETS - quality.BINS) for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]
        total += sum(float(weight[g]) for g in grams) * quality._SCALE / max(1, len(grams))
        for k, name in enumerate(quality.STATISTICS):
            value = float(found[name][t])
            total += float(weight[k * 16 + min(15, int(math.log2(value + 1) if name in ("words", "length") else min(value, 1) * 15))])
        assert math.isclose(model.apply(pa.array(texts, pa.string()))[2][t], 1 / (1 + math.exp(-total)), rel_tol=1e-4)


def test_accuracies_are_put_out(spark):
    cast = np.array([[2, 2], [0, 2], [2, 0]])
    rows = quality.accuracies(spark, quality.estimate(cast, np.array([80.0, 10.0, 10.0])), quality.LABELLERS[:2]).collect()
    assert [r.labeller for r in rows] == ["shouting", "odd marks"] and all(0.5 < r.accuracy <= 1 and r.false_alarms <= 0.01 for r in rows)


# --- language --------------------------------------------------------------------------------------------


def plain_grams(text):
    signs = [c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text.lower()} "]
    signs = [c for k, c in enumerate(signs) if c != " " or k == 0 or signs[k - 1] != " "]
    grams = Counter(c for c in signs if c != " ")
    grams.update(a + b for a, b in zip(signs, signs[1:], strict=False) if a + b != "  ")
    grams.update(a + b + c for a, b, c in zip(signs, signs[1:], signs[2:], strict=False))
    return grams


def plain_rank(grams, most):
    return sorted(grams, key=lambda g: (-grams[g], len(g), [0 if c == " " else ord(c) for c in g]))[:most]


@needs_tables
def test_distances_are_those_of_a_plain_program(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    held = {r.doc_id: r.held_out for r in docs.select("doc_id", language.held_out().alias("held_out")).collect()}
    learnt = {}
    for doc, text, lang in rows:
        if text is not None and lang is not None and not held[doc]:
            learnt.setdefault(lang, Counter()).update(plain_grams(text))
    profile = {lang: {g: k for k, g in enumerate(plain_rank(n, language.PROFILE))} for lang, n in learnt.items()}
    worst = max(map(len, profile.values()))
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    for doc, text, _ in rows:
        top = plain_rank(plain_grams(text or ""), language.RANKED)
        if not any(c.isalpha() for c in text or ""):
            assert found[doc].lang_pred == "und"
            continue
        distance = {lang: sum(abs(p[g] - k) if g in p else worst for k, g in enumerate(top)) for lang, p in profile.items()}
        best = min(sorted(distance), key=distance.get)
        assert found[doc].lang_pred == best and math.isclose(found[doc].score, max(0, 1 - distance[best] / (worst * len(top))))


def test_scripts_and_ties(spark):
    taught = [(1, "привет мир как дела сегодня", "ru"), (2, "γεια σου κόσμε τι κάνεις", "el"), (3, "abc abc", "b"), (4, "abc abc", "a"), (5, "你好世界今天天气很好", "zh")]
    rows = [*taught, (6, "как мир", None), (7, "κόσμε", None), (8, "abc", None), (9, "今天很好", None), (10, "x" * 300_000, None), (11, "१२३", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profile = language.profiles(spark.createDataFrame([(lang, t) for _, t, lang in taught], "lang string, text string"))
    found = {r.doc_id: r.x.lang for r in docs.select("doc_id", language.identified(docs.text, profile).alias("x")).collect()}
    assert [found[k] for k in (6, 7, 8, 9, 11)] == ["ru", "el", "a", "zh", "und"]  # of two profiles that are alike the first by name


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST", 3)
    with pytest.raises(ValueError, match="languages"):
        language.profiles(spark.createDataFrame([(f"l{k}", "some words of a text " * 40) for k in range(9)], "lang string, text string"), 5)


# --- templates -------------------------------------------------------------------------------------------

WORDS = "amber birch cedar delta ember fjord grove heath inlet juniper knoll lagoon meadow north orchard prairie quarry ridge summit thicket upland valley willow yarrow".split()
NAMES = ("Berlin", "Madrid", "Oslo", "Paris", "Rome", "Lima")


def test_random_items_are_found_and_no_others(spark):
    """Items with slots, put into texts verbatim or with other parameters, once or twice, among other words; recall and precision are 1."""
    rng = random.Random(11)

    def item():
        out = []
        for _ in range(rng.randrange(12, 40)):
            out.append(rng.choice(WORDS) + rng.choice(WORDS)[:3])
        for k in range(3, len(out), 7):
            out[k] = rng.choice(["{n}", "{n} km", "{c}"])
        return " ".join(out)

    def filled(form):
        numbers, names = rng.sample(range(2, 900), 40), rng.sample(NAMES, len(NAMES)) * 8
        while "{n}" in form:
            form = form.replace("{n}", str(numbers.pop()), 1)
        while "{c}" in form:
            form = form.replace("{c}", names.pop(), 1)
        return form

    forms = [item() for _ in range(40)]
    items = [filled(f) for f in forms]
    texts, want = [], set()
    for doc in range(150):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 60))) for _ in range(4)]
        for k in rng.sample(range(len(forms)), rng.randrange(3)):
            want.add((doc, k))
            for _ in range(rng.choice((1, 1, 2))):
                parts.insert(rng.randrange(len(parts)), "so " + (items[k] if rng.random() < 0.3 else filled(forms[k])))
        texts.append((doc, ". ".join(parts)))
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_hot_windows_are_dealt_out(spark, monkeypatch):
    items = [(k, "name the capital of peru and say how many people live there now") for k in range(30)]
    docs = spark.createDataFrame([(k, "We ask: name the capital of peru and say how many people live there now.") for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    counts = []
    for most in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST", most)
        counts.append(sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect()))
    assert len(counts[0]) == 1800 and counts[0] == counts[1]


# --- near copies -----------------------------------------------------------------------------------------


@needs_tables
def test_links_are_those_of_brute_force_on_a_real_table(spark):
    """Every link of the documents whose id is divisible by 20, against all, by exact similarity of all their shingles."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    found, sets, holders = {r.doc_id: r for r in jaccard_classes(docs).collect()}, {}, {}
    for r in docs.collect():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (r.text or "").lower())
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r.doc_id]:
            holders.setdefault(s, []).append(r.doc_id)
    for a in sets:
        if a % 20 == 0:
            shared = Counter(b for s in sets[a] for b in holders[s] if b != a)
            assert found[a].n_links == sum(5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n) for b, n in shared.items())


# --- tokens ----------------------------------------------------------------------------------------------


@needs_tables
def test_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    rng, path = random.Random(8), packing.default_tokenizer()
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    spaces = [chr(k) for k in range(0x110000) if chr(k).isspace()] + ["​", "﻿", "᠎", "\r\n", "  "]
    by_kind = {}
    for k in rng.sample(range(0x110000), 60_000):
        if not 0xD800 <= k < 0xE000:
            by_kind.setdefault(unicodedata.category(chr(k)), []).append(chr(k))
    pieces = [c for some in by_kind.values() for c in some[:40]] + spaces + ["don't", "I'LL", "he'd", "1234", "x9", "_", "</s>", "<s>", "<unk>"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(3000)] + spaces
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert all(packing.token_ids(t, path).tolist() == [*w.ids, 1] for t, w in zip(texts, want, strict=True))


# --- archives, media, placement ----------------------------------------------------------------------------


def test_archives_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string, record_id string")
    warc.archive(pages, f"file://{tmp_path}/none")
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0
    os.makedirs(tmp_path / "bare")
    assert warc.read_archive(spark, f"file://{tmp_path}/bare").count() == 0
    pages.drop("record_id").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.queries()["op4_warc"](spark, str(tmp_path)).count() == 0


def test_archives_of_clashing_columns_and_repeated_rows(spark, tmp_path):
    rows = [(5, "http://a", "same", 1, "x"), (5, "http://a", "same", 1, "x"), (7, "http://b", "same", 2, "y"), (None, None, None, 3, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long, digest string")
    warc.archive(pages, f"file://{tmp_path}/some")
    found = sorted((str(warc_id.record_id), warc_id.record_type) for warc_id in warc.read_archive(spark, f"file://{tmp_path}/some").collect())
    assert found == [("<urn:page:5>", "response")] * 2 + [("<urn:page:7>", "revisit"), ("<urn:page:>", "response")]


def test_what_is_no_whole_gif_is_an_error():
    data = gif.encode(bytes(range(256)) * 9 + bytes(range(255, -1, -1)) * 9, rows=4)
    frames = list(gif.decode(data))
    assert len(frames) == 2 and frames[0].canvas is not frames[1].canvas and not np.array_equal(frames[0].canvas, frames[1].canvas)
    for cut in (0, 5, 12, 40, 13 + 768, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            list(gif.decode(data[:cut]))
    at = data.index(b"\x2c") + 11
    with pytest.raises(ValueError):  # a code stream that ends too early
        list(gif.decode(data[:at] + b"\x02\x00\x03\x00;"))


def test_placement_keeps_the_columns_it_finds(spark):
    placed = sharding.place(spark.createDataFrame([(1, "mine", 2)], "doc_id long, slot string, Shard int"))
    assert placed.columns == ["doc_id", "slot", "Shard", "slot_", "shard_"] and placed.first()["slot"] == "mine"


def test_hot_keys_are_attached_like_others(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k % 7 if k < 60 else 99, "x") for k in range(200)], "id long, key long, note string")
    sizes = rows.groupBy("key").count().withColumnRenamed("count", "n").filter("n > 1").withColumn("more", F.col("key") * 2)
    want = sorted(tuple(r) for r in shared.attach(rows, sizes, "key").select("id", "key", "n", "more").collect())
    monkeypatch.setattr(shared, "HOT", 20)
    hot = shared.attach(rows, sizes, "key")
    assert sorted(tuple(r) for r in hot.select("id", "key", "n", "more").collect()) == want and len(want) == 200
    assert "BroadcastHashJoin" in hot._jdf.queryExecution().executedPlan().toString()


def test_links_with_hot_nodes_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 3)
    monkeypatch.setattr("marlstone.llm.ngram_join.BUCKET", 6)
    rng = random.Random(12)
    base, long = [rng.choice(WORDS) + str(k) for k in range(80)], " ".join(str(k) for k in range(60_000))
    texts = [" ".join(w if rng.random() > 0.01 else f"edit{rng.random()}" for w in base) for _ in range(60)] + [long, long + " end", "short one"]
    found = {r.doc_id: r for r in jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().replace(".", " ").split() for t in texts)]
    for a, one in enumerate(sets):
        assert found[a].n_links == sum(5 * len(one & other) >= 4 * len(one | other) for b, other in enumerate(sets) if b != a)


def test_conversations_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", "a", 5), (1, 1, "assistant", "yo", "b", 6)], "conv_id long, turn long, role string, text string, formatted string, part int")
    assert chat.digests(chat.format_conversations(rows)).first().n_turns == 2
