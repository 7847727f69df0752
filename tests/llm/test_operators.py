"""The ten operators on small tables: against brute force, as round trips, and on odd rows."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, decontaminate, gif, language, license_rules, licenses, packing, quality, sharding, warc
from marlstone.llm.components import components
from marlstone.llm.ngram_join import jaccard_classes

DOCS = "doc_id long, text string, lang string, score string, slot long"
WORDS = "amber birch cedar delta ember fjord grove heath inlet juniper knoll lagoon meadow north orchard prairie quarry ridge summit thicket upland valley willow yarrow".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 9) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "!!! ???"), (None, "one two three four five six"), (4, "One two, three four five six."), (4, "One two, three four five six."), (5, "one two three four five six"), (6, "ä")]


@pytest.fixture
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- near duplicates --------------------------------------------------------------------------------


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links, up = dict.fromkeys(sets, 0), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * len(sets[a] | sets[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return links, {i: root(i) for i in sets}


def test_jaccard_classes_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows, passage = [], words(rng, 30)
    for _ in range(60):
        rows.append(words(rng, rng.randrange(3, 150)))
    for base in (words(rng, 120), words(rng, 60)):
        for _ in range(130):  # a group larger than a bucket and a block
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            rows.append(" ".join(w))
    rows += [passage + " " + words(rng, 25) for _ in range(40)] + rows[:9]
    rows = list(enumerate(rows))
    monkeypatch.setattr("marlstone.llm.ngram_join.BUCKET", 16)
    monkeypatch.setattr("marlstone.llm.ngram_join.BLOCK_SETS", 50)
    found = {r.doc_id: r for r in jaccard_classes(docs_of(spark, rows)).collect()}
    links, classes = brute_links(rows)
    assert {i: r.n_links for i, r in found.items()} == links
    assert {i: r.class_id for i, r in found.items()} == classes


def test_jaccard_classes_of_odd_rows(odd, empty):
    found = collections.Counter(tuple(r) for r in jaccard_classes(odd).collect())
    assert found == {(1, 1, 0, 1): 1, (2, 2, 0, 1): 1, (3, 3, 0, 1): 1, (None, None, 0, 1): 1, (4, 4, 1, 2): 1, (5, 4, 1, 2): 1, (6, 6, 0, 1): 1}
    assert jaccard_classes(empty).count() == 0


def test_components_follow_long_chains(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# --- quality and language ------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join(" ".join(rng.choice(WORDS)[:3] + rng.choice(WORDS)[-4:] for _ in range(9)).capitalize() + "." for _ in range(n))


def test_quality_tells_junk_without_labels(spark):
    rng = random.Random(2)
    good = [prose(rng, rng.randrange(3, 12)) for _ in range(160)]
    junk = [("buy now " * 60) if k % 3 == 0 else " ".join(w + "*** $$$" for w in words(rng, 60).split()) if k % 3 == 1 else words(rng, 60).upper().replace(" ", "!! ") for k in range(45)]
    rows = list(enumerate(good + junk))
    found = {r.doc_id: r for r in quality.classify(docs_of(spark, rows)).collect()}
    right = sum(found[i].keep == (i < len(good)) for i, _ in rows)
    assert right >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and len(r.votes) == len(quality.LABELLERS) for r in found.values())


def test_quality_of_odd_rows(odd, empty):
    found = quality.classify(odd).collect()
    assert len(found) == len(ODD) and len({r.score for r in found if r.doc_id == 4}) == 1
    assert quality.classify(empty).count() == 0


def test_label_model_finds_who_is_right():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    cast = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 for p in (0.99, 0.97, 0.98)], axis=1)
    cast[rng.random(cast.shape) < 0.1] = 1
    rows, counts = np.unique(cast, axis=0, return_counts=True)
    model = quality.estimate(rows, counts.astype(float), false_alarms=0.05)
    assert ((model.posterior(cast) > 0.5) == truth).mean() > 0.97
    assert (model.accuracy() > 0.9).all()


def test_language_by_profiles(spark, odd, empty):
    rng = random.Random(4)
    stems = {"aa": "the and ing tion with for was her".split(), "bb": "und der sch ung ein nicht ich zu".split()}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(40)), lang, "", 0) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(900, None, "aa", "", 0), (901, "123 !!", "aa", "", 0), (902, rows[0][1], None, "", 0), (None, rows[1][1], "bb", "", 0)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, *_ in rows[:80])
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(80))
    assert (found[900].lang_pred, found[901].lang_pred, found[902].lang_pred, found[None].lang_pred) == ("und", "und", "aa", "bb")
    assert found[900].score == 0 and found[None].held_out is False
    assert language.identify(odd).count() == len(ODD) and language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_profiles_ignore_held_out_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [(held, "zzz zzz zzz", "zz", "", 0), *[(i, "the and with", "aa", "", 0) for i in range(99) if i != held]]
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()} == {"aa"}


# --- decontamination ------------------------------------------------------------------------------------


ITEM = "A train leaves Berlin at 9 o'clock and travels 120 km before the second train from Hamburg leaves with 45 passengers on board"


def held(spark, rows, items=((7, ITEM),)):
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs_of(spark, rows), spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_decontamination_finds_items_and_new_parameters(spark):
    rng = random.Random(1)
    other = ITEM.replace("Berlin", "Madrid").replace("Hamburg", "Sevilla").replace("120", "95").replace("45", "30").replace("9", "7")
    mixed = ITEM + ". " + other + ". " + ITEM.replace("Berlin", "Paris")
    rows = [(1, words(rng, 40) + ". " + ITEM + ". " + words(rng, 40)), (2, other), (3, words(rng, 90)), (4, ITEM.lower()), (5, " ".join(ITEM.split()[:9])), (6, mixed), (None, ITEM)]
    found = held(spark, rows)
    assert set(found) == {(1, 7), (2, 7), (4, 7), (6, 7), (None, 7)}
    assert found[1, 7].verbatim and not found[2, 7].verbatim and found[6, 7].verbatim


def test_decontamination_of_inconsistent_slots(spark):
    text = "In town 12 cats met 30 dogs and later 12 cats met 40 birds while 30 dogs slept near 40 birds all day long"
    same = text.replace("12", "5").replace("30", "6").replace("40", "7")
    changed = "In town 1 cats met 2 dogs and later 3 cats met 4 birds while 5 dogs slept near 6 birds all day long"
    assert set(held(spark, [(1, same), (2, changed)], [(1, text)])) == {(1, 1)}


def test_decontamination_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (3, "too short")], "item_id long, text string")
    assert decontaminate.contaminated(odd, items).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert len(held(spark, [(1, ITEM), (1, ITEM), (2, ITEM * 200)])) == 2


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    assert set(held(spark, [(1, ITEM), (2, "nothing of the kind")])) == {(1, 7)}


# --- licenses --------------------------------------------------------------------------------------------


def test_license_base_is_that_of_brute_force(spark):
    rng, parts = random.Random(3), ["MIT", "License", "license,", "GNU General Public", "Apache", "CC BY", "cc-by", "é", "the", "İ", "mit license", "\n", "a_b", "v2"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)] + ["mit license " * 500]
    rows = [*ODD, *enumerate(texts, 100)]
    found = licenses.summary(licenses.scan(docs_of(spark, rows))).collect()
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    want = collections.Counter()
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
        places = [(k, label) for phrase, label in license_rules.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        want[i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


def test_license_rules_overlap(spark, empty):
    text = "Released under the terms of the GNU Lesser General Public License version 2 1. All rights reserved. SPDX-License-Identifier: BSD-3-Clause License"
    row = licenses.scan(docs_of(spark, [(1, text)])).first()
    kept = [d.label for d in row.found if d.kept]
    assert kept == ["lgpl", "all-rights-reserved", "bsd-3"]
    assert [d.label for d in row.found if not d.kept].count("gpl") >= 1
    assert len(licenses.rules()) > 200 and licenses.scan(empty).count() == 0


# --- chat ---------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark, empty):
    rng, pieces = random.Random(6), ["[INST]", "[/INST]", "<s>", "</s>", "\\", "\\\\[INST]", "<<SYS>>", " ", "\n", "ü", "[ROLE]", "text", "[", "<"]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool\n[x]", None]), None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for conv in [*range(30), None] for turn in range(rng.randrange(1, 9))]
    rows += [(77, k, "assistant" if k % 2 else "user", "x" * 200_000) for k in range(24)] + [(78, 1, "user", "a"), (78, 1, "user", "a")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = formatted.collect()
    found = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert len(found) == 33
    for conv in found:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        told = [(role or "", text or "") for _, _, role, text in own]
        back = [(role, text.decode()) for p in sorted([p for p in parts if p.conv_id == conv], key=lambda p: p.part) for role, text in chat.turns(p.formatted.encode())]
        assert back == told
        loss = "".join(text for role, text in told if role == "assistant")
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in told).encode()).hexdigest()
        assert (found[conv].n_turns, found[conv].loss_chars, found[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len([p for p in parts if p.conv_id == 77]) > 1
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(none)).count() == 0


# --- WARC -----------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT", 2000)
    rows = [(k, f"http://h/{k % 7} x", "p" * (k % 5) * 100) for k in range(40)] + [(3, "again", "p" * 300), (None, None, "p" * 100), (50, "n", None), (51, "big", "é" * 3_000_000)]
    path = f"file://{tmp_path}/out"
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    back = warc.read_archive(spark, path).collect()
    assert len(back) == len(rows)
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(x for x in (first.get(html or ""), i) if x is not None)
    want, got = collections.Counter(), collections.Counter()
    for i, _, html in rows:
        data, of = (html or "").encode(), first[html or ""]
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == of else "revisit", None if i == of else of] += 1
    for r in back:
        number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:>" else None
        got[number(r.record_id), r.payload_length, r.payload_digest[5:], r.record_type, number(r.refers_to)] += 1
        assert r.payload is None or len(r.payload) == r.payload_length
    assert got == want
    pushed = warc.read_archive(spark, path, payload=False).filter("record_type = 'revisit' AND target_uri LIKE 'http%'")
    assert "Filter" not in pushed._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert pushed.count() == sum(1 for i, url, html in rows if url and url.startswith("http") and i != first[html or ""])


def test_warc_reads_foreign_files(spark, tmp_path):
    import gzip

    records = [warc.record(k, "http://u", b"x" * k * 3000, None, "2020-01-01T00:00:00Z") for k in range(6)]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[3:])))
    found = warc.read_archive(spark, f"file://{tmp_path}").select("record_id", F.octet_length("payload")).collect()
    assert sorted(map(tuple, found)) == [(f"<urn:page:{k}>", k * 3000) for k in range(6)]


# --- packing, sharding, media -------------------------------------------------------------------------------------


def test_packing_holds_every_token_once(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [*ODD, (7, "<|endoftext|> x <|endoftext|>"), (8, " \n\t" * 40 + "漢字 🎉 don't"), (9, words(rng, 9000)), *[(20 + k, words(rng, rng.randrange(1, 700))) for k in range(60)]]
    pieces = packing.pack(docs_of(spark, rows).coalesce(2)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    texts = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id or 0, p.start)):
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
        if p.doc_id != 4:  # which is there twice
            texts[p.doc_id] += ids.tolist()
            assert len(want) and p.doc_tokens == len(next(x for i, x in want if i == p.doc_id))
    assert all(tuple(texts[i]) == ids for i, ids in want if i != 4)
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = 0
    for _, own in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0 and packing.pack(empty).count() == 0


def test_step_groups_are_balanced():
    packer = packing.Packer(packing.CONTEXTS, 4096, 0)
    rng = random.Random(0)
    for k in range(400):
        packer.add(k, np.ones(rng.randrange(1, 3000), np.uint32))
    steps = collections.Counter()
    for row in packer.rows:
        steps[row[6], row[7]] += len(row[2])
    for context in packing.CONTEXTS:
        last = max((step for size, step in steps if size == context), default=0)
        assert all(n == 4096 for (size, step), n in steps.items() if size == context and step < last)


def test_lookup_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    table = sharding.lookup_table(names, 2003)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(table, sharding.lookup_table(names[:-1], 2003), strict=True) if a != 19)
    assert moved < 0.25 * 2003
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 2000)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 7)


def test_placement_of_odd_rows(odd, empty, tmp_path):
    placed = sharding.place(odd)
    assert placed.columns == ["doc_id", "text", "lang", "score", "slot", "slot_", "shard"] and placed.count() == len(ODD)
    assert len({r.shard for r in placed.filter("doc_id = 4").collect()}) == 1 and placed.filter("shard IS NULL").count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|hashpartitioning", plan)
    assert sharding.place(empty).count() == 0
    sharding.write(odd, f"file://{tmp_path}/shards")
    assert odd.sparkSession.read.parquet(f"file://{tmp_path}/shards").count() == len(ODD)


def test_native_plans_have_no_python(odd, spark):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    for found in (decontaminate.contaminated(odd, items), licenses.summary(licenses.scan(odd))):
        assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 9000, bytes(range(256)) * 40, random.Random(0).randbytes(90_000), b"\0" * 70_000])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_without_clear_codes_and_with_fewer_bits():
    """A stream by a plain encoder that never clears its full table, of 2-bit pixels."""
    rng = random.Random(1)
    pixels = bytes(rng.randrange(4) for _ in range(60_000))
    table, codes, current = {bytes([k]): k for k in range(4)}, [4], b""
    sizes, free, size = [3], 6, 3
    for k in range(len(pixels)):
        longer = current + pixels[k : k + 1]
        if longer in table:
            current = longer
            continue
        codes.append(table[current])
        sizes.append(size)
        if free < 4096:
            table[longer] = free
            free += 1
            if free > 1 << size and size < 12:
                size += 1
        current = pixels[k : k + 1]
    codes += [table[current], 5]
    sizes += [size, min(12, size + (free + 1 > 1 << size))]
    bits = sum(c << at for c, at in zip(codes, itertools.accumulate([0, *sizes[:-1]]), strict=True))
    assert gif.lzw_decode(bits.to_bytes((sum(sizes) + 7) // 8, "little"), 2, len(pixels)) == pixels


def gif_of(frames, palette=b"\xff\0\0\0\xff\0\0\0\xff\0\0\0"):
    import struct

    out = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + palette
    for left, top, width, height, pixels, disposal, transparent, interlaced in frames:
        flag = disposal << 2 | (transparent is not None)
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flag, 7, transparent or 0, 0) + struct.pack("<BHHHHB", 0x2C, left, top, width, height, 0x40 * interlaced)
        out += b"\x08" + gif._blocks(gif.lzw_encode(bytes(pixels)))
    return out + b";"


def test_gif_disposal_transparency_and_interlacing():
    full = (0, 0, 4, 4, [0] * 16, 1, None, False)
    frames = list(map(lambda f: f.canvas.copy(), gif.decode(gif_of([full, (1, 1, 2, 2, [1, 3, 3, 1], 3, 3, False), (0, 0, 1, 1, [2], 2, None, False), (3, 3, 1, 1, [1], 0, None, False)]))))
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert frames[1][1, 1].tolist() == green and frames[1][1, 2].tolist() == red
    assert frames[2][1, 1].tolist() == red and frames[2][0, 0].tolist() == blue  # restored to what was before
    assert frames[3][0, 0].tolist() == [0, 0, 0] and frames[3][3, 3].tolist() == green  # restored to the background
    rows = next(gif.decode(gif_of([(0, 0, 4, 4, [0] * 4 + [2] * 4 + [1] * 4 + [3] * 4, 0, None, True)]))).pixels[:, 0]
    assert rows.tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        next(gif.decode(b"no image"))


def test_media_columns(spark, empty):
    rng = random.Random(9)
    rows = [*ODD, (9, words(rng, 30_000)), (10, words(rng, 30_000)), (11, "x" * 576), (12, "x" * 577)]
    found = gif.features(gif.store(docs_of(spark, rows))).collect()
    assert len(found) == len(rows)
    texts = collections.Counter((i, (t or "").encode()) for i, t in rows)
    for r in found:
        data = bytes(r.payload)[: r.n_bytes]
        assert (r.doc_id, data) in texts and bytes(r.payload)[r.n_bytes :] == b"\xff" * (len(r.payload) - r.n_bytes)
        assert len(r.payload) % 576 == 0 and len(r.payload) >= 576 and sum(f.width * f.height for f in r.frames) == len(r.payload)
        assert all(sum(f.histogram) == 3 * 576 * r.frames[0].height for f in r.frames)
    assert len({bytes(r.media) for r in found if r.doc_id in (1, 2)}) == 1
    assert gif.features(gif.store(empty)).count() == 0
    assert gif.decoded(F.lit(None).cast("binary")) is not None
