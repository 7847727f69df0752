"""Chunks, calendars, roles and corporate actions on small literal tables."""

import datetime
import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.functions import articles
from marlstone.operators import calendars, chunking, composition, dedup, ledger
from marlstone.sources import files

D = datetime.date
TRADES = "symbol string, day date, id string, side string, qty double, price double"
ACTIONS = "symbol string, day date, id string, ratio double, per_share double"


def test_heading_chunks(spark):
    text = "intro\n\n# One #\na\n### Deep\nb\nc\nd\n### Other\n## Two\n\n\n# Last\n"
    rows = [(1, text), (2, None), (3, ""), (4, "\n \n")]
    found = chunking.heading_chunks(spark.createDataFrame(rows, "id long, t string"), "id", "t", 2).orderBy("start_line").collect()
    assert [(r.id, r.start_line, r.end_line, r.heading_path, r.text) for r in found] == [
        (1, 1, 2, "", "intro"),
        (1, 3, 4, "One", "# One #\na"),
        (1, 5, 6, "One > Deep", "### Deep\nb"),
        (1, 7, 8, "One > Deep", "c\nd"),
        (1, 9, 9, "One > Deep > Other", "### Other"),  # a skipped level leaves its place to the heading before
        (1, 10, 11, "One > Two", "## Two"),
        (1, 13, 13, "Last", "# Last"),
    ]
    assert chunking.heading_chunks(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def blocks(text):
    """Start and end of what blank lines part; lines between fences stay together."""
    start, end, at, fenced = None, 0, 0, False
    for line in text.split("\n"):
        bare = line.strip()
        if bare or fenced:
            start = at + len(line) - len(line.lstrip()) if start is None else start
            end = at + len(line.rstrip()) if bare else end
            fenced ^= bare.startswith(("```", "~~~"))
        elif start is not None:
            yield start, end
            start = None
        at += len(line) + 1
    if start is not None:
        yield start, end


def spans(text, size, overlap):
    """Blocks joined while they span at most `size`; a longer block is cut in windows."""
    out, group = [], []  # start, end, first and last block
    for n, (start, end) in enumerate(blocks(text), 1):
        if group and (end - start > size or end - group[0] > size):
            out.append({"start": group[0], "end": group[1], "kind": "blocks", "first": group[2], "last": group[3]})
            group = []
        if end - start > size:
            for at in range(start, end, size - overlap):
                piece = text[at : min(at + size, end)]
                left = at + len(piece) - len(piece.lstrip())
                if piece.strip():
                    out.append({"start": left, "end": left + len(piece.strip()), "kind": "window", "first": n, "last": n})
                if at + size >= end:
                    break
        else:
            group = [group[0] if group else start, end, group[2] if group else n, n]
    if group:
        out.append({"start": group[0], "end": group[1], "kind": "blocks", "first": group[2], "last": group[3]})
    return out


def test_parent_spans(spark):
    text = "  one\n\ntwo\n\n```\na\n\nb\n```\n\n" + "x" * 25
    row = spark.createDataFrame([(text,), (None,), (" \n",)], "t string").select(chunking.parent_spans(F.col("t"), 20, 5).alias("s")).collect()
    assert [(text[s.start : s.end], s.kind, s.first, s.last) for s in row[0].s] == [("one\n\ntwo", "blocks", 1, 2), ("```\na\n\nb\n```", "blocks", 3, 3), ("x" * 20, "window", 4, 4), ("x" * 10, "window", 4, 4)]
    assert [len(r.s) for r in row[1:]] == [0, 0]
    with pytest.raises(ValueError, match="overlap"):
        chunking.parent_spans(F.col("t"), 5, 5)


def test_parent_spans_are_those_of_a_plain_program(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", " ", "\n", "\n\n", "```", "~~~", "x" * 9, "é"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.parent_spans(F.col("t"), 11, 3).alias("s")).collect()
    for r in rows:
        assert [x.asDict() for x in r.s] == spans(r.t, 11, 3), r.t


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n`~", max_size=120), st.integers(2, 30))
def test_spans_hold_all_text(text, size):
    """Spans are in order, of bounded size without blank ends, and leave out white space only. Windows overlap, so that two
    may begin alike once trimmed."""
    held, last = set(), -1
    for s in spans(text, size, 1):
        piece = text[s["start"] : s["end"]]
        assert piece == piece.strip() and 0 < len(piece) <= size and s["start"] >= last
        held |= set(range(s["start"], s["end"]))
        last = s["start"]
    assert all(c.isspace() or k in held for k, c in enumerate(text))


def test_effective_dates(spark):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    sessions = spark.createDataFrame([("cn", D(2024, 1, d), at(d, 7)) for d in (4, 5, 8)], "market string, day date, close timestamp")
    rows = [(1, "cn", at(5, 7)), (2, "cn", at(5, 6)), (3, "cn", at(7, 12)), (4, "cn", at(8, 8)), (5, "cn", at(1, 20)), (6, "us", at(8, 2)), (7, None, at(8, 2)), (8, "cn", None), (9, "cn", datetime.datetime(2024, 5, 1))]
    asked = spark.createDataFrame(rows, "k int, market string, at timestamp")
    found = {r.k: r.effective for r in calendars.effective_dates(asked, sessions).collect()}
    assert found == {1: D(2024, 1, 5), 2: D(2024, 1, 4), 3: D(2024, 1, 5), 4: D(2024, 1, 8), 5: D(2024, 1, 2), 6: D(2024, 1, 7), 7: D(2024, 1, 8), 8: None, 9: D(2024, 5, 1)}


def test_composition(spark):
    schema = "q int, target string, score double, primary_score double, roles array<string>, assigned string, negative_for array<string>"
    rows = [(1, "a", 30.0, 9.0, ["primary"], "primary", ["x"]), (1, "b", 40.0, 5.0, ["primary", "style"], "style", ["x"]), (1, "c", 18.0, 0.0, ["supporting", "style"], "supporting", None), (1, "d", 17.0, 0.0, ["supporting"], "supporting", []), (1, "e", 0.0, 99.0, ["primary"], "primary", []), (2, "f", 5.0, 0.0, ["style"], "style", [])]
    found = {(r.q, r.target, r.role, r.place) for r in composition.compose(spark.createDataFrame(rows, schema), "q").collect()}
    assert found == {(1, "a", "primary", 1), (1, "b", "rejected", 1), (1, "c", "supporting", 1), (1, "c", "style", 1), (2, "f", "primary", 1)}


def test_splits_and_dividends(spark):
    trades = spark.createDataFrame([("s", D(2024, 1, 1), "1", "buy", 10.0, 8.0), ("s", D(2024, 1, 3), "2", "buy", 10.0, 5.0), ("s", D(2024, 1, 5), "3", "sell", 30.0, 6.0)], TRADES)
    actions = spark.createDataFrame([("s", D(2024, 1, 2), "d", None, 0.5), ("s", D(2024, 1, 3), "x", 2.0, None), ("s", D(2024, 1, 4), "d", None, 1.0)], ACTIONS)
    paid = ledger.with_actions(trades, actions).filter("per_share > 0").orderBy("day").collect()
    assert [(r.before, r.cash) for r in paid] == [(10.0, 5.0), (30.0, 30.0)]
    adjusted = ledger.split_adjusted(trades, actions)
    assert [(r.qty, r.price) for r in adjusted.orderBy("id").collect()] == [(20.0, 4.0), (10.0, 5.0), (30.0, 6.0)]
    taken = ledger.fifo(adjusted).agg(F.sum("proceeds").alias("p"), F.sum("cost").alias("c")).first()
    assert (taken.p, taken.c) == (180.0, 130.0)
    with pytest.raises(PySparkException, match="above 0"):
        ledger.with_actions(trades, actions.withColumn("ratio", F.lit(-1.0))).collect()


def test_markdown(spark):
    page = """<h2>A &amp; b</h2><p>one  <b>two</b>\n<a href="/x"> go\n on </a><a href="#y">here</a></p><ol><li>p</li><li>q<ul><li>r</li></ul></li></ol><script>no</script><nav>no</nav>
    <pre>a  <code>b</code>\n c</pre><img data-src="i.png" alt="pic"><table><tr><th>h</th><td>v</td></tr></table><blockquote>said</blockquote>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string").select("k", articles.markdown(F.col("h")).alias("md")).orderBy("k").collect()
    assert rows[0].md == "## A & b\n\none **two**[go on](/x)here\n\n1. p\n2. q\n\n  - r\n\n```text\na  b\n c\n```\n\n![pic](i.png)\n\n| h | v |\n\n> said\n"
    assert [r.md for r in rows[1:]] == [None, "\n"]


def test_article_fields(spark):
    page = f"""<html><head><meta property="og:title" content="T &amp; x"><meta name="author" content="Ann"><title>other</title></head><body><article>short</article><article class="x"><!-- no --><p>{"word " * 20}</p></article></body></html>"""
    frame = spark.createDataFrame([(1, page), (2, "<title> </title><body>few</body>"), (3, None)], "k int, h string")
    h = F.col("h")
    rows = frame.select("k", articles.field(h, "title", "none").alias("t"), articles.field(h, "author").alias("a"), articles.body(h).alias("b")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "T & x", "Ann", f"<p>{'word ' * 20}</p>"), (2, "none", "", None), (3, "none", "", None)]


def test_similar_names(spark):
    """The same as comparing every two names."""
    draw = random.Random(3)
    known = sorted({"".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(150)})
    asked = sorted({k[:2] + draw.choice("abz") + k[3:] for k in known} | {"", "zzzz"})
    make = lambda names: spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "name string")
    for least in (0.8, 0.7):
        want = {}
        for a in asked:
            best = max((difflib.SequenceMatcher(None, k, a).ratio(), k) for k in known)
            if a and best[0] >= least:
                want[a] = best[::-1]
        found = {r.asked: (r.name, r.ratio) for r in dedup.similar_names(make(asked), make(known), least).collect()}
        assert len(want) > 20 and found == want


def test_headings_keep_their_lines(spark):
    text = "# a\n```\n# no\n\n```\n## b\n```\n# open"
    found = spark.range(1).select(files.headings(F.lit(text)).alias("h")).first().h
    assert [(h.line, h.level, h.title) for h in found] == [(1, 1, "a"), (6, 2, "b")]
