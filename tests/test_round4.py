"""Odd events and enlarged tables of the fourth round's findings."""

from datetime import datetime

import duckdb
import pytest

from marlstone.plans import trading
from tests.oracle import compare

EVENTS = "event_id long, user_id long, ts timestamp_ntz, value double"


@pytest.mark.parametrize("name", ["backtest", "forward_bars"])
def test_odd_bars_as_in_sql(spark, tmp_path, name):
    """Codes below 0 or none, a bar without a day, and prices of 0, below it, without end and beyond 64 bits."""
    prices = [3.0, -0.0, 2e200, 0.0, 1e-200, float("nan"), float("inf"), -5.0, 7.5, None, 0.0, 4.0, 4.1, 4.2, 9.0, 1.0]
    rows = [(100 * d + (user or 0), user, datetime(2024, 1, d + 1, 12), prices[(d + (user or 0)) % len(prices)]) for user in (-7, -6, -5, -4, 1, 2, 3, 4, None) for d in range(16)]
    rows += [(9000 + user, user, None, 6.5) for user in (-7, 1, 2)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert compare(spark, con, str(tmp_path), name, trading.QUERIES[name], trading.ORACLE[name]) == ""


def _plain_routes(texts, profiles):
    """Wikis of texts, found by holding each against each."""
    import re

    from marlstone.operators import routing as G

    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def tokens(t):
        return [w for w in words(t) if len(w) >= 2 and w not in G.STOP]

    def forms(t):
        out = set()
        for w in tokens(t):
            n = len(w)
            out |= {w} | ({w[:-3] + "y"} if w.endswith("ies") and n > 4 else set()) | ({w[:-1]} if w.endswith("s") and n > 4 else set()) | ({w[:-3]} if w.endswith("ics") and n > 5 else set()) | ({w[:-2]} if w.endswith("ic") and n > 4 else set())
        return out

    needles = set()
    for wiki, kind, phrase in profiles:
        own = tokens(phrase)
        if words(phrase) and (kind == "negative" or own and not (len(own) == 1 and own[0] in G.GENERIC)):
            needles.add((wiki, kind, " ".join(words(phrase)), True))
        needles |= {(wiki, kind, w, False) for w in own}
    found = {}
    for key, text, focus in texts:
        held = lambda t: {n for n in needles if (f" {n[2]} " in f" {' '.join(words(t))} " if n[3] else n[2] in forms(t))}  # noqa: E731, B023
        scored = []
        for wiki in {n[0] for n in needles}:
            met = [n for n in held(text) if n[0] == wiki]
            if met:
                plain = lambda n: not n[3] and n[2] in G.GENERIC
                total = sum((G.PHRASES if n[3] else G.PLAIN if plain(n) else G.WORDS).get(n[1], 0.0) for n in met) + 0.1 * len({n[2] for n in met if n[1] != "negative" and plain(n)})
                strong = any(n[1] != "negative" and n[3] for n in met) and round(max(0.0, total), 6) >= 5
                near = any(n[0] == wiki and n[1] != "negative" and not plain(n) for n in held(focus))
                scored.append((round(max(0.0, total), 2), wiki, strong, near, sorted({n[2] for n in met if n[1] != "negative"}), sorted({n[2] for n in met if n[1] == "negative"})))
        for place, (score, wiki, *rest) in enumerate(sorted(scored, key=lambda s: (-s[0], s[1])), 1):
            found[key, wiki] = (score, place, rest[2], rest[3], "strong" if rest[0] else "none" if score <= 0 else "moderate" if score >= 2 else "weak", rest[1])
    return found


@pytest.mark.parametrize(("bits", "broadcast", "pairs"), [(63, 16_000_000, 1 << 20), (3, 16_000_000, 4), (63, 0, 1 << 20)])
def test_routes_of_wikis_with_many_terms(spark, monkeypatch, bits, broadcast, pairs):
    """Terms beyond a whole number's bits, of several kinds at once, of phrases of one, two and five words, and wikis that only the focus meets."""
    from marlstone.operators import routing as G

    for name, value in (("BITS", bits), ("BROADCAST", broadcast), ("PAIRS", pairs)):
        monkeypatch.setattr(G, name, value)
    many = " ".join(f"w{k:03}" for k in range(150))
    profiles = [("big", "core", many), ("big", "negative", "w149 w148 data"), ("big", "alias", "w001"), ("a", "core", "data"), ("a", "alias", "data models"), ("a", "adjacent", "data"), ("a", "negative", "data w003")]
    profiles += [("b", "core", "one two three four five"), ("b", "alias", "five six"), ("b", "negative", "the"), ("c", "core", "cities basics"), ("c", "alias", "cities"), ("d", "alias", "only")]
    texts = [(1, f"{many} {many} data models", "w001"), (2, "w149 w148 data one two three four five six", "five"), (3, "the city and basics of data, Data models", "cities"), (4, "one two three four", "only"), (5, "Five  six; w003 data w003", None), (6, None, "only")]
    found = G.ranked(spark.createDataFrame(texts, "key int, text string, focus string"), "key", "text", "focus", spark.createDataFrame(profiles, "wiki string, kind string, phrase string")).collect()
    near = {"possible_child_profile": True, "adjacent_family": True, "generic_overlap": False}
    want = _plain_routes(texts, profiles)
    assert {(r.key, r.wiki): (r.score, r.place, r.terms, r.negatives, r.quality) for r in found} == {k: v[:5] for k, v in want.items()}
    assert all(near[r.hint] == want[r.key, r.wiki][5] for r in found if r.hint in near and r.score >= (4 if r.hint == "possible_child_profile" else 2))


def test_pairs_of_texts_and_wikis_are_summed_as_numbers(spark):
    from marlstone.operators import routing as G

    texts = spark.createDataFrame([(1, "deep sea things", "sea")], "key int, text string, focus string")
    found = G.ranked(texts, "key", "text", "focus", spark.createDataFrame([("x", "core", "deep sea")], "wiki string, kind string, phrase string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "collect_set" not in plan
    assert G.ranked(texts, "key", "text", "focus", spark.createDataFrame([], "wiki string, kind string, phrase string")).count() == 0
