"""Queries that do the whole job, on small tables whose rows an earlier cut would have lost."""

import datetime

from marlstone.operators import ledger
from marlstone.plans import content, knowledge


def written(spark, tmp_path, name, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_claims_are_sought_in_all_that_follows(spark, tmp_path):
    claim = "Copper furnaces glow."
    rows = [(1, f"{claim} Copper furnaces glow again."), (2, f"{claim} " + "filler " * 2000 + ". copper furnaces glow"), (3, claim), (4, None), (5, "")]
    found = {r.doc_id: (r.matched, r.level) for r in knowledge.claim_support(spark, written(spark, tmp_path, "documents", rows, "doc_id long, text string")).collect()}
    assert found == {1: (3, "strong"), 2: (3, "strong"), 3: (0, "weak"), 4: (0, "weak"), 5: (0, "weak")}


def test_only_the_overselling_sale_is_refused(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("a", day, "1", "sell", 5.0, 9.0), ("a", day, "2", "buy", 10.0, 1.0), ("a", day, "3", "sell", 11.0, 2.0), ("a", day, "4", "sell", 4.0, 3.0), ("b", day, "5", "sell", 1.0, 1.0), ("c", day, "6", "buy", 2.0, 1.0)]
    trades = spark.createDataFrame(rows, "symbol string, day date, id string, side string, qty double, price double")
    assert {r.id: (r.status, r.held) for r in ledger.judged(trades).collect()} == {"1": ("refused", 0), "2": ("accepted", 10), "3": ("refused", 10), "4": ("accepted", 6), "5": ("refused", 0), "6": ("accepted", 2)}
    assert [tuple(r) for r in ledger.fifo(ledger.accepted(trades)).collect()] == [("a", "4", day, "2", 4.0, 4.0, 12.0)]
    assert {r.symbol: (r.held, r.realised) for r in ledger.average_cost(ledger.accepted(trades)).collect()} == {"a": (6.0, 8.0), "c": (2.0, 0.0)}


def test_titles_are_compared_whole(spark, tmp_path):
    start = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda xi"  # longer than 60 characters
    rows = [(k, f"<html><head><title>{t}</title></head></html>") for k, t in enumerate([f"{start} mu", f"{start} nu", f"{start} {'one two three four five six'}", "other"])]
    found = content.title_pairs(spark, written(spark, tmp_path, "pages", rows, "page_id long, html string")).collect()
    titles = [r[1][19:-22] for r in rows]
    brute = {(a, b) for a in titles for b in titles if a < b and len(set(a.split()) & set(b.split())) >= 0.85 * len(set(a.split()) | set(b.split()))}
    assert {(r.a, r.b) for r in found} == brute and len(brute) == 1
