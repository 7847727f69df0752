"""What questions have in common with templates stays in their rows: findings 22 and 24."""

import pytest

from marlstone.operators import scoring as T
from tests.conftest import SMALL
from tests.test_scoring import FIELD, field_points, made, said


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_points_of_a_question_are_not_gathered(spark):
    """They were collected by question and field and then joined with the question's digest, so that memory and spill grew with the result."""
    from marlstone.plans import scoring

    plan = plan_of(scoring.template_points(spark, SMALL))
    assert "Aggregate" not in plan and "Sort" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("crossed", [100, 0])
def test_templates_are_sought_where_they_are_many(spark, monkeypatch, crossed):
    monkeypatch.setattr(T, "CROSSED", crossed)
    monkeypatch.setattr(T, "ASKED", 7)
    questions, fields = made(5)
    questions += [(90, "x"), (91, "b lue"), (92, "lue cha"), (93, "‘blue’  “CHART”\t图表")]
    fields += [("t1", "exact", "a", "title", "x"), ("t9", "own", "", "tag", "lue"), ("t9", "own", "", "tag", "‘blue’ “chart”"), ("t9", "variant", "v", "notes", "the"), ("none", "own", "", "tag", "nowhere")]
    asked = spark.createDataFrame(questions, "id long, q string")
    told = spark.createDataFrame([*fields, *fields[:5], (None, "own", None, "tag", "neon art")], FIELD)
    straight = lambda x: None if x is None else x.replace("‘", "'").replace("’", "'").replace("“", '"').replace("”", '"')
    wanted = {}
    for k, q in questions:
        for f in {*fields, (None, "own", None, "tag", "neon art")}:
            q_, t = said(straight(q)), said(straight(f[4]))
            same = f[1] in T.SAME and f[3] in ("title", "preview", "prompt") and q_ == t
            if q_ and ((p := field_points(q_, f[1], f[3], t)) or same):
                one = (k, *f[:4], *(p[:2] if p else (0, False)), same, p[2] if p else 0)
                wanted[one] = wanted.get(one, 0) + 1
    found = {}
    for r in T.points(asked, "id", "q", told).collect():
        assert r.tokens == sorted(set(r.tokens))
        one = (r.id, r.target, r.part, r.item, r.field, r.points, r.phrase, r.same, len(r.tokens))
        found[one] = found.get(one, 0) + 1
    assert found == wanted and any(one[7] and not one[6] for one in wanted)
    rules = spark.createDataFrame([("t1", "r", "lue", 3), ("t1", "r", "blue", 3), ("t1", "s", "x", 4), ("t2", "r", "图表", 5), ("t2", "r", None, 5)], "target string, rule string, term string, points int")
    scored = {(r.id, r.target): r.score for r in T.rule_points(asked.filter("id >= 90"), "id", "q", rules).collect()}
    assert scored == {(91, "t1"): 3, (92, "t1"): 3, (93, "t1"): 3, (93, "t2"): 5}


def test_words_of_a_source_are_ranked_before_they_are_shuffled(spark, monkeypatch):
    """All words of all sources were shuffled by source and sorted there, for 24 of each."""
    from marlstone.plans import scoring

    plans, write = [], scoring.materialize
    monkeypatch.setattr(scoring, "materialize", lambda df, name: plans.append((name, plan_of(df))) or write(df, name))
    assert scoring.template_ranks(spark, SMALL).count() > 0
    plan = dict(plans)["template-words"]
    assert plan.count("WindowGroupLimit") == 2 and "translate" not in plan
    # what a question adds to items isn't written and dealt out again
    assert [name for name, _ in plans] == ["template-words", "template-questions"]


def test_items_without_a_name_and_of_no_known_part(spark):
    scored = spark.createDataFrame([(1, "t", "exact", "a", 5), (1, "t", "exact", None, 9), (1, "t", "exact", "gone", 7), (1, "u", "own", "", 3), (2, "u", "exact", "a", 1), (2, "none", "exact", "a", 1)], "id long, target string, part string, item string, score int")
    entries = spark.createDataFrame([("t", "exact", "a", 8), ("t", "exact", "b", 8), ("t", "exact", None, 2), ("u", "exact", "a", 30), ("u", "own", "", 1), ("u", "odd", "x", 2), ("u", "odd", "y", 2)], "target string, part string, item string, base long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {tuple(r) for r in T.item_ranks(asked, "id", scored, entries, "exact").collect()} == {(1, "t", "a", 13, 1), (1, "t", "b", 8, 2), (1, "t", None, 2, 3), (2, "u", "a", 31, 1)}
    assert {tuple(r) for r in T.ranked(asked, "id", scored, entries, 5).collect()} == {(1, "t", 32, 1), (1, "u", 26, 2), (2, "u", 23, 1), (2, "t", 18, 2), (3, "u", 23, 1), (3, "t", 18, 2)}
