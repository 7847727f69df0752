"""What a model wrote as JSON: well-formed values stay, every cut of one is mended, odd forms have a stated result."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import jsonish as J
from tests.oracle import compare, duck
from tests.conftest import SMALL
from marlstone.plans import catalog


def mended(spark, texts, of=J.mended):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", of(F.col("t")).alias("m")).collect()
    return [r.m for r in sorted(rows)]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind == 0:
        return "".join(rng.choice('ab"\\{}[],:\'/* \n\tü漢😀') for _ in range(rng.randrange(12)))
    if kind < 5:
        return [rng.randrange(-99, 99), rng.random() * 1e9, True, None][kind - 1]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(['', ' x', ':', '}'])}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_well_formed_values_stay(spark):
    rng = random.Random(5)
    values = [{"v": value(rng)} for _ in range(300)] + [[value(rng, 1)] for _ in range(50)]
    found = mended(spark, [json.dumps(v, ensure_ascii=bool(i % 2), indent=[None, 2][i % 3 == 0]) for i, v in enumerate(values)])
    assert [json.loads(m) for m in found] == values


def test_every_cut_is_well_formed(spark):
    whole = json.dumps({"a": {"b": [1, 2.5, "x\\y\"z", {"c": None}], "d": True}, "e": "} ] end", "f": {}, "ü": "é"})
    found = mended(spark, [whole[:n] for n in range(1, len(whole) + 1)])
    read = [json.loads(m) for m in found]
    assert read[-1] == json.loads(whole) and all(isinstance(r, dict) for r in read)


@pytest.mark.parametrize("text, result", [
    (None, None), ("", None), ("no object", None), ("{", {}), ("}{", {}), ('{"user":{"id":1}', {"user": {"id": 1}}), ('{"user":{"id":1} so', {"user": {"id": 1}}), ('{"a":1}{"b":2}', {"a": 1}),
    ('{"a" "b"}', {"a": "b"}), ('{"a":,"b"}', {"a": None, "b": None}), ('{"a":[1,,2,]]}', {"a": [1, 2]}), ("{'it\\'s': 'say \"x\"'}", {"it's": 'say "x"'}), ("{a: don't know, b: 01}", {"a": "don't know", "b": "01"}),
    ('see {x} then ```json\n{"a": "```"}\n``` done {}', {"a": "```"}), ('{"a": 1, // } c\n"u": "http://x" /* { */}', {"a": 1, "u": "http://x"}), ('{"a": "l1\nl2"}', {"a": "l1\nl2"}), ('{"a": True, "b": None}', {"a": True, "b": None}),
])
def test_odd_forms(spark, text, result):
    found = mended(spark, [text])[0]
    assert (found if found is None else json.loads(found)) == result


def test_wrapped_answers(spark):
    inner = '```json\n{"a": 1}\n```'
    texts = [json.dumps({"answer": inner}), json.dumps({"choices": [{"message": {"content": inner}}]}), json.dumps({"text": "plain words"})]
    assert [json.loads(m) for m in mended(spark, texts, J.unwrapped)] == [{"a": 1}, {"a": 1}, {"text": "plain words"}]


def test_long_texts(spark):
    whole = {"text": 'q"\\ ' * 200_000, "items": list(range(20_000))}
    assert json.loads(mended(spark, [json.dumps(whole)[:-2]])[0]) == whole


def test_query(spark):
    assert compare(spark, duck(SMALL), SMALL, "mended_outputs", catalog.QUERIES["mended_outputs"], catalog.ORACLE["mended_outputs"]) == ""
