"""Decontamination by occurrence, and of items shorter than a window."""

from marlstone.llm import decontaminate

ITEM = "A train leaves Berlin at 9 o'clock and travels 120 km before the second train from Hamburg leaves with 45 passengers on board"


def held(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_items_are_decided_by_occurrence(spark):
    one = ITEM.replace("120", "95").replace("45", "30").replace("Berlin", "Madrid")
    two = ITEM.replace("120", "60").replace("45", "31").replace("Berlin", "Paris")
    chance = "then travels 7 km before the second train from Rome leaves"
    spread = " ".join(ITEM.split()[:14]) + ". " + "quiet words of other matters " * 30 + ". " + " ".join(ITEM.split()[8:])
    texts = [f"{one}. {two}", f"{one}. " + "quiet words " * 50 + f". {chance} and travels 8 km before the second train from Oslo leaves", spread, chance]
    found = held(spark, texts, [ITEM])
    assert set(found) == {(0, 0), (1, 0), (2, 0)}
    assert not found[0, 0] and not found[1, 0]


def test_short_items_are_found(spark):
    items = ["Name the capital of Peru", "42", "Paris falls", "sum 3 and 3"]
    texts = ["We ask: name the capital of Chile today.", "They had 42 of them.", "They had 43 of them.", "He said Paris falls.", "sum 5 and 5", "sum 5 and 6", "name the river of Peru"]
    assert held(spark, texts, items) == {(0, 0): False, (1, 1): True, (3, 2): True, (4, 3): False}
