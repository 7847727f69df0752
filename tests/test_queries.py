"""Every query runs, and gives the rows of its SQL on an independent engine."""

import importlib.util
import os

import pytest

from marlstone.plans import registry
from tests.conftest import SMALL
from tests.oracle import compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_as_sql(spark, con, name):
    queries, oracles = registry.queries(), registry.oracle_sql()
    if name in oracles:
        assert compare(spark, con, SMALL, name, queries[name], oracles[name]) == ""
    else:
        assert queries[name](spark, SMALL).columns


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(registry.queries()) <= set(entry.queries())
    there = all(importlib.util.find_spec(name) is not None for name in ("marlstone.llm", "corpus_pipeline"))
    assert ("pipeline" in entry.queries()) == there
