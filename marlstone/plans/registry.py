"""Every query of the library outside the llm subpackage, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import catalog, content, entities, knowledge, lints, market, messages, policy, reports, retrieval, routing, scoring, stores, strategies, streams, structure, trading, walks

MODULES = (retrieval, market, trading, content, reports, streams, knowledge, structure, policy, lints, catalog, walks, messages, entities, stores, routing, scoring, strategies)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
