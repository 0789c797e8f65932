"""All registered queries of the library, without the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytelake.plans import bytecode, expected, shapes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**shapes.QUERIES, **bytecode.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**shapes.ORACLE, **expected.oracle_sql()}
