"""Registration of queries: a name, the relations its SQL uses, the SQL, and the DataFrame form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Relations, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, relations: str = "", sql: str | None = None):
    def register(build: Callable[[Relations], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Relations(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_relations(relations, sql)
        return build

    return register
