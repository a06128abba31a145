"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return make

    return add
