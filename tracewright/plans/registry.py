"""Registry of queries: a function (spark, folder) -> DataFrame and, where one exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.functions.text import WS_CLASS

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS_CLASS}+', ' ', 'g'))"


def compared_sql(c: str) -> str:
    return f"lower({squeeze_sql(c)})"


def clean_id_sql(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')), '')"
