"""How the modules of this folder register queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


def catalog() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator): a decorated function takes what reads a table by name."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def add(f):
            def run(spark, sf_dir):
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            queries[f.__name__] = run
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
