"""Name -> query and name -> DuckDB SQL, for every operator shown on the driver's tables.

The archive's own data isn't among those tables, so each query runs an operator on an analogue:
orders are dated entries, lineitem their comments, customers users, documents bodies, pages HTML,
events timed entries, conversations threads.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES = ("scalars", "joins", "aggregates", "windows", "trees", "documents_html", "datasets", "extras", "merges", "archives")


class Tables:
    """Attribute access to the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name, with the SQL that gives the same rows."""

    def put(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        import_module(f"daybook.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
