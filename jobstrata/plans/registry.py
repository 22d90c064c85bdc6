"""Registry of the queries that are checked: name -> (Spark callable, DuckDB twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"query {name} registered twice")
        _REGISTRY[name] = (function, sql)
        return function

    return register


def registered_sql(name: str) -> str | None:
    """The twin of a query that was registered before."""
    return _REGISTRY[name][1]


def registered() -> dict[str, tuple[Query, str | None]]:
    from jobstrata.plans import (  # noqa: F401 - importing fills the registry
        change_plans,
        flow_plans,
        scalar_plans,
        search_plans,
        source_plans,
        upkeep_plans,
        watch_plans,
    )

    return dict(_REGISTRY)


# Shapes both engines print alike.
def joined(tags: Column, name: str) -> Column:
    return F.array_join(tags, ",").alias(name)


def sorted_tags(tags: Column, name: str) -> Column:
    return F.array_join(F.array_sort(tags), ",").alias(name)


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name.split(".")[-1])


def rounded(value: Column, name: str) -> Column:
    return F.round(value, 6).alias(name)


def sql_tags(expr: str, name: str) -> str:
    return f"array_to_string({expr}, ',') AS {name}"


def sql_sorted(expr: str, name: str) -> str:
    return f"array_to_string(list_sort({expr}), ',') AS {name}"


def sql_stamp(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr.split('.')[-1]}"
