"""Small helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.session import bound_batches as bound_batches, ensure_checkpoint_dir

#: A word: code points other than blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows from a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with one row per group, null keys included. A group with a large share of the rows is
    dealt over ``salts`` parts by ``spread`` (any column that differs between its rows)."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.select("_salt", *[F.col(k).alias(f"_group_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = left["_salt"] == right["_salt"]
    for key in keys:
        on = on & left[key].eqNullSafe(right[f"_group_{key}"])
    return left.join(right, on, "left").drop(left["_salt"]).drop(right["_salt"]).drop(*[f"_group_{k}" for k in keys])
