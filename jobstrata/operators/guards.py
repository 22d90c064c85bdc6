"""Checks that keep personal data out of the index and links pointing at the employer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata import constants as C
from jobstrata import schemas
from jobstrata.functions.urls import ats_job_id, resolve_apply, url_authority


def _personal() -> Column:
    return F.array(*[F.lit(k) for k in C.PERSONAL_KEYS])


def leaked_filter_keys(keys: Column) -> Column:
    """Personal keys among filter keys, as written."""
    return F.array_sort(F.array_intersect(F.coalesce(keys, F.array().cast("array<string>")), _personal()))


def leaked_argument_keys(keys: Column) -> Column:
    """Personal keys among call arguments, whatever their case."""
    lowered = F.transform(F.coalesce(keys, F.array().cast("array<string>")), F.lower)
    return F.array_sort(F.array_intersect(lowered, _personal()))


def is_anonymous(token: Column) -> Column:
    """A short single-line token; anything longer may be crammed content."""
    shaped = (F.char_length(token) <= C.MAX_TOKEN_LENGTH) & ~F.contains(token, F.lit("\n"))
    return F.coalesce(shaped, F.lit(False))


def unexpected_columns(df: DataFrame, allowed: T.StructType) -> list[str]:
    """Columns of ``df`` outside its whitelist, or with a personal key in their name."""
    names = set(df.columns) - set(allowed.fieldNames())
    words = {c: set(c.lower().split("_")) for c in df.columns}
    personal = {c for c, parts in words.items() if parts & (set(C.PERSONAL_KEYS) - {"file", "name"})}
    return sorted(names | personal)


def schema_report(df: DataFrame, allowed: T.StructType) -> DataFrame:
    """column, filled: each column that doesn't belong and in how many rows it holds something; no rows when all do."""
    found = unexpected_columns(df, allowed)
    if not found:
        return df.sparkSession.createDataFrame([], "column string, filled long")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in found])
    return counts.unpivot([], found, "column", "filled")


def assert_anonymous_schema(watches: DataFrame, applications: DataFrame) -> None:
    """Raise when a caller-owned table could hold personal data."""
    for df, allowed in ((watches, schemas.WATCHES), (applications, schemas.APPLICATIONS)):
        found = unexpected_columns(df, allowed)
        if found:
            raise ValueError(f"columns not allowed in a caller-owned table: {', '.join(found)}")


def foreign_sources(jobs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """How many postings come from a source that is not first-party; must be 0."""
    known = F.col("source").isin(allowed or ["employer_site", C.SOURCE_ATS])
    return jobs.agg(
        F.count(F.lit(1)).alias("postings"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("foreign"),
    )


def apply_channel_report(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Per posting: does the stored link deep-link, and does resolving it again change it?"""
    tenants = companies.select(F.col("id").alias("company_id"), "ats_vendor", "ats_tenant")
    job_id = ats_job_id(F.col("id"))
    again = resolve_apply(F.col("ats_vendor"), F.col("ats_tenant"), job_id, F.col("apply_channel"))
    hosts = [h for group in C.APPLY_HOSTS.values() for h in group]
    return jobs.select("id", "company_id", "apply_channel").join(tenants, "company_id").select(
        "id",
        F.startswith("apply_channel", F.lit("https://")).alias("is_https"),
        url_authority(F.col("apply_channel")).isin(hosts).alias("on_ats_host"),
        F.contains("apply_channel", job_id).alias("has_job_id"),
        (again["url"] == F.col("apply_channel")).alias("is_stable"),
    )
