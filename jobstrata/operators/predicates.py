"""Hard filters. Each takes a parameter and returns a Column; null parameters filter nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata.functions.remote import remote_scope
from jobstrata.functions.skills import lower_set
from jobstrata.session import as_timestamp


def _all() -> Column:
    return F.lit(True)


def is_live() -> Column:
    return F.col("delisted_at").isNull()


def is_remote(wanted: bool | None) -> Column:
    """Only an explicit true filters; false and null keep everything."""
    return F.col("remote_policy") == "remote" if wanted is True else _all()


def pays_at_least(floor: int | None) -> Column:
    """Postings that could meet the floor; unstated pay cannot be ruled out and stays."""
    if floor is None:
        return _all()
    low, high = F.col("salary_min"), F.col("salary_max")
    return (high >= floor) | (low >= floor) | (low.isNull() & high.isNull())


def states_salary(required: bool) -> Column:
    if not required:
        return _all()
    return F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()


def pays_in(currency: str | None) -> Column:
    return F.col("salary_currency") == currency.upper() if currency else _all()


def first_seen_after(cursor) -> Column:
    return _all() if cursor is None else F.col("first_seen_at") > as_timestamp(cursor)


def _tags(values: list[str]) -> Column:
    return F.array(*[F.lit(v.lower()) for v in values]).cast("array<string>")


def has_any_skill(skills: list[str] | None) -> Column:
    if not skills:
        return _all()
    return F.arrays_overlap(lower_set(F.col("skills")), _tags(skills))


def has_all_skills(skills: list[str] | None) -> Column:
    if not skills:
        return _all()
    return F.size(F.array_except(_tags(skills), lower_set(F.col("skills")))) == 0


def has_scope(scope: str | None) -> Column:
    if not scope:
        return _all()
    return remote_scope(F.col("remote_policy"), F.col("location"))["scope"] == scope


def in_family(family: str | None) -> Column:
    """A posting without a family never matches once a family is asked for."""
    return F.lower("role_family") == family.lower() if family else _all()


def pending_extraction(target: str) -> Column:
    """Rows of another source; a null source is neither, as in SQL."""
    return F.col("extraction_source") != target


def pending_family() -> Column:
    return F.col("role_family").isNull()


def active_watch(fingerprint: str | None = None) -> Column:
    active = F.coalesce(F.col("active"), F.lit(False))
    return active if fingerprint is None else active & (F.col("fingerprint") == fingerprint)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
