"""Remote policy and remote scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions.text import WORD, strip


def says_remote(location: Column) -> Column:
    return F.coalesce(F.contains(F.lower(location), F.lit("remote")), F.lit(False))


def _whole(pattern: str) -> str:
    return f"(?<![{WORD}])(?:{pattern})(?![{WORD}])"


def resolve_remote(hint: Column, location: Column, text: Column) -> Column:
    """The vendor's hint, else (case-sensitive) phrases of the text, else the location."""

    def phrase(needles: list[str], pattern: str) -> Column:
        near = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])
        return near & text.rlike(_whole(pattern))

    return (
        F.when(hint.isin(C.DECISIVE_HINTS), hint)
        .when(phrase(["remote"], "fully remote|100% remote|remote[- ]first"), F.lit("remote"))
        .when(phrase(["hybrid"], "hybrid"), F.lit("hybrid"))
        .when(phrase(["site", "office"], "on[- ]?site|in[- ]?office"), F.lit("onsite"))
        .when(says_remote(location), F.lit("remote"))
        .otherwise(F.lit("unknown"))
    )


def _labels(location: Column, tokens: dict[str, str]) -> Column:
    hits = [F.when(F.contains(location, F.lit(t)), F.lit(label)) for t, label in tokens.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def remote_scope(
    policy: Column,
    location: Column,
    regions: dict[str, str] | None = None,
    countries: dict[str, str] | None = None,
) -> Column:
    """Struct ``(scope, regions)``: where a remote posting is open to, read off its location.

    Tokens match as substrings, so 'ap' also fires in 'Japan'; the lists are parameters.
    """
    place = F.lower(F.coalesce(location, F.lit("")))
    region = _labels(place, C.REGION_TOKENS if regions is None else regions)
    country = _labels(place, C.COUNTRY_TOKENS if countries is None else countries)
    worldwide = reduce(
        lambda a, b: a | b,
        [F.contains(place, F.lit(token)) for token in C.WORLDWIDE_TOKENS],
        (place == "") | strip(place).isin(C.UNQUALIFIED_REMOTE),
    )
    none = F.array().cast("array<string>")

    def result(scope: str | None, labels: Column) -> Column:
        return F.struct(F.lit(scope).cast("string").alias("scope"), labels.alias("regions"))

    return (
        F.when(~F.coalesce(policy == "remote", F.lit(False)), result(None, none))
        .when(worldwide, result("worldwide", none))
        .when(F.size(region) > 0, result("region_locked", region))
        .when(F.size(country) > 0, result("country_locked", country))
        .otherwise(result("worldwide", none))
    )
