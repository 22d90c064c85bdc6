"""Scores: staleness, freshness, match and rank; token cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions.skills import lower_set

_MICROS_PER_DAY = 86_400_000_000.0


def days_between(start: Column, end: Column) -> Column:
    """Fractional days between two instants."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(_MICROS_PER_DAY)


def whole_days_between(start: Column, end: Column) -> Column:
    return F.floor(days_between(start, end))


def ghost_score(relist_count: Column, days_open: Column) -> Column:
    """Grows with every relist and with every day past the grace period, up to 1."""
    relists = F.greatest(F.lit(0), relist_count) * F.lit(C.RELIST_WEIGHT)
    overdue = F.greatest(F.lit(0.0), days_open - F.lit(float(C.STALE_GRACE_DAYS)))
    stale = overdue / F.lit(float(C.STALE_SPAN_DAYS)) * F.lit(C.STALE_WEIGHT)
    return F.least(F.lit(1.0), relists + stale)


def ghost_score_at(relist_count: Column, posted_at: Column, first_seen_at: Column, now: Column) -> Column:
    """Staleness at ``now``, aged from the employer's date, else from the first sighting."""
    return ghost_score(relist_count, days_between(F.coalesce(posted_at, first_seen_at), now))


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def freshness(verified_at: Column, now: Column) -> Column:
    """1 when verified now, falling to 0 over the horizon."""
    return _unit(1.0 - days_between(verified_at, now) / F.lit(C.FRESHNESS_HORIZON_DAYS))


def match_quality(requested: Column, have: Column) -> Column:
    """Share of the requested skills a posting has; 1 when none are requested."""
    wanted, offered = lower_set(requested), lower_set(have)
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(wanted, offered)) / F.size(wanted)
    )


def rank_score(match: Column, fresh: Column) -> Column:
    """The only ranking there is. It takes match and freshness, and nothing that can be bought."""
    return F.lit(C.MATCH_WEIGHT) * _unit(match) + F.lit(C.FRESHNESS_WEIGHT) * _unit(fresh)


def token_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    million = F.lit(1_000_000.0)
    return prompt_tokens / million * F.lit(C.PRICE_INPUT) + completion_tokens / million * F.lit(
        C.PRICE_OUTPUT
    )
