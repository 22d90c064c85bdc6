"""Short texts shown for a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: what a missing bound and undisclosed pay read as --------------
MISSING = "None"
UNDISCLOSED = "薪资未公开"


def salary_text(low: Column, high: Column, currency: Column, absent: str = UNDISCLOSED) -> Column:
    """'USD 90000–140000'; zero bounds count as unstated."""
    stated = (F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0)
    bound = lambda c: F.coalesce(c.cast("string"), F.lit(MISSING))
    text = F.concat(F.coalesce(currency, F.lit("")), F.lit(" "), bound(low), F.lit("–"), bound(high))
    return F.when(stated, text).otherwise(F.lit(absent))


def scope_text(scope: Column, regions: Column) -> Column:
    """'region_locked [EMEA]', or '' for a posting that is not remote."""
    listed = F.when(F.size(regions) > 0, F.concat(F.lit(" ["), F.array_join(regions, ", "), F.lit("]")))
    return F.coalesce(F.concat(scope, F.coalesce(listed, F.lit(""))), F.lit(""))
