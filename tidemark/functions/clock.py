"""Times: one clock, UTC, fixed-width text with milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import IN_GAME, PRE_MATCH

FIXED = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def to_text(ts: Column) -> Column:
    """Fixed-width UTC text; microseconds are cut off, not rounded."""
    return F.date_format(ts, FIXED)


def from_text(text: Column) -> Column:
    """Any ISO 8601 time; null for '' and for what is none."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def day(ts: Column) -> Column:
    return F.to_date(ts)


def slug_day(slug: Column, *otherwise: Column) -> Column:
    """Midnight of the date in a slug; of no or an impossible date the first of ``otherwise`` that can be read."""
    found = F.nullif(F.regexp_extract(slug, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    return F.coalesce(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")), *[from_text(x) for x in otherwise])


def regime(kickoff: Column, now: Column) -> Column:
    """Before kickoff or not; null without a kickoff."""
    return F.when(kickoff.isNull(), None).when(now < kickoff, PRE_MATCH).otherwise(IN_GAME)
