"""Relative and absolute date resolution as native column expressions.

``resolve_date(phrase, anchor)`` works on a column of phrases (vectorised,
JVM-side) and yields NULL for anything it does not accept. The Python helper
``parse_relative_date`` evaluates the same grammar on the driver for a single
search parameter and raises ``ValueError`` on failure, so both paths agree.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions.text import WHITESPACE, trim_whitespace

# Fixed values of the date grammar.
# Whole-phrase words (matched case-insensitively, before any trimming):
#   today = midnight of the anchor day, yesterday = midnight of the day before,
#   last week / last month / last year = anchor minus 7 / 30 / 365 days.
FIXED_WORDS = {"today": None, "yesterday": None, "last week": 7, "last month": 30, "last year": 365}
# "N <unit> ago" with N >= 1; a unit is worth this many days.
UNIT_DAYS = {"day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30, "year": 365, "years": 365}
AGO_PATTERN = rf"^(\d+){WHITESPACE}+(day|days|week|weeks|month|months|year|years){WHITESPACE}+ago$"
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
# Day counts above this leave the years 1 to 9999 from any anchor; results outside these years are refused as well.
MAX_DAYS = 3_652_058
FIRST_DAY = "0001-01-01 00:00:00"


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def resolve_date(phrase: Column, anchor: Column) -> Column:
    """TIMESTAMP_NTZ for a relative-date phrase, or NULL when it is not valid.

    The expression is kept small (each piece appears at most a few times in
    the tree): a non-match extracts '', which casts to NULL; an oversized
    number overflows ``try_multiply`` to NULL.
    """
    low = F.lower(phrase)
    midnight = F.date_trunc("DAY", anchor).cast("timestamp_ntz")
    trimmed = trim_whitespace(low)
    per_unit = F.try_element_at(
        F.create_map(*[x for u, d in UNIT_DAYS.items() for x in (F.lit(u), F.lit(d).cast("bigint"))]),
        F.regexp_extract(trimmed, AGO_PATTERN, 2))
    days = F.try_multiply(F.regexp_extract(trimmed, AGO_PATTERN, 1).try_cast("bigint"), per_unit)
    ago = F.when(days.between(1, MAX_DAYS), anchor - _days(days))
    ago = F.when(ago >= F.lit(FIRST_DAY).cast("timestamp_ntz"), ago)
    fixed = F.try_element_at(
        F.create_map(*[x for w, d in FIXED_WORDS.items() if d for x in (F.lit(w), F.lit(d))]), low)
    return (
        F.when(low == "today", midnight)
        .when(low == "yesterday", (midnight - _days(F.lit(1))).cast("timestamp_ntz"))
        .when(fixed.isNotNull(), anchor - _days(fixed))
        .otherwise(ago)
    )


_AGO_RE = re.compile(AGO_PATTERN.replace(WHITESPACE, r"\s"), re.UNICODE)


def parse_relative_date(phrase: str, anchor: dt.datetime | None = None) -> dt.datetime:
    """Driver-side twin of :func:`resolve_date` for one search parameter."""
    now = anchor or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    low = phrase.lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if low == "today":
        return midnight
    if low == "yesterday":
        return midnight - dt.timedelta(days=1)
    if low in FIXED_WORDS:
        return now - dt.timedelta(days=FIXED_WORDS[low])
    m = _AGO_RE.match(low.strip())
    if not m or not m.group(1).isascii():
        raise ValueError(f"not a relative date: {phrase!r}")
    n = int(m.group(1))
    if n <= 0:
        raise ValueError(f"a relative date needs a count of one or more, not {n}")
    days = n * UNIT_DAYS[m.group(2)]
    try:
        if days > MAX_DAYS:
            raise OverflowError
        return now - dt.timedelta(days=days)
    except OverflowError:
        raise ValueError(f"a relative date {n} units back is before year 1") from None


def date_bound(value, anchor: dt.datetime | None = None, end: bool = False) -> dt.datetime:
    """A search bound from a datetime, an ISO date or a relative phrase.

    A bare ``YYYY-MM-DD`` as the upper bound covers the whole day: the bound
    returned is the last microsecond of that day (inclusive ``<=``).
    """
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, dt.date):
        value = value.isoformat()
    text = str(value)
    if re.match(ISO_DATE_PATTERN, text.strip()):
        day = dt.datetime.strptime(text.strip(), "%Y-%m-%d")
        return day + dt.timedelta(days=1) - dt.timedelta(microseconds=1) if end else day
    return parse_relative_date(text, anchor)
