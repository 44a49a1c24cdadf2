"""Dates and instants kept as text, parsed where they are compared as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_text(instant: Column) -> Column:
    """ISO-8601 with seconds and Z; the session's time zone must be UTC."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instant_of(text: Column) -> Column:
    """The instant of an ISO text; without an offset it is UTC; null where malformed."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.trim(text)))


def cutoff_of(text: Column) -> Column:
    """The instant of a cutoff; null stays null, anything malformed is an error: a cutoff that can't be read must not become none."""
    at = instant_of(text)
    return F.when(text.isNull() | at.isNotNull(), at).otherwise(F.raise_error(F.concat(F.lit("malformed cutoff: "), text)).cast("timestamp"))


def iso_day(text: Column) -> Column:
    """The leading day of a text, null where absent or not in the calendar."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(trimmed, 1, 10).try_cast("date"))


def visible_at(first_observed: Column, public_at: Column, cutoff: Column, mode: str) -> Column:
    """When a version became visible, if by the cutoff; an unknown instant never is."""
    instant = {"system": first_observed, "public": public_at}[mode]
    return F.when(instant <= cutoff, instant)


def china_display(instant: Column) -> Column:
    return F.date_format(instant + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm:ss")


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def within_hours(text: Column, now: Column, hours: int) -> Column:
    """Whether an instant lies in the hours before now. Both sides are compared as timestamps: as text, an ISO instant with its T sorts after
    any of the same day that is written with a space, which would let up to a day too much in."""
    at, end = text.try_cast("timestamp"), now.cast("timestamp")
    return F.coalesce((at >= end - F.make_interval(hours=F.lit(hours))) & (at <= end), F.lit(False))
