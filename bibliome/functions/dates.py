"""Dates as sources write them, and the date a feed sorts by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how many days ahead a publication date may lie and still be believed.
HORIZON_DAYS = 365


def iso_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def notice_date(c: Column) -> Column:
    """Month first with or without a time, else ISO; null where none of them fits."""
    return F.coalesce(F.try_to_date(c, "M/d/yyyy H:mm"), F.try_to_date(c, "M/d/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def plausible(c: Column, today: Column) -> Column:
    return c.isNull() | (c <= F.date_add(today, HORIZON_DAYS))


def believed(c: Column, today: Column) -> Column:
    return F.when(plausible(c, today), c)


def feed_date(published: Column, first_seen: Column) -> Column:
    """The earlier of what a paper claims and when it came in; null where it claims nothing."""
    return F.when(published.isNotNull(), F.least(published, first_seen))


def earliest(a: Column, b: Column) -> Column:
    return F.least(a, b)
