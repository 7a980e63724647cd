"""Calendar expressions: seasons, ISO weeks, week and month labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions.timeparts import col

# Meteorological seasons by month.
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Autumn": (9, 10, 11)}


def season(month: Column | str) -> Column:
    m = col(month)
    return reduce(lambda done, s: F.when(m.isin(*s[1]), F.lit(s[0])).otherwise(done), SEASONS.items(), F.lit(None).cast("string"))


def iso_year(d: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d)).cast("int")


def iso_week(d: Column | str) -> Column:
    return F.weekofyear(col(d))


def iso_thursday(year: Column | str, week: Column | str) -> Column:
    """The Thursday of an ISO week: it lies in the week's own year."""
    first = F.to_date(F.date_trunc("week", F.make_date(col(year), F.lit(1), F.lit(4))))
    return F.date_add(first, (col(week).cast("int") - 1) * 7 + 3)


def week_end(d: Column | str) -> Column:
    """The Sunday on or after a date."""
    return F.next_day(F.date_sub(col(d), 1), "Sun")


def next_sunday(d: Column | str) -> Column:
    """The Sunday strictly after a date."""
    return F.next_day(col(d), "Sun")


def month_end(d: Column | str) -> Column:
    return F.last_day(col(d))


def month_name(d: Column | str) -> Column:
    return F.date_format(col(d), "MMMM")


def day_name(d: Column | str) -> Column:
    return F.date_format(col(d), "EEEE")


def quarter_words(week: Column | str) -> Column:
    """What part of the year an ISO week lies in, in words. The bounds 13, 26 and 39."""
    w = col(week)
    return (
        F.when(w <= 13, "early year first quarter spring").when(w <= 26, "mid year second quarter summer")
        .when(w <= 39, "late year third quarter autumn").when(w.isNotNull(), "end year fourth quarter winter")
    )


def choose(value: Column | str, by: Sequence[tuple[object, object]], otherwise: object = None) -> Column:
    """CASE value WHEN ... THEN ... END."""
    v = col(value)
    return reduce(lambda done, x: F.when(v == F.lit(x[0]), F.lit(x[1])).otherwise(done), reversed(list(by)), F.lit(otherwise))
