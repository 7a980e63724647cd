"""Date and time expressions on TIMESTAMP_NTZ columns; none depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds of the wall clock since 1970-01-01 00:00:00."""
    ts = col(ts)
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_epoch_seconds(seconds: Column | str) -> Column:
    s = col(seconds).cast("long")
    day, rest = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    return F.date_from_unix_date(day.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(secs=rest.cast("decimal(18,6)"))


def usable(value: Column | str, *present: Column | str) -> Column:
    """The value is neither null nor NaN, and the other columns are present."""
    value = col(value)
    ok = value.isNotNull() & ~F.isnan(value.cast("double"))
    for c in present:
        ok = ok & col(c).isNotNull()
    return ok
