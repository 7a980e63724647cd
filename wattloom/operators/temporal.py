"""Time series at several granularities: reshaping, cleaning, and day, week, month, season, year and system aggregates.

All operators take the columns they name and ignore others. NaN counts as missing throughout: it becomes null on the way
in, and null values take no part in an aggregate; standard deviations of a single value are null. Empty tables give empty
results. Aggregates combine on the map side and are keyed by entity and period, so a busy entity is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import calendar as cal

# The columns that hold an aggregate's main figure, in order of precedence.
PRIMARY_COLUMNS = ("load_mean", "weekly_mean", "monthly_mean", "seasonal_mean", "Global_active_power_mean", "yearly_mean")
SYSTEM = "system"


def null_if_nan(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def normalised_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def number(c: Column | str) -> Column:
    """DOUBLE of text that may have thousands separators; null where it isn't a number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")


def melt_hours(df: DataFrame, value_name: str = "load_mw") -> DataFrame:
    """Wide rows of 24 hour columns h1..h24 into (zone_id, datetime, value).

    The zone is the first column whose name holds 'zone'; year, month and day give the date; h1 is the hour from 00:00.
    Values that are no numbers, and rows whose date doesn't exist, are left out.
    """
    df = normalised_names(df)
    hours = sorted((c for c in df.columns if re.fullmatch(r"h\d+", c)), key=lambda c: int(c[1:]))
    zone = next((c for c in df.columns if "zone" in c), None)
    if not hours or zone is None or not {"year", "month", "day"} <= set(df.columns):
        raise ValueError("needs a zone column, year, month, day and hour columns h1..h24")
    ids = [zone, "year", "month", "day"]
    long = df.select(*ids, *[number(h).alias(h) for h in hours]).unpivot(ids, hours, "hour_label", "value").where("value is not null")
    hour = F.regexp_extract("hour_label", r"(\d+)", 1).cast("int") - 1
    date = F.try_make_timestamp_ntz(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return long.select(F.col(zone).alias("zone_id"), (date + F.make_dt_interval(hours=hour)).alias("datetime"), F.col("value").alias(value_name)).where("datetime is not null")


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide measures into long form; null and NaN values are left out."""
    return df.select(*ids, *[null_if_nan(F.col(m).cast("double")).alias(m) for m in measures]).unpivot(list(ids), list(measures), name, value).where(F.col(value).isNotNull())


def clean_measures(df: DataFrame, measures: Sequence[str], primary: str) -> DataFrame:
    """Measures as DOUBLE with NaN and text that is no number as null; rows without the primary measure are dropped."""
    present = [m for m in measures if m in df.columns]
    out = df.withColumns({m: null_if_nan(F.col(m).try_cast("double")) for m in present})
    return out.na.drop(subset=[primary]) if primary in df.columns else out


def valid_aggregates(df: DataFrame, candidates: Sequence[str] = PRIMARY_COLUMNS) -> DataFrame:
    """Rows whose main figure is present and positive; all rows if there is no such column."""
    primary = next((c for c in candidates if c in df.columns), None)
    return df if primary is None else df.where(F.col(primary).isNotNull() & (F.col(primary) > 0))


def _stats(value: str, prefix: str, more: Sequence[Column] = ()) -> list[Column]:
    return [F.avg(value).alias(f"{prefix}_mean"), F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"), F.stddev_samp(value).alias(f"{prefix}_std"), *more]


def daily_stats(df: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """Mean, minimum, maximum, sample deviation, sum and count by entity and day, with the parts of the date."""
    rows = df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(F.col(entity).cast("string").alias("zone_id"), F.to_date(ts).alias("date"), null_if_nan(F.col(value).cast("double")).alias("v"))
    out = rows.where("v is not null").groupBy("zone_id", "date").agg(*_stats("v", "load", [F.sum("v").alias("load_sum"), F.count("v").alias("obs_count")]))
    return out.withColumns({"year": F.year("date"), "month": F.month("date"), "dow": cal.day_name("date")})


def weekly_stats(daily: DataFrame) -> DataFrame:
    """Over daily means, by entity and ISO week. The mean of daily means doesn't weigh days by their readings."""
    return daily.groupBy("zone_id", cal.iso_year("date").alias("iso_year"), cal.iso_week("date").alias("iso_week")).agg(*_stats("load_mean", "weekly"))


def monthly_stats(daily: DataFrame) -> DataFrame:
    return daily.groupBy("zone_id", "year", "month").agg(*_stats("load_mean", "monthly"))


def seasonal_stats(daily: DataFrame) -> DataFrame:
    """By calendar year and season: January, February and December of the same year make its winter."""
    return daily.groupBy("zone_id", "year", cal.season("month").alias("season")).agg(*_stats("load_mean", "seasonal", [F.count("load_mean").alias("day_count")]))


def system_stats(zones: DataFrame, level: str) -> DataFrame:
    """All zones together, from their daily, weekly or monthly statistics.

    Means, minima, maxima and sums are added up over the zones; deviations and counts are averaged. The minimum is so the
    sum of the zones' minima, not the minimum of the sum.
    """
    prefix, keys = {"daily": ("load", ["date"]), "weekly": ("weekly", ["iso_year", "iso_week"]), "monthly": ("monthly", ["year", "month"])}[level]
    sums = [c for c in (f"{prefix}_mean", f"{prefix}_min", f"{prefix}_max", "load_sum") if c in zones.columns]
    means = [c for c in (f"{prefix}_std", "obs_count") if c in zones.columns]
    out = zones.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means]).withColumn("zone_id", F.lit(SYSTEM))
    return out.withColumns({"year": F.year("date"), "month": F.month("date"), "dow": cal.day_name("date")}) if level == "daily" else out


def resample(df: DataFrame, ts: str, measures: Sequence[str], freq: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, minimum, maximum and deviation of each measure by day (D), week that ends on Sunday (W) or month (ME).

    ``period_start`` is the label: the day, the Sunday, the last day of the month. Periods without any value are dropped.
    """
    day = F.to_date(ts)
    label = {"D": day, "W": cal.week_end(day), "ME": cal.month_end(day)}[freq]
    rows = df.where(F.col(ts).isNotNull()).select(*keys, label.alias("period_start"), *[null_if_nan(F.col(m).cast("double")).alias(m) for m in measures])
    out = rows.groupBy(*keys, "period_start").agg(*[x for m in measures for x in _stats(m, m)])
    return out.where(F.coalesce(*[F.col(f"{m}_mean") for m in measures]).isNotNull())


def appliance_shares(resampled: DataFrame, meters: Mapping[str, str]) -> DataFrame:
    """Percentage of each meter (column -> output name) in the sum of all, to one place; null where the sum is 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in meters), F.lit(0.0))
    share = lambda c: F.round(F.col(c) / F.nullif(F.col("total"), F.lit(0.0)) * 100, 1)
    return resampled.withColumn("total", total).withColumns({name: share(c) for c, name in meters.items()}).drop("total")


def yearly_peak(monthly: DataFrame, date: str, value: str, keys: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """By year: statistics of the monthly means, the mean of each column of ``also``, and the season with the highest mean.

    Ties take the first season by name.
    """
    keys = list(keys)
    rows = monthly.select(*keys, F.year(date).alias("year"), cal.season(F.month(date)).alias("season"), F.col(value).alias("v"), *also)
    by_year = rows.groupBy(*keys, "year").agg(*_stats("v", "yearly"), *[F.avg(c).alias(c) for c in also])
    by_season = rows.groupBy(*keys, "year", "season").agg(F.avg("v").alias("m"))
    best = Window.partitionBy(*keys, "year").orderBy(F.col("m").desc(), "season")
    peak = by_season.withColumn("at", F.row_number().over(best)).where("at = 1").select(*keys, "year", F.col("season").alias("peak_season"))
    return by_year.join(peak, [*keys, "year"], "left")


def stratified_sample(df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int, strata: int) -> DataFrame:
    """max(1, limit // strata) rows of each stratum, by ``order``. The quota of a small stratum isn't given to others."""
    per = max(1, limit // max(1, strata))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= per).drop("_at")


def type_counts(df: DataFrame, expected: Sequence[tuple[str, str]], dataset: str = "dataset", granularity: str = "granularity") -> DataFrame:
    """Rows of each expected (dataset, granularity), with OK or MISSING."""
    want = df.sparkSession.createDataFrame(list(expected), f"{dataset} string, {granularity} string")
    counts = df.groupBy(dataset, granularity).agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return want.join(counts, [dataset, granularity], "left").select(dataset, granularity, n.alias("n"), F.when(n > 0, "OK").otherwise("MISSING").alias("status"))
