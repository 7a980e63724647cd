"""Rolling totals over trailing periods of calendar days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.timeparts import usable


def daily_totals(df: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """(entity_id, activity_day, day_total, n_readings) of the days with a usable reading."""
    return (
        df.where(usable(value, entity, ts))
        .select(F.col(entity).alias("entity_id"), F.to_date(ts).alias("activity_day"), F.col(value).cast("double").alias("value"))
        .groupBy("entity_id", "activity_day")
        .agg(F.sum("value").alias("day_total"), F.count("value").alias("n_readings"))
    )


def with_calendar(daily: DataFrame) -> DataFrame:
    """A row for each calendar day between an entity's first and last active day.

    Each active day brings forth the inactive days that follow it, so no join with a calendar is needed: the next active
    day comes from a window over the days of one entity, which are few whatever the number of readings.
    """
    by_day = Window.partitionBy("entity_id").orderBy("activity_day")
    last = F.coalesce(F.date_sub(F.lead("activity_day").over(by_day), 1), F.col("activity_day"))
    active = F.col("day") == F.col("activity_day")
    return (
        daily.withColumn("until", last)
        .withColumn("day", F.explode(F.sequence("activity_day", "until")))
        .select(
            "entity_id",
            F.col("day").alias("activity_day"),
            F.when(active, F.col("day_total")).otherwise(0.0).alias("day_total"),
            F.when(active, F.col("n_readings")).otherwise(0).alias("n_readings"),
        )
    )


def rolling_totals(df: DataFrame, entity: str, ts: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages over the trailing periods, for each entity and calendar day.

    The frame of a period of n days is a range over integer day numbers that ends with the day itself. ``avg_nd`` divides
    by n, whether or not the days were active or lie before the entity's first day; ``mean_reading_nd`` is the mean over
    the usable readings of the frame, null without any. A day without usable reading has total 0 and 0 readings.

    Rows with null entity, null time or null or NaN value take no part; every delivery counts by itself; an empty table
    gives no rows. Further columns of ``df`` are ignored, whatever their names.
    """
    out = with_calendar(daily_totals(df, entity, ts, value)).withColumn("day_no", F.unix_date("activity_day"))
    by_day = Window.partitionBy("entity_id").orderBy("day_no")
    for n in periods:
        frame = by_day.rangeBetween(-(n - 1), 0)
        total, count = F.sum("day_total").over(frame), F.sum("n_readings").over(frame)
        out = out.withColumns({
            f"total_{n}d": total,
            f"readings_{n}d": count,
            f"active_days_{n}d": F.sum(F.when(F.col("n_readings") > 0, 1).otherwise(0)).over(frame),
        })
    for n in periods:
        out = out.withColumns({
            f"avg_{n}d": F.col(f"total_{n}d") / F.lit(float(n)),
            f"mean_reading_{n}d": F.when(F.col(f"readings_{n}d") > 0, F.col(f"total_{n}d") / F.col(f"readings_{n}d")),
        })
    return out.drop("day_no")
