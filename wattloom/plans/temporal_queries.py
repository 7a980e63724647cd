"""Queries of the time-series operators over load_history and household."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import evaluation as ev
from wattloom.operators import temporal as tp
from wattloom.sources.tables import table

MEASURES = ("global_active_power", "global_reactive_power", "voltage", "global_intensity", "sub_metering_1", "sub_metering_2", "sub_metering_3")
METERS = {f"sub_metering_{i}_mean": f"share_{i}_pct" for i in (1, 2, 3)}


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to four places and dates as text, for comparison. Halves go up even if a sum falls short by its order."""
    turned = {"double": lambda c: F.round(F.col(c) + 1e-9, digits), "date": lambda c: F.col(c).cast("string"), "timestamp_ntz": lambda c: F.col(c).cast("string")}
    return df.select(*[turned.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.daily_stats(table(spark, sf_dir, "load_history"), "zone_id", "datetime", "load_mw")


def _house(spark: SparkSession, sf_dir: str, freq: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    return tp.resample(table(spark, sf_dir, "household").where("house_id is not null"), "datetime", measures, freq, ["house_id"])


def daily_stats(spark, sf_dir):
    return _rounded(days(spark, sf_dir))


def weekly_stats(spark, sf_dir):
    return _rounded(tp.weekly_stats(days(spark, sf_dir)))


def monthly_stats(spark, sf_dir):
    return _rounded(tp.monthly_stats(days(spark, sf_dir)))


def seasonal_stats(spark, sf_dir):
    return _rounded(tp.seasonal_stats(days(spark, sf_dir)))


def system_daily(spark, sf_dir):
    return _rounded(tp.system_stats(days(spark, sf_dir), "daily"), 3)


def system_weekly(spark, sf_dir):
    return _rounded(tp.system_stats(tp.weekly_stats(days(spark, sf_dir)), "weekly"), 3)


def system_monthly(spark, sf_dir):
    return _rounded(tp.system_stats(tp.monthly_stats(days(spark, sf_dir)), "monthly"), 3)


def resample_day(spark, sf_dir):
    return _rounded(_house(spark, sf_dir, "D"))


def resample_week(spark, sf_dir):
    return _rounded(_house(spark, sf_dir, "W"))


def resample_month(spark, sf_dir):
    return _rounded(_house(spark, sf_dir, "ME"))


def share_pct(spark, sf_dir):
    monthly = _house(spark, sf_dir, "ME", ("sub_metering_1", "sub_metering_2", "sub_metering_3"))
    return _rounded(tp.appliance_shares(monthly, METERS).select("house_id", "period_start", *METERS.values()))


def yearly_peak(spark, sf_dir):
    return _rounded(tp.yearly_peak(_house(spark, sf_dir, "ME"), "period_start", "global_active_power_mean", ["house_id"], [f"sub_metering_{i}_mean" for i in (1, 2, 3)]))


def melt_measures(spark, sf_dir):
    return tp.unpivot_measures(table(spark, sf_dir, "household"), ["reading_id"], ["sub_metering_1", "sub_metering_2", "sub_metering_3"])


def melt_hours(spark, sf_dir):
    """Hourly means laid out wide, as text with thousands separators, and read back into the long form."""
    rows = table(spark, sf_dir, "load_history").where("zone_id is not null and datetime is not null")
    v = tp.null_if_nan("load_mw")
    wide = rows.groupBy("zone_id", F.year("datetime").alias("Year "), F.month("datetime").alias("month"), F.day("datetime").alias("day")).agg(
        *[F.format_number(F.round(F.avg(F.when(F.hour("datetime") == h - 1, v)) + 1e-9, 2), 2).alias(f"h{h}") for h in range(1, 25)]
    )
    return tp.melt_hours(wide).withColumn("datetime", F.col("datetime").cast("string"))


def clean_rows(spark, sf_dir):
    df = tp.clean_measures(table(spark, sf_dir, "household"), ["global_active_power", "voltage", "global_intensity"], "global_active_power")
    return df.select("reading_id", "global_active_power", "voltage", "global_intensity")


def validate_rows(spark, sf_dir):
    return _rounded(tp.valid_aggregates(days(spark, sf_dir)).select("zone_id", "date", "load_mean"))


def stratified_sample(spark, sf_dir):
    order = F.pmod((F.year("date").cast("long") * 372 + F.month("date") * 31 + F.day("date")) * 7919, F.lit(1009))
    return _rounded(tp.stratified_sample(days(spark, sf_dir), ["zone_id"], [order, F.col("date")], 100, 20).select("zone_id", "date", "load_mean"))


def type_counts(spark, sf_dir):
    expected = [(d, g) for d in ("gefcom", "household", "system", "grid") for g in ("daily", "weekly", "monthly", "seasonal")]
    return tp.type_counts(table(spark, sf_dir, "documents"), expected)


def reading_gaps(spark, sf_dir):
    return ev.missing_counts(table(spark, sf_dir, "household").select(*[tp.null_if_nan(c).alias(c) for c in MEASURES]), list(MEASURES))


QUERIES = {
    f.__name__: f
    for f in (
        daily_stats, weekly_stats, monthly_stats, seasonal_stats, system_daily, system_weekly, system_monthly, resample_day, resample_week, resample_month,
        share_pct, yearly_peak, melt_measures, melt_hours, clean_rows, validate_rows, stratified_sample, type_counts, reading_gaps,
    )
}

_SEASON = "CASE WHEN {m} IN (12, 1, 2) THEN 'Winter' WHEN {m} <= 5 THEN 'Spring' WHEN {m} <= 8 THEN 'Summer' ELSE 'Autumn' END"
_DAYS = """
WITH days AS (SELECT CAST(zone_id AS VARCHAR) AS zone_id, CAST(datetime AS DATE) AS date, avg(load_mw) AS load_mean, min(load_mw) AS load_min, max(load_mw) AS load_max,
  stddev_samp(load_mw) AS load_std, sum(load_mw) AS load_sum, count(*) AS obs_count FROM load_history
  WHERE zone_id IS NOT NULL AND datetime IS NOT NULL AND load_mw IS NOT NULL AND NOT isnan(load_mw) GROUP BY 1, 2)"""
_OVER = "avg(load_mean) AS {p}_mean, min(load_mean) AS {p}_min, max(load_mean) AS {p}_max, stddev_samp(load_mean) AS {p}_std"
_WEEKS = f", weeks AS (SELECT zone_id, CAST(isoyear(date) AS INT) AS iso_year, CAST(week(date) AS INT) AS iso_week, {_OVER.format(p='weekly')} FROM days GROUP BY 1, 2, 3)"
_MONTHS = f", months AS (SELECT zone_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, {_OVER.format(p='monthly')} FROM days GROUP BY 1, 2, 3)"


def _round(prefix: str, columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({prefix}_{c} + 1e-9, {digits}) AS {prefix}_{c}" for c in columns.split())


def _system(prefix: str, source: str, keys: str) -> str:
    sums = ", ".join(f"round(sum({prefix}_{c}) + 1e-9, 3) AS {prefix}_{c}" for c in ("mean", "min", "max"))
    return f"SELECT {keys}, {sums}, round(avg({prefix}_std) + 1e-9, 3) AS {prefix}_std, 'system' AS zone_id FROM {source} GROUP BY {keys}"


def _stats_of(m: str) -> str:
    v = f"CASE WHEN NOT isnan({m}) THEN {m} END"
    return f"avg({v}) AS {m}_mean, min({v}) AS {m}_min, max({v}) AS {m}_max, stddev_samp({v}) AS {m}_std"


_LABEL = {"D": "d", "W": "CAST(d + INTERVAL ((7 - isodow(d))) DAY AS DATE)", "ME": "last_day(d)"}


def _resampled(freq: str, measures: tuple[str, ...]) -> str:
    present = " OR ".join(f"{m}_mean IS NOT NULL" for m in measures)
    return f"""(SELECT * FROM (SELECT house_id, {_LABEL[freq]} AS period_start, {', '.join(map(_stats_of, measures))}
      FROM (SELECT *, CAST(datetime AS DATE) AS d FROM household WHERE house_id IS NOT NULL AND datetime IS NOT NULL) GROUP BY 1, 2) WHERE {present})"""


def _resample_sql(freq: str) -> str:
    return f"SELECT house_id, CAST(period_start AS VARCHAR) AS period_start, {', '.join(_round(m, 'mean min max std') for m in MEASURES)} FROM {_resampled(freq, MEASURES)}"


_TOTAL = "nullif(" + " + ".join(f"coalesce(sub_metering_{i}_mean, 0)" for i in (1, 2, 3)) + ", 0)"
ORACLE_SQL = {
    "daily_stats": _DAYS + f"SELECT zone_id, CAST(date AS VARCHAR) AS date, {_round('load', 'mean min max std sum')}, obs_count, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, dayname(date) AS dow FROM days",
    "weekly_stats": _DAYS + _WEEKS + f"SELECT zone_id, iso_year, iso_week, {_round('weekly', 'mean min max std')} FROM weeks",
    "monthly_stats": _DAYS + _MONTHS + f"SELECT zone_id, year, month, {_round('monthly', 'mean min max std')} FROM months",
    "seasonal_stats": _DAYS + f"SELECT zone_id, year, season, {_round('seasonal', 'mean min max std')}, day_count FROM (SELECT zone_id, CAST(year(date) AS INT) AS year, {_SEASON.format(m='month(date)')} AS season, {_OVER.format(p='seasonal')}, count(*) AS day_count FROM days GROUP BY 1, 2, 3)",
    "system_daily": _DAYS + """SELECT CAST(date AS VARCHAR) AS date, round(sum(load_mean) + 1e-9, 3) AS load_mean, round(sum(load_min) + 1e-9, 3) AS load_min, round(sum(load_max) + 1e-9, 3) AS load_max, round(sum(load_sum) + 1e-9, 3) AS load_sum,
      round(avg(load_std) + 1e-9, 3) AS load_std, round(avg(obs_count) + 1e-9, 3) AS obs_count, 'system' AS zone_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, dayname(date) AS dow FROM days GROUP BY days.date""",
    "system_weekly": _DAYS + _WEEKS + _system("weekly", "weeks", "iso_year, iso_week"),
    "system_monthly": _DAYS + _MONTHS + _system("monthly", "months", "year, month"),
    "resample_day": _resample_sql("D"),
    "resample_week": _resample_sql("W"),
    "resample_month": _resample_sql("ME"),
    "share_pct": f"SELECT house_id, CAST(period_start AS VARCHAR) AS period_start, {', '.join(f'round(round(sub_metering_{i}_mean / {_TOTAL} * 100, 1) + 1e-9, 4) AS share_{i}_pct' for i in (1, 2, 3))} FROM {_resampled('ME', ('sub_metering_1', 'sub_metering_2', 'sub_metering_3'))}",
    "yearly_peak": f"""
      WITH m AS (SELECT house_id, CAST(year(period_start) AS INT) AS year, {_SEASON.format(m='month(period_start)')} AS season, global_active_power_mean AS v, sub_metering_1_mean, sub_metering_2_mean, sub_metering_3_mean FROM {_resampled('ME', MEASURES)}),
      y AS (SELECT house_id, year, avg(v) AS yearly_mean, min(v) AS yearly_min, max(v) AS yearly_max, stddev_samp(v) AS yearly_std, avg(sub_metering_1_mean) AS s1, avg(sub_metering_2_mean) AS s2, avg(sub_metering_3_mean) AS s3 FROM m GROUP BY 1, 2),
      s AS (SELECT *, row_number() OVER (PARTITION BY house_id, year ORDER BY mm DESC, season) AS at FROM (SELECT house_id, year, season, avg(v) AS mm FROM m GROUP BY 1, 2, 3))
      SELECT y.house_id, y.year, {_round('yearly', 'mean min max std')}, {', '.join(f'round(s{i} + 1e-9, 4) AS sub_metering_{i}_mean' for i in (1, 2, 3))}, s.season AS peak_season FROM y LEFT JOIN s ON s.house_id = y.house_id AND s.year = y.year AND s.at = 1""",
    "melt_measures": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT reading_id, 'sub_metering_{i}' AS measure, sub_metering_{i} AS value FROM household" for i in (1, 2, 3)) + ") WHERE value IS NOT NULL AND NOT isnan(value)",
    "melt_hours": """SELECT zone_id, strftime(date_trunc('hour', datetime), '%Y-%m-%d %H:%M:%S') AS datetime, round(avg(load_mw) + 1e-9, 2) AS load_mw FROM load_history
      WHERE zone_id IS NOT NULL AND datetime IS NOT NULL AND load_mw IS NOT NULL AND NOT isnan(load_mw) GROUP BY 1, 2""",
    "clean_rows": "SELECT reading_id, global_active_power, CASE WHEN NOT isnan(voltage) THEN voltage END AS voltage, CASE WHEN NOT isnan(global_intensity) THEN global_intensity END AS global_intensity FROM household WHERE global_active_power IS NOT NULL AND NOT isnan(global_active_power)",
    "validate_rows": _DAYS + "SELECT zone_id, CAST(date AS VARCHAR) AS date, round(load_mean + 1e-9, 4) AS load_mean FROM days WHERE load_mean > 0",
    "stratified_sample": _DAYS + "SELECT zone_id, CAST(date AS VARCHAR) AS date, round(load_mean + 1e-9, 4) AS load_mean FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY ((year(date) * 372 + month(date) * 31 + day(date)) * 7919) % 1009, days.date) AS rn FROM days) WHERE rn <= 5",
    "type_counts": "SELECT e.dataset, e.granularity, count(d.doc_id) AS n, CASE WHEN count(d.doc_id) > 0 THEN 'OK' ELSE 'MISSING' END AS status FROM (SELECT * FROM (VALUES ('gefcom'), ('household'), ('system'), ('grid')) a(dataset), (VALUES ('daily'), ('weekly'), ('monthly'), ('seasonal')) b(granularity)) e LEFT JOIN documents d ON d.dataset = e.dataset AND d.granularity = e.granularity GROUP BY 1, 2",
    "reading_gaps": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM household" for c in MEASURES),
}
