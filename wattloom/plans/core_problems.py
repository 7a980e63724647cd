"""Queries of the numbered problems on readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.impute import METERS, filled_readings
from wattloom.operators.regular_grid import OBSERVED, regular_grid
from wattloom.operators.rolling import rolling_totals
from wattloom.operators.spikes import SpikeRule, implausible_measures
from wattloom.sources.tables import table

HOUR, HALF_HOUR = 3600, 1800
LOAD_RULE = SpikeRule(low=0.0, low_open=True)
VOLTAGE_RULE = SpikeRule(low=0.0, low_open=True, least_ratio=1.05)
POWER_RULE = SpikeRule(low=0.0, heavy_tail=True, least_ratio=1.5)


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_totals(table(spark, sf_dir, "load_history"), "zone_id", "datetime", "load_mw")
    rounded = [F.round(c, 4).alias(c) for c in ("day_total", "total_7d", "total_30d", "avg_7d", "avg_30d", "mean_reading_7d", "mean_reading_30d")]
    return out.select(
        F.col("entity_id").alias("zone_id"), F.col("activity_day").cast("string").alias("activity_day"), "n_readings", "readings_7d", "readings_30d",
        "active_days_7d", "active_days_30d", *rounded,
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_totals(table(spark, sf_dir, "load_history"), "zone_id", "datetime", "load_mw")
    return out.where("n_readings = 0").select(F.col("entity_id").alias("zone_id"), F.col("activity_day").cast("string").alias("activity_day"))


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = regular_grid(table(spark, sf_dir, "load_history"), "zone_id", "datetime", "load_mw", HOUR, max_gap_steps=6)
    house = regular_grid(table(spark, sf_dir, "household"), "house_id", "datetime", "global_active_power", HALF_HOUR, max_gap_steps=12)
    both = load.withColumn("source_table", F.lit("load_history")).unionByName(house.withColumn("source_table", F.lit("household")))
    return both.select("source_table", "entity_id", F.col("period_start").cast("string").alias("period_start"), "value", "status", "n_readings")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_grid(spark, sf_dir).where(F.col("status") != OBSERVED).select("source_table", "entity_id", "period_start")


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    load, house = table(spark, sf_dir, "load_history"), table(spark, sf_dir, "household")
    amps = F.when(F.col("global_intensity").between(0.05, 200.0), F.col("global_intensity"))
    zones = implausible_measures(load, "reading_id", "zone_id", "datetime", {"load_mw": LOAD_RULE}).withColumn("source_table", F.lit("load_history"))
    rules = {"global_active_power": POWER_RULE, "voltage": VOLTAGE_RULE}
    homes = implausible_measures(house, "reading_id", "house_id", "datetime", rules, {"global_active_power": amps}).withColumn("source_table", F.lit("household"))
    return zones.unionByName(homes).select("source_table", "reading_id", "field", "entity_id", "value", "kind")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_flags(spark, sf_dir).select("source_table", "reading_id", "field")


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filled_readings(table(spark, sf_dir, "household"), "reading_id", "house_id", "datetime")
    return out.withColumn("datetime", F.col("datetime").cast("string"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = p6_filled(spark, sf_dir)
    marks = F.array(*[F.when(F.col(f"{t}_source") != OBSERVED, F.lit(t)) for t in METERS])
    return out.select("reading_id", F.explode(F.array_compact(marks)).alias("field"))


QUERIES = {f.__name__: f for f in (p2_rolling, p2_found, p3_grid, p3_found, p4_flags, p4_found, p6_filled, p6_found)}

_P2_CALENDAR = """
WITH usable AS (SELECT zone_id, CAST(datetime AS DATE) AS d, load_mw FROM load_history
                WHERE zone_id IS NOT NULL AND datetime IS NOT NULL AND load_mw IS NOT NULL AND NOT isnan(load_mw)),
daily AS (SELECT zone_id, d, sum(load_mw) AS day_total, count(*) AS n FROM usable GROUP BY zone_id, d),
bounds AS (SELECT zone_id, min(d) AS a, max(d) AS b FROM daily GROUP BY zone_id),
days AS (SELECT zone_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM bounds),
calendar AS (SELECT c.zone_id, c.d, coalesce(y.day_total, 0) AS day_total, coalesce(y.n, 0) AS n
             FROM days c LEFT JOIN daily y ON y.zone_id = c.zone_id AND y.d = c.d)
"""


def _grid_sql(table_name: str, entity: str, value: str, step: str) -> str:
    return f"""
SELECT '{table_name}' AS source_table, g.{entity} AS entity_id, strftime(g.p, '%Y-%m-%d %H:%M:%S') AS period_start FROM (
  SELECT {entity}, unnest(generate_series(min(p), max(p), INTERVAL {step})) AS p FROM (
    SELECT {entity}, time_bucket(INTERVAL {step}, datetime, TIMESTAMP '1970-01-01') AS p FROM {table_name}
    WHERE {entity} IS NOT NULL AND datetime IS NOT NULL AND {value} IS NOT NULL AND NOT isnan({value})) GROUP BY {entity}) g
WHERE NOT EXISTS (SELECT 1 FROM {table_name} r WHERE r.{entity} = g.{entity} AND {value} IS NOT NULL AND NOT isnan({value})
  AND time_bucket(INTERVAL {step}, r.datetime, TIMESTAMP '1970-01-01') = g.p)"""


ORACLE_SQL = {
    "p2_rolling": _P2_CALENDAR + """
SELECT zone_id, CAST(d AS VARCHAR) AS activity_day, n AS n_readings, CAST(sum(n) OVER w7 AS BIGINT) AS readings_7d, CAST(sum(n) OVER w30 AS BIGINT) AS readings_30d,
  CAST(count(*) FILTER (n > 0) OVER w7 AS BIGINT) AS active_days_7d, CAST(count(*) FILTER (n > 0) OVER w30 AS BIGINT) AS active_days_30d,
  round(day_total, 4) AS day_total, round(sum(day_total) OVER w7, 4) AS total_7d, round(sum(day_total) OVER w30, 4) AS total_30d,
  round(sum(day_total) OVER w7 / 7.0, 4) AS avg_7d, round(sum(day_total) OVER w30 / 30.0, 4) AS avg_30d,
  round(CASE WHEN sum(n) OVER w7 > 0 THEN sum(day_total) OVER w7 / sum(n) OVER w7 END, 4) AS mean_reading_7d,
  round(CASE WHEN sum(n) OVER w30 > 0 THEN sum(day_total) OVER w30 / sum(n) OVER w30 END, 4) AS mean_reading_30d
FROM calendar
WINDOW w7 AS (PARTITION BY zone_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY zone_id ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""",
    "p2_found": _P2_CALENDAR + "SELECT zone_id, CAST(d AS VARCHAR) AS activity_day FROM calendar WHERE n = 0",
    "p3_found": _grid_sql("load_history", "zone_id", "load_mw", "1 HOUR") + " UNION ALL " + _grid_sql("household", "house_id", "global_active_power", "30 MINUTE"),
    "p6_found": """
SELECT reading_id, 'global_active_power' AS field FROM household WHERE global_active_power IS NULL OR isnan(global_active_power)
UNION ALL SELECT reading_id, 'sub_metering_1' FROM household WHERE sub_metering_1 IS NULL OR isnan(sub_metering_1) OR sub_metering_1 < 0 OR sub_metering_1 > 1000
UNION ALL SELECT reading_id, 'global_intensity' FROM household WHERE global_intensity IS NULL OR isnan(global_intensity) OR global_intensity < 0 OR global_intensity > 500""",
}
