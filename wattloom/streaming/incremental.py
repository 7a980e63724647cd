"""Running the batch operators on arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattloom.functions.timeparts import usable
from wattloom.sources.sinks import append_new


def read_arriving(spark: SparkSession, directory: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that come to a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def daily_stats_stream(readings: DataFrame, entity: str, ts: str, value: str, late: str = "30 days") -> DataFrame:
    """Statistics by entity and day of a stream of readings; a day is given out once readings ``late`` behind can't come.

    The time is read as UTC for the watermark. Unusable readings take no part.
    """
    rows = readings.where(usable(value, entity, ts)).select(F.col(entity).alias("zone_id"), F.col(ts).cast("timestamp").alias("at"), F.col(value).cast("double").alias("v"))
    days = rows.withWatermark("at", late).groupBy("zone_id", F.window("at", "1 day"))
    out = days.agg(F.avg("v").alias("load_mean"), F.min("v").alias("load_min"), F.max("v").alias("load_max"), F.stddev_samp("v").alias("load_std"), F.sum("v").alias("load_sum"), F.count("v").alias("obs_count"))
    return out.select("zone_id", F.to_date("window.start").alias("date"), "load_mean", "load_min", "load_max", "load_std", "load_sum", "obs_count")


def append_arriving(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and append what is new by key, until all present files are read.

    A batch that is run again after a failure finds its keys in the table and adds nothing twice.
    """
    return (
        stream.writeStream.foreachBatch(lambda df, _: append_new(operator(df), out, key) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
