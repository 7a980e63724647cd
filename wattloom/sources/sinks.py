"""Sinks: append with resume, stage tables, vector tables, logs and a Markdown table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.documents import pending
from wattloom.sources.files import hadoop_paths

LOG_COLUMNS = ("timestamp", "dataset", "granularity", "row_id", "prompt_tokens_est", "status", "latency_s")


def append_new(df: DataFrame, path: str, key: str, partition_by: list[str] | None = None) -> DataFrame:
    """Append the rows whose key isn't in the table yet, and give them back as they were written.

    A run that is broken off and started again goes on where it stopped. Keys that repeat within ``df`` are all written.
    """
    spark = df.sparkSession
    known = spark.read.parquet(path) if hadoop_paths(spark, f"{path}/*") else None
    new = df if known is None else pending(df, known, key)
    writer = new.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def save_result(rows: DataFrame, aggregate: DataFrame, directory: str) -> None:
    """An experiment's rows, partitioned by experiment and k, and its aggregates as JSON lines."""
    rows.write.mode("overwrite").partitionBy("exp_id", "top_k").parquet(f"{directory}/query_results")
    aggregate.write.mode("overwrite").json(f"{directory}/agg_metrics")


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def save_vectors(documents: DataFrame, embed: Column, path: str) -> None:
    """Documents with their vectors: the table that exact search reads. Null vectors aren't kept."""
    documents.withColumn("vector", embed).where("vector is not null").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """The vector table, or the part with given metadata: filtered before any ranking, so a search gets its full k."""
    df = spark.read.parquet(path)
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df


def request_log(prompts: DataFrame, status: Column, latency: Column, at: Column) -> DataFrame:
    """A log row per prompt; tokens are estimated as a quarter of the signs."""
    values = {"timestamp": F.date_format(at, "dd-MM-yyyy HH:mm:ss"), "prompt_tokens_est": F.floor(F.length("prompt_text") / 4), "status": status, "latency_s": F.round(latency, 3)}
    return prompts.select(*[values.get(c, F.col(c) if c not in values else None).alias(c) for c in LOG_COLUMNS])


def failure_log(prompts: DataFrame, message: Column, at: Column) -> DataFrame:
    return prompts.select(F.date_format(at, "dd-MM-yyyy HH:mm:ss").alias("timestamp"), "dataset", "granularity", "row_id", message.alias("error_msg"))


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A small table as Markdown, N/A for missing values. Reports show at most ``rows`` rows."""
    taken = df.limit(rows).collect()
    show = lambda v: "N/A" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in taken)])
