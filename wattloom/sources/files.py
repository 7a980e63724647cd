"""Readers of raw files and stage tables: text is read with stated types, never inferred over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions import text as tx


def hadoop_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern, on any file system that Spark reads, sorted; [] for none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    return sorted(str(x.getPath().toString()) for x in (found or []))


def check_paths(spark: SparkSession, *dirs: str) -> None:
    """Raise FileNotFoundError that names the first missing directory."""
    for d in dirs:
        if not hadoop_paths(spark, d):
            raise FileNotFoundError(d)


def find_file(spark: SparkSession, directory: str, patterns: Sequence[str]) -> str | None:
    """Of the first pattern that matches anything the last file by name; null if none does."""
    for p in patterns:
        if found := hadoop_paths(spark, f"{directory}/{p}"):
            return found[-1]
    return None


def read_csv(spark: SparkSession, path: str, sep: str = ",", null: str | None = None) -> DataFrame:
    """A CSV with a header; every column as text, quotes and line breaks inside quotes allowed."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    return (reader.option("nullValue", null) if null is not None else reader).csv(path)


def read_csv_directory(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Each CSV of a directory by its lower-case stem; files that can't be read are skipped. Raises if there is none."""
    out: dict[str, DataFrame] = {}
    for path in hadoop_paths(spark, f"{directory}/*.csv"):
        try:
            out[path.rpartition("/")[2].removesuffix(".csv").lower()] = read_csv(spark, path)
        except AnalysisException:
            continue
    if not out:
        raise FileNotFoundError(f"no readable CSV in {directory}")
    return out


def sniff_separator(spark: SparkSession, path: str) -> str:
    """';' if the first line has one, else ','."""
    first = spark.read.text(path).first()
    return ";" if first is not None and ";" in first[0] else ","


def read_meter_file(spark: SparkSession, path: str, date: str = "Date", time: str = "Time") -> DataFrame:
    """A meter's raw file: separator found out, '?' as null, day-first date and time fused to ``datetime``.

    Rows with a date or time that doesn't exist have a null datetime. The other columns become DOUBLE, null where they are
    no number.
    """
    raw = read_csv(spark, path, sniff_separator(spark, path), "?")
    fused = F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("d/M/yyyy H:mm:ss")).cast("timestamp_ntz")
    return raw.select(fused.alias("datetime"), *[F.col(c).try_cast("double").alias(c) for c in raw.columns if c not in (date, time)])


def read_kb(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """A knowledge base from Parquet or CSV; one dataset of it, if named."""
    kb = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    return kb if dataset is None else kb.where(F.col("dataset") == dataset)


def documents_from_kb(kb: DataFrame, text: str = "summary") -> DataFrame:
    """Documents with content: the summary as text, the rest as text metadata."""
    from wattloom.operators.documents import cleaned_documents

    return cleaned_documents(kb, text, [c for c in kb.columns if c != text])


def documents_from_records(df: DataFrame, column: str) -> DataFrame:
    """Text of 'key: value' lines to its ``summary``; the whole text where there is no such key."""
    m = tx.key_values(column)
    return df.withColumn("text", F.coalesce(F.nullif(m["summary"], F.lit("")), F.col(column)))


def read_json_or_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table from JSON (a list of records or an object of columns) or CSV."""
    if not path.endswith(".json"):
        return read_csv(spark, path)
    df = spark.read.option("multiLine", True).json(path)
    if df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema):
        return df.select(F.explode(F.arrays_zip(*df.columns)).alias("r")).select("r.*")
    return df


def read_result(spark: SparkSession, directory: str) -> DataFrame:
    """An experiment's rows: Parquet, else CSV, else JSON. Raises if there is none of them."""
    for pattern in ("*.parquet", "query_results.csv", "*.json"):
        if hadoop_paths(spark, f"{directory}/{pattern}"):
            return spark.read.parquet(directory) if pattern == "*.parquet" else read_json_or_csv(spark, find_file(spark, directory, [pattern]))
    raise FileNotFoundError(directory)


def read_run(spark: SparkSession, root: str, exp_id: str, top_k: int) -> DataFrame:
    """One run of the results table, which is partitioned by exp_id and top_k: only its files are read."""
    return spark.read.parquet(root).where((F.col("exp_id") == exp_id) & (F.col("top_k") == top_k))
