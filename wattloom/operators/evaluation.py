"""Evaluation tables: aggregates by experiment and pipeline, scorecards, rankings and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import metrics as mx
from wattloom.functions import text as tx
from wattloom.operators.temporal import null_if_nan


def experiment_aggregate(results: DataFrame, keys: Sequence[str], means: Sequence[str], rates: Sequence[str] = (), latency: str = "latency_sec", error: str = "error") -> DataFrame:
    """By experiment: rows, errors, mean of the present values, and rates in which a missing value is 0; to four places.

    Means are taken in decimals of nine places, so halves round up whatever the order of the rows. Rows with a filled error count as errors and take no part in the means. NaN is missing.
    """
    ok = F.coalesce(F.col(error), F.lit("")) == ""
    value = lambda c: F.when(ok, null_if_nan(F.col(c).cast("double")))
    return results.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(ok, 0).otherwise(1)).alias("n_errors"),
        *[F.round(F.avg(value(c).cast("decimal(38,9)")), 4).cast("double").alias(f"avg_{c}") for c in means],
        *[F.round(F.sum(F.when(ok, F.coalesce(value(c), F.lit(0.0)))) / F.sum(F.when(ok, 1)), 4).alias(f"rate_{c}") for c in rates],
        F.round(F.avg(value(latency)), 4).alias("avg_latency"),
    )


def mean_and_count(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Of each metric the mean of and the number of its values."""
    v = lambda m: null_if_nan(F.col(m).cast("double"))
    return df.groupBy(*keys).agg(*[x for m in metrics for x in (F.round(F.avg(v(m)), 4).alias(f"{m}_mean"), F.count(v(m)).alias(f"{m}_count"))])


def coverage_table(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, n_valid, n_total, pct_valid) over all rows, computed in one pass."""
    v = lambda m: null_if_nan(F.col(m).cast("double"))
    one = df.agg(F.count("*").alias("n_total"), *[F.count(v(m)).alias(m) for m in metrics])
    return one.unpivot(["n_total"], list(metrics), "metric", "n_valid").select("metric", "n_valid", "n_total", F.round(F.col("n_valid") * 100.0 / F.nullif("n_total", F.lit(0)), 2).alias("pct_valid"))


def pass_rates(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Percentage of true in each flag; null flags don't count."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f).cast("int")) * 100, 2).alias(f"{f}_pct") for f in flags])


def length_describe(df: DataFrame, key: str | None, text: str) -> DataFrame:
    """Word counts of texts: count, mean, deviation, minimum and maximum; over all rows (no key) the quartiles as well."""
    rows = df.select(*([key] if key else []), tx.word_count(text).alias("words"))
    stats = [F.count("words").alias("count"), F.round(F.avg("words"), 4).alias("mean"), F.round(F.stddev_samp("words"), 4).alias("std"), F.min("words").alias("min"), F.max("words").alias("max")]
    if key:
        return rows.groupBy(key).agg(*stats)
    q = F.percentile("words", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.agg(*stats, q.alias("q")).select("*", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]).drop("q")


def counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row by column, 0 for none. The columns are stated, so no extra pass looks for them."""
    return df.groupBy(row).agg(*[F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(v) for v in values])


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in columns]).unpivot([], list(columns), "column", "missing")


def filled_percentages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows with content, by column."""
    full = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    return df.agg(*[F.round(F.avg(full(c).cast("int")) * 100, 2).alias(c) for c in columns]).unpivot([], list(columns), "column", "pct_filled")


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the present values of a row; null without any."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(n, F.lit(0))


def ranking(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """Ranks over a table of results per pipeline or experiment, which is small whatever the data."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), tie)))


def retrieval_summary(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Composite (mean of the metrics) and rank per pipeline."""
    return ranking(df.withColumn("composite_score", F.round(row_mean([F.col(m) for m in metrics]), 4)), "composite_score", key)


def baseline_change(df: DataFrame, key: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Percentage change of each metric against the baseline's row; null without one or if it is 0."""
    base = {m: df.where(F.col(key) == baseline).agg(F.max(m)).scalar() for m in metrics}
    change = lambda m: F.round((F.col(m) - base[m]) / F.nullif(base[m], F.lit(0.0)) * 100, 2)
    return df.select(key, *[change(m).alias(f"{m}_change_pct") for m in metrics])


def scorecard(retrieval: DataFrame, guard: DataFrame, judge: DataFrame | None = None, key: str = "pipeline") -> DataFrame:
    """Retrieval composite, pass rate and risk per pipeline in one table, ranked by the mean of both, each scaled to 1."""
    risk = guard.withColumn("risk_score", F.round(1 - F.col("overall_pass"), 4))
    out = retrieval.select(key, F.col("composite_score").alias("composite_retrieval")).join(risk.select(key, "overall_pass", "risk_score"), key, "full")
    if judge is not None:
        out = out.join(judge, key, "left")
    top = F.max("composite_retrieval").over(Window.partitionBy(F.lit(1)))
    overall = F.round(row_mean([F.col("composite_retrieval") / F.nullif(top, F.lit(0.0)), 1 - F.col("risk_score")]), 4)
    return ranking(out.withColumn("overall_score", overall), "overall_score", key, "overall_rank")


def overall_ranking(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Experiments by the weighted composite of their mean metrics."""
    score = mx.composite(F.col("faithfulness"), F.col("hallucination_rate"), F.col("answer_relevance"), F.col("recall_at_k"), F.col("semantic_similarity"))
    return ranking(df.withColumn("composite_score", score), "composite_score", keys[0])


def difficulty_aggregate(rows: DataFrame, keys: Sequence[str], label: str, cautious: Column, scores: Sequence[str] = ()) -> DataFrame:
    """By ``keys``: mean of each score, queries of each difficulty, and the share of hard ones that were answered with caution.

    The share is null without a hard query; null labels count as queries only.
    """
    hard = F.col(label) == "Hard"
    return rows.groupBy(*keys).agg(
        *[F.round(F.avg(null_if_nan(F.col(s).cast("double"))), 4).alias(f"avg_{s}") for s in scores],
        *[F.count(F.when(F.col(label) == v, 1)).alias(f"n_{v.lower()}") for v in ("Easy", "Medium", "Hard")],
        F.round(F.avg(F.when(hard, cautious.cast("int"))), 4).alias("cautious_response_accuracy"), F.count("*").alias("n_queries"),
    )


def comparison_table(aggregates: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("exp_id", "top_k", "pipeline"), only: Column | None = None) -> DataFrame:
    """A table of a report: the keys and the columns of experiments that ``only`` lets through; columns that aren't there are null."""
    rows = aggregates if only is None else aggregates.where(only)
    return rows.select(*keys, *[F.col(c) if c in aggregates.columns else F.lit(None).cast("double").alias(c) for c in columns])


def comparison_ranking(aggregates: DataFrame, keys: Sequence[str] = ("exp_id", "top_k", "pipeline")) -> DataFrame:
    """All experiments by their composite score with its parts; ties go by the keys. One row an experiment, so small whatever the data."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in aggregates.columns else F.lit(0.0)
    parts = {
        "faithfulness": part("avg_faithfulness"), "1_minus_halluc": 1.0 - F.coalesce(F.col("avg_hallucination_rate"), F.lit(1.0)), "answer_relevance": part("avg_answer_relevance"),
        "recall_at_k": part("avg_recall_at_k"), "semantic_sim": part("avg_semantic_similarity"),
    }
    weights = dict(zip(parts, mx.COMPOSITE.values(), strict=True))
    composite = F.round(sum((weights[n] * c for n, c in parts.items()), F.lit(0.0)), 4)
    rows = aggregates.select(*keys, *[F.round(c, 4).alias(n) for n, c in parts.items()], composite.alias("composite_score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("composite_score").desc(), *[F.col(k).asc_nulls_first() for k in keys])))


def run_status(df: DataFrame, expected: DataFrame, keys: Sequence[str], valid: str, total: str) -> DataFrame:
    """OK from 90 % valid rows, WARN from half, PART below, PENDING without a run."""
    share = F.col(valid) / F.nullif(F.col(total), F.lit(0))
    status = F.when(F.col(total).isNull() | (F.col(total) == 0), "PENDING").when(share >= 0.9, "OK").when(share >= 0.5, "WARN").otherwise("PART")
    return expected.join(df, list(keys), "left").select(*keys, valid, total, status.alias("status"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables under each other; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
