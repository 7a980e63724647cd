"""Queries of the numbered problems on text and of the percentile sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.languages import train_languages
from wattloom.llm.leakage import leaked_items
from wattloom.llm.pairs import pair_defects, truncated_answers
from wattloom.llm.quantiles import merge_sketches, percentiles, rank_errors, tail_sketches
from wattloom.llm.spam import spam_pages
from wattloom.llm.tokenizer import decoded, encoded
from wattloom.llm.truncation import length_hazards
from wattloom.operators.joins import spread
from wattloom.sources.tables import table

LEVELS = (0.5, 0.9, 0.95, 0.99)


def with_percentiles(sketches: DataFrame) -> DataFrame:
    keys = [c for c in sketches.columns if c not in ("n", "sketch")]
    q = sketches.select(*keys, "n", percentiles("sketch", LEVELS).alias("q"), rank_errors("sketch", LEVELS).alias("e"))
    names = [f"p{round(100 * x)}" for x in LEVELS]
    return q.select(*keys, "n", *[F.element_at("q", i + 1).alias(p) for i, p in enumerate(names)], *[F.element_at("e", i + 1).alias(f"{p}_rank_error") for i, p in enumerate(names)])


def latency_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "query_results").withColumn("day", F.to_date("run_ts").cast("string"))
    return tail_sketches(results, ["pipeline", "exp_id", "day"], "latency_sec")


def p1_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_percentiles(latency_days(spark, sf_dir))


def p1_latency_by_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the sketches of the days, without another look at the rows."""
    return with_percentiles(merge_sketches(latency_days(spark, sf_dir), ["pipeline"]))


def p1_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_percentiles(tail_sketches(table(spark, sf_dir, "load_history"), ["zone_id"], "load_mw"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "query_results")
    languages = train_languages(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    return pair_defects(results, "result_id", "question", "answer", "exp_id", languages).withColumnRenamed("source", "exp_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).where(F.col("defect").isNotNull()).select("result_id", "defect")


def cut_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_answers(table(spark, sf_dir, "query_results"), "result_id", "question", "answer", "exp_id", ["pipeline"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_answers(spark, sf_dir).where("truncated").select("result_id")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut answers by pipeline and experiment."""
    return cut_answers(spark, sf_dir).groupBy("pipeline", F.col("source").alias("exp_id")).agg(
        F.count("*").alias("answers"), F.sum(F.col("truncated").cast("long")).alias("cut"),
        F.sum((F.col("truncated") & F.col("at_limit")).cast("long")).alias("cut_at_limit"), F.avg(F.col("truncated").cast("double")).alias("share"),
    )


def p7_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "query_results").withColumn("answer_length", F.length("answer"))
    out = length_hazards(results, "exp_id", "answer_length").withColumnRenamed("source", "exp_id")
    return out.withColumns({c: F.round(c, 6) for c in ("hazard", "expected", "p_value", "excess")})


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "ids")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's tokens and whether decoding them gives the text again."""
    docs = encoded(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    back = decoded(docs, "ids", "back")
    return back.select("doc_id", F.size("ids").alias("tokens"), (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"user_query": None, "reference_answer": 0.75}
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "golden_queries"), "golden_id", fields)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("golden_id", "doc_id").distinct()


def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pages(spark, sf_dir).where("spam").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_latency, p1_latency_by_pipeline, p1_load, p5_pairs, p5_found, p7_found, p7_rates, p7_hazards, p8_ids, p8_roundtrip, p9_leaks,
        p9_found, p10_pages, p10_found,
    )
}
ORACLE_SQL = {
    "p7_hazards": """
WITH counts AS (SELECT exp_id, length(answer) AS length, count(*) AS n FROM query_results WHERE answer IS NOT NULL GROUP BY 1, 2),
around AS (SELECT *, sum(n) OVER (PARTITION BY exp_id ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS at_risk, sum(n) OVER w AS near, sum(n * length) OVER w AS near_signs,
    coalesce(sum(n) OVER (PARTITION BY exp_id ORDER BY length RANGE BETWEEN 21 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS beyond, max(length) OVER (PARTITION BY exp_id) AS longest, greatest(length - 20, 0) AS first
  FROM counts WINDOW w AS (PARTITION BY exp_id ORDER BY length RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING)),
risks AS (SELECT *, near_signs - (first - 1) * near + (length + 20 - first + 1) * beyond - at_risk AS risk, least(length + 20, longest) - first AS others, near - n + 1 AS ended FROM around),
tested AS (SELECT *, CASE WHEN risk > 0 THEN greatest(at_risk * ended / risk, ended / others) ELSE CAST(at_risk AS DOUBLE) END AS expected FROM risks),
valued AS (SELECT *, CASE WHEN n > expected AND n >= 5 THEN exp(-(n * ln(n / expected) - n + expected)) ELSE 1.0 END AS p_value FROM tested),
ranked AS (SELECT *, p_value <= 0.01 * row_number() OVER (PARTITION BY exp_id ORDER BY p_value, length) / count(*) OVER (PARTITION BY exp_id) AS passes FROM valued),
decided AS (SELECT *, max(CASE WHEN passes THEN p_value END) OVER (PARTITION BY exp_id) AS bound FROM ranked)
SELECT exp_id, CAST(length AS BIGINT) AS length, n, CAST(at_risk AS BIGINT) AS at_risk, round(n / at_risk, 6) AS hazard, round(expected, 6) AS expected, round(p_value, 6) AS p_value,
  coalesce(p_value <= bound, false) AS significant, round(greatest(0, 1 - expected / n), 6) AS excess FROM decided""",
}
