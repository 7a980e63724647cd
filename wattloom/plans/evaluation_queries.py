"""Queries of the evaluation operators over query_results, golden_queries, documents and embeddings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import metrics as mx
from wattloom.functions import text as tx
from wattloom.operators import evaluation as ev
from wattloom.operators import experiments as ex
from wattloom.operators import retrieval as rt
from wattloom.operators.joins import spread
from wattloom.operators.temporal import null_if_nan
from wattloom.plans import knowledge_queries as kq
from wattloom.session import checkpointed
from wattloom.sources.tables import table

METRICS = ("recall_at_k", "answer_relevance", "hallucination_rate")
GRANULARITIES = ("daily", "weekly", "monthly", "seasonal")


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_results")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with what their evaluation item asks for; items that are gone ask for nothing."""
    golden = table(spark, sf_dir, "golden_queries").select(
        F.col("golden_id").alias("query_id"), "reference_answer", tx.json_list("answer_must_include").alias("include"),
        tx.json_list("answer_must_not_include").alias("exclude"), tx.json_list("expected_summary_ids").alias("expected"),
    )
    none = F.array().cast("array<string>")
    rows = results_of(spark, sf_dir).join(golden, "query_id", "left")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("include", "exclude", "expected")})


def by_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda c: F.round(F.avg(null_if_nan(c)) + 1e-9, 4)
    return results_of(spark, sf_dir).where("pipeline is not null").groupBy("pipeline").agg(*[v(m).alias(m) for m in METRICS])


def rate_aggregate(spark, sf_dir):
    return ev.experiment_aggregate(results_of(spark, sf_dir), ["exp_id", "pipeline", "top_k"], METRICS, ["recall_at_k"])


def judge_mean_count(spark, sf_dir):
    return ev.mean_and_count(results_of(spark, sf_dir), ["exp_id", "top_k"], METRICS[1:])


def metric_coverage(spark, sf_dir):
    return ev.coverage_table(results_of(spark, sf_dir), METRICS)


def length_describe(spark, sf_dir):
    return ev.length_describe(results_of(spark, sf_dir), "pipeline", "answer")


def length_quartiles(spark, sf_dir):
    return ev.length_describe(results_of(spark, sf_dir), None, "answer")


def pivot_counts(spark, sf_dir):
    return ev.pivot_counts(table(spark, sf_dir, "documents"), "dataset", "granularity", GRANULARITIES)


def value_counts(spark, sf_dir):
    return ev.counts(results_of(spark, sf_dir), ["exp_id", "pipeline", "top_k"])


def filled_pct(spark, sf_dir):
    return ev.filled_percentages(table(spark, sf_dir, "documents"), ["text", "lang", "source", "dataset"])


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    guard = mx.keyword_guard("answer", F.col("include"), F.col("exclude"))
    return rows.select("result_id", "pipeline", F.size(guard["missing_terms"]).alias("missing"), F.size(guard["forbidden_terms"]).alias("forbidden"), *[guard[c].alias(c) for c in ("include_pass", "exclude_pass", "overall_pass")])


def keyword_guard(spark, sf_dir):
    return guarded(spark, sf_dir).drop("pipeline")


def guard_rates(spark, sf_dir):
    return ev.pass_rates(guarded(spark, sf_dir), "pipeline", ["include_pass", "exclude_pass", "overall_pass"])


def clarity(spark, sf_dir):
    return results_of(spark, sf_dir).select("result_id", mx.clarity("answer").alias("clarity"))


def citations(spark, sf_dir):
    return results_of(spark, sf_dir).select("result_id", F.array_join(tx.citations("answer"), ",").alias("cited"))


def tag_of(letter: str) -> Callable[[Column], Column]:
    return lambda i: F.concat(F.lit(letter), i.cast("string"))


def attributed(spark: SparkSession, sf_dir: str, letters: str) -> DataFrame:
    rows = results_of(spark, sf_dir)
    tags = F.array().cast("array<string>")
    numbers = F.when(F.col("top_k") > 0, F.sequence(F.lit(1), F.greatest("top_k", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    for letter in letters:
        tags = F.concat(tags, F.transform(numbers, tag_of(letter)))
    m = mx.attribution("answer", tags, letters)
    return rows.select("result_id", "exp_id", *[c.alias(k) for k, c in m.items()])


def attribution_metrics(spark, sf_dir):
    return attributed(spark, sf_dir, "E").drop("exp_id")


def attribution_parents(spark, sf_dir):
    """With tags of children and parents."""
    return attributed(spark, sf_dir, "EP").drop("exp_id")


def attribution_by_experiment(spark, sf_dir):
    return ev.mean_and_count(attributed(spark, sf_dir, "E"), ["exp_id"], ["attribution_coverage", "citation_accuracy", "unsupported_claim_rate"])


def scored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    top = rt.dense_topk(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", 10)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    return top.groupBy("query_id").agg(ordered.alias("scores"))


def difficulty(spark, sf_dir):
    d = mx.difficulty("scores")
    return scored_queries(spark, sf_dir).select("query_id", *[c.alias(k) for k, c in d.items()])


def difficulty_summary(spark, sf_dir):
    rows = difficulty(spark, sf_dir)
    return rows.groupBy("difficulty_label").agg(F.count("*").alias("n"), F.round(F.avg("difficulty_score") + 1e-9, 4).alias("avg_score"))


def label_precision(spark, sf_dir):
    """Precision, reciprocal rank and hit of the ten nearest vectors, where a vector of the query's label is relevant."""
    v = table(spark, sf_dir, "embeddings")
    top = rt.dense_topk(v.where("vec_id % 100 = 0"), v, "vec_id", "vec_id", "embedding", 10).where("query_id <> row_id")
    labels = v.select(F.col("vec_id").alias("row_id"), F.col("label").alias("found"))
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hits = top.join(labels, "row_id").join(asked, "query_id").withColumn("hit", (F.col("found") == F.col("wanted")).cast("int"))
    return hits.groupBy("query_id").agg(
        F.round(F.avg("hit"), 4).alias("precision"), F.max("hit").alias("any_hit"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)), 4).alias("first_hit")
    )


def caution(spark, sf_dir):
    rows = results_of(spark, sf_dir)
    return rows.select("result_id", F.size(tx.matched_phrases("answer", tx.CAUTIONS)).alias("phrases"), tx.contains_any("answer", tx.CAUTIONS).alias("cautious"))


def difficulty_totals(spark, sf_dir):
    """By experiment: questions of each difficulty, and how many of the hard ones were answered with caution."""
    golden = table(spark, sf_dir, "golden_queries").select(F.col("golden_id").alias("query_id"), F.initcap("difficulty_level").alias("label"))
    rows = results_of(spark, sf_dir).join(golden, "query_id", "left")
    return ev.difficulty_aggregate(rows, ["exp_id"], "label", tx.contains_any("answer", tx.CAUTIONS))


def experiment_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.experiment_aggregate(results_of(spark, sf_dir), ["exp_id", "top_k", "pipeline"], METRICS)


def comparison_overall(spark, sf_dir):
    """Answers of all experiments."""
    return ev.comparison_table(experiment_aggregates(spark, sf_dir), ["avg_answer_relevance", "avg_hallucination_rate", "n", "n_errors"])


def comparison_retrieval(spark, sf_dir):
    """Retrieval of the experiments that retrieve."""
    return ev.comparison_table(experiment_aggregates(spark, sf_dir), ["avg_recall_at_k", "n"], only=~F.coalesce(F.col("exp_id").startswith("exp_a"), F.lit(False)))


def comparison_attribution(spark, sf_dir):
    """Attribution of the experiments that cite."""
    names = ["attribution_coverage", "citation_accuracy", "unsupported_claim_rate", "total_claims", "claims_with_citation", "correct_citations", "spurious_citations"]
    rows = attributed(spark, sf_dir, "E").groupBy("exp_id").agg(*[F.round(F.avg(n), 4).alias(f"avg_{n}") for n in names])
    return ev.comparison_table(rows, [f"avg_{n}" for n in names], ["exp_id"], F.col("exp_id").contains("attr"))


def comparison_ranking(spark, sf_dir):
    """All experiments by the composite of what is known of them."""
    return ev.comparison_ranking(experiment_aggregates(spark, sf_dir))


def _retrieved(rows: DataFrame) -> DataFrame:
    """A stand-in for a retrieved list: a stranger, then the expected ids backwards, cut at top_k."""
    return rows.withColumn("retrieved", F.slice(F.concat(F.array(F.lit("none")), F.reverse("expected")), 1, F.greatest("top_k", F.lit(1))))


def recall_precision_at_k(spark, sf_dir):
    m = mx.metrics_at_k("retrieved", "expected", 5)
    return _retrieved(judged(spark, sf_dir)).select("result_id", *[c.alias(k) for k, c in m.items()])


def recall_precision_set(spark, sf_dir):
    m = mx.metrics_as_sets("retrieved", "expected")
    return _retrieved(judged(spark, sf_dir)).select("result_id", *[F.round(c, 4).alias(k) for k, c in m.items()], mx.any_hit("retrieved", "expected").alias("any_hit"))


def support(spark, sf_dir):
    """Share of sentences that the reference doesn't bear out, by the words that they share."""
    rows = judged(spark, sf_dir)
    reference = F.array_distinct(tx.tokens("reference_answer"))
    scores = F.transform(tx.sentences("answer", min_words=3), lambda s: tx.overlap_share(F.array_distinct(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != "")), reference))
    return rows.where("reference_answer is not null").select("result_id", mx.unsupported_rate(scores).alias("unsupported"))


def answer_relevance(spark, sf_dir):
    rows = results_of(spark, sf_dir).select("result_id", rt.letter_vector("question").alias("q"), rt.letter_vector("answer").alias("a"))
    return rows.select("result_id", F.round(F.coalesce(mx.dot("q", "a"), F.lit(0.0)), 4).alias("relevance"))


def useful_answers(spark, sf_dir):
    return results_of(spark, sf_dir).select("result_id", mx.useful("answer", null_if_nan("answer_relevance")).alias("useful"))


def answer_observers(spark, sf_dir):
    """Traits of answers."""
    a = F.coalesce("answer", F.lit(""))
    return results_of(spark, sf_dir).select(
        "result_id", a.rlike(r"\d").alias("has_number"), a.rlike(r"\[E\d+\]").alias("has_citation"), a.rlike(r"(^|\n)- ").alias("has_list"),
        a.rlike(r"\|").alias("has_table"), a.rlike(r"(?i)\b(may|might|could|possibly)\b").alias("hedges"),
    )


def retrieval_ranking(spark, sf_dir):
    return ev.retrieval_summary(by_pipeline(spark, sf_dir), "pipeline", ["recall_at_k", "answer_relevance"])


def baseline_delta(spark, sf_dir):
    return ev.baseline_change(by_pipeline(spark, sf_dir), "pipeline", "dense", METRICS)


def composite_rank(spark, sf_dir):
    rows = by_pipeline(spark, sf_dir).withColumns({"faithfulness": F.lit(None).cast("double"), "semantic_similarity": F.lit(None).cast("double")})
    return ev.overall_ranking(rows, ["pipeline"]).select("pipeline", "composite_score", "rank")


def scorecard(spark, sf_dir):
    retrieval = ev.retrieval_summary(by_pipeline(spark, sf_dir), "pipeline", ["recall_at_k", "answer_relevance"])
    guard = guarded(spark, sf_dir).where("pipeline is not null").groupBy("pipeline").agg(F.round(F.avg(F.col("overall_pass").cast("int")), 4).alias("overall_pass"))
    return ev.scorecard(retrieval, guard)


def run_status(spark, sf_dir):
    rows = results_of(spark, sf_dir)
    runs = rows.groupBy("exp_id", "top_k").agg(F.count("*").alias("total"), F.count(null_if_nan("answer_relevance")).alias("valid"))
    return ev.run_status(runs, rows.select("exp_id", "top_k").distinct(), ["exp_id", "top_k"], "valid", "total")


def _stand_in(prompts: list[str]) -> list[str]:
    """A model that gives back all lines of its evidence, each with its tag."""
    return ["\n".join(_tagged_lines(p)) for p in prompts]


def _tagged_lines(prompt: str) -> Iterator[str]:
    tag = ""
    for line in prompt.partition("Context:\n")[2].rpartition("\n\nQuestion: ")[0].split("\n"):
        if opened := re.match(r"\[(E\d+)\] ", line):
            tag, line = opened[1], line[opened.end() :]
        if tag and line.strip():
            yield f"{line} [{tag}]."


def _experiment(spark: SparkSession, sf_dir: str, pipeline: str, mode: str) -> DataFrame:
    q = kq.questions_of(spark, sf_dir)
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("row_id"), "dataset", "granularity", F.lit("").alias("parent_id"), "text"))
    variants = rt.reply_variants(kq.stand_in_expansion(F.col("text")))
    found = checkpointed(ex.retrieve(q, docs, pipeline, 5, rt.letter_vector, mode, variants))
    stage = None if pipeline == "dense" else ex.search(q, docs, "dense", 5, rt.letter_vector)
    out = ex.run(ex.prompts(q, found, docs, stage=stage), _stand_in, f"{pipeline}_{mode}", pipeline, 5, rt.letter_vector)
    return out.select("exp_id", "query_id", F.array_join("retrieved", ",").alias("retrieved"), "error", "difficulty_label", "answer_relevance", "clarity", "attribution_coverage", "citation_accuracy")


def experiment_dense(spark, sf_dir):
    return _experiment(spark, sf_dir, "dense", "baseline")


def experiment_hybrid_full(spark, sf_dir):
    """Hybrid search over question and variant, reranked."""
    return _experiment(spark, sf_dir, "hybrid", "full")


def fallback_metrics(spark, sf_dir):
    """Metrics of keyword search where a document that resembles the reference answer is a hit too."""
    golden = table(spark, sf_dir, "golden_queries").select(F.col("golden_id").alias("query_id"), F.col("golden_id").alias("row_id"), F.col("reference_answer").alias("text"))
    docs = kq.documents_of(spark, sf_dir).withColumn("row_id", F.col("row_id").cast("string"))
    found = rt.bm25_topk(kq.questions_of(spark, sf_dir), docs, 5).join(docs, "row_id")
    return ex.metrics_with_fallback(found, golden, 5)


QUERIES = {
    f.__name__: f
    for f in (
        rate_aggregate, judge_mean_count, metric_coverage, length_describe, length_quartiles, pivot_counts, value_counts, filled_pct, keyword_guard, guard_rates,
        clarity, citations, attribution_metrics, attribution_parents, attribution_by_experiment, difficulty, difficulty_summary, label_precision, caution,
        recall_precision_at_k, recall_precision_set, support, answer_relevance, useful_answers, answer_observers, retrieval_ranking, baseline_delta,
        composite_rank, scorecard, run_status, difficulty_totals, comparison_overall, comparison_retrieval, comparison_attribution, comparison_ranking, experiment_dense, experiment_hybrid_full, fallback_metrics,
    )
}


def _v(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"


_BY_PIPELINE = "by_pipeline AS (SELECT pipeline, " + ", ".join(f"round(avg({_v(m)}) + 1e-9, 4) AS {m}" for m in METRICS) + " FROM query_results WHERE pipeline IS NOT NULL GROUP BY 1)"
_WORDS = kq._RAW_WORDS.format(t="answer")
_LISTS = """judged AS (SELECT r.*, g.reference_answer, coalesce(from_json(g.answer_must_include, '["VARCHAR"]'), []) AS include, coalesce(from_json(g.answer_must_not_include, '["VARCHAR"]'), []) AS exclude,
  coalesce(from_json(g.expected_summary_ids, '["VARCHAR"]'), []) AS expected FROM query_results r LEFT JOIN golden_queries g ON g.golden_id = r.query_id)"""
_GUARD = _LISTS + """, guarded AS (SELECT result_id, pipeline, CAST(len(list_filter(include, lambda t: NOT contains(lower(coalesce(answer, '')), lower(t)))) AS INT) AS missing,
  CAST(len(list_filter(exclude, lambda t: contains(lower(coalesce(answer, '')), lower(t)))) AS INT) AS forbidden FROM judged)"""
_PASSES = "missing = 0 AS include_pass, forbidden = 0 AS exclude_pass, missing = 0 AND forbidden = 0 AS overall_pass"
_SENT3 = r"list_filter({s}, lambda x: x <> '' AND len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) >= 3)"
_CLAIMS = "list_filter(" + kq._SENTENCES.format(t="answer") + ", lambda x: length(x) > 10)"


def _attribution(letters: str) -> str:
    cited = " || ".join(rf"list_transform(list_distinct(regexp_extract_all(coalesce(answer, ''), '\[{c}(\d+)\]', 1)), lambda n: '{c}' || CAST(CAST(n AS INT) AS VARCHAR))" for c in letters)
    have = " || ".join(f"list_transform(CASE WHEN top_k > 0 THEN generate_series(1, top_k) ELSE [] END, lambda i: '{c}' || CAST(i AS VARCHAR))" for c in letters)
    apart = "".join(
        f", CAST(len(list_intersect({k}, have)) AS INT) AS correct_{n}_citations, CAST(len(list_filter({k}, lambda x: NOT list_contains(have, x))) AS INT) AS spurious_{n}_citations" for k, n in (("e", "child"), ("p", "parent"))
    ) if len(letters) > 1 else ""
    each = "".join(rf", list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\[{c}(\d+)\]', 1), lambda n: '{c}' || CAST(CAST(n AS INT) AS VARCHAR))) AS {c.lower()}" for c in letters)
    names = ", correct_child_citations, spurious_child_citations, correct_parent_citations, spurious_parent_citations" if apart else ""
    return rf"""attributed AS (SELECT result_id, exp_id, CAST(t AS INT) AS total_claims, CAST(w AS INT) AS claims_with_citation, round(CASE WHEN t > 0 THEN w / t ELSE 0 END, 4) AS attribution_coverage,
      CAST(ok AS INT) AS correct_citations, CAST(n - ok AS INT) AS spurious_citations, round(CASE WHEN n > 0 THEN ok / n ELSE 0 END, 4) AS citation_accuracy, round(1.0 - CASE WHEN t > 0 THEN w / t ELSE 0 END, 4) AS unsupported_claim_rate{names}
      FROM (SELECT result_id, exp_id{apart}, len(claims) AS t, len(list_filter(claims, lambda c: regexp_matches(c, '\[[{letters}]\d+\]'))) AS w, len(list_distinct(cited)) AS n, len(list_intersect(list_distinct(cited), have)) AS ok
        FROM (SELECT result_id, exp_id, {_CLAIMS} AS claims, {cited} AS cited, {have} AS have{each} FROM query_results)))"""


_ATTR_COLUMNS = "result_id, total_claims, claims_with_citation, attribution_coverage, correct_citations, spurious_citations, citation_accuracy, unsupported_claim_rate"
_TOP10 = "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (SELECT q.vec_id AS query_id, d.vec_id AS row_id, q.label AS wanted, d.label AS found, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0))"
_DIFFICULTY = f"""{_TOP10}, hard AS (SELECT *, round(0.6 * coverage_score + 0.4 * consistency_score, 4) AS difficulty_score FROM (SELECT query_id, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS coverage_score,
  CASE WHEN count(*) < 2 THEN 1.0 ELSE round(greatest(0.0, 1 - stddev_pop(score) / 0.5), 4) END AS consistency_score FROM top WHERE rank <= 10 GROUP BY query_id)),
difficulty AS (SELECT *, CASE WHEN difficulty_score >= 0.65 THEN 'Easy' WHEN difficulty_score >= 0.4 THEN 'Medium' ELSE 'Hard' END AS difficulty_label FROM hard)"""
_CAUTIOUS = ["contains(lower(coalesce(answer, '')), '" + p + "')" for p in tx.CAUTIONS]
_RETRIEVED = _LISTS + ", listed AS (SELECT *, list_slice(['none'] || list_reverse(expected), 1, greatest(top_k, 1)) AS retrieved FROM judged)"
_HITS = "list_transform({r}, lambda x: CASE WHEN list_contains(expected, x) THEN 1 ELSE 0 END)"
_DCG = "coalesce(list_sum(list_transform(list_zip(h, generate_series(1, len(h))), lambda p: p[1] / log2(p[2] + 1))), 0)"


def _ideal(n: str) -> str:
    return f"coalesce(list_sum(list_transform(generate_series(1, {n}), lambda i: 1 / log2(i + 1))), 0)"


_AGGREGATES = "aggregates AS (SELECT exp_id, top_k, pipeline, count(*) AS n, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_errors, " + ", ".join(f"round(avg(CASE WHEN ok THEN {_v(m)} END) + 1e-9, 4) AS avg_{m}" for m in METRICS) + " FROM (SELECT *, coalesce(error, '') = '' AS ok FROM query_results) GROUP BY 1, 2, 3)"
_COMPOSITE = "round((recall_at_k + answer_relevance) / 2, 4)"
_DISTINCT = r"list_distinct(list_filter(string_split_regex(lower({t}), '\s+'), lambda w: w <> ''))"
ORACLE_SQL = {
    "rate_aggregate": "SELECT exp_id, pipeline, top_k, count(*) AS n, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_errors, " + ", ".join(f"round(avg(CASE WHEN ok THEN {_v(m)} END) + 1e-9, 4) AS avg_{m}" for m in METRICS) + f", round(sum(CASE WHEN ok THEN coalesce({_v('recall_at_k')}, 0) END) / sum(CASE WHEN ok THEN 1 END), 4) AS rate_recall_at_k, round(avg(CASE WHEN ok THEN {_v('latency_sec')} END), 4) AS avg_latency FROM (SELECT *, coalesce(error, '') = '' AS ok FROM query_results) GROUP BY 1, 2, 3",
    "judge_mean_count": "SELECT exp_id, top_k, " + ", ".join(f"round(avg({_v(m)}), 4) AS {m}_mean, count({_v(m)}) AS {m}_count" for m in METRICS[1:]) + " FROM query_results GROUP BY 1, 2",
    "metric_coverage": " UNION ALL ".join(f"SELECT '{m}' AS metric, count({_v(m)}) AS n_valid, count(*) AS n_total, round(count({_v(m)}) * 100.0 / count(*), 2) AS pct_valid FROM query_results" for m in METRICS),
    "length_describe": f"SELECT pipeline, count(w) AS count, round(avg(w), 4) AS mean, round(stddev_samp(w), 4) AS std, min(w) AS min, max(w) AS max FROM (SELECT pipeline, CAST(len({_WORDS}) AS INT) AS w FROM query_results) GROUP BY 1",
    "length_quartiles": f"SELECT count(w) AS count, round(avg(w), 4) AS mean, round(stddev_samp(w), 4) AS std, min(w) AS min, max(w) AS max, quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.75) AS p75 FROM (SELECT CAST(len({_WORDS}) AS INT) AS w FROM query_results)",
    "pivot_counts": "SELECT dataset, " + ", ".join(f"CAST(sum(CASE WHEN granularity = '{g}' THEN 1 ELSE 0 END) AS BIGINT) AS {g}" for g in GRANULARITIES) + " FROM documents GROUP BY 1",
    "value_counts": "SELECT exp_id, pipeline, top_k, count(*) AS n FROM query_results GROUP BY 1, 2, 3",
    "filled_pct": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN trim(coalesce({c}, ''), ' ') <> '' THEN 1 ELSE 0 END) * 100, 2) AS pct_filled FROM documents" for c in ("text", "lang", "source", "dataset")),
    "keyword_guard": f"WITH {_GUARD} SELECT result_id, missing, forbidden, {_PASSES} FROM guarded",
    "guard_rates": f"WITH {_GUARD} SELECT pipeline, count(*) AS n, " + ", ".join(f"round(avg(CAST({c} AS INT)) * 100, 2) AS {c}_pct" for c in ("include_pass", "exclude_pass", "overall_pass")) + f" FROM (SELECT pipeline, {_PASSES} FROM guarded) GROUP BY 1",
    "clarity": f"""SELECT result_id, CASE WHEN len(s) = 0 THEN 0.0 ELSE round(1.0 - greatest(0.0, least(1.0, (list_sum(list_transform(s, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')))) / len(s) - 10.0) / 30.0)), 4) END AS clarity
      FROM (SELECT result_id, {_SENT3.format(s=kq._SENTENCES.format(t='answer'))} AS s FROM query_results)""",
    "citations": r"SELECT result_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\[E(\d+)\]', 1), lambda n: CAST(n AS INT)))), lambda n: 'E' || CAST(n AS VARCHAR)), ',') AS cited FROM query_results",
    "attribution_metrics": f"WITH {_attribution('E')} SELECT {_ATTR_COLUMNS} FROM attributed",
    "attribution_parents": f"WITH {_attribution('EP')} SELECT {_ATTR_COLUMNS}, correct_child_citations, spurious_child_citations, correct_parent_citations, spurious_parent_citations FROM attributed",
    "attribution_by_experiment": f"WITH {_attribution('E')} SELECT exp_id, " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, count({c}) AS {c}_count" for c in ("attribution_coverage", "citation_accuracy", "unsupported_claim_rate")) + " FROM attributed GROUP BY 1",
    "difficulty": f"WITH {_DIFFICULTY} SELECT query_id, coverage_score, consistency_score, difficulty_score, difficulty_label FROM difficulty",
    "difficulty_summary": f"WITH {_DIFFICULTY} SELECT difficulty_label, count(*) AS n, round(avg(difficulty_score) + 1e-9, 4) AS avg_score FROM difficulty GROUP BY 1",
    "label_precision": f"WITH {_TOP10} SELECT query_id, round(avg(CAST(wanted = found AS INT)), 4) AS precision, max(CAST(wanted = found AS INT)) AS any_hit, round(coalesce(1.0 / min(CASE WHEN wanted = found THEN rank END), 0), 4) AS first_hit FROM top WHERE rank <= 10 AND query_id <> row_id GROUP BY 1",
    "caution": "SELECT result_id, CAST(" + " + ".join(f"CAST({c} AS INT)" for c in _CAUTIOUS) + " AS INT) AS phrases, " + " OR ".join(_CAUTIOUS) + " AS cautious FROM query_results",
    "recall_precision_at_k": f"""WITH {_RETRIEVED} SELECT result_id, round(found / greatest(n, 1), 4) AS recall_at_k, round(found / 5.0, 4) AS precision_at_k, round(CASE WHEN list_position(h, 1) > 0 THEN 1.0 / list_position(h, 1) ELSE 0 END, 4) AS mrr,
      round(CASE WHEN n > 0 THEN {_DCG} / {_ideal('least(n, 5)')} ELSE 0 END, 4) AS ndcg_at_k, CAST(n AS INT) AS relevant_available, CAST(found AS INT) AS relevant_retrieved
      FROM (SELECT *, coalesce(list_sum(h), 0) AS found FROM (SELECT result_id, len(list_distinct(expected)) AS n, {_HITS.format(r='list_slice(retrieved, 1, 5)')} AS h FROM listed))""",
    "recall_precision_set": f"""WITH {_RETRIEVED} SELECT result_id, round(CASE WHEN n > 0 THEN f / n ELSE 0 END, 4) AS recall, round(CASE WHEN d > 0 THEN f / d ELSE 0 END, 4) AS precision, round(CASE WHEN list_position(h, 1) > 0 THEN 1.0 / list_position(h, 1) ELSE 0 END, 4) AS mrr,
      round(CASE WHEN n > 0 THEN {_DCG} / {_ideal('least(n, len(h))')} ELSE 0 END, 4) AS ndcg, f > 0 AS any_hit
      FROM (SELECT result_id, len(list_distinct(expected)) AS n, len(list_distinct(retrieved)) AS d, len(list_intersect(list_distinct(retrieved), expected)) AS f, {_HITS.format(r='retrieved')} AS h FROM listed)""",
    "support": f"""SELECT result_id, CASE WHEN len(s) = 0 THEN 0.0 ELSE round(len(list_filter(s, lambda x: len(list_intersect({_DISTINCT.format(t='x')}, r)) / greatest(len({_DISTINCT.format(t='x')}), 1) < 0.45)) / len(s), 4) END AS unsupported
      FROM (SELECT result_id, {_SENT3.format(s=kq._SENTENCES.format(t='answer'))} AS s, {_DISTINCT.format(t='g.reference_answer')} AS r FROM query_results q JOIN golden_queries g ON g.golden_id = q.query_id WHERE g.reference_answer IS NOT NULL)""",
    "answer_relevance": f"SELECT r.result_id, round(coalesce(list_dot_product(q.v, a.v), 0), 4) AS relevance FROM query_results r LEFT JOIN {kq._letters('query_results', 'result_id', 'result_id', 'question')} q ON q.result_id = r.result_id LEFT JOIN {kq._letters('query_results', 'result_id', 'result_id', 'answer')} a ON a.result_id = r.result_id",
    "useful_answers": f"SELECT result_id, len({_WORDS}) >= 20 AND coalesce({_v('answer_relevance')}, 0) >= 0.4 AS useful FROM query_results",
    "answer_observers": r"""SELECT result_id, regexp_matches(a, '\d') AS has_number, regexp_matches(a, '\[E\d+\]') AS has_citation, regexp_matches(a, '(^|\n)- ') AS has_list, regexp_matches(a, '\|') AS has_table,
      regexp_matches(a, '(?i)\b(may|might|could|possibly)\b') AS hedges FROM (SELECT result_id, coalesce(answer, '') AS a FROM query_results)""",
    "retrieval_ranking": f"WITH {_BY_PIPELINE} SELECT *, row_number() OVER (ORDER BY composite_score DESC, pipeline) AS rank FROM (SELECT *, {_COMPOSITE} AS composite_score FROM by_pipeline)",
    "baseline_delta": f"WITH {_BY_PIPELINE} SELECT pipeline, " + ", ".join(f"round(({m} - (SELECT {m} FROM by_pipeline WHERE pipeline = 'dense')) / nullif((SELECT {m} FROM by_pipeline WHERE pipeline = 'dense'), 0) * 100, 2) AS {m}_change_pct" for m in METRICS) + " FROM by_pipeline",
    "composite_rank": f"WITH {_BY_PIPELINE} SELECT *, row_number() OVER (ORDER BY composite_score DESC, pipeline) AS rank FROM (SELECT pipeline, round(0.2 * (1 - coalesce(hallucination_rate, 1)) + 0.2 * coalesce(answer_relevance, 0) + 0.2 * coalesce(recall_at_k, 0), 4) AS composite_score FROM by_pipeline)",
    "scorecard": f"""WITH {_BY_PIPELINE}, {_GUARD}, g AS (SELECT pipeline, round(avg(CASE WHEN missing = 0 AND forbidden = 0 THEN 1 ELSE 0 END), 4) AS overall_pass FROM guarded WHERE pipeline IS NOT NULL GROUP BY 1),
      c AS (SELECT coalesce(b.pipeline, g.pipeline) AS pipeline, {_COMPOSITE} AS composite_retrieval, overall_pass, round(1 - overall_pass, 4) AS risk_score FROM by_pipeline b FULL JOIN g ON g.pipeline = b.pipeline),
      o AS (SELECT *, round((composite_retrieval / max(composite_retrieval) OVER () + 1 - risk_score) / 2, 4) AS overall_score FROM c)
      SELECT *, row_number() OVER (ORDER BY overall_score DESC, pipeline) AS overall_rank FROM o""",
    "difficulty_totals": "SELECT exp_id, " + ", ".join(f"count(*) FILTER (label = '{v.lower()}') AS n_{v.lower()}" for v in ("Easy", "Medium", "Hard")) + f", round(avg(CASE WHEN label = 'hard' THEN CASE WHEN {' OR '.join(_CAUTIOUS)} THEN 1 ELSE 0 END END), 4) AS cautious_response_accuracy, count(*) AS n_queries FROM (SELECT r.exp_id, r.answer, lower(g.difficulty_level) AS label FROM query_results r LEFT JOIN golden_queries g ON g.golden_id = r.query_id) GROUP BY 1",
    "comparison_overall": f"WITH {_AGGREGATES} SELECT exp_id, top_k, pipeline, avg_answer_relevance, avg_hallucination_rate, n, n_errors FROM aggregates",
    "comparison_retrieval": f"WITH {_AGGREGATES} SELECT exp_id, top_k, pipeline, avg_recall_at_k, n FROM aggregates WHERE coalesce(exp_id, '') NOT LIKE 'exp_a%'",
    "comparison_attribution": f"WITH {_attribution('E')} SELECT exp_id, " + ", ".join(f"round(avg({c}), 4) AS avg_{c}" for c in ("attribution_coverage", "citation_accuracy", "unsupported_claim_rate", "total_claims", "claims_with_citation", "correct_citations", "spurious_citations")) + " FROM attributed WHERE exp_id LIKE '%attr%' GROUP BY 1",
    "comparison_ranking": f"""WITH {_AGGREGATES}, parts AS (SELECT exp_id, top_k, pipeline, CAST(0 AS DOUBLE) AS faithfulness, round(1 - coalesce(avg_hallucination_rate, 1), 4) AS "1_minus_halluc", coalesce(avg_answer_relevance, 0) AS answer_relevance, coalesce(avg_recall_at_k, 0) AS recall_at_k, CAST(0 AS DOUBLE) AS semantic_sim FROM aggregates),
      scored AS (SELECT *, round(0.2 * "1_minus_halluc" + 0.2 * answer_relevance + 0.2 * recall_at_k, 4) AS composite_score FROM parts)
      SELECT *, row_number() OVER (ORDER BY composite_score DESC, exp_id NULLS FIRST, top_k NULLS FIRST, pipeline NULLS FIRST) AS rank FROM scored""",
    "run_status": f"SELECT *, CASE WHEN valid / total >= 0.9 THEN 'OK' WHEN valid / total >= 0.5 THEN 'WARN' ELSE 'PART' END AS status FROM (SELECT exp_id, top_k, count({_v('answer_relevance')}) AS valid, count(*) AS total FROM query_results GROUP BY 1, 2)",
}
