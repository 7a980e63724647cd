"""Experiments end to end: retrieve, write the prompt, generate, score. Each step is a table, and each can be replaced."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import metrics as mx
from wattloom.functions import text as tx
from wattloom.operators import models
from wattloom.operators import retrieval as rt
from wattloom.operators.documents import PARENT, evidence_ids

RECALL_MULTIPLIER = 4  # Fixed value: candidates per kept document before reranking.
#: What each run mode switches on.
MODES = {
    "baseline": frozenset(), "rerank": frozenset({"rerank"}), "expand": frozenset({"expand"}), "expand+rerank": frozenset({"expand", "rerank"}),
    "improved_prompt": frozenset({"prompt"}), "full": frozenset({"expand", "rerank", "prompt"}),
}
METADATA = ("zone", "date", "granularity", "time_window", "source")

SYSTEM = "You are an analyst of electricity demand."
STYLES = {
    "plain": "Answer the question.",
    "grounded": "Answer from the context only, and say so if it doesn't hold the answer.",
    "attributed": "Answer from the evidence only. End each claim with the tag of its evidence, such as [E1].",
    "hierarchical": "Answer from the evidence only. Tag claims with [E1] for details and [P1] for broader context.",
    "zero_shot": "Answer without further material and name your uncertainty.",
    "few_shot": "Answer in the manner of the examples: a figure, its period, and what it is compared with.",
    "chain_of_thought": "List what you observe, then what follows from it, then the answer.",
    "structured": "Answer under the headings OBSERVATION, PATTERN, CONFIDENCE and INSIGHT.",
}
DIFFICULTY = {
    "Easy": "The evidence is good: answer with confidence and in detail.",
    "Medium": "The evidence is mixed: answer, and mark what is uncertain.",
    "Hard": "The evidence is limited: be careful, and say what can't be told from it.",
}


def messages(question: Column | str, style: str, context: Column | None = None, difficulty: Column | None = None) -> Column:
    """ARRAY<STRUCT<role, content>> of a prompt, with the whole context."""
    parts = [F.lit(STYLES[style])]
    if difficulty is not None:
        prefix = F.lit(None).cast("string")
        for label, words in DIFFICULTY.items():
            prefix = F.when(difficulty == label, words).otherwise(prefix)
        parts.insert(0, prefix)
    if context is not None:
        parts.append(F.concat(F.lit("Context:\n"), context))
    parts.append(F.concat(F.lit("Question: "), tx.clean_text(question)))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM)), message("user", F.concat_ws("\n\n", *parts)))


def evidence_line(tag: Column, text: Column, **metadata: Column) -> Column:
    """'[E1] zone: 3 | date: ... | text', with the metadata that is there."""
    known = [F.when(F.length(metadata[k]) > 0, F.concat(F.lit(f"{k}: "), metadata[k])) for k in METADATA if k in metadata]
    return F.concat(F.lit("["), tag, F.lit("] "), F.concat_ws(" | ", *known, text))


def keyword_boost(candidates: DataFrame, text: str, keywords: Sequence[str], key: str, least: int = 2) -> DataFrame:
    """The candidates that have a keyword, for keys where at least ``least`` do; all of them for other keys."""
    hit = tx.contains_any(text, [k.lower() for k in keywords]).cast("int")
    marked = candidates.withColumn("_hit", hit).withColumn("_hits", F.sum("_hit").over(Window.partitionBy(key)))
    return marked.where((F.col("_hits") < least) | (F.col("_hit") == 1)).drop("_hit", "_hits")


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash of seed and key: the same ones on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def cross_dataset_sample(df: DataFrame, dataset: str, key: str, n: int, datasets: int = 2, seed: int = 42) -> DataFrame:
    """n // datasets rows of each dataset, by the same order."""
    w = Window.partitionBy(dataset).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n // datasets).drop("_at")


def texts_of(lists: DataFrame, key: str, ids: str, docs: DataFrame) -> DataFrame:
    """(key, texts): the documents' texts in the order of the ids, '' for an id that isn't there."""
    one = lists.select(key, F.posexplode(ids).alias("pos", "row_id")).join(docs.select("row_id", "text"), "row_id", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return lists.select(key).join(one.groupBy(key).agg(ordered.alias("texts")), key, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def metrics_with_fallback(ranked: DataFrame, relevant: DataFrame, k: int, threshold: float = 0.55, cap: bool = True) -> DataFrame:
    """Recall, precision, MRR and nDCG where a document also hits by its text.

    ``ranked`` has query_id, rank, row_id, text; ``relevant`` query_id, row_id, text. A document hits if its id is relevant
    or its text resembles a relevant one's to ``threshold``. With ``cap``, hits count up to the number of relevant ids, so
    recall and nDCG stay within 1.
    """
    first = ranked.where(F.col("rank") <= k)
    wanted = relevant.select("query_id", F.col("row_id").alias("want_id"), F.col("text").alias("want_text"))
    pairs = first.join(wanted, "query_id", "left")
    ratio = models.similarity_ratio("text", "want_text")
    same = F.coalesce(F.col("row_id") == F.col("want_id"), F.lit(False))
    hits = pairs.withColumn("ratio", F.when(F.col("want_text").isNotNull(), ratio)).groupBy("query_id", "rank").agg(F.max((same | (F.coalesce("ratio", F.lit(0.0)) >= threshold)).cast("int")).alias("hit"))
    number = relevant.groupBy("query_id").agg(F.count_distinct("row_id").alias("n"))
    lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda x: x["hit"]).alias("h"), F.sum("hit").alias("found"))
    rows = lists.join(number, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = F.least(F.col("found"), F.col("n")) if cap else F.col("found")
    ideal = mx._ideal(F.least("n", F.lit(k)))
    ndcg = F.when(ideal > 0, mx._dcg(F.col("h")) / ideal).otherwise(0.0)
    return rows.select(
        "query_id", F.round(found / F.greatest("n", F.lit(1)), 4).alias("recall_at_k"), F.round(F.col("found") / F.lit(float(k)), 4).alias("precision_at_k"),
        F.round(mx.reciprocal_rank(F.col("h")), 4).alias("mrr"), F.round(F.least(ndcg, F.lit(1.0)) if cap else ndcg, 4).alias("ndcg_at_k"),
    )


def search(queries: DataFrame, docs: DataFrame, pipeline: str, k: int, vector: Callable[[str], Column]) -> DataFrame:
    """(query_id, row_id, score, rank) of one pipeline: dense, hybrid or hierarchical (children first, then parents)."""
    q = queries.select("query_id", vector("text").alias("payload"))
    d = docs.select("row_id", vector("text").alias("payload"))
    if pipeline == "hybrid":
        pool = 4 * k
        return rt.rrf(rt.block_topk(q, d, rt.dot_scorer, pool), rt.bm25_topk(queries, docs, pool), k, pool).select("query_id", "row_id", "score", "rank")
    dense = rt.block_topk(q, d, rt.dot_scorer, k)
    if pipeline == "dense":
        return dense
    if pipeline != "hierarchical":
        raise ValueError(pipeline)
    return rt.with_parents(dense, docs, PARENT).select("query_id", "row_id", "score", F.col("position").alias("rank"))


def retrieve(
    queries: DataFrame, docs: DataFrame, pipeline: str, k: int, vector: Callable[[str], Column], mode: str = "baseline",
    variants: Sequence[Column] = (), pair_score: Column | None = None,
) -> DataFrame:
    """A pipeline with what its mode adds: lists of query variants united, and candidates reranked to k."""
    on = MODES[mode]
    fetch = k * RECALL_MULTIPLIER if "rerank" in on else k
    if "expand" in on:
        asked = rt.query_variants(queries, list(variants)).withColumn("asked_id", F.concat_ws("#", "query_id", "variant"))
        found = search(asked.select(F.col("asked_id").alias("query_id"), "text"), docs, pipeline, fetch, vector)
        found = found.withColumnRenamed("query_id", "asked_id").join(asked.select("asked_id", "query_id", "variant"), "asked_id")
        found = rt.union_variants(found).select("query_id", "row_id", "score", F.col("position").alias("rank"))
    else:
        found = search(queries, docs, pipeline, fetch, vector)
    if "rerank" in on:
        score = pair_score if pair_score is not None else tx.overlap_share(F.array_distinct(tx.tokens("question")), F.array_distinct(tx.tokens("document")))
        return rt.rerank(found, queries, docs, score, k).select("query_id", "row_id", "score", "rank")
    return found.where(F.col("rank") <= k) if "expand" in on else found


def prompts(
    queries: DataFrame, found: DataFrame, docs: DataFrame, style: str = "attributed", with_difficulty: bool = False, stage: DataFrame | None = None
) -> DataFrame:
    """(query_id, question, retrieved, evidence, context, difficulty_label, messages) of each query, also of those that found nothing.

    The difficulty is that of the scores of ``stage``, a dense list (query_id, rank, score) of the same queries: the scores of
    fused lists are no similarities. Without it the list's own scores count, which then have to be similarities.
    """
    tagged = evidence_ids(found, "query_id", "rank").join(docs.select("row_id", "text", *[c for c in ("granularity",) if c in docs.columns]), "row_id")
    meta = {"granularity": F.col("granularity")} if "granularity" in docs.columns else {}
    line = evidence_line(F.col("evidence_id"), F.col("text"), **meta)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("x")))), lambda v: v["x"])
    lists = tagged.groupBy("query_id").agg(ordered(F.col("row_id")).alias("retrieved"), ordered(F.col("evidence_id")).alias("evidence"), ordered(line).alias("lines"), ordered(F.col("score")).alias("scores"))
    if stage is not None:
        lists = lists.drop("scores").join(stage.groupBy("query_id").agg(ordered(F.col("score")).alias("scores")), "query_id", "left")
    rows = queries.select("query_id", F.col("text").alias("question")).join(lists, "query_id", "left")
    rows = rows.withColumns({"context": F.coalesce(F.array_join("lines", "\n\n"), F.lit("No summaries retrieved.")), "difficulty_label": mx.difficulty("scores")["difficulty_label"]})
    label = F.col("difficulty_label") if with_difficulty else None
    return rows.withColumn("messages", messages("question", style, F.col("context"), label)).drop("lines", "scores")


def run(prompted: DataFrame, model: Callable[[list[str]], Sequence[str]], exp_id: str, pipeline: str, k: int, vector: Callable[[str], Column]) -> DataFrame:
    """Results of an experiment: answers with latency and error, and the metrics that need no judge."""
    asked = prompted.withColumn("_prompt", F.element_at("messages", -1)["content"])
    answered = models.generate(asked.select("query_id", "question", "retrieved", "evidence", "difficulty_label", "_prompt"), "_prompt", model)
    cited = mx.attribution("answer", F.coalesce("evidence", F.array().cast("array<string>")))
    relevance = F.round(F.coalesce(mx.dot("_q", "_a"), F.lit(0.0)), 4)
    return answered.withColumns({"_q": vector("question"), "_a": vector("answer")}).select(
        F.lit(exp_id).alias("exp_id"), "query_id", "question", F.lit(pipeline).alias("pipeline"), F.lit(k).alias("top_k"), "answer", "latency_sec", "error",
        "retrieved", "difficulty_label", relevance.alias("answer_relevance"), mx.clarity("answer").alias("clarity"), *[c.alias(n) for n, c in cited.items()],
    )
