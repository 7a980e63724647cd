"""Retrieval: dense, keyword, fused, hierarchical, expanded and reranked top-k lists as long tables.

A query set is searched against all rows of a corpus. The queries are the side that is held in memory, in blocks of a
bounded number; the corpus is read in parallel once per block and each task keeps its best k per query, so what is
shuffled is k rows per query and task whatever the corpus' size. Ranks are total: ties go by id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import text as tx
from wattloom.session import checkpointed

RRF_K = 60
QUERY_BLOCK = 4096

#: (payloads of the queries) -> function (payloads of a corpus batch) -> matrix queries x batch
Scorer = Callable[[list], Callable[[list], np.ndarray]]


def dot_scorer(queries: list) -> Callable[[list], np.ndarray]:
    q = np.array([np.asarray(x, dtype=np.float64) for x in queries])
    return lambda batch: q @ np.array([np.asarray(x, dtype=np.float64) for x in batch]).T


def overlap_scorer(queries: list) -> Callable[[list], np.ndarray]:
    """Share of a query's distinct words that a document has. A payload is its marker, then words; different markers give -1."""
    asked = [(x[0], set(x[1:])) for x in queries]
    holders: dict[str, dict[str, list[int]]] = {}
    members: dict[str, list[int]] = {}
    for i, (marker, words) in enumerate(asked):
        members.setdefault(marker, []).append(i)
        for w in words:
            holders.setdefault(marker, {}).setdefault(w, []).append(i)
    sizes = np.array([max(len(s), 1) for _, s in asked], dtype=np.float64)

    def score(batch: list) -> np.ndarray:
        out = np.full((len(asked), len(batch)), -1.0)
        for j, (marker, *words) in enumerate(batch):
            if marker not in members:
                continue
            out[members[marker], j] = 0
            at = holders.get(marker, {})
            for w in set(words) & at.keys():
                out[at[w], j] += 1
        return np.where(out >= 0, out / sizes[:, None], -1.0)

    return score


def marked_words(text: Column | str, *marks: Column) -> Column:
    """Payload of the overlap scorer: what has to agree, then the distinct words."""
    marker = F.concat_ws("|", *[F.coalesce(m, F.lit("")) for m in marks]) if marks else F.lit("")
    return F.concat(F.array(marker), F.array_distinct(tx.tokens(text)))


def bm25_scorer(average: float, k1: float, b: float) -> Scorer:
    """Okapi weights. A query's payload is its (term, weight) pairs, a document's its words in one text; -inf without a common word."""

    def prepare(queries: list) -> Callable[[list], np.ndarray]:
        terms: dict[str, int] = {}
        at = np.array([(terms.setdefault(t["term"], len(terms)), i) for i, q in enumerate(queries) for t in q], dtype=np.int64).reshape(-1, 2)
        weight = np.array([t["weight"] for q in queries for t in q], dtype=np.float64)
        order = np.argsort(at[:, 0], kind="stable")
        asking, weight = at[order, 1], weight[order]
        first = np.searchsorted(at[order, 0], np.arange(len(terms) + 1))

        def score(batch: list) -> np.ndarray:
            n = np.array([x.count(" ") + 1 if x else 0 for x in batch], dtype=np.float64)
            found = [(j, t, tf) for j, x in enumerate(batch) for t, tf in Counter(map(terms.get, x.split(" "))).items() if t is not None]
            doc, term, tf = np.array(found, dtype=np.int64).reshape(-1, 3).T
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[doc] / average))
            times = first[term + 1] - first[term]
            where = np.repeat(first[term] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            cell = asking[where] * len(batch) + np.repeat(doc, times)
            size = len(queries) * len(batch)
            total = np.bincount(cell, weights=np.repeat(part, times) * weight[where], minlength=size)
            return np.where(np.bincount(cell, minlength=size) > 0, total, -np.inf).reshape(len(queries), len(batch))

        return score

    return prepare


def block_topk(queries: DataFrame, corpus: DataFrame, scorer: Scorer, k: int, digits: int = 9, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, row_id, score, rank): the k best rows of the corpus for each query.

    ``queries`` has query_id and payload, ``corpus`` row_id and payload; rows whose payload is null take no part. Scores
    are rounded to ``digits`` places before they are compared, so equal rows tie and the lesser id wins; a row that scores
    -inf isn't found. Of several blocks the results of each are written before the next is taken, so the driver and the
    tasks hold one block of queries.
    """
    q_type, r_type = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["row_id"]
    rows = queries.where("payload is not null").select("query_id", "payload")
    blocks = max(1, -(-rows.count() // block))
    corpus = corpus.where("payload is not null").select("row_id", "payload")

    def found(b: int) -> DataFrame:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        taken = part.collect()
        shared = queries.sparkSession.sparkContext.broadcast(([r["query_id"] for r in taken], [r["payload"] for r in taken]))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = np.array(shared.value[0], dtype=object)
            if not len(ids):
                return
            score = scorer(shared.value[1])
            step = min(2048, max(1, (1 << 20) // len(ids)))
            held: pd.DataFrame | None = None
            for pdf in batches:
                for i in range(0, len(pdf), step):
                    rows_of = pdf["row_id"].to_numpy()[i : i + step]
                    s = np.round(score(pdf["payload"].tolist()[i : i + step]), digits)
                    n = min(k, s.shape[1])
                    least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                    q_at, r_at = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # ties with the last included
                    new = pd.DataFrame({"q": q_at, "row_id": rows_of[r_at], "score": s[q_at, r_at]})
                    held = new if held is None else pd.concat([held, new])
                    held = held.sort_values(["q", "score", "row_id"], ascending=[True, False, True], kind="stable").groupby("q").head(k)
            if held is not None and len(held):
                yield pd.DataFrame({"query_id": ids[held["q"].to_numpy()], "row_id": held["row_id"], "score": held["score"]})

        return corpus.mapInPandas(best, f"query_id {q_type}, row_id {r_type}, score double")

    together = found(0) if blocks == 1 else reduce(DataFrame.unionByName, [checkpointed(found(b)) for b in range(blocks)])
    return ranked(together, "score", k)


def ranked(scored: DataFrame, score: str, k: int | None = None, ties: Sequence[str] = ("row_id",)) -> DataFrame:
    """``rank`` from 1 by falling score within each query; the first k only, if k is given."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), *ties)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, corpus: DataFrame, query_id: str, row_id: str, vector: str, k: int) -> DataFrame:
    """Exact search by dot product (the cosine of unit vectors) in double precision."""
    pick = lambda df, i, name: df.select(F.col(i).alias(name), F.col(vector).alias("payload"))
    return block_topk(pick(queries, query_id, "query_id"), pick(corpus, row_id, "row_id"), dot_scorer, k)


def letter_vector(text: Column | str) -> Column:
    """Deterministic stand-in for an embedding: the unit vector of a text's letter counts; null for a text without."""
    low = F.lower(tx.clean_text(text))
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    # counts and norm are bound to names here, so that each is worked out once
    bound = F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    unit = F.transform(bound, lambda b: F.when(b["n"] > 0, F.transform(b["c"], lambda x: x / b["n"])))
    return F.element_at(unit, 1)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, row_id, score, rank) by Okapi BM25 over (query_id, text) and (row_id, text).

    Inverse document frequencies below 0 become ``epsilon`` times the mean over all terms. Statistics cover all documents,
    which are split into words once. A query's word counts as often as it stands there. Documents without any of the words
    aren't in the result. Null and empty texts are documents of length 0. Each task keeps the best ``k`` of its documents
    for a query, so a word that most documents have makes no rows but these.
    """
    words = checkpointed(docs.select("row_id", tx.tokens("text").alias("w")))
    facts = words.agg(F.count("*").alias("total"), F.avg(F.size("w")).alias("average")).first()
    having = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("having"))
    idf = having.select("term", (F.log(facts["total"] - F.col("having") + 0.5) - F.log(F.col("having") + 0.5)).alias("idf"))
    asked = queries.select("query_id", F.explode(tx.tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = checkpointed(idf.join(asked.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left"))
    floor = idf.agg(F.avg("idf") * epsilon).scalar()
    weight = F.col("times") * F.when(F.col("idf") < 0, floor).otherwise(F.col("idf"))
    weighed = asked.join(idf.where("asked").select("term", "idf"), "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("payload"))
    return block_topk(weighed, words.select("row_id", F.array_join("w", " ").alias("payload")), bm25_scorer(facts["average"] or 1.0, k1, b), k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int, pool: int, weights: tuple[float, float] = (1.0, 1.0), from_one: bool = False) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: the sum of weight / (60 + rank), ranks from 0, or from 1.

    A row that a list doesn't have counts with rank ``pool`` there; in the ensemble form (``from_one``) it gets nothing.
    """
    a = dense.select("query_id", "row_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "row_id", F.col("rank").alias("sparse_rank"))
    shift = 0 if from_one else 1
    term = lambda c, w: F.lit(w) / (RRF_K + F.col(c) - shift)
    absent = lambda w: F.lit(0.0) if from_one else F.lit(w / (RRF_K + pool))
    score = F.coalesce(term("dense_rank", weights[0]), absent(weights[0])) + F.coalesce(term("sparse_rank", weights[1]), absent(weights[1]))
    both = a.join(s, ["query_id", "row_id"], "full").withColumn("score", F.round(score, 9))
    return ranked(both, "score", k)


def ensemble(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Weighted fusion: 0.7 dense, 0.3 keyword, ranks from 1, fused on the row id."""
    return rrf(dense, sparse, k, 0, (0.7, 0.3), from_one=True)


def with_parents(children: DataFrame, docs: DataFrame, parent_of: dict[str, str]) -> DataFrame:
    """Children and, behind them, a parent for each: (query_id, position, row_id, score, retrieval_method, parent_resolution).

    The parent is the document that ``parent_id`` names ('exact'); failing that, the document of the next granularity and
    the same dataset, or any dataset if that has none, that shares most of the child's words ('semantic'; ties take the
    lesser id). A parent that is itself a child of the query, or the parent of an earlier child, isn't repeated.
    """
    facts = docs.select("row_id", "dataset", "granularity", "parent_id", "text")
    kids = children.select("query_id", "row_id", "score", "rank").join(facts, "row_id")
    known = docs.select(F.col("row_id").alias("found_id")).distinct()
    exact = kids.join(known, kids["parent_id"] == known["found_id"], "left")
    up = reduce(lambda done, x: F.when(F.col("granularity") == x[0], F.lit(x[1])).otherwise(done), parent_of.items(), F.lit(None).cast("string"))
    orphans = exact.where("found_id is null").select("row_id", "dataset", "text", up.alias("up")).where("up is not null").dropDuplicates(["row_id"])
    level = facts.where(F.col("granularity").isin(*parent_of.values()))

    def nearest(rows: DataFrame, *marks: str) -> DataFrame:
        q = rows.select(F.col("row_id").alias("query_id"), marked_words("text", F.col("up"), *[F.col(m) for m in marks]).alias("payload"))
        pool = level.select("row_id", marked_words("text", F.col("granularity"), *[F.col(m) for m in marks]).alias("payload"))
        top = block_topk(q, pool, overlap_scorer, 1).where("score >= 0")
        return top.select(F.col("query_id").alias("row_id"), F.col("row_id").alias("near_id"))

    own = nearest(orphans, "dataset")
    alike = own.unionByName(nearest(orphans.join(own.select("row_id"), "row_id", "left_anti")))
    linked = exact.join(alike, "row_id", "left")
    parents = linked.select("query_id", "rank", F.coalesce("found_id", "near_id").alias("row_id"), F.when(F.col("found_id").isNotNull(), "exact").otherwise("semantic").alias("parent_resolution")).where("row_id is not null")
    parents = parents.join(children.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    first = Window.partitionBy("query_id", "row_id").orderBy("rank")
    parents = parents.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at")
    both = kids.select("query_id", "row_id", "score", "rank", F.lit("dense_child").alias("retrieval_method"), F.lit("n/a").alias("parent_resolution"), F.lit(0).alias("kind")).unionByName(
        parents.select("query_id", "row_id", F.lit(0.0).alias("score"), "rank", F.lit("parent_expansion").alias("retrieval_method"), "parent_resolution", F.lit(1).alias("kind"))
    )
    order = Window.partitionBy("query_id").orderBy("kind", "rank")
    return both.withColumn("position", F.row_number().over(order)).drop("kind", "rank")


def query_variants(queries: DataFrame, variants: Sequence[Column]) -> DataFrame:
    """(query_id, variant, text): the question itself and its variants; blank and repeated ones are left out."""
    texts = F.array_distinct(F.filter(F.array(F.col("text"), *variants), lambda x: F.length(F.trim(x)) > 0))
    return queries.select("query_id", F.posexplode(texts).alias("variant", "text"))


def reply_variants(reply: Column | str) -> list[Column]:
    """The variants in a model's reply to a request for expansion: its keyword form and its paraphrase, null where it has none."""
    return [tx.reply_field(reply, name) for name in ("KEYWORD", "PARAPHRASE")]


def union_variants(results: DataFrame) -> DataFrame:
    """Of the lists of a query's variants each row once, in the order of variant and rank: (query_id, row_id, position)."""
    first = Window.partitionBy("query_id", "row_id").orderBy("variant", "rank")
    kept = results.withColumn("at", F.row_number().over(first)).where("at = 1")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("variant", "rank"))).drop("at")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, score: Column, k: int) -> DataFrame:
    """Score (question, document) pairs of a candidate list anew and keep the k best; ties keep the earlier order.

    ``score`` reads the columns ``question`` and ``document``.
    """
    pairs = candidates.join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(docs.select("row_id", F.col("text").alias("document")), "row_id")
    scored = pairs.withColumn("rerank_score", F.round(score, 9)).drop("question", "document").withColumnRenamed("rank", "prior_rank")
    return ranked(scored, "rerank_score", k, ("prior_rank",))


def routed(queries: DataFrame, target: str, pipelines: Sequence[str] = ("dense", "hybrid", "hierarchical")) -> DataFrame:
    """One row per query and pipeline to run: all of them for target 'all', else dense and the target."""
    t = F.lower(F.col(target))
    every = F.array(*[F.lit(p) for p in pipelines])
    return queries.withColumn("pipeline", F.explode(F.when(t == "all", every).otherwise(F.array_compact(F.array_distinct(F.array(F.lit("dense"), t))))))
