"""Metrics of retrieval and of answers, as column expressions over arrays and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions import text as tx
from wattloom.functions.timeparts import col

# Thresholds and weights that decide results.
SIMILAR, EASY, MEDIUM = 0.50, 0.65, 0.40
COVERAGE_WEIGHT, CONSISTENCY_WEIGHT, SPREAD = 0.6, 0.4, 0.5
SUPPORTED, USEFUL_RELEVANCE, USEFUL_WORDS = 0.45, 0.40, 20
COMPOSITE = {"faithfulness": 0.25, "one_minus_hallucination": 0.20, "answer_relevance": 0.20, "recall_at_k": 0.20, "semantic_similarity": 0.15}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hits_at(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """0/1 for each of the first k retrieved ids."""
    first = retrieved if k is None else F.slice(retrieved, 1, k)
    return F.transform(first, lambda x: F.when(F.array_contains(relevant, x), 1).otherwise(0))


def reciprocal_rank(hits: Column) -> Column:
    at = F.array_position(hits, 1)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def _dcg(hits: Column) -> Column:
    return _sum(F.transform(hits, lambda h, i: h / F.log2(i + 2.0)))


def _ideal(n: Column) -> Column:
    return F.when(n > 0, _sum(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0)))).otherwise(0.0)


def metrics_at_k(retrieved: Column | str, relevant: Column | str, k: int) -> dict[str, Column]:
    """Recall, precision (over k), MRR and nDCG of the first k ids against distinct relevant ids, to four places."""
    got, want = F.coalesce(col(retrieved), F.array().cast("array<string>")), F.array_distinct(F.coalesce(col(relevant), F.array().cast("array<string>")))
    hits = hits_at(got, want, k)
    n, found = F.size(want), _sum(hits)
    ideal = _ideal(F.least(n, F.lit(k)))
    return {
        "recall_at_k": F.round(found / F.greatest(n, F.lit(1)), 4),
        "precision_at_k": F.round(found / F.lit(float(k)), 4) if k > 0 else F.lit(0.0),
        "mrr": F.round(reciprocal_rank(hits), 4),
        "ndcg_at_k": F.round(F.when(ideal > 0, _dcg(hits) / ideal).otherwise(0.0), 4),
        "relevant_available": n,
        "relevant_retrieved": found.cast("int"),
    }


def metrics_as_sets(retrieved: Column | str, relevant: Column | str) -> dict[str, Column]:
    """Recall and precision over distinct ids without a cut; MRR and nDCG over the list."""
    got, want = F.coalesce(col(retrieved), F.array().cast("array<string>")), F.array_distinct(F.coalesce(col(relevant), F.array().cast("array<string>")))
    found, distinct = F.size(F.array_intersect(got, want)), F.size(F.array_distinct(got))
    hits = hits_at(got, want)
    ideal = _ideal(F.least(F.size(want), F.size(got)))
    return {
        "recall": F.when(F.size(want) > 0, found / F.size(want)).otherwise(0.0),
        "precision": F.when(distinct > 0, found / distinct).otherwise(0.0),
        "mrr": reciprocal_rank(hits),
        "ndcg": F.when(ideal > 0, _dcg(hits) / ideal).otherwise(0.0),
    }


def any_hit(retrieved: Column | str, relevant: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(col(retrieved), col(relevant)), F.lit(False))


def keyword_guard(answer: Column | str, include: Column, exclude: Column) -> dict[str, Column]:
    """Whether all required and no forbidden terms occur in an answer."""
    lacking, forbidden = tx.missing_terms(answer, include), tx.present_terms(answer, exclude)
    return {
        "missing_terms": lacking, "forbidden_terms": forbidden, "include_pass": F.size(lacking) == 0, "exclude_pass": F.size(forbidden) == 0,
        "overall_pass": (F.size(lacking) == 0) & (F.size(forbidden) == 0),
    }


def clarity(answer: Column | str) -> Column:
    """1 for sentences of 10 words on average or fewer, 0 for 40 or more; 0 without a sentence of three words."""
    s = tx.sentences(answer, min_words=3)
    words = F.aggregate(s, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    average = words / F.size(s)
    return F.when(F.size(s) == 0, 0.0).otherwise(F.round(1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (average - 10.0) / 30.0)), 4))


def unsupported_rate(similarities: Column | str, threshold: float = SUPPORTED) -> Column:
    """Share of sentences whose best similarity with the context is below the threshold: 1 without context, 0 without sentences."""
    s = col(similarities)
    return F.when(s.isNull(), 1.0).when(F.size(s) == 0, 0.0).otherwise(F.round(F.size(F.filter(s, lambda x: x < threshold)) / F.size(s), 4))


def useful(answer: Column | str, relevance: Column | str) -> Column:
    return (tx.word_count(answer) >= USEFUL_WORDS) & (F.coalesce(col(relevance), F.lit(0.0)) >= USEFUL_RELEVANCE)


def coverage(scores: Column | str, threshold: float = SIMILAR) -> Column:
    s = F.coalesce(col(scores), F.array().cast("array<double>"))
    return F.when(F.size(s) == 0, 0.0).otherwise(F.round(F.size(F.filter(s, lambda x: x >= threshold)) / F.size(s), 4))


def consistency(scores: Column | str) -> Column:
    """1 - population deviation / 0.5, not below 0; 1 for fewer than two scores."""
    s = F.coalesce(col(scores), F.array().cast("array<double>"))
    mean = _sum(s) / F.size(s)
    spread = F.sqrt(_sum(F.transform(s, lambda x: (x - mean) * (x - mean))) / F.size(s))
    return F.when(F.size(s) < 2, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - spread / SPREAD), 4))


def difficulty(scores: Column | str) -> dict[str, Column]:
    """Coverage, consistency, their weighted score and its label. A higher score is an easier query."""
    score = F.round(COVERAGE_WEIGHT * coverage(scores) + CONSISTENCY_WEIGHT * consistency(scores), 4)
    label = F.when(score >= EASY, "Easy").when(score >= MEDIUM, "Medium").otherwise("Hard")
    return {"coverage_score": coverage(scores), "consistency_score": consistency(scores), "difficulty_score": score, "difficulty_label": label}


def attribution(answer: Column | str, available: Column, letters: str = "E") -> dict[str, Column]:
    """Claims with citations, and citations that exist among the available ids.

    With letters 'EP' the tags of children and parents count together, and the citations of each by themselves as well. A
    claim is a sentence of more than ten signs.
    """
    claims = tx.sentences(answer, min_chars=10)
    tag = rf"\[[{letters}]\d+\]"
    cited = F.array().cast("array<string>")
    for letter in letters:
        cited = F.concat(cited, tx.citations(answer, letter))
    kinds = {"E": "child", "P": "parent"}
    apart = {
        f"{what}_{kinds[letter]}_citations": F.size(of(tx.citations(answer, letter), available))
        for letter in (letters if len(letters) > 1 else "") for what, of in (("correct", F.array_intersect), ("spurious", F.array_except))
    }
    with_tag = F.size(F.filter(claims, lambda c: c.rlike(tag)))
    correct, spurious = F.size(F.array_intersect(cited, available)), F.size(F.array_except(cited, available))
    covered = F.when(F.size(claims) > 0, with_tag / F.size(claims)).otherwise(0.0)
    return {
        "total_claims": F.size(claims), "claims_with_citation": with_tag, "attribution_coverage": F.round(covered, 4),
        "correct_citations": correct, "spurious_citations": spurious,
        "citation_accuracy": F.round(F.when(F.size(cited) > 0, correct / F.size(cited)).otherwise(0.0), 4), "unsupported_claim_rate": F.round(1.0 - covered, 4), **apart,
    }


def composite(faithfulness: Column, hallucination: Column, relevance: Column, recall: Column, similarity: Column) -> Column:
    """Weighted sum; a missing hallucination rate counts as 1, other missing parts as 0."""
    w = COMPOSITE
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round(
        w["faithfulness"] * zero(faithfulness) + w["one_minus_hallucination"] * (1.0 - F.coalesce(hallucination, F.lit(1.0)))
        + w["answer_relevance"] * zero(relevance) + w["recall_at_k"] * zero(recall) + w["semantic_similarity"] * zero(similarity), 4,
    )
