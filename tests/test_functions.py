from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.functions import metrics as mx
from wattloom.functions import text as tx


def value(spark, column, **row):
    fields = {k: v for k, v in row.items()} or {"x": 1}
    types = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
    kind = lambda v: "array<" + (types[type(v[0])] if v else "string") + ">" if isinstance(v, list) else types[type(v)]
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {kind(v)}" for k, v in fields.items()))
    return df.select(column.alias("out")).first()["out"]


def test_calendar(spark):
    day = F.to_date(F.lit("2005-01-01"))
    assert value(spark, F.concat_ws("-", cal.iso_year(day), cal.iso_week(day))) == "2004-53"
    assert str(value(spark, cal.week_end(F.to_date(F.lit("2007-01-07"))))) == "2007-01-07" and str(value(spark, cal.next_sunday(F.to_date(F.lit("2007-01-07"))))) == "2007-01-14"
    assert str(value(spark, cal.iso_thursday(F.lit(2004), F.lit(53)))) == "2004-12-30"
    assert [value(spark, cal.season(F.lit(m))) for m in (1, 3, 8, 11, 12)] == ["Winter", "Spring", "Summer", "Autumn", "Winter"]
    assert value(spark, cal.season(F.lit(None).cast("int"))) is None and str(value(spark, cal.month_end(F.to_date(F.lit("2008-02-03"))))) == "2008-02-29"
    assert value(spark, cal.quarter_words(F.lit(27))).startswith("late year") and value(spark, cal.choose(F.lit("b"), [("a", 1), ("b", 2)], 0)) == 2


def test_tokens_and_sentences(spark):
    assert value(spark, tx.tokens("t"), t=" A b  a ") == ["a", "b", "a"] and value(spark, tx.tokens("t"), t=None) == [] and value(spark, tx.word_count("t"), t="") == 0
    text = "Load rose to 11. It fell again!  Ok? - Zones compared: 11"
    assert value(spark, tx.sentences("t"), t=text) == ["Load rose to 11.", "It fell again!", "Ok?", "- Zones compared: 11"]
    assert value(spark, tx.sentences("t", min_words=3), t=text) == ["Load rose to 11.", "It fell again!", "- Zones compared: 11"]
    assert value(spark, tx.chunks("t"), t="11 a\n\n \n\nb1") == ["11 a", "b1"]
    assert value(spark, tx.citations("t"), t="x [E10] y [E2] [E10] [P1]") == ["E2", "E10"] and value(spark, tx.citations("t", "P"), t="x [P3]") == ["P3"]


def test_guards_and_summaries(spark):
    assert value(spark, tx.valid_summary("t"), t="word " * 30) is True and value(spark, tx.valid_summary("t"), t="word " * 29) is False
    assert value(spark, tx.valid_summary("t"), t="I cannot " + "word " * 40) is False and value(spark, tx.valid_summary("t"), t=None) is False
    g = mx.keyword_guard("a", F.col("i"), F.col("e"))
    assert value(spark, g["overall_pass"], a="Load of 5 MW", i=["mw"], e=["price"]) is True and value(spark, g["missing_terms"], a="x", i=["mw"], e=["price"]) == ["mw"]
    assert value(spark, g["overall_pass"], a=None, i=["mw"], e=["p"]) is False
    assert value(spark, tx.matched_phrases("a", tx.CAUTIONS), a="Uncertain; LOW confidence") == ["uncertain", "low confidence"]


def test_records_and_replies(spark):
    assert value(spark, tx.key_values("t"), t="id: 3\nsummary: a: b\nnone") == {"id": "3", "summary": "a: b"}
    reply = "OBSERVATION: up\nat dawn\nPATTERN: flat\nCONFIDENCE: High"
    assert value(spark, tx.section("t", "OBSERVATION", "PATTERN"), t=reply) == "up\nat dawn" and value(spark, tx.section("t", "CONFIDENCE", None), t=reply) == "High"
    assert value(spark, tx.section("t", "LIMITS", None), t=reply) is None and value(spark, tx.reply_field("t", "KEYWORD"), t="keyword: load peak\nPARAPHRASE: x") == "load peak"
    assert value(spark, tx.json_list("t"), t='["a", "b"]') == ["a", "b"] and value(spark, tx.json_list("t"), t=None) == []
    assert value(spark, tx.json_field("t", "k"), t='{"k": 5}') == "5" and value(spark, tx.json_field("t", "none"), t='{"k": 5}') == ""
    assert value(spark, tx.header([F.lit("a"), F.lit(None).cast("string"), F.lit("b")])) == "a | b" and value(spark, tx.render("%.1f|%s", F.lit(2.04), F.lit("z"))) == "2.0|z"


@pytest.mark.parametrize("got, want, k, expected", [
    (["a", "b", "c"], ["a", "c"], 3, (1.0, 0.6667, 1.0, 0.9197)),
    (["x", "a"], ["a", "b"], 2, (0.5, 0.5, 0.5, 0.3869)),
    (["a"], ["a"], 5, (1.0, 0.2, 1.0, 1.0)),
    ([], ["a"], 3, (0.0, 0.0, 0.0, 0.0)),
    (["a"], [], 3, (0.0, 0.0, 0.0, 0.0)),
])
def test_metrics_at_k(spark, got, want, k, expected):
    m = mx.metrics_at_k("g", "w", k)
    assert tuple(value(spark, m[c], g=got, w=want) for c in ("recall_at_k", "precision_at_k", "mrr", "ndcg_at_k")) == pytest.approx(expected)


def test_set_metrics(spark):
    m = mx.metrics_as_sets("g", "w")
    row = {"g": ["a", "a", "x"], "w": ["a", "b"]}
    assert value(spark, m["recall"], **row) == 0.5 and value(spark, m["precision"], **row) == 0.5 and value(spark, m["mrr"], **row) == 1.0
    assert value(spark, mx.any_hit("g", "w"), **row) is True


def test_difficulty(spark):
    d = mx.difficulty("s")
    assert (value(spark, d["coverage_score"], s=[0.9, 0.1]), value(spark, d["consistency_score"], s=[0.9, 0.1])) == (0.5, pytest.approx(0.2))
    assert value(spark, d["difficulty_label"], s=[0.9, 0.9]) == "Easy" and value(spark, d["difficulty_label"], s=[0.9, 0.1]) == "Hard" and value(spark, d["difficulty_score"], s=[0.6]) == 1.0
    none = F.array().cast("array<double>")
    assert value(spark, mx.coverage(none)) == 0.0 and value(spark, mx.consistency(none)) == 1.0


def test_answers(spark):
    assert value(spark, mx.clarity("a"), a="one two three. " + "word " * 17 + "end.") == pytest.approx(round(1 - (10.5 - 10) / 30, 4)) and value(spark, mx.clarity("a"), a="ok") == 0.0
    m = mx.attribution("a", F.array(F.lit("E1"), F.lit("E2")))
    text = "The load rose at dawn [E1]. It fell at noon [E7]. No tag stands here."
    assert [value(spark, m[c], a=text) for c in ("total_claims", "claims_with_citation", "correct_citations", "spurious_citations", "citation_accuracy")] == [3, 2, 1, 1, 0.5]
    assert value(spark, m["attribution_coverage"], a="") == 0.0 and value(spark, m["unsupported_claim_rate"], a=None) == 1.0
    assert value(spark, mx.unsupported_rate("s"), s=[0.5, 0.1]) == 0.5 and value(spark, mx.unsupported_rate(F.lit(None).cast("array<double>"))) == 1.0
    n = F.lit(None).cast("double")
    assert value(spark, mx.composite(n, F.lit(0.0), n, n, n)) == 0.2 and value(spark, mx.composite(n, n, n, n, n)) == 0.0
    assert value(spark, mx.dot("x", "y"), x=[1.0, 2.0], y=[3.0, 4.0]) == 11.0 and not math.isnan(value(spark, mx.dot("x", "y"), x=[0.0], y=[0.0]))
