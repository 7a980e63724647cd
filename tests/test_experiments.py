from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators import experiments as ex
from wattloom.operators import retrieval as rt
from wattloom.plans.evaluation_queries import _stand_in


def docs(spark):
    rows = [("d1", "a", "daily", "w1", "load zone one peak"), ("d2", "a", "daily", "", "voltage of the house"), ("d3", "a", "daily", "", "load zone two"), ("w1", "a", "weekly", "", "week of zone one")]
    return spark.createDataFrame(rows, "row_id string, dataset string, granularity string, parent_id string, text string")


def questions(spark):
    return spark.createDataFrame([("q#1", "load zone one"), ("r", "voltage"), ("s", "12")], "query_id string, text string")


def test_every_pipeline_and_mode_ends_in_k_rows(spark):
    for pipeline in ("dense", "hybrid", "hierarchical"):
        for mode in ("baseline", "full") if pipeline != "dense" else ex.MODES:
            found = ex.retrieve(questions(spark), docs(spark), pipeline, 2, rt.letter_vector, mode, [F.lit("peak load")]).collect()
            by = {}
            for r in found:
                by.setdefault(r["query_id"], []).append(r["rank"])
            assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and {"q#1", "r"} <= set(by)
            assert all(len(v) <= (4 if pipeline == "hierarchical" and "rerank" not in ex.MODES[mode] and "expand" not in ex.MODES[mode] else 2) for v in by.values())


def test_prompts_and_runs(spark):
    found = ex.search(questions(spark), docs(spark), "dense", 2, rt.letter_vector)
    prompted = ex.prompts(questions(spark), found, docs(spark), with_difficulty=True)
    rows = {r["query_id"]: r for r in prompted.collect()}
    assert rows["s"]["context"] == "No summaries retrieved." and rows["s"]["retrieved"] is None
    text = rows["q#1"]["messages"][1]["content"]
    assert "[E1] granularity: daily | " in text and text.endswith("Question: load zone one") and rows["q#1"]["messages"][0]["role"] == "system"
    results = {r["query_id"]: r for r in ex.run(prompted, lambda ps: ["The load of zone one peaked early [E1]."] * len(ps), "exp", "dense", 2, rt.letter_vector).collect()}
    assert results["q#1"]["correct_citations"] == 1 and results["s"]["spurious_citations"] == 1 and results["r"]["error"] == ""


def test_boost_samples_and_texts(spark):
    c = spark.createDataFrame([("q", "Peak load"), ("q", "peak"), ("q", "x"), ("r", "peak"), ("r", "y")], "k string, t string")
    assert sorted((r["k"], r["t"]) for r in ex.keyword_boost(c, "t", ["PEAK"], "k").collect()) == [("q", "Peak load"), ("q", "peak"), ("r", "peak"), ("r", "y")]
    ids = spark.range(50)
    assert ex.hashed_sample(ids, "id", 7).collect() == ex.hashed_sample(ids.repartition(5), "id", 7).collect() and ex.hashed_sample(ids, "id", 7).count() == 7
    assert ex.cross_dataset_sample(ids.withColumn("d", F.col("id") % 2), "d", "id", 10).count() == 10
    lists = spark.createDataFrame([("q", ["w1", "gone", "d2"]), ("r", [])], "k string, ids array<string>")
    assert {r["k"]: r["texts"] for r in ex.texts_of(lists, "k", "ids", docs(spark)).collect()} == {"q": ["week of zone one", "", "voltage of the house"], "r": []}


def test_fallback_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "x", "the load of zone one"), ("q", 2, "d1", "z"), ("q", 3, "y", "unlike")], "query_id string, rank int, row_id string, text string")
    relevant = spark.createDataFrame([("q", "d1", "The load of zone one!")], "query_id string, row_id string, text string")
    m = ex.metrics_with_fallback(ranked, relevant, 3).first()
    assert (m["recall_at_k"], m["precision_at_k"], m["mrr"], m["ndcg_at_k"]) == (1.0, 0.6667, 1.0, 1.0)
    assert ex.metrics_with_fallback(ranked, relevant, 3, cap=False).first()["recall_at_k"] == 2.0


def test_all_evidence_reaches_the_model(spark):
    texts = [("d1", "load zone one. " * 400 + "\nlast line"), ("d2", "zone two peaked at noon")]
    long = spark.createDataFrame(texts, "row_id string, text string")
    found = spark.createDataFrame([("q#1", "d1", 0.9, 1), ("q#1", "d2", 0.8, 2)], "query_id string, row_id string, score double, rank int")
    prompted = ex.prompts(questions(spark).where("query_id <> 's'"), found, long)
    content = {r["query_id"]: r["messages"][1]["content"] for r in prompted.collect()}["q#1"]
    assert all(t in content for _, t in texts) and "[E2] zone two peaked at noon" in content
    results = {r["query_id"]: r for r in ex.run(prompted, _stand_in, "exp", "dense", 2, rt.letter_vector).collect()}
    assert results["q#1"]["answer"].split("\n") == ["load zone one. " * 400 + " [E1].", "last line [E1].", "zone two peaked at noon [E2]."]
    assert results["q#1"]["correct_citations"] == 2 and results["r"]["answer"] == ""
