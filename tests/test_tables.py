from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wattloom.operators import documents as dc
from wattloom.operators import evaluation as ev
from wattloom.operators import models
from wattloom.operators import retrieval as rt
from wattloom.operators import temporal as tp
from wattloom.plans import knowledge_queries as kq


def zone_rows(spark, days=2):
    rows = [(z, at("2005-01-01T00:00") + dt.timedelta(hours=h), 100.0 + 10 * z + h % 24 + 5 * (h // 24)) for z in (1, 2) for h in range(24 * days)]
    return spark.createDataFrame([*rows, (1, rows[0][1], float("nan")), (None, rows[0][1], 1.0)], "zone_id int, datetime timestamp_ntz, load_mw double")


def test_daily_and_above(spark):
    daily = tp.daily_stats(zone_rows(spark), "zone_id", "datetime", "load_mw")
    one = daily.where("zone_id = '1' and date = '2005-01-01'").first()
    assert (one["load_mean"], one["load_min"], one["load_max"], one["obs_count"], one["dow"]) == (121.5, 110.0, 133.0, 24, "Saturday") and one["load_std"] == pytest.approx(7.0711, abs=1e-4)
    week = tp.weekly_stats(daily).where("zone_id = '2'").first()
    assert (week["iso_year"], week["iso_week"], week["weekly_mean"]) == (2004, 53, 134.0)
    system = {str(r["date"]): r for r in tp.system_stats(daily, "daily").collect()}
    assert system["2005-01-02"]["load_mean"] == 126.5 + 136.5 and system["2005-01-02"]["obs_count"] == 24.0 and system["2005-01-01"]["zone_id"] == "system"
    assert tp.system_stats(tp.weekly_stats(daily), "weekly").first()["weekly_mean"] == 124.0 + 134.0
    assert tp.seasonal_stats(daily).first()["season"] == "Winter" and tp.monthly_stats(daily).count() == 2
    single = tp.daily_stats(zone_rows(spark).where("hour(datetime) = 3"), "zone_id", "datetime", "load_mw").first()
    assert single["load_std"] is None


def test_melt_and_clean(spark):
    wide = spark.createDataFrame([(1, 2004, 2, 29, "16,853", "x"), (1, 2004, 2, 30, "5", "6")], "`Zone_ID ` int, year int, month int, day int, h1 string, h2 string")
    assert [(r["zone_id"], str(r["datetime"]), r["load_mw"]) for r in tp.melt_hours(wide).collect()] == [(1, "2004-02-29 00:00:00", 16853.0)]
    with pytest.raises(ValueError):
        tp.melt_hours(wide.drop("h1", "h2"))
    rows = spark.createDataFrame([("1.5", "a"), ("NaN", "2"), (None, "3")], "p string, q string")
    assert [(r["p"], r["q"]) for r in tp.clean_measures(rows, ["p", "q", "absent"], "p").collect()] == [(1.5, None)]
    agg = spark.createDataFrame([(1.0,), (0.0,), (None,)], "weekly_mean double")
    assert tp.valid_aggregates(agg).count() == 1 and tp.valid_aggregates(agg.toDF("other")).count() == 3


def test_resample_shares_and_peaks(spark):
    rows = [(at("2007-01-06T10:00"), 1.0, 2.0), (at("2007-01-07T10:00"), 3.0, None), (at("2007-02-28T00:00"), None, None)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, a double, b double")
    week = tp.resample(df, "datetime", ["a", "b"], "W").collect()
    assert [(str(r["period_start"]), r["a_mean"], r["b_mean"]) for r in week] == [("2007-01-07", 2.0, 2.0)]
    assert str(tp.resample(df, "datetime", ["a"], "ME").first()["period_start"]) == "2007-01-31"
    shares = tp.appliance_shares(spark.createDataFrame([(1.0, 3.0), (0.0, None)], "x double, y double"), {"x": "sx", "y": "sy"}).collect()
    assert (shares[0]["sx"], shares[0]["sy"], shares[1]["sx"]) == (25.0, 75.0, None)
    months = spark.createDataFrame([(dt.date(2007, 1, 31), 2.0), (dt.date(2007, 10, 31), 2.0)], "d date, v double")
    assert tp.yearly_peak(months, "d", "v").first()["peak_season"] == "Autumn"  # a tie: first by name


def test_sample_sizes(spark):
    df = spark.range(100).select((F.col("id") % 20).alias("g"), "id")
    assert tp.stratified_sample(df, ["g"], [F.col("id")], 50, 20).count() == 40 and tp.stratified_sample(df, ["g"], [F.col("id")], 5, 20).count() == 20
    docs = spark.createDataFrame([("a", "x")], "dataset string, granularity string")
    assert {(r["dataset"], r["n"], r["status"]) for r in tp.type_counts(docs, [("a", "x"), ("b", "x")]).collect()} == {("a", 1, "OK"), ("b", 0, "MISSING")}


def test_parents_are_there(spark):
    daily = tp.daily_stats(zone_rows(spark, 20), "zone_id", "datetime", "load_mw")
    parts = [dc.zone_documents(daily, "daily"), dc.zone_documents(tp.weekly_stats(daily), "weekly"), dc.zone_documents(tp.monthly_stats(daily), "monthly"), dc.zone_documents(daily, "daily")]
    kb = dc.master_kb(parts)
    rows = {r["row_id"]: r for r in kb.collect()}
    assert len(rows) == kb.count() == 2 * (20 + 4 + 1) and rows["gefcom_daily_1_2005-01-01"]["parent_id"] == "gefcom_weekly_1_W53_2004"
    assert rows["gefcom_weekly_1_W53_2004"]["parent_id"] == "gefcom_monthly_1_December_2004" and all(r["parent_id"] in rows for r in rows.values() if r["granularity"] == "daily")
    text = dc.enriched(kb, {"gefcom": "grid"}).where("row_id = 'gefcom_daily_1_2005-01-01'").first()["text"]
    assert text.startswith("grid | Zone 1 | daily granularity | January Winter daily demand pattern\nZone 1 on 2005-01-01 (Saturday): mean load 121.5 MW")
    picked = dc.select_context(kb, spark.createDataFrame([("q", "gefcom", "monthly"), ("r", "gefcom", "none")], "query_id string, dataset string, granularity string"), 3)
    assert {r["query_id"]: r["count"] for r in picked.groupBy("query_id").count().collect()} == {"q": 2, "r": 3}


def test_house_parents(spark):
    days = spark.createDataFrame([(3, dt.date(2007, 1, 7), 1.0, 1.0, 1.0, None)], "house_id int, period_start date, p_mean double, p_min double, p_max double, p_std double")
    assert dc.house_documents(days, "daily", "p").first()["parent_id"] == "household_weekly_3_2007-01-07" and dc.house_documents(days, "weekly", "p").first()["parent_id"] == "household_monthly_3_2007-01-31"


def test_dense_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8))
    v[7] = v[31]  # a tie
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vec array<double>")
    got = rt.dense_topk(df.where("id < 5 or id = 31"), df, "id", "id", "vec", 4).orderBy("query_id", "rank").collect()
    for q in (0, 1, 2, 3, 4, 31):
        want = sorted(range(60), key=lambda i: (-round(float(v[q] @ v[i]), 9), i))[:4]
        assert [r["row_id"] for r in got if r["query_id"] == q] == want
    assert rt.dense_topk(df.limit(0), df, "id", "id", "vec", 4).count() == 0 and rt.dense_topk(df, df.limit(0), "id", "id", "vec", 4).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "load peak load"), (2, "voltage"), (3, None), (4, "peak of voltage today")], "row_id long, text string")
    got = {r["row_id"]: r["score"] for r in rt.bm25_topk(spark.createDataFrame([("q", "Load LOAD none")], "query_id string, text string"), docs, 5).collect()}
    idf, avg = np.log(3.5) - np.log(1.5), 2.0
    assert got == {1: pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)))}


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, row_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, row_id string, rank int")
    got = {r["row_id"]: r["score"] for r in rt.rrf(a, b, 5, 20).collect()}
    assert got == {"x": pytest.approx(1 / 60 + 1 / 80), "y": pytest.approx(1 / 61 + 1 / 60), "z": pytest.approx(1 / 80 + 1 / 61)}
    assert {r["row_id"]: r["score"] for r in rt.ensemble(a, b, 5).collect()}["z"] == pytest.approx(0.3 / 62)


def test_hierarchy(spark):
    docs = spark.createDataFrame(
        [("d1", "a", "daily", "w1", "load zone one"), ("d2", "a", "daily", "gone", "load zone two"), ("d3", "b", "daily", "", "peak two"), ("w1", "a", "weekly", "", "week zone one"), ("w2", "a", "weekly", "", "load zone two week"), ("m", "a", "monthly", "", "x")],
        "row_id string, dataset string, granularity string, parent_id string, text string")
    children = spark.createDataFrame([("q", "d1", 0.9, 1), ("q", "d2", 0.8, 2), ("q", "d3", 0.7, 3), ("p", "d1", 0.9, 1), ("p", "w1", 0.8, 2)], "query_id string, row_id string, score double, rank int")
    out = [(r["query_id"], r["row_id"], r["retrieval_method"], r["parent_resolution"]) for r in rt.with_parents(children, docs, dc.PARENT).orderBy("query_id", "position").collect()]
    assert out == [("p", "d1", "dense_child", "n/a"), ("p", "w1", "dense_child", "n/a"), ("p", "m", "parent_expansion", "semantic"),
                   ("q", "d1", "dense_child", "n/a"), ("q", "d2", "dense_child", "n/a"), ("q", "d3", "dense_child", "n/a"), ("q", "w1", "parent_expansion", "exact"), ("q", "w2", "parent_expansion", "semantic")]


def test_variants_and_rerank(spark):
    q = spark.createDataFrame([("q", "load"), ("r", None)], "query_id string, text string")
    assert [(r["query_id"], r["variant"], r["text"]) for r in rt.query_variants(q, [F.lit("peak"), F.lit("load"), F.lit(" ")]).where("query_id = 'q'").collect()] == [("q", 0, "load"), ("q", 1, "peak")]
    found = spark.createDataFrame([("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 1, "b", 1), ("q", 1, "c", 2)], "query_id string, variant int, row_id string, rank int")
    assert [r["row_id"] for r in rt.union_variants(found).orderBy("position").collect()] == ["a", "b", "c"]
    docs = spark.createDataFrame([("a", "x"), ("b", "load"), ("c", "load")], "row_id string, text string")
    score = models.pair_score(lambda qs, ds: [float(x == y) for x, y in zip(qs, ds, strict=True)], "question", "document")
    cand = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, row_id string, rank int")
    assert [r["row_id"] for r in rt.rerank(cand, q, docs, score, 2).orderBy("rank").collect()] == ["b", "c"]
    routes = rt.routed(spark.createDataFrame([(1, "all"), (2, "hybrid"), (3, "dense"), (4, None)], "id int, t string"), "t")
    assert {(r["id"], r["pipeline"]) for r in routes.collect()} == {(1, "dense"), (1, "hybrid"), (1, "hierarchical"), (2, "dense"), (2, "hybrid"), (3, "dense"), (4, "dense")}


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    assert [r["v"] for r in df.select(models.embedding(lambda ts: [[float(len(t))] for t in ts], "t").alias("v")).collect()] == [[2.0], None]
    assert df.select(models.similarity_ratio("t", F.lit("AB")).alias("r")).first()["r"] == 1.0
    def fails(prompts):
        raise RuntimeError("no answer")
    assert [r["error"] for r in models.generate(df, "t", fails).collect()] == ["RuntimeError: no answer"] * 2
    assert [r["answer"] for r in models.generate(df, "t", lambda ts: [t.upper() for t in ts]).collect()] == ["AB", ""]
    pairs = spark.createDataFrame([(1, "a b", "a b c", "a")], "id int, answer string, context string, question string")
    scores = models.judge(pairs, models.lexical_judge, ["faithfulness", "answer_relevancy"], "id").first()
    assert (scores["faithfulness"], scores["answer_relevancy"]) == (1.0, 1.0)
    assert models.judge(pairs, lambda p: 1 / 0, ["faithfulness"], "id").first()["faithfulness"] is None or pd.isna(models.judge(pairs, lambda p: 1 / 0, ["faithfulness"], "id").first()["faithfulness"])


def test_evaluation_tables(spark):
    rows = spark.createDataFrame([("e", 0.5, "", 1.0), ("e", None, "", 3.0), ("e", 0.9, "timeout", 9.0), ("f", float("nan"), None, None)], "exp_id string, m double, error string, latency_sec double")
    got = {r["exp_id"]: r for r in ev.experiment_aggregate(rows, ["exp_id"], ["m"], ["m"]).collect()}
    assert (got["e"]["n"], got["e"]["n_errors"], got["e"]["avg_m"], got["e"]["rate_m"], got["e"]["avg_latency"]) == (3, 1, 0.5, 0.25, 2.0) and got["f"]["avg_m"] is None and got["f"]["rate_m"] == 0.0
    assert ev.coverage_table(rows, ["m"]).first()["n_valid"] == 2
    p = spark.createDataFrame([("dense", 0.2), ("x", 0.3), ("y", None)], "pipeline string, r double")
    assert {r["pipeline"]: r["r_change_pct"] for r in ev.baseline_change(p, "pipeline", "dense", ["r"]).collect()} == {"dense": 0.0, "x": 50.0, "y": None}
    ranked = ev.retrieval_summary(p, "pipeline", ["r"]).orderBy("rank")
    assert [r["pipeline"] for r in ranked.collect()] == ["x", "dense", "y"]
    guard = spark.createDataFrame([("dense", 1.0), ("z", 0.5)], "pipeline string, overall_pass double")
    assert {r["pipeline"] for r in ev.scorecard(ranked, guard).collect()} == {"dense", "x", "y", "z"}
    runs = spark.createDataFrame([("a", 9, 10), ("b", 5, 10), ("c", 1, 10)], "exp string, valid int, total int")
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "exp string")
    assert {r["exp"]: r["status"] for r in ev.run_status(runs, expected, ["exp"], "valid", "total").collect()} == {"a": "OK", "b": "WARN", "c": "PART", "d": "PENDING"}
    assert ev.union_all([p, guard]).columns == ["pipeline", "r", "overall_pass"]


def test_overlap_parent_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(list("abcdefghijklmnop"), 6)) for i in range(50, 450, 10)} | {50: None, 60: " ", 410: "Q r s", 500: "q R s t", 600: "", 700: None}
    rows = [(i, t, None if i % 3 else "daily") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, granularity string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {i: set(t.lower().split()) for i, t in texts.items() if t and t.split()}
    want = {}
    for q in (i for i in words if i % 100 == 0):
        share, least = min((-round(len(words[q] & words[d]) / len(words[q]), 9), d) for d in words if d != q)
        want[q] = (least, round(-share, 6))
    got = {r["query_id"]: (r["row_id"], r["score"]) for r in kq.overlap_parent(spark, str(tmp_path)).collect()}
    assert got == want and set(got) == {100, 200, 300, 400, 500} and got[500] == (410, 0.75)


def test_difficulty_aggregate_and_comparison_tables(spark):
    rows = [("a", "Hard", "the evidence is limited evidence", 0.5), ("a", "Hard", "sure", None), ("a", "Easy", None, float("nan")), ("a", None, "x", 0.7), ("b", "Easy", "x", 1.0)]
    df = spark.createDataFrame(rows, "exp_id string, label string, answer string, s double").withColumn("n_hard", F.lit("x"))
    out = {r["exp_id"]: r for r in ev.difficulty_aggregate(df, ["exp_id"], "label", F.coalesce(F.col("answer").contains("limited"), F.lit(False)), ["s"]).collect()}
    assert (out["a"]["avg_s"], out["a"]["n_easy"], out["a"]["n_hard"], out["a"]["cautious_response_accuracy"], out["a"]["n_queries"]) == (0.6, 1, 2, 0.5, 4)
    assert out["b"]["cautious_response_accuracy"] is None and ev.difficulty_aggregate(df.limit(0), ["exp_id"], "label", F.lit(True)).count() == 0
    agg = spark.createDataFrame([("x", 5, "p", 0.5, 0.2, 0.4), ("y", 5, None, None, None, None)], "exp_id string, top_k int, pipeline string, avg_answer_relevance double, avg_hallucination_rate double, avg_recall_at_k double")
    ranked = ev.comparison_ranking(agg).orderBy("rank").collect()
    assert [(r["exp_id"], r["composite_score"], r["rank"]) for r in ranked] == [("x", 0.34, 1), ("y", 0.0, 2)]
    table = ev.comparison_table(agg, ["avg_recall_at_k", "avg_mrr"], only=F.col("pipeline").isNotNull()).collect()
    assert len(table) == 1 and table[0]["avg_mrr"] is None and table[0]["avg_recall_at_k"] == 0.4


def test_expansion_replies(spark):
    df = spark.createDataFrame([("q", "load?", "KEYWORD: zone load peak\nnoise\nparaphrase: When was the peak?"), ("r", "load?", "no idea"), ("s", "load?", None)], "query_id string, text string, reply string")
    got = {(r["query_id"], r["variant"]): r["text"] for r in rt.query_variants(df, rt.reply_variants("reply")).collect()}
    assert got == {("q", 0): "load?", ("q", 1): "zone load peak", ("q", 2): "When was the peak?", ("r", 0): "load?", ("s", 0): "load?"}


def test_search_in_several_blocks_gives_the_same(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, payload array<double>")
    q, c = df.where("i % 9 = 0").withColumnRenamed("i", "query_id"), df.withColumnRenamed("i", "row_id")
    one, many = (sorted(map(tuple, rt.block_topk(q, c, rt.dot_scorer, 3, block=b).collect())) for b in (4096, 4))
    assert one == many and len(one) == 23 * 3
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(1, i % 6 + 1))) for i in range(60)] + [(60, None), (61, "")], "row_id int, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i} w{i + 1} none") for i in range(9)] + [(9, "none"), (10, None)], "query_id int, text string")
    found = rt.bm25_topk(asked, docs, 4).collect()
    assert {r["query_id"] for r in found} == set(range(9)) and all(r["rank"] <= 4 for r in found)
