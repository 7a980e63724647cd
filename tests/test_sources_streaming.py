from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import READINGS, at
from wattloom.operators.documents import cleaned_documents
from wattloom.sources import files, sinks
from wattloom.streaming import incremental


def test_csv_directory_and_artefacts(spark, tmp_path):
    (tmp_path / "Load_A.csv").write_text('zone_id,h1\n1,"16,853"\n')
    (tmp_path / "temp.csv").write_text("a,b\n1,2\n")
    got = files.read_csv_directory(spark, str(tmp_path))
    assert sorted(got) == ["load_a", "temp"] and got["load_a"].first()["h1"] == "16,853"
    assert files.find_file(spark, str(tmp_path), ["none*.csv", "*.csv"]).endswith("temp.csv") and files.find_file(spark, str(tmp_path), ["x*"]) is None
    files.check_paths(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        files.check_paths(spark, str(tmp_path), str(tmp_path / "gone"))
    with pytest.raises(FileNotFoundError):
        files.read_csv_directory(spark, str(tmp_path / "gone"))


def test_meter_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Date;Time;Power\n16/12/2006;17:24:00;4.216\n16/12/2006;17:25:00;?\n31/2/2007;00:00:00;1\n")
    rows = files.read_meter_file(spark, str(tmp_path / "m.txt")).collect()
    assert [(r["datetime"], r["Power"]) for r in rows] == [(at("2006-12-16T17:24"), 4.216), (at("2006-12-16T17:25"), None), (None, 1.0)]


def test_json_forms_and_results(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "dict.json").write_text(json.dumps({"a": [1, 2], "b": ["x", "y"]}))
    assert files.read_json_or_csv(spark, str(tmp_path / "list.json")).count() == 2
    assert [(r["a"], r["b"]) for r in files.read_json_or_csv(spark, str(tmp_path / "dict.json")).collect()] == [(1, "x"), (2, "y")]
    rows = spark.createDataFrame([("e", 3, "q1"), ("e", 5, "q2")], "exp_id string, top_k int, query_id string")
    sinks.save_result(rows, rows.groupBy("exp_id").count(), str(tmp_path / "out"))
    assert files.read_run(spark, str(tmp_path / "out/query_results"), "e", 5).first()["query_id"] == "q2"
    assert spark.read.json(str(tmp_path / "out/agg_metrics")).first()["count"] == 2
    with pytest.raises(FileNotFoundError):
        files.read_result(spark, str(tmp_path / "gone"))


def test_kb_and_documents(spark, tmp_path):
    kb = spark.createDataFrame([("r1", "gefcom", "Load rose."), ("r2", "household", " "), ("r3", "household", None)], "row_id string, dataset string, summary string")
    sinks.save_table(kb, str(tmp_path / "kb"))
    sinks.save_table(kb, str(tmp_path / "kb.csv"), "csv")
    assert files.read_kb(spark, str(tmp_path / "kb"), "household").count() == 2 and files.read_kb(spark, str(tmp_path / "kb.csv"), "gefcom").count() == 1
    assert [r["text"] for r in files.documents_from_kb(kb).collect()] == ["Load rose."]
    assert [r["text"] for r in files.documents_from_records(spark.createDataFrame([("id: 1\nsummary: s: t",), ("plain",)], "c string"), "c").collect()] == ["s: t", "plain"]
    assert cleaned_documents(kb.limit(0), "summary", ["row_id"]).count() == 0


def test_append_resumes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.append_new(df, str(tmp_path / "t"), "id").count() == 2
    assert sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], "id int, v string")), str(tmp_path / "t"), "id").count() == 3


def test_vectors_logs_and_markdown(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x", "gefcom"), ("b", None, "household")], "row_id string, text string, dataset string")
    sinks.save_vectors(docs, F.when(F.col("text").isNotNull(), F.array(F.lit(1.0))), str(tmp_path / "v"))
    assert sinks.load_vectors(spark, str(tmp_path / "v")).count() == 1 and sinks.load_vectors(spark, str(tmp_path / "v"), dataset="household").count() == 0
    prompts = spark.createDataFrame([("r", "d", "g", "x" * 41)], "row_id string, dataset string, granularity string, prompt_text string")
    log = sinks.request_log(prompts, F.lit("ok"), F.lit(1.23456), F.lit("2020-01-02 03:04:05").cast("timestamp")).first()
    assert (log["timestamp"], log["prompt_tokens_est"], log["latency_s"]) == ("02-01-2020 03:04:05", 10, 1.235)
    assert sinks.failure_log(prompts, F.lit("m"), F.current_timestamp()).columns == ["timestamp", "dataset", "granularity", "row_id", "error_msg"]
    assert sinks.markdown(spark.createDataFrame([("a|b", 0.5, None)], "k string, v double, w double")) == "| k | v | w |\n|---|---|---|\n| a\\|b | 0.5000 | N/A |"


def test_streams(spark, tmp_path):
    rows = [(1, 1, at("2020-01-01T01:00"), 2.0), (2, 1, at("2020-01-01T02:00"), 4.0), (3, 1, at("2020-01-02T02:00"), float("nan"))]
    spark.createDataFrame(rows, READINGS).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_arriving(spark, str(tmp_path / "in"), READINGS)
    for _ in range(2):  # the second run finds nothing new
        incremental.append_arriving(stream, lambda df: df.where("load_mw > 1"), "reading_id", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["reading_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    query = incremental.daily_stats_stream(stream, "zone_id", "datetime", "load_mw").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("select * from days").collect()
    assert len(got) == 1 and got[0]["load_mean"] == 3.0 and got[0]["obs_count"] == 2
