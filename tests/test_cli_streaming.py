import json

import pytest
from pyspark.sql import functions as F

from judgeloom.cli import demo, loader, main, prepare_sample
from judgeloom.streaming.votes import verdict_counts


def test_demo_and_help(spark, capsys):
    assert demo(spark)["uncertainty"]["logit"]["msp"] == 0.77
    assert main([]) == 0 and "run-position" in capsys.readouterr().out


def test_prepare_sample(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").alias("question_id"), F.lit("m").alias("model_a"), F.lit("n").alias("model_b"), F.when(F.col("id") % 3 == 0, "tie").otherwise("model_a").alias("winner"), F.lit(1).alias("turn"), F.array(F.lit("x")).alias("conversation_a"), F.array(F.lit("y")).alias("conversation_b"))
    rows.write.parquet(str(tmp_path / "in"))
    prepare_sample(spark, str(tmp_path / "in"), str(tmp_path / "out"), 9, 42)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).groupBy("winner").count().collect()[0]["count"] == 4


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("source_row_index"), F.col("event_type").alias("verdict"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = verdict_counts(stream).writeStream.outputMode("complete").format("memory").queryName("votes").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("votes").collect())) == sorted(map(str, verdict_counts(events).collect()))


def test_runner_flags(spark, tmp_path, capsys, monkeypatch):
    from test_engine import CSV

    (tmp_path / "pairs.csv").write_text(CSV)
    (tmp_path / "my_judge.py").write_text("from test_engine import load_judge as load\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    flags = ["--data-path", str(tmp_path / "pairs.csv"), "--output-dir", str(tmp_path / "out"), "--judge", "my_judge:load", "--model-name", "m1", "--limit", "2", "--consistency-runs", "1", "--sampling-temperature", "0.3"]
    assert main(["run-position", *flags]) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["model_name"], got["total_pairs_loaded"], got["consistency_runs"], got["sampling_temperature"]) == ("m1", 2, 1, 0.3)
    assert json.loads((tmp_path / "out" / "position_summary.json").read_text()) == got
    assert (got["tensor_parallel_size"], got["max_model_len"], got["gpu_memory_utilization"]) == (1, 8192, 0.9)
    assert main(["run-bandwagon", *flags]) == 0 and json.loads(capsys.readouterr().out)["bandwagon_congruent_cue_follow_rate"] is not None


def test_demo_record(spark, capsys):
    import judgeloom

    assert main(["schema-demo"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert list(got) == judgeloom.RUN_RECORD.fieldNames()
    assert (got["record_id"], got["prompt_hash"]) == ("b1db7b304cc9923e", "36d08549733e85f3")
    assert got["uncertainty"]["logit"]["entropy"] == pytest.approx(0.9517476484356663) and got["uncertainty"]["consistency"] is None and got["spec"]["uncertainty_methods"] == ["logit"]


def test_sample_command(spark, tmp_path, capsys):
    rows = spark.range(60).selectExpr("id AS question_id", "'x' AS model_a", "'y' AS model_b", "element_at(array('model_a', 'model_b', 'tie'), cast(id % 3 + 1 AS int)) AS winner", "1 AS turn", "array(named_struct('role', 'user', 'content', 'q')) AS conversation_a", "array(named_struct('role', 'user', 'content', 'q')) AS conversation_b")
    rows.write.parquet(str(tmp_path / "in"))
    assert main(["prepare-sample", "--data-path", str(tmp_path / "in"), "--output-path", str(tmp_path / "out"), "--target-size", "9", "--seed", "7"]) == 0
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted(r.winner for r in got) == ["model_a"] * 3 + ["model_b"] * 3 + ["tie"] * 3 and "n_distinct" in capsys.readouterr().out


def test_loader_takes_what_it_knows(tmp_path, monkeypatch):
    (tmp_path / "loaders.py").write_text("def some(model_name, max_model_len=1): return model_name, max_model_len\ndef none(): return 0\ndef all_of(**options): return options\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    options = {"model_name": "m", "max_model_len": 5, "tensor_parallel_size": 2}
    assert loader("loaders:some", options)() == ("m", 5) and loader("loaders:none", options)() == 0 and loader("loaders:all_of", options)() == options
