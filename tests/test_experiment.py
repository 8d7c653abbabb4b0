"""The tuned ranker's model, the registry, SQL functions and a whole experiment."""

import json

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import tuned
from mnemolake.operators.registry import Registry, default_registry, register_functions
from mnemolake.plans import experiment
from mnemolake.sources import tables as S


def test_model(spark):
    m = tuned.TunedModel(split_id="s", data_sha256="x")
    assert tuned.TunedModel.from_json(m.to_json()) == m
    for bad in ({"version": "1.3"}, {"training_split": "test"}, {"weights": {}}, {"protect": 3}, {"semantic_weight": 0.0, "lexical_weight": 0.0}):
        with pytest.raises(ValueError):
            tuned.TunedModel(**bad)
    m.check_run("x", "test")
    for run in (("y", "test"), ("x", "dev")):
        with pytest.raises(ValueError):
            m.check_run(*run)


def test_ablation_of_recency_kills_the_signals(spark):
    f = {"anchor": 0.5, "recency": 1.0, "contradiction": 0.9, "redundancy": 0.0, "token_cost": 0.0, "staleness": 0.0, "actionability": 0.5, "temporal": True, "lifecycle_status": "superseded"}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in f.items()])
    got = {r.ablation: r.score for r in tuned.ablations(df).withColumn("score", tuned.score(tuned.TunedModel(), F.col("off"), F.col("operation"))).collect()}
    from math import tanh

    assert got["full"] == pytest.approx(0.5 + 0.06 * tanh(0.1 - 0.045 + 0.2 * 0.9 + 0.05 * 0.5) - 0.03)
    assert got["no_recency"] == pytest.approx(0.5 + 0.06 * tanh(-0.045) - 0.03)
    assert got["no_update_operation"] == pytest.approx(0.5 + 0.06 * tanh(0.1 - 0.045 + 0.025) - 0.03)
    assert got["no_archive_operation"] == pytest.approx(got["full"] + 0.03) and got["no_merge_operation"] == got["full"]


def test_registry(spark):
    r = default_registry()
    assert {"bm25", "dense", "empty", "tf_cosine"} <= set(r.names())
    q = spark.createDataFrame([("q", "red cat")], "question_id string, question string")
    m = spark.createDataFrame([("q", "m1", "red red"), ("q", "m2", "blue")], "question_id string, memory_id string, content string")
    assert [x.memory_id for x in r.rank("Naive-Vector", q, m, 5).collect()] == ["m1"] and r.rank("no_memory", q, m, 5).count() == 0
    with pytest.raises(KeyError):
        r.rank("nothing", q, m, 5)
    with pytest.raises(ValueError):
        r.add("BM25", lambda a, b: a)
    assert Registry.normal(" A-b ") == "a_b"


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT mem_terms('Straße a-b!') t, mem_cosine(array(1D, 0D), array(1D, 1D)) c, mem_jaccard(array('a'), array('a', 'b')) j, mem_half_life(14D, 14D) h, mem_cosine(array(0D), array(1D)) z").first()
    assert r.t == ["strasse", "a-b"] and r.c == pytest.approx(0.5**0.5) and (r.j, r.h, r.z) == (0.5, 0.5, 0.0)


def test_run(spark, tiny, tmp_path):
    samples, memories = S.samples(spark, tiny), S.chunks(spark, tiny).where("content is not null")
    folder = str(tmp_path / "run")
    path = experiment.run(samples, memories, ["bm25", "tf-cosine", "bm25"], folder, reader=lambda ps: ["I don't know"] * len(ps))
    assert json.loads(path.read_text())["status"] == "complete"
    assert (tmp_path / "run/overall.csv").read_text().startswith("method_name,questions,recall_any_1")
    said = spark.read.json(f"{folder}/answers")
    assert said.groupBy("method_name", "question_id").count().where("count > 1").count() == 0
    assert said.where("abstention and abstention_accuracy < 1").count() == 0
    found = spark.read.json(f"{folder}/retrieved")
    left = experiment.answers(found, samples, lambda ps: ["x"] * len(ps), said)
    assert left.join(said, ["method_name", "question_id"], "left_semi").count() == 0
    per = experiment.evaluate(found, samples)
    assert experiment.cases(per, "bm25", "tf_cosine").count() <= 4
    with pytest.raises(FileExistsError):
        experiment.run(samples, memories, ["bm25"], folder)
    with pytest.raises(KeyError):
        experiment.run(samples, memories, ["nothing"], str(tmp_path / "bad"))
    assert json.loads((tmp_path / "bad/manifest.json").read_text())["status"] == "failed"
