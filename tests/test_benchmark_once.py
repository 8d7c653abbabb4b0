"""The benchmark's systems run once, over samples that are made once."""

import pytest

from mnemolake.operators import admission as A
from mnemolake.plans import all_queries
from mnemolake.plans import benchmark as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ablation_runs_systems_once(spark, tiny):
    p = plan(all_queries()[0]["feature_ablation"](spark, tiny))
    assert p.count("MapInArrow") == 1 and "chunks.parquet" not in p


def test_deltas(spark):
    rows = [("rule_policy", *[0.5] * len(B.SAMPLE_METRICS)), ("other", *[0.75] * len(B.SAMPLE_METRICS))]
    df = spark.createDataFrame(rows, "system_name string, " + ", ".join(f"{m} double" for m in B.SAMPLE_METRICS))
    got = {r.system_name: r.d_accuracy for r in B.deltas(df).collect()}
    assert got == {"rule_policy": 0.0, "other": 0.25} and B.deltas(df, "none").count() == 0


def test_contents_are_read_once():
    A.traits.cache_clear()
    for query in ("red", "blue"):
        f = A.features(A.Memory("a", "Today you must fix the stale token instead"), [], query, "p")
    assert A.traits.cache_info().misses == 1 and f["privacy_risk"] == 0.9 and f["staleness"] == 0.75 and f["actionability"] == pytest.approx(0.65)


def test_summary_makes_samples_once(spark, tiny):
    p = plan(all_queries()[0]["system_summary"](spark, tiny))
    assert p.count("MapInArrow") == 1 and "chunks.parquet" not in p
