"""Features in one pass: blocks don't matter, and no self-join that no label reads."""

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import text as X
from mnemolake.plans import all_queries
from mnemolake.plans import policy as C


def test_features_dont_depend_on_blocks(spark, tiny):
    names = ["memory_id", "redundancy", "contradiction", "semantic_relevance", "scope_match"]
    a, b = ({r.memory_id: tuple(r)[1:] for r in C.features(spark, tiny, block).select(names).collect()} for block in (8192, 3))
    assert a.keys() == b.keys() and len(a) > 0
    assert all(a[k] == pytest.approx(b[k], abs=2e-5) for k in a)


def test_probabilities_read_features_once(spark, tiny, monkeypatch):
    """Fitting and answering share one pass, and what no label and no feature reads isn't joined."""
    from mnemolake.operators import lifecycle as L

    monkeypatch.setattr(L, "superseded", lambda *a: pytest.fail("superseded memories aren't read"))
    plan = all_queries()[0]["learned_policy_proba"](spark, tiny)._jdf.queryExecution().toString()
    assert "chunks.parquet" not in plan and "Exchange" not in plan


def test_risk_of_odd_letters(spark):
    rows = [("my paſſword", 0.9), ("a toKen", 0.9), ("API-KEY", 0.9), ("tokens", 0.0), ("call 030 1234 5678", 0.65), ("+4930123456", 0.65), ("x1234567890", 0.0), ("a.b@c.de", 0.6), ("@", 0.0), (None, 0.0)]
    got = spark.createDataFrame(rows, "t string, w double").select(X.privacy_risk(F.col("t")).alias("r"), "w").collect()
    assert [r.r for r in got] == [r.w for r in got]
