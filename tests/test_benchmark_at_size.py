"""The benchmark's samples and systems without lists of pairs: what they give is what comparing all pairs gives."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import admission as A
from mnemolake.operators import lifecycle as L
from mnemolake.operators import sets
from mnemolake.plans import benchmark as B
from mnemolake.plans import ranking as P

WORDS = ["now", "red", "blue", "report", "instead", "changed", "旧", "must", "the", "a", "prefer", "token"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def memories(rng, n, ids=None):
    """Few words and scopes, so that copies, ties, updates and merges are frequent."""
    given = lambda: {"importance": rng.choice((0.0, 0.5, 1.0)), "confidence": 0.85, "recency": rng.choice((0.35, 1.0))}
    return [A.Memory(ids and rng.choice(ids) or f"m{rng.random()}", " ".join(rng.choices(WORDS, k=rng.choice((0, 2, 5)))), rng.choice(("semantic", "episodic")), rng.choice(("global", "p q", "p r")), given=given()) for _ in range(n)]


def test_samples_list_no_pairs(spark, tiny):
    p = plan(B.memory_samples(spark, tiny))
    assert "Generate" not in p and p.count("chunks.parquet") <= 1 and p.count("Exchange hashpartitioning(question_id") <= 3


def test_samples_have_the_lifecycle_statuses(spark, tiny):
    status = L.statuses(P.dated(spark, tiny), 0.98, 0.55).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("lifecycle_status") == "superseded", F.col("memory_id")))).alias("old"), (F.count_if(F.col("lifecycle_status") == "duplicate") > 0).alias("copied"))
    want = {r.question_id: (r.old, r.copied) for r in status.collect()}
    got = {r.sample_id: (r.superseded, "MERGE" in r.expected_ops) for r in B.memory_samples(spark, tiny).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and any(v[0] for v in got.values())


def test_sets_against_all_pairs():
    rng = random.Random(1)
    for t, _ in product((0.55, 0.98), range(40)):
        own = [set(rng.sample(range(7), rng.choice((0, 1, 3, 5)))) for _ in range(12)]
        s = sets.from_values(np.array([x for o in own for x in o], np.int64), np.array([len(o) for o in own]))
        ts, known, marked = np.array(rng.choices(range(3), k=12)), np.array(rng.choices((True, False), k=12)), np.array(rng.choices((True, False), k=12))
        near = lambda a, b: a != b and bool(own[a] and own[b]) and len(own[a] & own[b]) / len(own[a] | own[b]) >= t  # noqa: B023, E731
        assert sets.replaced(s, ts, known, marked, t).tolist() == [any(near(a, b) and known[a] and known[b] and marked[b] and ts[b] > ts[a] for b in range(12)) for a in range(12)]
        assert sets.any_repeats(s, known, t) == any(near(a, b) and known[a] for a in range(12) for b in range(a))


@pytest.mark.parametrize("loose", [256, 2])
@pytest.mark.parametrize("ids", [None, ["x", "y", "z", "w"]])
def test_sides_step_as_plain_stores(monkeypatch, loose, ids):
    monkeypatch.setattr(A, "LOOSE", loose)
    rng, seen = random.Random(7), set()
    for _ in range(60):
        initial, candidates, query = memories(rng, rng.choice((0, 1, 9)), ids), memories(rng, 14, ids), rng.choice(("", "red report"))
        arena = A.Arena([*initial, *candidates], query)
        pick = rng.choice((None, "UPDATE", "MERGE"))
        choose = pick and (lambda f, ops: pick if pick in ops and f["redundancy"] > 0.3 else "ADD")  # noqa: B023
        for off in (frozenset(), frozenset(["contradiction"]), frozenset(["redundancy"])):
            side, store = A.Side(arena, initial, off), A.Store(initial)
            for c in candidates:
                f = A.features(c, store.active(), query, c.scope, off=off)
                near = store.nearest(c)[0]
                op, got, mine = side.admit(c, A.alone(c, arena.relevance(c.content), c.scope), A.sight(arena, c), choose and (lambda near: choose))  # noqa: B023
                assert got == f and (mine and mine.id) == (near and near.id)
                assert op == A.admit(c, store, query, c.scope, off, choose)
                assert side.store.items == store.items
                seen.add(op)
            for m in store.active():
                assert arena.lone(m, "p q", off) == A.features(m, [], query, "p q", off=off)
    assert seen == {"ADD", "UPDATE", "MERGE", "IGNORE"}


def test_systems_share_what_they_compare(monkeypatch):
    looks, look = [], A.Arena.look
    monkeypatch.setattr(A.Arena, "look", lambda self, m: looks.append(m.id) or look(self, m))
    rng = random.Random(3)
    initial, candidates = memories(rng, 5), memories(rng, 6)
    cells = [(s, frozenset()) for s in A.SYSTEMS] + [("rule_policy", frozenset(["recency"])), ("none such", frozenset())]
    got = A.run_all(cells, "red report", initial, candidates, "p q", set())
    assert looks == [m.id for m in candidates]
    assert [type(x).__name__ for x, _ in got][-3:] == ["ValueError", "dict", "ValueError"] and all(s > 0 for _, s in got)
    assert got[6][0] == A.run("rule", "red report", initial, candidates, "p q", set())


def test_decisions_are_those_of_the_replay(spark, tiny):
    """Labels are told without comparing, and only chosen examples get their features."""
    s = B.materialize(B.memory_samples(spark, tiny), "decisions")
    every = {(r.sample_id, r.stage, r.memory_id): (r.label, r["values"]) for r in B._labelled(s).collect()}
    assert {(r.sample_id, r.stage, r.memory_id): r.label for r in B._decisions(s).collect()} == {k: v[0] for k, v in every.items()}
    some = frozenset(sorted(every)[::7])
    assert {(r.sample_id, r.stage, r.memory_id): (r.label, r["values"]) for r in B._labelled(s, some).collect()} == {k: every[k] for k in some}


def test_summary_compares_only_chosen_samples(spark, tiny, monkeypatch):
    asked, labelled = [], B._labelled
    monkeypatch.setattr(B, "_labelled", lambda s, only=None: asked.append(only) or labelled(s, only))
    assert B.system_summary(spark, tiny).count() == 8
    (only,) = asked
    assert only and max(len([k for k in only if k[1] == stage]) for stage in ("candidate", "archive", "retrieval")) <= 4 * B.EXAMPLES
