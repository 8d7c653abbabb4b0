"""Operators against brute force on small fixtures, and their invariants."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import admission as A
from mnemolake.operators import learned as N
from mnemolake.operators import lifecycle as L
from mnemolake.operators import metrics as M
from mnemolake.operators import ranking as R
from mnemolake.operators import splits as P
from mnemolake.operators.store import MemoryStore, merge

WORDS = "red green blue cat dog report draft budget note plan now changed memo".split()


@pytest.fixture(scope="module")
def memories(spark):
    rng = random.Random(3)
    rows = [(f"q{i % 4}", f"m{i:03d}", i, " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) if i % 11 else "") for i in range(120)]
    rows += [("q0", "m900", 900, rows[4][3]), ("q0", "m901", 901, rows[4][3])]
    return rows, spark.createDataFrame(rows, "question_id string, memory_id string, ord int, content string")


def test_bm25(spark, memories):
    rows, df = memories
    questions = {"q0": "red red cat", "q1": "report", "q2": "zebra", "q3": ""}
    got = {(r.question_id, r.memory_id): r.score for r in R.bm25(spark.createDataFrame(list(questions.items()), "question_id string, question string"), df).collect()}
    want = {}
    for q, text in questions.items():
        docs = {m: c.split() for k, m, _, c in rows if k == q}
        avg = sum(map(len, docs.values())) / len(docs)
        for m, d in docs.items():
            tf, s = Counter(d), 0.0
            for t in text.split():
                n = sum(t in x for x in docs.values())
                if tf[t]:
                    s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg))
            if s:
                want[q, m] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_similar_within(memories):
    rows, df = memories
    for t in (0.5, 0.8, 1.0):
        want = set()
        for i, (q, m, _, c) in enumerate(rows):
            for q2, m2, _, c2 in rows[:i]:
                a, b = set(c.split()), set(c2.split())
                if q == q2 and a and b and len(a & b) / len(a | b) >= t:
                    want.add((q, min(m, m2), max(m, m2)))
        assert {(r.question_id, r.a, r.b) for r in L.similar_within(df, t).collect()} == want


def test_duplicates_compare_with_all_earlier(spark):
    df = spark.createDataFrame([("q", "a", 0, "x y"), ("q", "b", 1, "x y"), ("q", "c", 2, "x y"), ("q", "d", 3, "z")], "question_id string, memory_id string, ord int, content string")
    assert {r.memory_id for r in L.duplicates(df).collect()} == {"b", "c"}


def test_superseded_wins(spark):
    rows = [("q", "old", 0, "budget is ten for cat", "2024-01-01"), ("q", "new", 1, "budget is ten for cat now ", "2024-01-20"), ("q", "same", 2, "budget is ten for cat", "2024-01-20")]
    df = spark.createDataFrame(rows, "question_id string, memory_id string, ord int, content string, d string").withColumn("ts", F.to_timestamp("d"))
    got = {r.memory_id: r.lifecycle_status for r in L.statuses(df).collect()}
    assert got == {"old": "superseded", "new": "active", "same": "duplicate"}


def test_redundancy_blocks(spark):
    rng = random.Random(1)
    rows = [("q" if i < 60 else "z", f"m{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(61)]
    df = spark.createDataFrame(rows, "question_id string, memory_id string, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {m: max([0.0, *(cos(v, w) for q2, m2, w in rows if q2 == q and m2 != m)]) for q, m, v in rows}
    for block in (512, 10):
        got = {r.memory_id: r.redundancy for r in L.redundancy(df, block).collect()}
        assert all(got[m] == pytest.approx(want[m], abs=1e-9) for m in want) and len(got) == 61


def reference_guard(rows, k, margin=0.02):
    dense = sorted(rows, key=lambda r: (-r["dense"], -r["anchor"], r["ord"]))
    key = lambda r: (-r["score"], -r["anchor"], r["ord"])
    kept, open_, tail = dense[:4], dense[4:5], dense[5:10]
    floor = min((r["score"] for r in open_), default=None)
    can = open_ + [r for r in tail if floor is not None and r["score"] >= floor + margin]
    head = kept + sorted(can, key=key)[:1]
    rest = [r for r in dense[:10] if r not in head]
    return [r["memory_id"] for r in sorted(head, key=key) + sorted(rest, key=key) + sorted(dense[10:], key=key)][:k]


def test_guarded_rerank(spark):
    rng = random.Random(5)
    groups = {}
    for g in range(40):
        groups[f"q{g}"] = [{"memory_id": f"m{i}", "ord": i, "dense": rng.randint(0, 8) / 8, "anchor": rng.randint(0, 4) / 4, "score": rng.randint(0, 50) / 50} for i in range(rng.randint(1, 25))]
    flat = [(q, r["memory_id"], r["ord"], r["dense"], r["anchor"], r["score"]) for q, rows in groups.items() for r in rows]
    got = R.guarded(spark.createDataFrame(flat, "question_id string, memory_id string, ord int, dense double, anchor double, score double"), 12).collect()
    for q, rows in groups.items():
        mine = [r.memory_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.rank_no)]
        assert mine == reference_guard(rows, 12)
        top = {r["memory_id"] for r in sorted(rows, key=lambda r: (-r["dense"], -r["anchor"], r["ord"]))[:10]}
        assert set(mine[:10]) == top


def test_retrieval_metrics(spark):
    df = spark.createDataFrame([(1, ["noise", "gb", "ga"], ["ga", "gb"]), (2, ["ga", "n1", "n2"], ["ga", "gb"])], "i int, sessions array<string>, gold array<string>")
    a, b = (r.asDict() for r in M.retrieval_metrics(df).orderBy("i").collect())
    assert (a["recall_any_1"], a["recall_all_3"], a["precision_5"], a["mrr"]) == (0.0, 1.0, 0.4, 0.5)
    assert a["ndcg_official_5"] == pytest.approx((1 + 1 / math.log2(3)) / 2)
    assert (b["recall_any_5"], b["recall_all_5"], b["fractional_recall_5"]) == (1.0, 0.0, 0.5)


def test_folds_and_splits(spark):
    assert spark.createDataFrame([("q1",)], "question_id string").select(P.fold("question_id").alias("f")).first().f == 2
    df = spark.createDataFrame([(f"q{i}",) for i in range(50)], "question_id string")
    one, two = ({r.question_id: r.split for r in P.dev_test(df, 10).collect()} for _ in range(2))
    assert one == two and sum(v == "dev" for v in one.values()) == 10


def test_store(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path))
    new = lambda *rows: spark.createDataFrame(list(rows), "id string, type string, scope string, content string, tags array<string>, content_embedding array<double>")
    s.add(new(("a", "semantic", "x", "red cat", ["t", "u"], [1.0, 0.0]), ("b", "episodic", "y", "blue dog", [], [0.0, 1.0])))
    s.add(new(("c", "semantic", "x", "red dog", ["t"], None)))
    with pytest.raises(ValueError):
        s.add(new(("a", "semantic", "x", "again", [], None)))
    with pytest.raises(ValueError):
        s.add(new(("-bad", "semantic", "x", "again", [], None)))
    s.update(spark.createDataFrame([("a", "green cat")], "id string, content string"))
    a = s.get("a").first()
    assert (a.content, a.content_embedding, a.type) == ("green cat", None, "semantic")
    with pytest.raises(KeyError):
        s.update(spark.createDataFrame([("nope", "x")], "id string, content string"))
    assert [r.id for r in s.list(tags=["t"]).collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        s.list(colour="red")
    s.archive(spark.createDataFrame([("b",)], "id string"))
    s.delete(spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in s.list().collect()] == ["a", "c"] and [r.id for r in s.list(status="archived").collect()] == ["b"]
    assert [r.version for r in s.history("a").collect()] == [1, 2] and s.history("b").count() == 2
    assert [r.id for r in s.search_text("red dog", 5).collect()] == ["c"]
    s.merge(spark.createDataFrame([("a", "c", 0)], "target_id string, source_id string, ord int"))
    assert s.get("a").first().content == "green cat\n\nred dog" and s.get("c").first().status == "archived"
    before = {r.id: r.content for r in s.all().collect()}
    s.compact()
    assert {r.id: r.content for r in s.all().collect()} == before and s.log().count() == 3
    assert s.execute("ADD", False) == "IGNORE"
    with pytest.raises(NotImplementedError):
        s.execute("SPLIT", True)


def test_merge_links(spark):
    rows = [("t", 0, "t", "a", "s1", ["r"], ["old"]), ("t", 1, "u", "a\n\nb", None, ["old", "t"], None)]
    got = merge(spark.createDataFrame(rows, "target_id string, ord int, id string, content string, summary string, related array<string>, supersedes array<string>")).first()
    assert (got.content, got.summary, got.related) == ("a\n\nb", "s1", ["r", "u"])


def test_admission():
    given = {"importance": 0.9, "confidence": 0.9, "novelty": 0.9, "redundancy": 0.0, "actionability": 0.9, "recency": 1.0}
    old = A.Memory("o", "The user prefers the red report", scope="p")
    assert A.admit(A.Memory("n", "Remember: you must prefer the blue workflow", "procedural", "p", given=given), A.Store([]), "q", "p") == "ADD"
    store = A.Store([old])
    changed = A.Memory("n", "The user prefers the blue report instead, changed", scope="p", given={"contradiction": 0.9, "recency": 1.0, "confidence": 0.9})
    assert A.admit(changed, store, "q", "p") == "UPDATE" and store.items["o"].content == changed.content
    store = A.Store([old])
    same = A.Memory("n", "The user prefers the red report", scope="p", given={"redundancy": 0.95, "scope_match": 1.0})
    assert A.admit(same, store, "q", "p") == "MERGE" and list(store.items) == ["o"]
    assert A.admit(A.Memory("n", "x", scope="p", given={"importance": 0.0, "novelty": 0.0}), A.Store([]), "q", "p") == "IGNORE"


def test_learned_policy(spark):
    examples = [("ADD", {"importance": 1.0, "novelty": 1.0}), ("IGNORE", {"importance": 0.0, "redundancy": 1.0})] * 3
    m = N.PolicyModel.train(examples, epochs=60)
    assert m.choose({"importance": 1.0, "novelty": 1.0}, ["ADD", "IGNORE"]) == "ADD"
    again = N.PolicyModel.from_json(m.to_json())
    f = dict.fromkeys(again.features, 0.25)
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in f.items()]).select(again.columns().alias("p")).first().p
    assert row == pytest.approx([again.probabilities(f)[k] for k in again.labels])


def test_trials():
    a, b = N.trials(12, 7), N.trials(12, 7)
    assert a == b and a[0]["semantic"] == 1.0 and [t["lexical"] for t in a[1:8]] == list(N.FUSION)
    assert all(0.7 <= t["semantic"] <= 1.0 and t["protect"] in (4, 5) for t in a[8:])
    assert N.gate({"recall_all_5": 0.95, "dense_recall_all_5": 0.9, "macro_gain": 0.0, "worst_gain": 0.0, "fold_stddev": 0.1}) == dict.fromkeys(("recall", "gain", "macro", "worst", "stable", "head"), True)
