"""Costs, the search, reports, resumed runs, labelled decisions, and the store's audits and index."""

import json
import math

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import nested
from mnemolake.functions import policy as P
from mnemolake.operators import admission as A
from mnemolake.operators import cost as C
from mnemolake.operators import lifecycle as L
from mnemolake.operators import ranking as R
from mnemolake.operators import search as H
from mnemolake.operators.store import HybridStore, MemoryStore
from mnemolake.operators.tuned import ABLATIONS
from mnemolake.plans import benchmark as B
from mnemolake.plans import experiment as E
from mnemolake.sources import config, exports, files, readers
from mnemolake.sources import tables as S
from mnemolake.streaming import ingest


def test_usage_at_any_depth(spark):
    rows = [('{"a": {"Prompt_Tokens": 5, "deep": {"input_tokens": 7}}, "completion_tokens": 3}', (12, 3, 15)), ('{"total_tokens": 9, "prompt_tokens": -4}', (0, 0, 9)), ('{"x": "\\"prompt_tokens\\": 4"}', None), ("{}", None), (None, None)]
    got = spark.createDataFrame(rows, "u string, w struct<i:int,o:int,t:int>").select(C.usage_tokens(F.col("u")).alias("g"), "w").collect()
    assert all((tuple(r.g) if r.g else None) == (tuple(r.w) if r.w else None) for r in got)
    r = spark.range(1).select(C.usage_or_estimate(F.lit(None).cast("string"), "input", F.lit(8)).alias("e"), C.counter_delta(F.lit(2), F.lit(5)).alias("d"), C.counter_delta(F.lit(5), F.lit(None).cast("int")).alias("n")).first()
    assert tuple(r) == (8, 0, 5)


def test_costs(spark):
    """Two right answers and a usage of 100 and 3 tokens each: 206 tokens were observed, 103 for each right answer."""
    per = spark.createDataFrame([("dense", "q1", 2, 50, 1024, 2, None, 4), ("dense", "q2", 1, 10, 0, 1, None, None)], "method_name string, question_id string, memories bigint, tokens bigint, bytes bigint, kept bigint, began timestamp, available bigint")
    told = spark.createDataFrame([("dense", True, 0, 0, '{"prompt_tokens": 100, "completion_tokens": 3}', 10.0)] * 2 + [("none", False, 1, None, None, None)], "method_name string, correct boolean, input_tokens bigint, output_tokens bigint, usage string, end_to_end_ms double")
    got = {r.method_name: r for r in C.with_deltas(C.summary(per, told), ("tuned", "dense")).collect()}
    d, n = got["dense"], got["none"]
    assert (d.correct_answers, d.observed_tokens, d.tokens_per_correct, d.ms_per_correct, d.retention_ratio, d.storage_coverage, d.usage_coverage) == (2, 206, 103.0, 10.0, 0.5, 0.5, 1.0)
    assert (n.samples, n.tokens_per_correct, n.usage_tokens, n.delta_reader_tokens, n.delta_memory_count) == (0, None, None, 1.0, None)


def test_blended_redundancy(spark):
    rows = [("q", "a", "red cat runs", "p x", "k", True), ("q", "b", "red cat sleeps", "p y", "k", False), ("q", "c", "", "", "z", True), ("q", "d", "red cat runs", None, "z", False), ("r", "e", "lone", "p", "k", True)]
    df = spark.createDataFrame(rows, "question_id string, memory_id string, content string, scope string, kind string, bare boolean")
    want = {"a": 0.8, "c": 0.1, "e": 0.0}
    for block in (512, 1):
        got = {r.memory_id: r.redundancy for r in L.blended_redundancy(df, block).collect()}
        assert got == pytest.approx(want)


def test_search_prefers_what_passes(spark):
    names = ["trial", "limit", *H.METRICS, "macro_type", "worst_type", "min_fold", "fold_stddev", "objective"]
    base = {"limit": 0.0, "head_kept": 1.0, "token_cost": 0.0, "stale_rate": 0.0, "conflict_rate": 0.0, "mrr": 0.5, "macro_type": 0.9, "worst_type": 0.8, "min_fold": 0.8, "fold_stddev": 0.1, "objective": 1.0}
    rows = [base | {"trial": 0, "recall_all_5": 0.90}, base | {"trial": 1, "recall_all_5": 0.93}, base | {"trial": 2, "recall_all_5": 0.95, "worst_type": 0.7}, base | {"trial": 3, "recall_all_5": 0.93, "limit": 0.1}]
    df = spark.createDataFrame([tuple(float(r[n]) if n != "trial" else r[n] for n in names) for r in rows], "trial int, " + ", ".join(f"{n} double" for n in names[1:]))
    got = {r.trial: (r.place, r.robust, r.gate) for r in H.select(df).collect()}
    assert got == {1: (1, True, True), 3: (2, True, True), 0: (3, True, False), 2: (4, False, False)}


def test_search_and_tuning(spark, tiny):
    from mnemolake.plans.tuned import tuning_rows

    rows = tuning_rows(spark, tiny)
    model, found = E.tune(rows, 10, 3, split_id="s")
    assert found.count() == 10 and found.where("place = 1").count() == 1 and model.split_id == "s"
    with pytest.raises(ValueError):
        E.ablation_table(spark.createDataFrame([("full", 1.0)], "ablation string, mrr double"))
    table = spark.createDataFrame([(n, 1.0) for n in sorted(ABLATIONS)], "ablation string, mrr double")
    assert [r.ablation for r in E.ablation_table(table).collect()] == list(ABLATIONS)


def test_resumed_run(spark, tiny, tmp_path):
    samples, memories = S.samples(spark, tiny), S.chunks(spark, tiny).where("content is not null")
    folder = str(tmp_path / "run")

    def broken(prompts):
        raise OSError("no service")

    with pytest.raises(Exception, match="no service"):
        E.run(samples, memories, ["bm25"], folder, reader=broken)
    assert json.loads((tmp_path / "run/manifest.json").read_text())["status"] == "failed"
    with pytest.raises(FileExistsError):
        E.run(samples, memories, ["bm25"], folder)
    with pytest.raises(ValueError, match="differ in k"):
        E.run(samples, memories, ["bm25"], folder, k=3, resume=True)
    E.run(samples, memories, ["bm25"], folder, reader=lambda ps: ["first"] * len(ps), resume=True)
    n = spark.read.json(f"{folder}/answers").count()
    E.run(samples, memories, ["bm25"], folder, reader=lambda ps: ["second"] * len(ps), resume=True)
    said = spark.read.json(f"{folder}/answers")
    assert said.count() == n and {r.prediction for r in said.collect()} == {"first"}
    told = spark.read.json(f"{folder}/hypotheses")
    assert told.count() == n and set(told.columns) == {"question_id", "hypothesis", "method_name"}
    assert "| method_name | questions |" in (tmp_path / "run/report.md").read_text()
    members = samples.select(F.lit("test").alias("split"), "question_id")
    assert E.scope(samples, members, "test", 2).count() == 2 and E.scope(samples, members, "dev").count() == 0 and E.scope(samples, members, "test", 0).count() == 0
    assert E.fingerprint(samples, "question_id") == E.fingerprint(samples.orderBy(F.desc("question_id")), "question_id") != E.fingerprint(samples.limit(1), "question_id")
    manifest = json.loads(exports.split_manifest(members, seed=1))
    assert manifest["seed"] == 1 and len(manifest["splits"]["test"]) == samples.count()


def test_cases(spark):
    per = spark.createDataFrame(
        [("t", "q1", "knowledge-update", None, 1.0, 1.0), ("d", "q1", "knowledge-update", None, 0.0, 0.2), ("t", "q2", "multi", None, 0.5, 0.1), ("d", "q2", "multi", None, 1.0, 1.0), ("t", "q3", "knowledge-update", None, 1.0, 0.5), ("d", "q3", "knowledge-update", None, 0.0, 0.5)],
        "method_name string, question_id string, question_type string, skip_reason string, recall_all_5 double, mrr double",
    )
    told = spark.createDataFrame([("t", "q3", 0.0, None), ("t", "q1", 1.0, None), ("d", "q1", 0.0, None)], "method_name string, question_id string, exact_match double, abstention_accuracy double")
    stale = spark.createDataFrame([("d", "q1", 2), ("t", "q1", 0), ("d", "q3", 1)], "method_name string, question_id string, stale int")
    archived = spark.createDataFrame([("q2", 1, 0, 3), ("q1", 1, 2, 0)], "question_id string, archived int, kept_out int, memories int")
    got = {r.case: r.question_id for r in E.cases(per, "t", "d", told, stale, archived).collect()}
    assert got == {"update": "q1", "error": "q3", "stale": "q1", "archive": "q1"}
    samples = spark.createDataFrame([("q1", "?", ["a"]), ("q3", "!", ["b"])], "question_id string, question string, answer array<string>")
    found = spark.createDataFrame([("q1", "t", 1, "m", "text")], "question_id string, method_name string, rank_no int, memory_id string, content string")
    page = E.case_pages(E.cases(per, "t", "d", told), samples, found)
    assert "## error: q3" in page and "1. t, m: text" in page


def test_labelled_decisions(spark):
    m = lambda i, text, **more: {"id": i, "type": "semantic", "scope": "p", "content": text, "summary": None, "importance": 0.8, "confidence": 0.9, "recency": None} | more
    rows = [("s1", "which report", "p", ["old"], [m("old", "the red report"), m("x", "another thing")], [m("new", "the blue report")], ["new", "x"], [], ["ADD", "ARCHIVE", "RETRIEVE"]), ("s2", None, None, None, [], [m("c", "alone")], [], None, [])]
    df = spark.createDataFrame(rows, f"sample_id string, query string, target_scope string, superseded array<string>, initial array<{B.RECORD}>, candidates array<{B.RECORD}>, gold_ids array<string>, stale_ids array<string>, expected_ops array<string>")
    got = {(r.sample_id, r.stage, r.memory_id): r.label for r in B.training_examples(df).collect()}
    assert got == {("s1", "candidate", "new"): "ADD", ("s1", "archive", "old"): "ARCHIVE", ("s1", "archive", "x"): "IGNORE", ("s1", "archive", "new"): "IGNORE", ("s1", "retrieval", "x"): "RETRIEVE", ("s1", "retrieval", "new"): "RETRIEVE", ("s2", "candidate", "c"): "IGNORE"}
    f = B.training_examples(df).where("memory_id = 'new' and stage = 'candidate'").first().features
    assert set(f) == set(P.FEATURES) and f["importance"] == 0.8
    res = spark.createDataFrame([("s1", "a", ["ADD"]), ("s1", "b", ["IGNORE"]), ("s2", "a", []), ("s2", "b", [])], "sample_id string, system_name string, ops array<string>")
    assert [r.sample_id for r in B.differences(res, "a", "b").collect()] == ["s1"]
    scored = spark.createDataFrame([("s1", "a", "x", None, 0.0), ("s2", "a", "x", "E", 1.0), ("s3", "a", "x", None, 1.0)], "sample_id string, system_name string, answer string, error string, accuracy double")
    assert [r.sample_id for r in B.failures(scored).collect()] == ["s1", "s2"]


def test_replay_agrees_with_single_steps(spark, tiny):
    """The registered replay over Spark gives for every sample what the plain functions give on the driver."""
    rows = B.memory_samples(spark, tiny).collect()
    got = {r.sample_id: (r.add, r.update, r.merge, r["ignore"], r.archive, r.active, r.error) for r in B.admission_replay(spark, tiny).collect()}
    assert len(got) == len(rows) > 0
    for r in rows[:15]:
        make = lambda x, initial: A.Memory(x["id"], x["content"] or "", x["type"], x["scope"], x["summary"], given={k: x[k] for k in ("importance", "confidence") if x[k] is not None} | {"recency": 0.35 if initial else 1.0})
        out = A.run("rule_policy", r["query"] or "", [make(x, True) for x in r.initial], [make(x, False) for x in r.candidates], r.target_scope, set(r.superseded))
        n = [out["ops"].count(op) for op in ("ADD", "UPDATE", "MERGE", "IGNORE", "ARCHIVE")]
        assert got[r.sample_id] == (*n, out["active"], None)


def test_benchmark_report(spark, tiny):
    s = B.memory_samples(spark, tiny).limit(5)
    page = B.report(B.sample_metrics(B.run_systems(s, ["No-Memory", "rule"]), s))
    assert page.startswith("# Memory policy benchmark") and "latency_ms_p95" in page and "| rule |" in page and "No memory available." in page


def test_store_audits_and_batches(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "a"), embedder=lambda ts: [[float(len(t)), 1.0] for t in ts])
    new = lambda *rows: spark.createDataFrame(list(rows), "id string, type string, scope string, content string, content_embedding array<double>")
    assert s.execute("ADD", True, "why", 0.7, 0.9, rows=new(("a", "semantic", "x", "red", [1.0, 0.0]))) == "ADD"
    assert s.execute("IGNORE", True, score=0.1) == "IGNORE" and s.execute("RETRIEVE", True, query="red", k=3) == "RETRIEVE"
    assert [r.id for r in s.found.collect()] == ["a"]
    assert sorted((r.op, r.decided, r.score) for r in s.audit().collect()) == [("ADD", "ADD", 0.7), ("IGNORE", "IGNORE", 0.1), ("RETRIEVE", "RETRIEVE", None)]
    s.update(spark.createDataFrame([("a", "green")], "id string, content string"))
    assert s.get("a").first().content_embedding == [5.0, 1.0]
    batch = spark.createDataFrame([("a", "blue"), ("b", "new"), ("b", "new")], "id string, content string")
    write = ingest.upsert_into(s, "q")
    for _ in range(2):
        write(batch, 7)
    assert s.history("a").count() == 3 and s.history("b").count() == 1 and s.get("b").first().status == "active"
    before = s.log()
    s.compact(history=True)
    assert s.history("a").count() == 3 and before.count() == s.log().count()  # readers of the old table still have it
    s.compact()
    assert s.log().count() == 2


def test_hybrid_store(spark, tmp_path, monkeypatch):
    s = HybridStore(spark, str(tmp_path / "h"))
    new = lambda *rows: spark.createDataFrame(list(rows), "id string, type string, scope string, content string, content_embedding array<double>")
    s.add(new(("a", "semantic", "x", "red", [1.0, 0.0]), ("b", "semantic", "x", "blue", [0.0, 1.0])))
    assert [r.id for r in s.search_vector([1.0, 0.1], 5).collect()] == ["a", "b"] and s.reindex() == 0
    s.archive(spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in s.search_vector([1.0, 0.1], 5).collect()] == ["a"]

    def fail(rows):
        raise OSError("index")

    with monkeypatch.context() as m:
        m.setattr(s, "_write_index", fail)
        with pytest.raises(OSError):
            s.add(new(("c", "semantic", "x", "lost", [1.0, 0.0])))
        assert s.get("c").first().status == "archived"
        with pytest.raises(OSError):
            s.update(spark.createDataFrame([("a", [0.5, 0.5])], "id string, content_embedding array<double>"))
    assert s.reindex() == 1 and s.reindex() == 0


def test_small_sources(spark, tmp_path):
    made = files.init_workspace(spark, str(tmp_path / "w"))
    files.write_text(spark, str(tmp_path / "w/logs/events.jsonl"), "kept")
    assert len(made) == 7 and files.init_workspace(spark, str(tmp_path / "w")) == [] and files.read_text(spark, str(tmp_path / "w/logs/events.jsonl")) == "kept"
    assert files.read_text(spark, str(tmp_path / "none")) is None
    c = config.parse("# note\nmodel:\n  name: 'a b'\n  key_env: KEY\n  retries: 3\n  stop: [x, 2]\n  deep:\n    on: true # yes\nplain: 0.5\nnone: null\n")
    assert c == {"model": {"name": "a b", "key_env": "KEY", "retries": 3, "stop": ["x", 2], "deep": {"on": True}}, "plain": 0.5, "none": None}
    assert config.resolved(c, {"KEY": "s"})["model"]["key"] == "s"
    with pytest.raises(KeyError):
        config.resolved(c, {})
    with pytest.raises(ValueError, match="line 2"):
        config.parse("a: 1\n- b")
    (tmp_path / "q.jsonl").write_text('# x\n{"qid": "1", "question": "?", "extra": {"a": 1}}\n\n{"qid": "2", "question": "!"}\n')
    q = readers.questions(spark, str(tmp_path / "q.jsonl"), rest=True)
    assert {r.question_id: r.rest for r in q.collect()} == {"1": '{"extra":{"a":1}}', "2": None}
    assert readers.questions(spark, str(tmp_path / "q.jsonl"), limit=0).count() == 0 and readers.questions(spark, str(tmp_path / "q.jsonl"), limit=1).count() == 1
    assert [r.event_id for r in readers.query_events(q).orderBy("question_id").collect()] == ["query_1", "query_2"] and readers.generic_samples(q).first().task_type == "unknown"
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="bad.jsonl: not JSON: not json"):
        readers.records(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "empty.jsonl").write_text("# nothing\n")
    with pytest.raises(ValueError, match="no records"):
        readers.benchmark_samples(spark, str(tmp_path / "empty.jsonl"))


def test_small_functions(spark):
    r = spark.createDataFrame([('{"a": {"b": 1, "c": [1]}, "d": 2}', '{"a": {"b": null, "e": 3}, "d": {"f": 1}}'), ("{}", None), (None, '{"x": 1}')], "a string, b string")
    assert [json.loads(x.m) for x in r.select(nested.deep_merge(F.col("a"), F.col("b")).alias("m")).collect()] == [{"a": {"b": None, "c": [1], "e": 3}, "d": {"f": 1}}, {}, {"x": 1}]
    f = dict.fromkeys(P.FEATURES, 0.1) | {"recency": 0.9, "importance": 0.9, "novelty": 0.5}
    df = spark.range(1).select(F.lit("m").alias("memory_id"), *[F.lit(v).alias(k) for k, v in f.items()])
    row = df.select(P.explain(3).alias("top"), P.to_operation("write").alias("op")).first()
    assert row.top == ["importance", "recency", "novelty"] and row.op.target_memory_id == "m" and row.op.payload.feature_snapshot["recency"] == 0.9 and row.op.op == "IGNORE" and math.isclose(row.op.threshold, 0.65)
    part = lambda *rows: spark.createDataFrame(list(rows), "question_id string, memory_type string, content string, score double, source_date string")
    got = R.united([part(("q", "t", "One", 0.5, "2024"), ("q", None, "x", 0.5, "2025")), part(("q", "t", "one ", 0.9, None), ("q", "u", "one", 0.1, None))], 3).orderBy("rank_no").collect()
    assert [(x.content, x.score) for x in got] == [("one ", 0.9), ("x", 0.5), ("one", 0.1)]


def test_wide_latex(spark):
    df = spark.createDataFrame([tuple(range(9))], ", ".join(f"c{i} int" for i in range(9)))
    assert "table*" in exports.to_latex(df) and "resizebox" in exports.to_latex(df) and "table*" not in exports.to_latex(df.select("c0"))


def test_services(spark, tmp_path):
    """Models, answers and usage of a service on this machine; what a cache found and what it had to embed."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from mnemolake.sources import embedding

    class Service(BaseHTTPRequestHandler):
        def _send(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._send({"data": [{"id": "b"}, {"id": "a"}]})

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self._send({"choices": [{"message": {"content": "yes"}}], "usage": {"prompt_tokens": 100, "completion_tokens": 3}})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    prompts = spark.createDataFrame([("q", "what?")], "question_id string, prompt string")
    assert embedding.http_models(url) == ["a", "b"]
    r = embedding.answer(prompts, embedding.chat_reader(url, "a")).first()
    server.shutdown()
    assert (r.prediction, r.input_tokens, r.output_tokens) == ("yes", 100, 3)
    assert embedding.answer(prompts, lambda ps: ["yes"] * len(ps)).first().input_tokens == 2
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"), "n", embedding.hashing_embedder(4))
    df = spark.createDataFrame([("one",), ("two",), ("one",), (None,)], "content string")
    cache.embed(df)
    cache.embed(df)
    assert cache.counts == {"hits": 2, "generated": 2}


def test_admission_over_batches(spark, tmp_path):
    """Two micro batches, with the state between them, decide as one plain pass over each scope does."""
    texts = ["Remember: the user must prefer the red report", "Remember: the user must prefer the red report", "the weather", "Now the user must prefer the blue report instead", "A workflow you should always reuse to fix and debug the blue report"]
    rows = [(f"e{i}", f"2025-01-0{i % 9 + 1}", f"s{i % 2}", texts[i % 5]) for i in range(14)]
    schema = "event_id string, ts string, scope string, content string"
    for n in (0, 1):
        part = [r for r in rows if (r[1] > "2025-01-05") == bool(n)]
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = ingest.event_stream(spark, str(tmp_path / "in/*"), ingest.MEMORY_EVENT, files=1)
        q = ingest.admissions(stream).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r.event_id: (r.op, r.memories) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for scope in ("s0", "s1"):
        store = A.Store([])
        for e, _, s, t in sorted((r for r in rows if r[2] == scope), key=lambda r: (r[1], r[0])):
            op = A.admit(A.Memory(e, t, scope=s), store, "", s)
            want[e] = (op, len(store.active()))
    assert got == want and len({op for op, _ in want.values()}) > 1
