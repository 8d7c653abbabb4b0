"""Readers, the Markdown store, exports, the embedding cache and streams."""

import json

import pytest
from pyspark.sql import functions as F

from mnemolake.operators.store import MemoryStore
from mnemolake.sources import embedding, exports, markdown, readers
from mnemolake.streaming import ingest

SAMPLE = {"qid": "q1", "question": "?", "haystack_sessions": [[{"speaker": "User", "text": "hello"}, {"role": "assistant", "content": " "}], []], "haystack_dates": ["2025-01-01"]}


@pytest.mark.parametrize("wrap", [lambda x: json.dumps([x]), lambda x: json.dumps({"data": [x]}), lambda x: json.dumps({"samples": [x]}), lambda x: "# note\n\n" + json.dumps(x) + "\n", lambda x: json.dumps(x)])
def test_question_files(spark, tmp_path, wrap):
    (tmp_path / "f.json").write_text(wrap(SAMPLE))
    r = readers.questions(spark, str(tmp_path / "f.json")).first()
    assert (r.question_id, r.answer, r.haystack_session_ids, r.haystack_dates) == ("q1", ["I don't know"], ["session_0", "session_1"], ["2025-01-01", None])
    assert r.haystack_sessions[0][0].role == "User" and r.haystack_sessions[0][0].content == "hello"
    chunks = readers.session_chunks(readers.questions(spark, str(tmp_path / "f.json"))).collect()
    assert [(c.memory_id, c.content, c.turn_count) for c in chunks] == [("lme_q1_session_0", "User: hello", 1)]
    assert [t.event_type for t in readers.turn_chunks(readers.questions(spark, str(tmp_path / "f.json"))).collect()] == ["user_message"]


def test_bad_question_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([SAMPLE | {"haystack_session_ids": ["only"]}]))
    with pytest.raises(Exception, match="differ in number"):
        readers.questions(spark, str(tmp_path / "f.json")).collect()


def test_operation_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"op": "ADD", "payload": {"feature_snapshot": {"importance": 0.5}}}) + "\n" + json.dumps({"op": "IGNORE"}) + "\n")
    got = readers.training_examples(readers.operation_log(spark, [str(tmp_path / "log.jsonl"), str(tmp_path / "none.jsonl")])).collect()
    assert [(r.label, r.features) for r in got] == [("ADD", {"importance": 0.5})]
    assert readers.operation_log(spark, [str(tmp_path / "none.jsonl")]).count() == 0


def test_markdown_round_trip(spark, tmp_path):
    rows = [("a", "semantic", "p", "line\n\nmore: text\n", "sum: mary", "active", ["x", "y"], 0.5, None), ("b", "episodic", "q", "", None, "archived", None, None, 0.25)]
    df = spark.createDataFrame(rows, markdown.SCHEMA)
    assert markdown.write(df, str(tmp_path)) == 2
    assert sorted(map(tuple, markdown.read(spark, str(tmp_path)).collect())) == rows
    (tmp_path / "c.md").write_text('---\nid: "other"\n---\n\nx')
    with pytest.raises(Exception, match="differ"):
        markdown.read(spark, str(tmp_path)).collect()
    assert [r.line for r in markdown.index(df).collect()][0] == "## Active (1)"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a|b_c", 0.5, None)], "name string, value double, other string")
    paths = exports.export(df, str(tmp_path), "t", "50% & more")
    csv, md, tex = (p.read_text() for p in paths)
    assert csv == "name,value,other\na|b_c,0.5000,\n" and "a\\|b_c" in md and "a|b\\_c & 0.5000" in tex and "50\\% \\& more" in tex
    assert json.loads(exports.manifest(str(tmp_path), status="done").read_text()) == {"status": "done"}


def test_embedding_cache(spark, tmp_path):
    calls = []
    embedder = embedding.hashing_embedder(8)
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "c"), "hash", embedder)
    df = spark.createDataFrame([(1, "red cat"), (2, "red cat"), (3, None), (4, "dog")], "i int, content string")
    got = {r.i: r.embedding for r in cache.embed(df).collect()}
    assert got[1] == got[2] and got[3] is None and len(got[4]) == 8 and cache.table().count() == 2
    cache.embed(df)
    assert cache.table().count() == 2 and not calls


def test_reader_and_candidates(spark):
    out = embedding.answer(spark.createDataFrame([("q", "what?")], "question_id string, prompt string"), lambda ps: ["swimming" for _ in ps]).first()
    assert (out.prediction, out.output_tokens) == ("swimming", 2)
    ev = spark.createDataFrame([(1, "x"), (2, "y")], "event_id bigint, content string")
    reply = 'Sure: [{"content": "likes tea", "type": "odd"}, {"content": ""}]'
    got = embedding.candidates(ev, lambda ts: [reply if t == "x" else "no json" for t in ts]).collect()
    assert [(r.event_id, r.content, r.type, r.importance) for r in got] == [(1, "likes tea", "semantic", 0.7)]


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_windows(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(ingest.windowed_counts(ingest.event_stream(spark, str(tmp_path / "in")), "6 hours"), "windows")
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    want = {(r.w.start, r.event_type): r["count"] for r in events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").count().collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_stream_upserts(spark, tmp_path):
    schema = "id string, type string, scope string, content string"
    store = MemoryStore(spark, str(tmp_path / "store"))
    for n, rows in enumerate(([("a", "semantic", "x", "one")], [("a", "semantic", "x", "two"), ("b", "semantic", "x", "three")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / f"in/{n}"))
        s.writeStream.foreachBatch(ingest.upsert_into(store)).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.id: r.content for r in store.all().collect()} == {"a": "two", "b": "three"}


def test_stream_admission(spark, tmp_path):
    rows = [("1", "2025-01-01", "p", "You must prefer the workflow to reuse the fix for the debug process and should remember it"), ("2", "2025-01-02", "p", "You must prefer the workflow to reuse the fix for the debug process and should remember it"), ("3", "2025-01-02", None, "x")]
    spark.createDataFrame(rows, "event_id string, d string, scope string, content string").select("event_id", F.to_timestamp("d").alias("ts"), "scope", "content").coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(ingest.admissions(ingest.event_stream(spark, str(tmp_path / "in"), ingest.MEMORY_EVENT)), "admitted")
    got = {r.event_id: r.op for r in spark.table("admitted").collect()}
    assert set(got) == {"1", "2"} and set(got.values()) <= {"ADD", "MERGE", "UPDATE", "IGNORE"}
