"""The policy benchmark: systems over samples, per-sample metrics, aggregates, ablations, tuning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions.numbers import parse_date
from mnemolake.functions.policy import FEATURES
from mnemolake.functions.text import UPDATE_WORDS, contains_any, squeeze, terms, token_overlap
from mnemolake.operators import admission as A
from mnemolake.operators import learned as N
from mnemolake.operators import metrics as M
from mnemolake.operators.sets import any_repeats, from_values, replaced
from mnemolake.sources import exports
from mnemolake.sources import tables as S
from mnemolake.sources.working import materialize

from . import ranking as P
from .policy import kind
from .registry import query

RECORD = "struct<id:string,type:string,scope:string,content:string,summary:string,importance:double,confidence:double,recency:double>"
RESULT = "sample_id string, system_name string, answer string, retrieved array<string>, ops array<string>, tokens bigint, active bigint, error string, latency_ms double"
WRITES = ("ADD", "UPDATE", "MERGE", "ARCHIVE", "COMPRESS")
#: Least similarity of a duplicate and of a superseded memory.
DUPLICATE, SUPERSEDE = 0.98, 0.55


def run_systems(samples: DataFrame, systems: list[str], k: int = 3, off: dict[str, str] | None = None, model: N.PolicyModel | None = None) -> DataFrame:
    """What each system does with each sample; an error of one cell is recorded and doesn't stop the others.

    samples: sample_id, query, target_scope, superseded array<string>, initial and candidates array<RECORD>. off: systems
    that are the rule policy with one feature switched off, by name.
    """
    off = off or {}
    cells = [(name, name, frozenset()) for name in systems] + [(name, "rule_policy", frozenset([f])) for name, f in off.items()]

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        keys = [c.split()[0] for c in RESULT.split(", ")]
        for r in _rows(batches):
            initial, candidates = _memories(r)
            got = A.run_all([c[1:] for c in cells], r["query"] or "", initial, candidates, r["target_scope"], set(r["superseded"] or []), k, model)
            out = []
            for (name, _, _), (what, seconds) in zip(cells, got):
                row = {"sample_id": r["sample_id"], "system_name": name, "answer": None, "retrieved": [], "ops": [], "tokens": 0, "active": 0, "error": None, "latency_ms": seconds * 1000}
                out.append(row | ({"error": f"{type(what).__name__}: {what}"[:200]} if isinstance(what, Exception) else what))
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in zip(keys, kinds)], keys)

    return samples.select("sample_id", "query", "target_scope", "superseded", "initial", "candidates").mapInArrow(run, RESULT)


def _rows(batches):
    """Row by row, as one may hold many memories."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _memories(r: dict) -> tuple[list[A.Memory], list[A.Memory]]:
    """The memories in store and the candidates of a sample."""

    def memory(x: dict, recency: float) -> A.Memory:
        given = {key: x[key] for key in ("importance", "confidence", "recency") if x.get(key) is not None}
        given.setdefault("recency", recency)
        return A.Memory(x["id"], x["content"] or "", x["type"] or "semantic", x["scope"] or "global", x["summary"], given=given)

    return [memory(x, 0.35) for x in r["initial"] or []], [memory(x, 1.0) for x in r["candidates"] or []]


def sample_metrics(results: DataFrame, samples: DataFrame) -> DataFrame:
    """results joined to samples (sample_id, gold_answers, gold_ids, stale_ids, expected_ops, task_type, before) with the benchmark's metrics."""
    j = results.join(samples.select("sample_id", "gold_answers", "gold_ids", "stale_ids", "expected_ops", "task_type", "before"), "sample_id")
    distinct, gold, stale, want = F.array_distinct("retrieved"), F.array_distinct("gold_ids"), F.array_distinct("stale_ids"), F.array_distinct("expected_ops")
    n, common = F.size(distinct), F.size(F.array_intersect("gold_ids", "retrieved"))
    text = F.lower(squeeze(F.col("answer")))
    right = F.exists("gold_answers", lambda g: (F.length(squeeze(g)) > 0) & (F.contains(text, F.lower(squeeze(g))) | (token_overlap(F.col("answer"), g) >= 0.75)))
    written = F.filter("ops", lambda o: o.isin(*WRITES))
    conflict = F.col("task_type").isin("conflict_resolution", "preference_update")
    clash = F.arrays_overlap(F.coalesce("stale_ids", F.array().cast("array<string>")), "retrieved")
    changed = F.array_contains("ops", "UPDATE") | F.array_contains("ops", "MERGE")
    as_double = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return j.withColumns(
        {
            "accuracy": as_double(F.col("answer").isNotNull() & right),
            "evidence_precision": F.when(n > 0, common / n).otherwise((F.size(gold) == 0).cast("double")),
            "evidence_recall": F.when(F.size(gold) > 0, common / F.size(gold)).otherwise((n == 0).cast("double")),
            "operation_recall": F.when(F.size(want) > 0, F.size(F.array_intersect("expected_ops", "ops")) / F.size(want)).otherwise(F.lit(1.0)),
            "write_precision": F.when(F.size(written) > 0, F.size(F.filter(written, lambda o: F.array_contains("expected_ops", o))) / F.size(written)).otherwise((~F.exists("expected_ops", lambda o: o.isin(*WRITES))).cast("double")),
            "update_accuracy": F.when(F.array_contains("expected_ops", "UPDATE"), F.array_contains("ops", "UPDATE").cast("double")).otherwise(F.lit(1.0)),
            "conflict_resolution": F.when(conflict, as_double(changed & ~clash)).otherwise(F.lit(1.0)),
            "conflict_retrieval": F.when(conflict, as_double(clash)).otherwise(F.lit(0.0)),
            "stale_usage": F.when(n > 0, F.size(F.array_intersect("stale_ids", "retrieved")) / n).otherwise(F.lit(0.0)),
            "memory_growth": F.greatest(F.lit(0.0), (F.col("active") - F.col("before")) / F.greatest(F.lit(1), F.col("before"))),
            "token_cost": F.col("tokens").cast("double"),
        }
    )


SAMPLE_METRICS = ("accuracy", "evidence_precision", "evidence_recall", "operation_recall", "write_precision", "update_accuracy", "conflict_resolution", "conflict_retrieval", "stale_usage", "memory_growth", "token_cost")


def summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("system_name").agg(F.count("*").alias("samples"), F.round(F.avg(F.col("error").isNotNull().cast("double")), 6).alias("error_rate"), *[F.round(F.avg(m), 6).alias(m) for m in SAMPLE_METRICS])


def deltas(summary_: DataFrame, reference: str = "rule_policy") -> DataFrame:
    """Each system's metrics less the reference's (one row). The few rows meet in one list, as a join would run the systems twice."""
    every = summary_.groupBy().agg(F.collect_list(F.struct("system_name", *SAMPLE_METRICS)).alias("all"))
    pairs = every.select("all", F.explode(F.filter("all", lambda s: s["system_name"] == reference)).alias("ref")).select(F.explode("all").alias("s"), "ref")
    return pairs.select("s.system_name", *[F.round(F.col(f"s.{m}") - F.col(f"ref.{m}"), 6).alias(f"d_{m}") for m in SAMPLE_METRICS])


def memory_samples(spark, d) -> DataFrame:
    """Each question with its memories as a sample: the earlier half is in store, the later half comes as candidates. Superseded and duplicate
    memories are those of the lifecycle statuses, and tell what operations are expected: an update and an archive for the former, a
    merge for the latter. A sample is worked off by one task, as each decision rests on those before it.
    """
    m = P.memories(spark, d)
    record = F.struct(F.col("memory_id").alias("id"), kind().alias("type"), F.coalesce("scope", F.lit("global")).alias("scope"), "content", F.lit(None).cast("string").alias("summary"), "importance", F.lit(0.85).alias("confidence"), F.lit(None).cast("double").alias("recency"))
    dated = F.unix_micros(parse_date(F.col("source_date"))).alias("ts")
    one = F.struct("ord", "memory_id", record.alias("r"), F.col("source_session_id").alias("session"), dated, contains_any(F.col("content"), UPDATE_WORDS, pad=True).alias("marked"))
    g = m.select("question_id", one.alias("one")).groupBy("question_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    s = S.samples(spark, d).select("question_id", F.col("question").alias("query"), F.coalesce("answer", F.array().cast("array<string>")).alias("gold_answers"), "question_type", "answer_session_ids")
    half = F.ceil(F.size("all") / 2).cast("int")
    rows = F.transform("all", lambda x: x["r"])
    none = F.array().cast("array<string>")
    gold = F.transform(F.filter("all", lambda x: F.array_contains("answer_session_ids", x["session"])), lambda x: x["memory_id"])
    words = F.transform("all", lambda x: F.transform(F.array_distinct(terms(x["r"]["content"])), lambda t: F.xxhash64(t)))
    wide = g.join(s, "question_id").select(
        F.col("question_id").alias("sample_id"), "query", F.get("all", F.lit(0))["r"]["scope"].alias("target_scope"), F.slice(rows, 1, half).alias("initial"), F.filter(rows, lambda r, i: i >= half).alias("candidates"),
        "gold_answers", F.coalesce(F.array_sort(gold), none).alias("gold_ids"), "question_type", half.alias("before"), F.transform("all", lambda x: x["memory_id"]).alias("ids"),
        words.alias("words"), F.transform("all", lambda x: x["ts"]).alias("ts"), F.transform("all", lambda x: x["marked"]).alias("marked"),
    )
    t = _told(wide)
    old = F.col("old")
    changed = F.size(old) > 0
    expected = F.array_compact(F.array(F.lit("ADD"), F.when(changed, F.lit("UPDATE")), F.when(F.col("doubled"), F.lit("MERGE")), F.when(changed, F.lit("ARCHIVE")), F.lit("RETRIEVE")))
    kinds = F.when(changed, F.lit("conflict_resolution")).otherwise(F.coalesce("question_type", F.lit("unknown")))
    return t.select("sample_id", "query", "target_scope", old.alias("superseded"), "initial", "candidates", "gold_answers", "gold_ids", old.alias("stale_ids"), expected.alias("expected_ops"), kinds.alias("task_type"), "before")


def _told(wide: DataFrame) -> DataFrame:
    """Samples with the ids of their superseded memories (old) and whether another is a duplicate (doubled), as lifecycle.statuses has them:
    read from ids, words (hashes), ts and marked, which are in order of the memories.
    """
    asked = ("ids", "words", "ts", "marked")
    kept = wide.drop(*asked)
    names, out = kept.columns, kept.withColumns({"old": F.array().cast("array<string>"), "doubled": F.lit(None).cast("boolean")}).schema

    def run(batches):
        for batch in batches:
            olds, doubled = [], []
            for i in range(batch.num_rows):
                ids, words, ts, marked = (batch.column(c).slice(i, 1).flatten() for c in asked)
                sets = from_values(words.flatten().to_numpy(zero_copy_only=False), np.array(words.value_lengths(), np.int64))
                old = replaced(sets, ts.fill_null(0).to_numpy(zero_copy_only=False), ts.is_valid().to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False).astype(bool), SUPERSEDE)
                olds.append(sorted(ids.filter(pa.array(old)).to_pylist()))
                doubled.append(any_repeats(sets, ~old, DUPLICATE))
            arrays = [*(batch.column(c) for c in names), pa.array(olds, pa.list_(pa.string())), pa.array(doubled, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "old", "doubled"])

    return wide.mapInArrow(run, out)


@query("admission_replay")
def admission_replay(spark, d):
    """Operations of the rule policy on each question's later memories: sequential, so without SQL."""
    r = run_systems(memory_samples(spark, d), ["rule_policy"])
    n = lambda op: F.size(F.filter("ops", lambda o: o == op)).cast("bigint").alias(op.lower())
    return r.select("sample_id", *[n(op) for op in ("ADD", "UPDATE", "MERGE", "IGNORE", "ARCHIVE")], "active", F.array_join("retrieved", " ").alias("retrieved"), "error")


#: Rows of each label that a model is fitted on at most, by hash of their ids, and passes over them (the training's default).
EXAMPLES, EPOCHS = 150, 500


@query("system_summary")
def system_summary(spark, d):
    """All systems over all samples. The learned one is fitted on at most EXAMPLES labelled decisions of each label, by hash."""
    s = materialize(memory_samples(spark, d), "benchmark_samples")  # read by the training, the systems and their metrics
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("sample_id", "stage", "memory_id"), "sample_id", "stage", "memory_id"))
    few = _decisions(s).withColumn("r", rank).where(F.col("r") <= EXAMPLES).orderBy("r", "label").collect()
    keys = [(r.sample_id, r.stage, r.memory_id) for r in few]
    values = {(r.sample_id, r.stage, r.memory_id): r["values"] for r in _labelled(s.where(F.col("sample_id").isin(sorted({k[0] for k in keys}))), frozenset(keys)).collect()} if few else {}
    model = N.PolicyModel.train([(r.label, dict(zip(FEATURES, values[k]))) for r, k in zip(few, keys)], epochs=EPOCHS) if few else None
    return summary(sample_metrics(run_systems(s, list(A.SYSTEMS), model=model), s))


@query("feature_ablation")
def feature_ablation(spark, d):
    """The rule policy with one feature off at a time, against the whole."""
    s = materialize(memory_samples(spark, d), "ablation_samples")  # read by the systems and by their metrics
    off = {f"without_{f}": f for f in ("recency", "contradiction", "redundancy", "importance", "confidence", "token_cost", "scope_match")}
    return deltas(summary(sample_metrics(run_systems(s, ["rule_policy"], off=off), s)))


@query("learned_policy_proba")
def learned_policy_proba(spark, d):
    """Probabilities of a model trained on operations that the rule scores give to a bounded set of memories, EXAMPLES of each label."""
    from mnemolake.functions import policy as G

    from .policy import inputs

    f = inputs(spark, d, {*G.FEATURES, *G.SCORES["write"][0], *G.SCORES["merge"][0]}).withColumn("label", F.when(G.decision("write") == "ADD", "ADD").when(G.decision("merge") == "MERGE", "MERGE").otherwise("IGNORE"))
    f = materialize(f.select("memory_id", "label", *G.FEATURES), "policy_inputs")  # read by the sample and by the result
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("memory_id"), "memory_id"))
    few = f.withColumn("r", rank).where(F.col("r") <= EXAMPLES).orderBy("r", "label").select("label", *G.FEATURES).collect()
    model = N.PolicyModel.train([(r["label"], r.asDict()) for r in few], ["ADD", "IGNORE", "MERGE"], epochs=EPOCHS)
    p = model.columns()
    return f.select("memory_id", *[F.round(F.get(p, F.lit(i)), 6).alias(label.lower()) for i, label in enumerate(model.labels)])


EXAMPLE = "sample_id string, stage string, memory_id string, label string, features map<string,double>"


def training_examples(samples: DataFrame) -> DataFrame:
    """(EXAMPLE) of samples (as run_systems takes them, with expected_ops, gold_ids and stale_ids): the gold operations are replayed over each
    sample's store, and every decision on the way becomes a row. Stages: `candidate`, labelled UPDATE, MERGE, ADD or IGNORE and then
    applied; `archive`, ARCHIVE or IGNORE; `retrieval`, RETRIEVE or IGNORE. Sequential within a sample.
    """
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), F.col("values"))
    return _labelled(samples).select("sample_id", "stage", "memory_id", "label", pairs.alias("features"))


def _label(want: set[str], near: bool) -> str:
    """What is expected of a candidate. near: the store holds another memory."""
    return next((op for op, ok in (("UPDATE", near and "UPDATE" in want), ("MERGE", near and "MERGE" in want), ("ADD", bool(want & {"ADD", "COMPRESS"}))) if ok), "IGNORE")


def _ended(r: dict, held: Iterable[str]) -> Iterator[tuple[str, str, str]]:
    """(stage, memory_id, label) of the memories that the store holds after the candidates."""
    old, gold = {*(r["superseded"] or []), *(r["stale_ids"] or [])} if "ARCHIVE" in (r["expected_ops"] or []) else set(), set(r["gold_ids"] or [])
    held = list(held)
    yield from (("archive", i, "ARCHIVE" if i in old else "IGNORE") for i in held)
    yield from (("retrieval", i, "RETRIEVE" if i in gold else "IGNORE") for i in held if i not in old)


_DECIDED = ("sample_id", "superseded", "gold_ids", "stale_ids", "expected_ops")


def _decisions(samples: DataFrame) -> DataFrame:
    """training_examples() without features, so without comparing: a label asks only whether the store holds another memory."""
    ids = lambda c: F.transform(c, lambda x: x["id"]).alias(c)

    def rows(r: dict):
        held, want = dict.fromkeys(r["initial"] or []), set(r["expected_ops"] or [])
        for i in r["candidates"] or []:
            op = _label(want, len(held) > (i in held))
            yield "candidate", i, op
            if op == "ADD":
                held[i] = None
        yield from _ended(r, held)

    def run(batches):
        for r in _rows(batches):
            found = list(rows(r))
            yield pa.RecordBatch.from_arrays([pa.array([r["sample_id"]] * len(found), pa.string()), *(pa.array([x[i] for x in found], pa.string()) for i in range(3))], ["sample_id", "stage", "memory_id", "label"])

    return samples.select(*_DECIDED, ids("initial"), ids("candidates")).mapInArrow(run, "sample_id string, stage string, memory_id string, label string")


def _labelled(samples: DataFrame, only: frozenset[tuple[str, str, str]] | None = None) -> DataFrame:
    """training_examples() with the features' values in an array. only: keys (sample_id, stage, memory_id) of those that come out, if not all."""

    def rows(r: dict):
        initial, candidates = _memories(r)
        arena, want = A.Arena([*initial, *candidates], r["query"]), set(r["expected_ops"] or [])
        side = A.Side(arena, initial)
        for m in candidates:
            op, f, _ = side.admit(m, A.alone(m, arena.relevance(m.content), r["target_scope"] or m.scope), A.sight(arena, m), lambda near: lambda _f, _ops: _label(want, near is not None))
            yield "candidate", m.id, op, f
        for stage, i, label in _ended(r, side.store.items):
            yield stage, i, label, arena.lone(side.store.items[i], r["target_scope"] or "global")

    def run(batches):
        for r in _rows(batches):
            found = [x for x in rows(r) if only is None or (r["sample_id"], *x[:2]) in only]
            stage, ident, label = (pa.array([x[i] for x in found], pa.string()) for i in range(3))
            values = pa.array([[x[3][f] for f in FEATURES] for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r["sample_id"]] * len(found), pa.string()), stage, ident, label, values], ["sample_id", "stage", "memory_id", "label", "values"])

    return samples.select(*_DECIDED, "query", "target_scope", "initial", "candidates").mapInArrow(run, "sample_id string, stage string, memory_id string, label string, values array<double>")


@query("training_examples")
def training_examples_query(spark, d):
    """Labelled decisions of all samples, counted by stage and label: sequential, so without SQL."""
    return training_examples(memory_samples(spark, d)).groupBy("stage", "label").agg(F.count("*").alias("examples"), F.round(F.avg(F.col("features")["importance"]), 6).alias("mean_importance"))


def differences(results: DataFrame, reference: str, other: str, most: int = 12) -> DataFrame:
    """The first samples, by id, in which two systems do other operations."""
    side = lambda name, c: results.where(F.col("system_name") == name).select("sample_id", F.col("ops").alias(c))
    return side(reference, "ops_reference").join(side(other, "ops_other"), "sample_id").where("ops_reference <> ops_other").orderBy("sample_id").limit(most)


def failures(scored: DataFrame, most: int = 20) -> DataFrame:
    """The first cells, by system and sample, that failed or answered wrongly."""
    return scored.where("error is not null or accuracy < 1").orderBy("system_name", "sample_id").select("system_name", "sample_id", "answer", "error", "accuracy").limit(most)


def aggregate_latency(results: DataFrame, column: str = "latency_ms") -> DataFrame:
    return results.groupBy("system_name").agg(*M.latency(column))


def report(scored: DataFrame) -> str:
    """The benchmark as Markdown: means and latencies of each system, and the first failures."""
    first = ("samples", "error_rate", *SAMPLE_METRICS)
    return exports.report("Memory policy benchmark", summary(scored).join(aggregate_latency(scored), "system_name").orderBy("system_name"), failures(scored), first)
