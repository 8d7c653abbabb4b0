"""A retrieval and answering experiment from tables to exports, and the selection of cases worth reading."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.text import prompt
from mnemolake.operators import metrics as M
from mnemolake.operators import search as H
from mnemolake.operators import tuned as T
from mnemolake.operators.registry import Registry, default_registry
from mnemolake.sources import exports, files
from mnemolake.sources.embedding import Reader, answer
from mnemolake.sources.tables import is_abstention


def retrieve(questions: DataFrame, memories: DataFrame, methods: list[str], k: int = 10, registry: Registry | None = None) -> DataFrame:
    """(method_name, question_id, memory_id, rank_no, score, source_session_id, source_date, token_count, content) of every method; what memories lack is null."""
    registry = registry or default_registry()
    out = None
    for m in dict.fromkeys(Registry.normal(x) for x in methods):
        one = registry.rank(m, questions, memories, k).select(F.lit(m).alias("method_name"), "question_id", "memory_id", "rank_no", "score")
        out = one if out is None else out.unionByName(one)
    more = [F.col(c) if c in memories.columns else F.lit(None).cast(t).alias(c) for c, t in (("source_session_id", "string"), ("source_date", "string"), ("token_count", "bigint"), ("content", "string"))]
    return out.join(memories.select("memory_id", *more), "memory_id")


def evaluate(retrieved: DataFrame, samples: DataFrame) -> DataFrame:
    """Metrics of each method and question; skip_reason instead where there is nothing to measure."""
    s = samples.select("question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), F.array_distinct(F.coalesce("answer_session_ids", F.array().cast("array<string>"))).alias("gold"), F.when(is_abstention(), "abstention").when(F.coalesce(F.size("answer_session_ids"), F.lit(0)) <= 0, "missing_gold").alias("skip_reason"))
    j = M.ranked_sessions(retrieved).join(s, "question_id")
    return M.retrieval_metrics(j.where("skip_reason is null")).unionByName(j.where("skip_reason is not null"), allowMissingColumns=True)


def scope(samples: DataFrame, members: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """Samples of one split (members: split, question_id), the first `limit` by id after the split if given; 0 gives none."""
    own = samples.join(members.where(F.col("split") == split).select("question_id").distinct(), "question_id", "left_semi")
    return own if limit is None else own.orderBy("question_id").limit(limit)


def fingerprint(df: DataFrame, *columns: str) -> str:
    """A digest of the rows of some columns, whatever their order: an aggregate, combined before the shuffle."""
    r = df.agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(i), *columns)).alias(f"x{i}") for i in range(3)]).first()
    return hashlib.sha256(repr(tuple(r)).encode()).hexdigest()


def signature(**settings: object) -> str:
    """A digest of settings; runs of equal signature may be continued."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def run(samples: DataFrame, memories: DataFrame, methods: list[str], folder: str, k: int = 10, reader: Reader | None = None, resume: bool = False, model: T.TunedModel | None = None, split: str = "") -> Path:
    """Rank, evaluate, answer if there is a reader, and export: records as JSON lines, tables in three formats, a report, a manifest.

    A folder that exists is refused unless resume is set: then data, model and settings must be those of its manifest, rankings that
    are there are kept, and only unanswered questions reach the reader. A failed run is marked in its manifest and can be
    resumed. A model isn't run on other data than it was trained on, nor on its training split.
    """
    spark = samples.sparkSession
    data = fingerprint(samples, "question_id", "question")
    if model is not None:
        model.check_run(data, split)
    settings = {"data_sha256": data, "k": k, "methods": sorted({Registry.normal(m) for m in methods}), "model_sha256": signature(model=model.to_json()) if model else "", "split": split}
    held = files.read_text(spark, f"{folder}/manifest.json")
    if files.exists(spark, folder):
        if not resume or held is None:
            raise FileExistsError(folder)
        check_compatible(json.loads(held), settings)
    began = time.time()
    note = lambda status, **more: exports.manifest(folder, status=status, signature=signature(**settings), seconds=round(time.time() - began, 3), spark=spark.version, **settings, **more)
    try:
        questions = samples.select("question_id", "question", "question_date", *[c for c in ("query_vector",) if c in samples.columns])
        records, told = f"{folder}/retrieved", f"{folder}/answers"
        if not files.exists(spark, f"{records}/_SUCCESS"):
            exports.write_records(retrieve(questions, memories, methods, k, default_registry(model, max(k, 10))), records, "method_name")
        found = spark.read.json(records)
        per = evaluate(found, samples)
        exports.write_records(per, f"{folder}/metrics", "method_name")
        keep = [F.round(F.avg(m), 6).alias(m) for m in M.METRICS]
        good = per.where("skip_reason is null")
        overall = good.groupBy("method_name").agg(F.count("*").alias("questions"), *keep).orderBy("method_name")
        exports.export(overall, folder, "overall")
        exports.export(good.groupBy("method_name", "question_type").agg(F.count("*").alias("questions"), *keep).orderBy("method_name", "question_type"), folder, "by_type")
        files.write_text(spark, f"{folder}/report.md", exports.report("Retrieval", overall, first=("questions", "recall_all_5", "mrr"), notes=settings))
        if reader is not None:
            done = spark.read.json(told) if files.exists(spark, f"{told}/_SUCCESS") else None
            answers(found, samples, reader, done).write.mode("append").partitionBy("method_name").json(told)
            exports.hypotheses(spark.read.json(told), f"{folder}/hypotheses")
    except BaseException:
        note("failed")
        raise
    return note("complete")


def check_compatible(*manifests: dict) -> None:
    """Refuse runs that differ in data, split, model, methods or depth."""
    for key in ("data_sha256", "split", "model_sha256", "methods", "k"):
        if len({json.dumps(m.get(key), sort_keys=True) for m in manifests}) > 1:
            raise ValueError(f"runs differ in {key}")


def answers(retrieved: DataFrame, samples: DataFrame, reader: Reader, done: DataFrame | None = None) -> DataFrame:
    """(method_name, question_id, prediction and metrics): the reader sees the ranked evidence; (method_name, question_id) in done are left out."""
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "content"))), lambda x: x["content"])
    e = retrieved.groupBy("method_name", "question_id").agg(evidence.alias("evidence")).join(samples.select("question_id", "question", "question_date"), "question_id")
    if done is not None:
        e = e.join(done.select("method_name", "question_id"), ["method_name", "question_id"], "left_anti")
    asked = e.select(F.concat_ws("|", "method_name", "question_id").alias("question_id"), prompt(F.col("question"), F.col("question_date"), F.col("evidence")).alias("prompt"))
    part = F.split("question_id", "\\|", 2)
    said = answer(asked, reader).select(part[0].alias("method_name"), part[1].alias("question_id"), "prediction", "input_tokens", "output_tokens")
    gold = samples.where(F.size("answer") > 0).select("question_id", F.col("answer").alias("golds"), is_abstention().alias("abstention"))
    return M.qa_metrics(said.join(gold, "question_id"))


def right() -> Column:
    """Whether an answer with its metrics is right; null without an answer."""
    return F.when(F.col("exact_match").isNotNull() | F.col("abstention_accuracy").isNotNull(), F.coalesce(F.col("exact_match") >= 1, F.lit(False)) | F.coalesce(F.col("abstention_accuracy") >= 1, F.lit(False)))


def cases(per: DataFrame, method: str, other: str, told: DataFrame | None = None, stale: DataFrame | None = None, archived: DataFrame | None = None) -> DataFrame:
    """(case, question_id, question_type, first, second, third): one question for each kind of case, the best by its three keys, ties by id.

    per: evaluate(). told: answers() of both methods. stale: (method_name, question_id, stale), retrieved memories that are outdated.
    archived: (question_id, archived, kept_out, memories), what archiving did. Kinds: `update`, an update question that `method` answers not wrongly and
    finds more for than `other`; `stale`, an update question where `other` has more outdated memories; `archive`, the most
    archived; `error`, the worst answer or miss of `method`.
    """
    cols = ("question_id", "question_type", "skip_reason", "recall_all_5", "mrr")
    mine, theirs = per.where(F.col("method_name") == method).select(*cols), per.where(F.col("method_name") == other).select("question_id", F.col("recall_all_5").alias("theirs"))
    none = per.sparkSession.createDataFrame([], "question_id string, method_name string, ok boolean")
    ok = none if told is None else told.select("question_id", "method_name", right().alias("ok"))
    of = lambda m, name: ok.where(F.col("method_name") == m).select("question_id", F.col("ok").alias(name))
    j = mine.join(theirs, "question_id").join(of(method, "ok"), "question_id", "left").join(of(other, "their_ok"), "question_id", "left").withColumn("update", F.contains(F.lower("question_type"), F.lit("update")))
    num = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    wrong = F.coalesce(~F.col("ok"), F.lit(False))

    def pick(name: str, rows: DataFrame, *keys: Column) -> DataFrame:
        r = rows.select("question_id", "question_type", *[F.round(num(k), 6).alias(n) for n, k in zip(("first", "second", "third"), keys)])
        return r.orderBy(F.desc("first"), F.desc("second"), F.desc("third"), "question_id").limit(1).select(F.lit(name).alias("case"), "*")

    recall, lost = num(F.col("recall_all_5")), num(F.col("theirs"))
    out = pick("update", j.where(F.col("update") & ~wrong & (recall > lost)), recall - lost, F.col("mrr"), -lost)
    miss = F.col("skip_reason").isNull() & (recall < 1)
    out = out.unionByName(pick("error", j.where(wrong | miss), wrong.cast("double"), F.lit(1.0) - recall, F.lit(1.0) - num(F.col("mrr"))))
    if stale is not None:
        n = lambda m, name: stale.where(F.col("method_name") == m).select("question_id", F.col("stale").alias(name))
        s = j.join(n(method, "a"), "question_id", "left").join(n(other, "b"), "question_id", "left")
        gain = F.coalesce(F.col("ok") & ~F.col("their_ok"), F.lit(False)).cast("double")
        out = out.unionByName(pick("stale", s.where(F.col("update") & (num(F.col("b")) > num(F.col("a")))), num(F.col("b")) - num(F.col("a")), gain, recall))
    if archived is not None:
        a = j.join(archived, "question_id").where("archived > 0")
        out = out.unionByName(pick("archive", a, F.col("archived"), F.col("kept_out"), F.col("memories")))
    return out


def case_pages(chosen: DataFrame, samples: DataFrame, found: DataFrame, most: int = 5) -> str:
    """The chosen cases as Markdown: the question, its answer, and what each method found first. A handful of rows."""
    rows = chosen.join(samples.select("question_id", "question", F.array_join("answer", " / ").alias("answer")), "question_id").orderBy("case").collect()
    near = found.join(F.broadcast(chosen.select("question_id").distinct()), "question_id").where(F.col("rank_no") <= most).orderBy("question_id", "method_name", "rank_no").select("question_id", "method_name", "rank_no", "memory_id", F.substring("content", 1, 160).alias("content")).collect()
    parts = ["# Cases"]
    for r in rows:
        parts += [f"## {r['case']}: {r.question_id} ({r.question_type})", f"Question: {r.question}\n\nAnswer: {r.answer}"]
        parts += [f"{x.rank_no}. {x.method_name}, {x.memory_id}: {(x.content or '').strip()}" for x in near if x.question_id == r.question_id]
    return "\n\n".join(parts) + "\n"


def ablation_table(metrics: DataFrame) -> DataFrame:
    """metrics (ablation, ...) in the order of the ablations; all of them must be there."""
    names = list(T.ABLATIONS)
    missing = set(names) - {r.ablation for r in metrics.select("ablation").distinct().collect()}  # a row for each ablation
    if missing:
        raise ValueError(f"ablations are missing: {sorted(missing)}")
    return metrics.orderBy(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("ablation")))


def tune(rows: DataFrame, trials: int = 512, seed: int = 2025, data_sha256: str = "", split_id: str = "") -> tuple[T.TunedModel, DataFrame]:
    """(model of the winning trial, all trials): a search over rows as search.evaluate() takes them."""
    params = H.parameters(rows.sparkSession, trials, seed)
    found = H.select(H.summarise(H.evaluate(rows, params)))
    best = found.where("place = 1").join(params.drop("limit"), "trial").first()
    weights = dict.fromkeys(T.FEATURES, 0.0) | {f: best[f"w_{f}"] for f in H.SEARCHED}
    model = T.TunedModel(weights=weights, semantic_weight=best["semantic"], lexical_weight=best["lexical"], limit=best["limit"], protect=best["protect"], margin=best["margin"], superseded_penalty=best["penalty"], duplicate_penalty=H.DUPLICATE, data_sha256=data_sha256, split_id=split_id)
    return model, found


def whole(samples: DataFrame, memories: DataFrame, rows: DataFrame, members: DataFrame, folder: str, k: int = 10, trials: int = 512, seed: int = 2025, gate: bool = True) -> Path:
    """Tune on the dev split, hold the winner against the gate, and run it with the other rankers on the test split."""
    model, found = tune(rows, trials, seed)
    if gate and not found.where("place = 1").first()["gate"]:
        raise ValueError("no trial passes the gate")
    return run(scope(samples, members, "test"), memories, ["bm25", "dense", "tuned"], folder, k, model=model, split="test")

