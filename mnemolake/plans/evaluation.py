"""Queries that evaluate retrieval and answers, and sum up cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import cost as C
from mnemolake.operators import metrics as M
from mnemolake.operators import splits as P
from mnemolake.operators.store import hydrate
from mnemolake.sources import tables as S

from . import sqltext as Q
from .registry import query

# ---------------------------------------------------------------- retrieval

_RS = f"""rs AS (SELECT method_name, question_id, list(source_session_id ORDER BY r, source_session_id) AS sessions FROM (
 SELECT method_name, question_id, source_session_id, min(rank_no) AS r FROM {Q.RETRIEVED} t WHERE source_session_id IS NOT NULL AND trim(source_session_id) <> '' GROUP BY ALL) GROUP BY ALL),
ev AS (SELECT method_name, rs.question_id, coalesce(question_type, 'unknown') AS question_type, sessions, list_distinct(answer_session_ids) AS gold FROM rs JOIN {Q.SAMPLES} s USING (question_id) WHERE NOT {Q.ABSTENTION} AND len(answer_session_ids) > 0)"""
_RS = _RS.replace("lower(question_id)", "lower(s.question_id)")


def _hits(k: int) -> str:
    return f"len(list_filter(sessions[1:{k}], lambda x: list_contains(gold, x)))"


def _dcg(k: int, standard: bool) -> str:
    w = "1.0::DOUBLE / log2(i + 1)" if standard else "CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / log2(i) END"
    got = f"coalesce(list_sum(list_transform(range(1, least(len(sessions), {k}) + 1), lambda i: CASE WHEN list_contains(gold, sessions[i]) THEN {w} ELSE 0.0::DOUBLE END)), 0.0::DOUBLE)"
    best = f"list_sum(list_transform(range(1, least(len(gold), {k}) + 1), lambda i: {w}))"
    return f"({got} / {best})"


def _metric_sql() -> dict[str, str]:
    out = {}
    for k in M.CUTS:
        out[f"recall_any_{k}"] = f"({_hits(k)} > 0)::INT::DOUBLE"
        out[f"recall_all_{k}"] = f"({_hits(k)} >= len(gold))::INT::DOUBLE"
        out[f"fractional_recall_{k}"] = f"{_hits(k)}::DOUBLE / len(gold)"
        out[f"ndcg_official_{k}"], out[f"ndcg_standard_{k}"] = _dcg(k, False), _dcg(k, True)
    out["precision_5"] = f"{_hits(5)} / 5.0::DOUBLE"
    first = "list_min(list_filter(range(1, len(sessions) + 1), lambda i: list_contains(gold, sessions[i])))"
    out["mrr"] = f"coalesce(1.0::DOUBLE / {first}, 0.0::DOUBLE)"
    return out


_MS = _metric_sql()


def evaluated(spark, d):
    """Ranked sessions of each method and question that has gold sessions and isn't an abstention question, with its metrics."""
    gold = S.samples(spark, d).where(~S.is_abstention() & (F.size("answer_session_ids") > 0)).select("question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), F.array_distinct("answer_session_ids").alias("gold"))
    return M.retrieval_metrics(M.ranked_sessions(S.retrieved(spark, d)).join(gold, "question_id"))


@query("ranked_sessions", f"WITH {_RS.split(', ev AS' if ', ev AS' in _RS else chr(10) + 'ev AS')[0].rstrip(',')} SELECT method_name, question_id, array_to_string(sessions, ' ') AS sessions FROM rs")
def ranked_sessions(spark, d):
    return M.ranked_sessions(S.retrieved(spark, d)).select("method_name", "question_id", F.array_join("sessions", " ").alias("sessions"))


@query("retrieval_metrics", f"WITH {_RS} SELECT method_name, question_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _MS.items()) + " FROM ev")
def retrieval_metrics(spark, d):
    return evaluated(spark, d).select("method_name", "question_id", *[F.round(m, 6).alias(m) for m in M.METRICS])


@query(
    "retrieval_summary",
    f"WITH {_RS}, em AS (SELECT method_name, question_type, " + ", ".join(f"{e} AS {n}" for n, e in _MS.items()) + " FROM ev) SELECT method_name, CASE WHEN grouping(question_type) = 1 THEN 'all' ELSE question_type END AS question_type, count(*) AS questions, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in _MS) + " FROM em GROUP BY GROUPING SETS ((method_name, question_type), (method_name))",
)
def retrieval_summary(spark, d):
    return M.with_total(evaluated(spark, d), ["method_name"], "question_type", F.count("*").alias("questions"), *[F.round(F.avg(m), 6).alias(m) for m in M.METRICS])


@query(
    "skipped_questions",
    f"SELECT question_id, CASE WHEN {Q.ABSTENTION} THEN 'abstention' WHEN coalesce(len(answer_session_ids), 0) = 0 THEN 'missing_gold' END AS skip_reason FROM {Q.SAMPLES} s",
)
def skipped_questions(spark, d):
    reason = F.when(S.is_abstention(), "abstention").when(F.coalesce(F.size("answer_session_ids"), F.lit(0)) <= 0, "missing_gold")
    return S.samples(spark, d).select("question_id", reason.alias("skip_reason"))


@query(
    "ablation_delta",
    f"WITH {_RS}, em AS (SELECT method_name, avg({_MS['recall_any_5']}) AS r, avg({_MS['mrr']}) AS m, avg({_MS['ndcg_standard_5']}) AS n FROM ev GROUP BY 1) SELECT a.method_name, round(a.r - b.r, 6) AS d_recall, round(a.m - b.m, 6) AS d_mrr, round(a.n - b.n, 6) AS d_ndcg FROM em a CROSS JOIN (SELECT * FROM em WHERE method_name = 'tuned_ranker') b",
)
def ablation_delta(spark, d):
    per = evaluated(spark, d).groupBy("method_name").agg(F.avg("recall_any_5").alias("r"), F.avg("mrr").alias("m"), F.avg("ndcg_standard_5").alias("n"))
    ref = F.broadcast(per.where("method_name = 'tuned_ranker'").select(*[F.col(c).alias(f"{c}0") for c in "rmn"]))  # one row
    return per.crossJoin(ref).select("method_name", *[F.round(F.col(c) - F.col(f"{c}0"), 6).alias(n) for c, n in (("r", "d_recall"), ("m", "d_mrr"), ("n", "d_ndcg"))])


@query("hydrate_join", f"SELECT method_name, question_id, r.memory_id, rank_no, round(1.0::DOUBLE - (row_number() OVER w - 1)::DOUBLE / count(*) OVER (PARTITION BY method_name, question_id), 6) AS rank_score FROM {Q.RETRIEVED} r JOIN (SELECT memory_id FROM {Q.CHUNKS} c) c USING (memory_id) WINDOW w AS (PARTITION BY method_name, question_id ORDER BY rank_no)")
def hydrate_join(spark, d):
    found, _ = hydrate(S.retrieved(spark, d).select("method_name", "question_id", "memory_id", "rank_no"), S.chunks(spark, d).select("memory_id"), "memory_id", "method_name", "question_id")
    return found.select("method_name", "question_id", "memory_id", "rank_no", "rank_score")


@query("missing_memories", f"SELECT DISTINCT method_name, memory_id FROM {Q.RETRIEVED} r WHERE memory_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.memory_id = r.memory_id)")
def missing_memories(spark, d):
    return S.retrieved(spark, d).where("memory_id is not null").select("method_name", "memory_id").distinct().join(S.table(spark, d, "chunks").select("memory_id"), "memory_id", "left_anti")


_TS = Q.parse_date("source_date")


@query("latest_provenance", f"SELECT memory_id, arg_max(source_session_id, (coalesce(epoch({_TS})::BIGINT, 0), source_session_id)) AS source_session_id FROM {Q.RETRIEVED} r WHERE memory_id IS NOT NULL AND source_session_id IS NOT NULL GROUP BY 1")
def latest_provenance(spark, d):
    from mnemolake.functions.numbers import parse_date

    at = F.coalesce(F.unix_timestamp(parse_date(F.col("source_date"))), F.lit(0))
    return S.retrieved(spark, d).where("memory_id is not null and source_session_id is not null").groupBy("memory_id").agg(F.max_by("source_session_id", F.struct(at, "source_session_id")).alias("source_session_id"))


_STALE = f"""gd AS (SELECT s.question_id, max({Q.parse_date('dt')}) AS newest FROM (SELECT question_id, answer_session_ids, unnest(haystack_session_ids) AS sid, unnest(haystack_dates) AS dt FROM {Q.SAMPLES} s) s WHERE list_contains(answer_session_ids, sid) GROUP BY 1),
rr AS (SELECT r.method_name, r.question_id, r.rank_no, {Q.distinct_terms('content')} AS w, coalesce(list_contains(s.answer_session_ids, r.source_session_id), FALSE) AS own, coalesce({_TS} < newest, FALSE) AS older FROM {Q.RETRIEVED} r JOIN {Q.SAMPLES} s USING (question_id) JOIN gd USING (question_id)),
gt AS (SELECT DISTINCT question_id, w AS g FROM rr WHERE own AND len(w) > 0),
nr AS (SELECT DISTINCT rr.method_name, rr.question_id, rr.rank_no FROM rr JOIN gt USING (question_id) WHERE NOT own AND older AND {Q.jaccard('w', 'g')} >= 0.10::DOUBLE),
st AS (SELECT rr.method_name, rr.question_id, count(*) AS retrieved, count(nr.rank_no) AS stale FROM rr LEFT JOIN nr USING (method_name, question_id, rank_no) GROUP BY ALL)"""
#: Least similarity of a stale memory to one of a gold session.
RELATED = 0.10


@query("stale_retrievals", f"WITH {_STALE} SELECT method_name, sum(retrieved)::BIGINT AS retrieved, sum(stale)::BIGINT AS stale, round(avg((stale > 0)::INT::DOUBLE), 6) AS stale_rate FROM st GROUP BY 1")
def stale_retrievals(spark, d):
    """Retrieved memories outside the gold sessions that are older than the newest gold session, and about the same as a retrieved gold memory."""
    from mnemolake.functions import text as X
    from mnemolake.functions.numbers import parse_date

    s = S.samples(spark, d)
    pairs = s.select("question_id", "answer_session_ids", F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates")).alias("z"))
    newest = pairs.where(F.array_contains("answer_session_ids", F.col("z.haystack_session_ids"))).groupBy("question_id").agg(F.max(parse_date(F.col("z.haystack_dates"))).alias("newest"))
    r = S.retrieved(spark, d).join(s.select("question_id", "answer_session_ids"), "question_id").join(newest, "question_id")
    own = F.coalesce(F.array_contains("answer_session_ids", F.col("source_session_id")), F.lit(False))
    r = r.select("method_name", "question_id", "rank_no", F.array_distinct(X.terms(F.col("content"))).alias("w"), own.alias("own"), F.coalesce(parse_date(F.col("source_date")) < F.col("newest"), F.lit(False)).alias("older"))
    gold = r.where("own and size(w) > 0").select("question_id", F.col("w").alias("g")).distinct()
    near = r.where("not own and older").join(gold, "question_id").where(X.jaccard(F.col("w"), F.col("g")) >= RELATED).select("method_name", "question_id", "rank_no", F.lit(1).alias("stale")).distinct()
    per = r.join(near, ["method_name", "question_id", "rank_no"], "left").groupBy("method_name", "question_id").agg(F.count("*").alias("n"), F.count("stale").alias("stale"))
    return per.groupBy("method_name").agg(F.sum("n").cast("bigint").alias("retrieved"), F.sum("stale").cast("bigint").alias("stale"), F.round(F.avg((F.col("stale") > 0).cast("double")), 6).alias("stale_rate"))


# ---------------------------------------------------------------- answers

_QA = f"""pr AS (SELECT output_id, question_id, method_name, question_type, abst, {Q.answer_tokens("coalesce(prediction, '')")} AS p, list_transform(golds, lambda g: {Q.answer_tokens("coalesce(g, '')")}) AS gs, {Q.abstains("coalesce(prediction, '')")} AS says, input_tokens, output_tokens, usage FROM (
 SELECT output_id, o.question_id, method_name, coalesce(question_type, 'unknown') AS question_type, o.answer AS prediction, s.answer AS golds, {Q.ABSTENTION.replace('lower(question_id)', 'lower(s.question_id)').replace('(answer,', '(s.answer,')} AS abst, input_tokens, output_tokens, usage FROM {Q.OUTPUTS} o JOIN {Q.SAMPLES} s USING (question_id) WHERE len(s.answer) > 0)),
qa AS (SELECT output_id, question_id, method_name, question_type, abst, input_tokens, output_tokens, usage,
 CASE WHEN NOT abst THEN list_max(list_transform(gs, lambda g: (array_to_string(g, ' ') = array_to_string(p, ' '))::INT::DOUBLE)) END AS exact_match,
 CASE WHEN NOT abst THEN list_max(list_transform(gs, lambda g: CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INT::DOUBLE ELSE coalesce(2.0::DOUBLE * nullif(coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0), 0) / (len(p) + len(g)), 0.0::DOUBLE) END)) END AS token_f1,
 CASE WHEN NOT abst THEN list_max(list_transform(gs, lambda g: CASE WHEN len(g) = 0 THEN (len(p) = 0)::INT::DOUBLE ELSE contains(' ' || array_to_string(p, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ')::INT::DOUBLE END)) END AS contains_answer,
 CASE WHEN abst THEN says::INT::DOUBLE END AS abstention_accuracy FROM pr)"""
QA = ("exact_match", "token_f1", "contains_answer", "abstention_accuracy")


def judged(spark, d):
    """Reader outputs with the gold answers of their sample and their metrics; samples without an answer are left out."""
    s = S.samples(spark, d).where(F.size("answer") > 0).select("question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), F.col("answer").alias("golds"), S.is_abstention().alias("abstention"))
    o = S.reader_outputs(spark, d).withColumnRenamed("answer", "prediction")
    return M.qa_metrics(o.join(s, "question_id"))


@query("qa_metrics", f"WITH {_QA} SELECT output_id, method_name, " + ", ".join(f"round({m}, 6) AS {m}" for m in QA) + " FROM qa")
def qa_metrics(spark, d):
    return judged(spark, d).select("output_id", "method_name", *[F.round(m, 6).alias(m) for m in QA])


@query("qa_summary", f"WITH {_QA} SELECT method_name, CASE WHEN grouping(question_type) = 1 THEN 'all' ELSE question_type END AS question_type, count(*) AS answers, count(*) FILTER (abst) AS abstentions, " + ", ".join(f"round(coalesce(avg({m}), 0.0), 6) AS {m}" for m in QA) + " FROM qa GROUP BY GROUPING SETS ((method_name, question_type), (method_name))")
def qa_summary(spark, d):
    return M.with_total(judged(spark, d), ["method_name"], "question_type", F.count("*").alias("answers"), F.count_if("abstention").alias("abstentions"), *[M.mean_or_zero(m).alias(m) for m in QA])


#: Methods that costs are held against, the first that is there.
REFERENCE = ("tuned_ranker", "rule_ranker", "dense")
_USED = {k: "list_sum(list_transform(list_filter(map_entries(usage), lambda e: lower(e.key) IN (" + ", ".join(f"'{n}'" for n in names) + ")), lambda e: greatest(0, e.value)))" for k, names in C.USAGE.items()}
_MEAN = lambda c: f"round(coalesce(avg({c}), 0.0), 6)"
_COST = f"""{_QA},
rq AS (SELECT method_name, question_id, count(*) AS memories, sum(coalesce(token_count, 0)) AS tokens, sum(coalesce(octet_length(encode(content)), 0)) AS bytes, count(DISTINCT memory_id) AS kept, min(retrieved_at) AS began FROM {Q.RETRIEVED} r GROUP BY ALL),
av AS (SELECT question_id, count(*) AS n FROM {Q.CHUNKS} c WHERE question_id IS NOT NULL GROUP BY 1),
cr AS (SELECT method_name, count(*) AS samples, {_MEAN('tokens')} AS mean_retrieved_tokens, sum(tokens)::BIGINT AS total_retrieved_tokens, {_MEAN('memories')} AS mean_memory_count, {_MEAN('bytes')} AS mean_storage_bytes, {_MEAN('bytes / 1048576.0::DOUBLE')} AS mean_storage_mb, {_MEAN('(bytes > 0)::INT::DOUBLE')} AS storage_coverage, {_MEAN('CASE WHEN n > 0 THEN kept / n::DOUBLE END')} AS retention_ratio FROM rq LEFT JOIN av USING (question_id) GROUP BY 1),
qq AS (SELECT qa.*, coalesce(exact_match >= 1, FALSE) OR coalesce(abstention_accuracy >= 1, FALSE) AS ok, {_USED['input']} AS ui, {_USED['output']} AS uo, {_USED['total']} AS ut, CASE WHEN began IS NOT NULL AND made IS NOT NULL THEN greatest(0.0::DOUBLE, (epoch_us(made) - epoch_us(began)) / 1000.0::DOUBLE) END AS ms FROM qa JOIN (SELECT output_id, created_at AS made FROM {Q.OUTPUTS} o) USING (output_id) LEFT JOIN rq USING (method_name, question_id)),
qu AS (SELECT *, CASE WHEN ui IS NOT NULL OR uo IS NOT NULL OR ut IS NOT NULL THEN coalesce(ut, coalesce(ui, 0) + coalesce(uo, 0)) END AS used FROM qq),
cq AS (SELECT method_name, count(*) AS qa_samples, count(*) FILTER (ok) AS correct_answers, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS local_accuracy, coalesce(sum(input_tokens), 0)::BIGINT AS total_input_tokens, {_MEAN('coalesce(input_tokens, 0)')} AS mean_input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS total_output_tokens, {_MEAN('coalesce(output_tokens, 0)')} AS mean_output_tokens, round(quantile_cont(coalesce(output_tokens, 0)::DOUBLE, 0.95), 6) AS p95_output_tokens,
 sum(coalesce(ui, 0)) FILTER (used IS NOT NULL)::BIGINT AS usage_input_tokens, sum(coalesce(uo, 0)) FILTER (used IS NOT NULL)::BIGINT AS usage_output_tokens, sum(used)::BIGINT AS usage_tokens, round(count(used) / count(*)::DOUBLE, 6) AS usage_coverage,
 {_MEAN('ms')} AS mean_end_to_end_ms, round(coalesce(quantile_cont(ms, 0.95), 0.0), 6) AS p95_end_to_end_ms, coalesce(sum(ms), 0.0) AS total_ms FROM qu GROUP BY 1),
cs AS (SELECT method_name, coalesce(samples, 0) AS samples, * EXCLUDE (method_name, samples, total_ms), total_input_tokens + total_output_tokens + coalesce(usage_tokens, 0) AS observed_tokens, round((total_input_tokens + total_output_tokens + coalesce(usage_tokens, 0))::DOUBLE / nullif(correct_answers, 0), 6) AS tokens_per_correct, round(total_ms / nullif(correct_answers, 0), 6) AS ms_per_correct FROM cq LEFT JOIN cr USING (method_name)),
rf AS (SELECT * FROM cs WHERE method_name IN ({', '.join(repr(m) for m in REFERENCE)}) ORDER BY list_position([{', '.join(repr(m) for m in REFERENCE)}], method_name) LIMIT 1)"""


@query(
    "cost_summary",
    f"WITH {_COST} SELECT cs.*, round(cs.mean_end_to_end_ms - rf.mean_end_to_end_ms, 6) AS delta_end_to_end_ms, round(cs.mean_input_tokens + cs.mean_output_tokens - rf.mean_input_tokens - rf.mean_output_tokens, 6) AS delta_reader_tokens, round(cs.mean_memory_count - rf.mean_memory_count, 6) AS delta_memory_count FROM cs LEFT JOIN rf ON TRUE",
)
def cost_summary(spark, d):
    """What each method's answers cost: tokens of evidence, reader and usage reports, time from retrieval to answer, storage, and all of it per correct answer."""
    right = (F.col("exact_match") >= 1) | (F.col("abstention_accuracy") >= 1)
    r = S.retrieved(spark, d)
    available = S.chunks(spark, d).where("question_id is not null").groupBy("question_id").agg(F.count("*").alias("available"))
    per = C.evidence(r).join(available, "question_id", "left")
    told = judged(spark, d).withColumn("correct", F.coalesce(right, F.lit(False))).join(per.select("method_name", "question_id", "began"), ["method_name", "question_id"], "left")
    ms = F.greatest(F.lit(0.0), (F.unix_micros("created_at") - F.unix_micros("began")) / F.lit(1000.0))
    return C.with_deltas(C.summary(per, told.withColumn("end_to_end_ms", F.when(F.col("began").isNotNull() & F.col("created_at").isNotNull(), ms)).withColumn("usage", F.to_json("usage"))), REFERENCE)


@query("resume_unanswered", f"SELECT question_id FROM {Q.SAMPLES} s WHERE NOT EXISTS (SELECT 1 FROM reader_outputs o WHERE o.question_id = s.question_id AND o.method_name = 'bm25')")
def resume_unanswered(spark, d):
    done = S.table(spark, d, "reader_outputs").where("method_name = 'bm25'").select("question_id")
    return S.samples(spark, d).select("question_id").join(done, "question_id", "left_anti")


@query("reader_identity", f"SELECT count(DISTINCT (coalesce(provider, ''), coalesce(model, ''))) AS readers, count(DISTINCT method_name) AS methods FROM {Q.OUTPUTS} o")
def reader_identity(spark, d):
    return S.reader_outputs(spark, d).agg(F.countDistinct(F.struct(F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit("")))).alias("readers"), F.countDistinct("method_name").alias("methods"))


@query("alignment", f"SELECT coalesce(a.method_name, b.method_name) AS method_name, count(*) FILTER (b.question_id IS NULL) AS only_retrieved, count(*) FILTER (a.question_id IS NULL) AS only_answered, count(*) FILTER (a.question_id IS NOT NULL AND b.question_id IS NOT NULL) AS aligned FROM (SELECT DISTINCT method_name, question_id FROM retrieved WHERE question_id IS NOT NULL AND method_name IS NOT NULL) a FULL JOIN (SELECT DISTINCT method_name, question_id FROM reader_outputs WHERE question_id IS NOT NULL AND method_name IS NOT NULL) b ON a.method_name = b.method_name AND a.question_id = b.question_id GROUP BY 1")
def alignment(spark, d):
    keys = ["method_name", "question_id"]
    known = lambda n: S.table(spark, d, n).select(*keys).dropna().distinct()
    a, b = known("retrieved").withColumn("x", F.lit(True)), known("reader_outputs").withColumn("y", F.lit(True))
    return a.join(b, keys, "full").groupBy("method_name").agg(F.count_if(F.col("y").isNull()).alias("only_retrieved"), F.count_if(F.col("x").isNull()).alias("only_answered"), F.count_if(F.col("x") & F.col("y")).alias("aligned"))


# ---------------------------------------------------------------- splits


@query("split_assignment", f"SELECT question_id, dataset_path, CASE WHEN row_number() OVER (PARTITION BY dataset_path ORDER BY sha256('42:' || question_id), question_id) <= 20 THEN 'dev' ELSE 'test' END AS split FROM {Q.SAMPLES} s")
def split_assignment(spark, d):
    return P.dev_test(S.samples(spark, d).select("question_id", "dataset_path"), 20, 42, group="dataset_path")


@query("fold_counts", f"SELECT (('0x' || substring(sha256('\"' || question_id || '\"'), 1, 8))::BIGINT % 5)::BIGINT AS fold, count(*) AS questions FROM {Q.SAMPLES} s GROUP BY 1")
def fold_counts(spark, d):
    return S.samples(spark, d).groupBy(P.fold("question_id").alias("fold")).agg(F.count("*").alias("questions"))


@query("split_type_counts", f"SELECT split, coalesce(question_type, 'unknown') AS question_type, count(*) AS questions FROM {Q.MEMBERS} m JOIN {Q.SAMPLES} s USING (question_id, dataset_path) GROUP BY ALL")
def split_type_counts(spark, d):
    return S.split_members(spark, d).join(S.samples(spark, d), ["question_id", "dataset_path"]).groupBy("split", F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("questions"))


@query("split_missing_ids", f"SELECT split_id, split, question_id FROM {Q.MEMBERS} m WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.question_id = m.question_id)")
def split_missing_ids(spark, d):
    return S.split_members(spark, d).select("split_id", "split", "question_id").join(S.table(spark, d, "samples").select("question_id"), "question_id", "left_anti")


@query("split_overlaps", f"SELECT question_id, count(DISTINCT split) AS n FROM {Q.MEMBERS} m GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_overlaps(spark, d):
    return P.overlapping(S.split_members(spark, d))


@query("split_digests", f"""SELECT split_id, sha256('["' || array_to_string(list_sort(list(DISTINCT question_id)), '","') || '"]') AS digest FROM {Q.MEMBERS} m GROUP BY 1""")
def split_digests(spark, d):
    return P.ids_digest(S.split_members(spark, d), "split_id")


_FOLD = "('0x' || substring(sha256('\"' || question_id || '\"'), 1, 8))::BIGINT % 5"


@query(
    "fold_stability",
    f"WITH {_RS}, e AS (SELECT method_name, question_type, {_FOLD} AS fold, {_MS['recall_any_5']} AS value FROM ev), t AS (SELECT method_name, round(avg(v), 6) AS macro_type, round(min(v), 6) AS worst_type FROM (SELECT method_name, question_type, avg(value) AS v FROM e GROUP BY ALL) GROUP BY 1), f AS (SELECT method_name, round(min(v), 6) AS lowest_fold, round(stddev_pop(v), 6) AS fold_stddev FROM (SELECT method_name, fold, avg(value) AS v FROM e GROUP BY ALL) GROUP BY 1) SELECT * FROM t JOIN f USING (method_name)",
)
def fold_stability(spark, d):
    return M.stability(evaluated(spark, d).select("method_name", "question_type", P.fold("question_id").alias("fold"), F.col("recall_any_5").alias("value")))
