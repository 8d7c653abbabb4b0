"""Queries of the tuned ranker and its ablations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions import text as X
from mnemolake.operators import metrics as M
from mnemolake.operators import ranking as R
from mnemolake.operators import search as H
from mnemolake.operators import tuned as T
from mnemolake.operators.learned import OBJECTIVE
from mnemolake.operators.splits import fold
from mnemolake.sources import tables as S

from . import ranking as P
from . import sqltext as Q
from .registry import query

MODEL = T.TunedModel()


def rows(spark, d):
    """The candidate pool of every question with the ranker's features and score."""
    return T.candidates(P.asked(spark, d), P.held(spark, d), MODEL)


_W = {k: v for k, v in MODEL.weights.items() if v}
_RAW = {
    "recency": "rec", "contradiction": "con", "redundancy": "redundancy", "token_cost": Q.clamp("coalesce(token_count, 0) / 2048.0::DOUBLE"), "staleness": "stl",
    "update_signal": "CASE WHEN ti THEN con * rec ELSE 0.0::DOUBLE END", "action_signal": "act * rec",
}
_SQL = f"""{P._ANCHOR}, {P._POOL}, {P._SETS.replace('m AS MATERIALIZED', 'mm AS MATERIALIZED')}, {P._pairs(0.55, 'ps').replace('FROM m a JOIN m b', 'FROM mm a JOIN mm b')}, {P._pairs(0.98, 'pd').replace('FROM m a JOIN m b', 'FROM mm a JOIN mm b')},
sup AS (SELECT DISTINCT a FROM ps WHERE ub AND tb > ta), dup AS (SELECT DISTINCT a FROM pd WHERE (ob, b) < (oa, a)),
red AS (SELECT a.memory_id, round({Q.clamp(f"max({Q.cosine('a.embedding', 'b.embedding')})")}, 5) AS redundancy FROM v a LEFT JOIN v b ON a.question_id = b.question_id AND a.memory_id <> b.memory_id GROUP BY ALL),
t0 AS (SELECT po.*, q.question, c.token_count, red.redundancy, {Q.parse_date('po.source_date')} AS s, {Q.parse_date('q.question_date')} AS n, CASE WHEN sup.a IS NOT NULL THEN 0.03::DOUBLE WHEN dup.a IS NOT NULL THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS pen
 FROM po JOIN {P._Q} q USING (question_id) JOIN (SELECT memory_id, token_count FROM {Q.CHUNKS} c) c USING (memory_id) JOIN red USING (memory_id) LEFT JOIN sup ON sup.a = po.memory_id LEFT JOIN dup ON dup.a = po.memory_id),
t1 AS (SELECT *, CASE WHEN s IS NULL OR n IS NULL THEN 0.5::DOUBLE ELSE power(0.5::DOUBLE, {Q.age('n', 's')} / 14.0::DOUBLE) END AS rec, CASE WHEN {Q.words_any('content', X.UPDATE_WORDS, True)} THEN 0.9::DOUBLE ELSE {Q.clamp('0.1::DOUBLE * redundancy')} END AS con,
 {Q.words_any('question', X.TEMPORAL_WORDS, True)} AS ti, 0.22::DOUBLE + CASE WHEN {Q.words_any('content', X.RANKER_ACTION_WORDS)} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len({Q.terms('content')}) >= 12 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS act FROM t0),
t2 AS (SELECT *, greatest(1.0::DOUBLE - rec, CASE WHEN {Q.words_any('content', X.RANKER_STALE_WORDS)} THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END) AS stl FROM t1),
t3 AS (SELECT *, round({Q.clamp("anchor + 0.06::DOUBLE * tanh(0.0::DOUBLE" + "".join(f" + {w}::DOUBLE * {_RAW[k]}" for k, w in _W.items()) + ") - pen")}, 9) AS score FROM t2)"""


@query("tuned_scores", f"WITH {_SQL} SELECT question_id, memory_id, round(score, 6) AS score, pen > 0 AS penalised FROM t3")
def tuned_scores(spark, d):
    return rows(spark, d).select("question_id", "memory_id", F.round(T.score(MODEL), 6).alias("score"), (F.col("lifecycle_status") != "active").alias("penalised"))


@query("guarded_rerank", f"WITH {_SQL}, {P.guard_sql('t3')} SELECT question_id, memory_id, round(score, 6) AS score, rank_no::BIGINT AS rank_no, rd::BIGINT AS dense_rank FROM g6 WHERE rank_no <= 10")
def guarded_rerank(spark, d):
    scored = rows(spark, d).withColumn("score", T.score(MODEL))
    return P._out(R.guarded(scored, P.K, MODEL.margin, protect=MODEL.protect), F.col("rd").cast("bigint").alias("dense_rank"))


def _kept(name: str, table: dict[str, str]) -> str:
    return f"CASE WHEN off = '{name}' THEN 0.0::DOUBLE ELSE {table[name]} END"


_OFF = {k: f"({_kept(k, _RAW)})" for k in _RAW if not k.endswith("_signal")}
_OFF |= {"update_signal": f"(CASE WHEN ti AND op IS DISTINCT FROM 'update' THEN {_OFF['contradiction']} * {_OFF['recency']} ELSE 0.0::DOUBLE END)", "action_signal": f"(act * {_OFF['recency']})"}
_ABLATED = ", ".join(f"('{k}', {repr(f) if f else 'NULL'}, {repr(o) if o else 'NULL'})" for k, (f, o) in T.ABLATIONS.items())
_GOLD = f"SELECT question_id, list_distinct(answer_session_ids) AS gold FROM {Q.SAMPLES} s WHERE NOT {Q.ABSTENTION} AND len(answer_session_ids) > 0"


@query(
    "tuned_ablations",
    f"""WITH {_SQL}, ab(ablation, off, op) AS (VALUES {_ABLATED}),
    ta AS (SELECT ablation, question_id, memory_id, ord, dense, anchor, round({Q.clamp("anchor + 0.06::DOUBLE * tanh(0.0::DOUBLE" + "".join(f" + {w}::DOUBLE * {_OFF[k]}" for k, w in _W.items()) + ") - CASE WHEN pen = 0.03::DOUBLE AND op IS NOT DISTINCT FROM 'archive' OR pen = 0.01::DOUBLE AND op IS NOT DISTINCT FROM 'merge' THEN 0.0::DOUBLE ELSE pen END")}, 9) AS score FROM t2 CROSS JOIN ab),
    {P.guard_sql('ta', 'ablation, question_id')},
    hs AS (SELECT ablation, question_id, source_session_id AS sid, min(rank_no) AS r FROM g6 JOIN (SELECT memory_id, source_session_id FROM {Q.CHUNKS} c) c USING (memory_id) WHERE rank_no <= 10 AND trim(source_session_id) <> '' GROUP BY ALL),
    ls AS (SELECT ablation, question_id, list(sid ORDER BY r, sid) AS ss FROM hs GROUP BY ALL),
    me AS (SELECT ablation, (len(list_intersect(ss[1:5], gold)) >= len(gold))::INT::DOUBLE AS ra, len(list_intersect(ss[1:5], gold)) / 5.0::DOUBLE AS p5, coalesce(1.0::DOUBLE / list_min(list_filter(range(1, len(ss) + 1), lambda i: list_contains(gold, ss[i]))), 0.0::DOUBLE) AS rr FROM ls JOIN ({_GOLD}) g USING (question_id)),
    av AS (SELECT ablation, avg(ra) AS a, avg(p5) AS p, avg(rr) AS m FROM me GROUP BY 1)
    SELECT x.ablation, round(x.a, 6) AS recall_all_5, round(x.p, 6) AS precision_5, round(x.m, 6) AS mrr, round(x.a - f.a, 6) AS d_recall_all_5, round(x.p - f.p, 6) AS d_precision_5, round(x.m - f.m, 6) AS d_mrr FROM av x CROSS JOIN (SELECT * FROM av WHERE ablation = 'full') f""",
)
def tuned_ablations(spark, d):
    """Recall, precision and reciprocal rank of every ablation after the guarded rerank, less those of the full ranker."""
    scored = T.ablations(rows(spark, d)).withColumn("score", T.score(MODEL, F.col("off"), F.col("operation")))
    ranked = R.guarded(scored, P.K, MODEL.margin, protect=MODEL.protect, by=("ablation", "question_id"))
    hits = ranked.where("source_session_id is not null").select(F.col("ablation").alias("method_name"), "question_id", "source_session_id", "rank_no")
    gold = S.samples(spark, d).where(~S.is_abstention() & (F.size("answer_session_ids") > 0)).select("question_id", F.array_distinct("answer_session_ids").alias("gold"))
    m = M.retrieval_metrics(M.ranked_sessions(hits).join(gold, "question_id")).groupBy("method_name").agg(*[F.avg(c).alias(c) for c in ("recall_all_5", "precision_5", "mrr")])
    ref = F.broadcast(m.where("method_name = 'full'").select(*[F.col(c).alias(f"_{c}") for c in ("recall_all_5", "precision_5", "mrr")]))  # one row
    return m.crossJoin(ref).select(F.col("method_name").alias("ablation"), *[F.round(F.col(c), 6).alias(c) for c in ("recall_all_5", "precision_5", "mrr")], *[F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"d_{c}") for c in ("recall_all_5", "precision_5", "mrr")])


#: Trials of the search and the seed of their draws.
TRIALS, SEED = 512, 2025


def tuning_rows(spark, d):
    """Memories of the dev questions that can be evaluated, with what the search needs of them."""
    dev = S.split_members(spark, d).where("split = 'dev'").select("dataset_path", "question_id").distinct()
    s = S.samples(spark, d).where(~S.is_abstention() & (F.size("answer_session_ids") > 0)).join(dev, ["dataset_path", "question_id"], "left_semi")
    s = s.select("question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), F.array_distinct("answer_session_ids").alias("gold"), fold("question_id").alias("fold"))
    r = rows(spark, d).drop("question_type", "score").join(s, "question_id").withColumnRenamed("source_session_id", "session")
    r = r.withColumn("update_signal", T._value("update_signal", F.lit(None).cast("string"), F.lit(None).cast("string"))).withColumn("action_signal", T._value("action_signal", F.lit(None).cast("string"), F.lit(None).cast("string")))
    newest = F.max(F.when(F.array_contains("gold", F.col("session")), F.col("source_ts"))).over(Window.partitionBy("question_id"))
    keep = ("question_id", "question_type", "fold", "gold", "memory_id", "ord", "session", "source_ts", "dense", "lx", "lifecycle_status", *[f for f in H.SEARCHED])
    return r.withColumn("newest_gold", newest).select(*keep, "newest_gold", F.coalesce("token_count", F.lit(0)).alias("token_count"))


_PARAMS = ", ".join(f"({r[0]}, {r[1]}, {', '.join(f'{v!r}::DOUBLE' for v in r[2:])})" for r in H.parameter_rows(TRIALS, SEED))
_DEV = f"SELECT DISTINCT question_id FROM {Q.MEMBERS} x WHERE split = 'dev' AND dataset_path = s.dataset_path"
_CELLS = ", ".join(f"avg({m}) AS {m}" for m in H.METRICS)


@query(
    "tuning_trials",
    f"""WITH {_SQL}, pr(trial, protect, semantic, lexical, lim, penalty, margin, {', '.join('w_' + k for k in H.SEARCHED)}) AS (VALUES {_PARAMS}),
    ex AS (SELECT question_id, coalesce(question_type, 'unknown') AS question_type, list_distinct(answer_session_ids) AS gold, ('0x' || substring(sha256('"' || question_id || '"'), 1, 8))::BIGINT % 5 AS fold FROM {Q.SAMPLES} s WHERE NOT {Q.ABSTENTION} AND len(answer_session_ids) > 0 AND question_id IN ({_DEV})),
    u0 AS (SELECT t2.question_id, question_type, fold, gold, memory_id, ord, source_session_id AS session, s AS source_ts, coalesce(token_count, 0) AS token_count, dense, lx, pen, con AS contradiction, {', '.join(f'{_RAW[k]} AS f_{k}' for k in H.SEARCHED)} FROM t2 JOIN ex USING (question_id) JOIN (SELECT memory_id, source_session_id FROM {Q.CHUNKS} c) c USING (memory_id)),
    u1 AS (SELECT *, max(CASE WHEN list_contains(gold, session) THEN source_ts END) OVER (PARTITION BY question_id) AS newest, rank() OVER (PARTITION BY question_id ORDER BY dense DESC) AS fd FROM u0),
    u2 AS (SELECT *, round({Q.clamp('(semantic * ' + Q.clamp('dense') + ' + lexical * ' + Q.clamp('lx') + ') / (semantic + lexical)')}, 9) AS anchor FROM u1 CROSS JOIN pr WHERE fd <= 10),
    u3 AS (SELECT *, round({Q.clamp('anchor + lim * tanh(0.0::DOUBLE' + ''.join(f' + w_{k} * f_{k}' for k in H.SEARCHED) + ') - CASE WHEN pen = 0.03::DOUBLE THEN penalty WHEN pen = 0.01::DOUBLE THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END')}, 9) AS score,
      NOT coalesce(list_contains(gold, session), FALSE) AND coalesce(source_ts < newest, FALSE) AND contains(lower(question_type), 'update') AS stale FROM u2),
    {P.guard_sql('u3', 'trial, question_id', 'margin', 'protect')},
    u4 AS (SELECT trial, lim, question_id, question_type, fold, any_value(gold) AS gold, list(session ORDER BY rank_no) FILTER (trim(session) <> '') AS ss, least(1.0::DOUBLE, coalesce(sum(token_count) FILTER (rank_no <= 5), 0) / 2048.0::DOUBLE) AS token_cost,
      count(*) FILTER (rank_no <= 5 AND rd <= 5)::DOUBLE / least(5, count(*)) AS head_kept, count(*) FILTER (rank_no <= 5 AND stale)::DOUBLE / least(5, count(*)) AS stale_rate, count(*) FILTER (rank_no <= 5 AND stale AND contradiction >= 0.45)::DOUBLE / least(5, count(*)) AS conflict_rate FROM g6 WHERE rank_no <= 10 GROUP BY trial, lim, question_id, question_type, fold),
    u5 AS (SELECT *, list_filter(coalesce(ss, []), lambda x, i: list_position(ss, x) = i) AS us FROM u4),
    u6 AS (SELECT *, (len(list_intersect(us[1:5], gold)) >= len(gold))::INT::DOUBLE AS recall_all_5, coalesce(1.0::DOUBLE / list_min(list_filter(range(1, len(us) + 1), lambda i: list_contains(gold, us[i]))), 0.0::DOUBLE) AS mrr FROM u5),
    u7 AS (SELECT * FROM (SELECT trial, lim, {_CELLS} FROM u6 GROUP BY ALL) JOIN (SELECT trial, avg(v) AS macro_type, min(v) AS worst_type FROM (SELECT trial, question_type, avg(recall_all_5) AS v FROM u6 GROUP BY ALL) GROUP BY 1) USING (trial) JOIN (SELECT trial, min(v) AS min_fold, stddev_pop(v) AS fold_stddev FROM (SELECT trial, fold, avg(recall_all_5) AS v FROM u6 GROUP BY ALL) GROUP BY 1) USING (trial)),
    u8 AS (SELECT trial, lim, {', '.join(f'round({m}, 6) AS {m}' for m in (*H.METRICS, 'macro_type', 'worst_type', 'min_fold', 'fold_stddev'))} FROM u7),
    u9 AS (SELECT *, round(0.0::DOUBLE{''.join(f' + {w}::DOUBLE * {k}' for k, w in OBJECTIVE.items())}, 6) AS objective FROM u8),
    ua AS (SELECT u9.*, round(u9.recall_all_5 - b.recall_all_5, 6) >= 0.0 AND round(u9.macro_type - b.macro_type, 6) >= 0.0 AND round(u9.worst_type - b.worst_type, 6) >= -0.03 AS robust,
      u9.recall_all_5 >= 0.90 AND round(u9.recall_all_5 - b.recall_all_5, 6) >= 0.02 AND round(u9.macro_type - b.macro_type, 6) >= 0.0 AND round(u9.worst_type - b.worst_type, 6) >= -0.03 AND u9.fold_stddev <= 0.20 AS gate FROM u9 CROSS JOIN (SELECT * FROM u9 WHERE trial = 0) b)
    SELECT trial, {', '.join((*H.METRICS, 'macro_type', 'worst_type', 'min_fold', 'fold_stddev', 'objective', 'robust', 'gate'))}, row_number() OVER (ORDER BY gate DESC, robust DESC, recall_all_5 DESC, macro_type DESC, min_fold DESC, fold_stddev, objective DESC, mrr DESC, lim, trial)::BIGINT AS place FROM ua""",
)
def tuning_trials(spark, d):
    """All trials of the search on the dev questions, over five folds; place 1 is the winner."""
    found = H.select(H.summarise(H.evaluate(tuning_rows(spark, d), H.parameters(spark, TRIALS, SEED))))
    return found.select("trial", *H.METRICS, "macro_type", "worst_type", "min_fold", "fold_stddev", "objective", "robust", "gate", "place")


@query(
    "dense_ceilings",
    f"""WITH {P._DENSE}, g AS (SELECT question_id, list_distinct(answer_session_ids) AS gold FROM {Q.SAMPLES} s WHERE NOT {Q.ABSTENTION} AND len(answer_session_ids) > 0),
    k AS (SELECT dn.question_id, gold, source_session_id, row_number() OVER (PARTITION BY dn.question_id ORDER BY score DESC, ord, memory_id) AS rd FROM dn JOIN g USING (question_id) JOIN (SELECT memory_id, source_session_id FROM {Q.CHUNKS} c) c USING (memory_id))
    SELECT count(DISTINCT question_id) AS questions, round(avg(a5), 6) AS recall_all_5, round(avg(a10), 6) AS recall_all_10 FROM (SELECT question_id, (count(DISTINCT source_session_id) FILTER (rd <= 5 AND list_contains(gold, source_session_id)) = len(any_value(gold)))::INT AS a5, (count(DISTINCT source_session_id) FILTER (rd <= 10 AND list_contains(gold, source_session_id)) = len(any_value(gold)))::INT AS a10 FROM k GROUP BY 1)""",
)
def dense_ceilings(spark, d):
    """How many questions have all gold sessions among the first 5 and 10 dense results: what a guarded rerank can reach."""
    gold = S.samples(spark, d).where(~S.is_abstention() & (F.size("answer_session_ids") > 0)).select("question_id", F.array_distinct("answer_session_ids").alias("gold"))
    j = P.dense(spark, d).join(gold, "question_id").join(S.chunks(spark, d).select("memory_id", "source_session_id"), "memory_id")
    rd = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ord", "memory_id"))
    j = j.withColumn("rd", rd).withColumn("hit", F.array_contains("gold", F.col("source_session_id")))
    all_in = lambda k: (F.countDistinct(F.when((F.col("rd") <= k) & F.col("hit"), F.col("source_session_id"))) == F.first(F.size("gold"))).cast("int")
    return j.groupBy("question_id").agg(all_in(5).alias("a5"), all_in(10).alias("a10")).agg(F.count("*").alias("questions"), F.round(F.avg("a5"), 6).alias("recall_all_5"), F.round(F.avg("a10"), 6).alias("recall_all_10"))
