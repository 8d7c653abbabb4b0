"""Random search over the tuned ranker's parameters: every trial over every training question in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions.numbers import clamp01

from . import learned as N
from . import ranking as R

#: Features whose range in the search isn't zero.
SEARCHED = tuple(k for k, r in N.RANGES.items() if r != (0.0, 0.0))
PARAMETERS = ("semantic", "lexical", "limit", "penalty", "margin")
METRICS = ("recall_all_5", "mrr", "head_kept", "token_cost", "stale_rate", "conflict_rate")
#: Penalty of duplicates, which isn't searched; evidence that counts as read; tokens that evidence may have.
DUPLICATE, READ, BUDGET = 0.01, 5, 2048


def parameter_rows(trials: int, seed: int) -> list[tuple]:
    """(trial, protect, PARAMETERS, SEARCHED) of each trial."""
    return [(t["trial"], t["protect"], *(float(t[k]) for k in PARAMETERS), *(float(t["weights"][k]) for k in SEARCHED)) for t in N.trials(trials, seed)]


def parameters(spark: SparkSession, trials: int, seed: int) -> DataFrame:
    kinds = ["trial int", "protect int", *(f"{k} double" for k in PARAMETERS), *(f"w_{k} double" for k in SEARCHED)]
    return spark.createDataFrame(parameter_rows(trials, seed), ", ".join(kinds))


def evaluate(rows: DataFrame, params: DataFrame, keep: int = 10) -> DataFrame:
    """(trial, limit, question_id, question_type, fold, METRICS) of each trial and question.

    rows: question_id, question_type, fold, gold (array of sessions), newest_gold, memory_id, ord, session, source_ts, token_count, dense,
    lexical, lifecycle_status, and the searched features. Only rows that may be among the first `keep` by dense can be
    retrieved, so the others are dropped before rows meet the trials (broadcast; a few hundred). Rows are dealt by
    question first, which serves every window and group of a trial.
    """
    first = F.rank().over(Window.partitionBy("question_id").orderBy(F.desc("dense")))
    some = rows.repartition("question_id").withColumn("_first", first).where(F.col("_first") <= keep).drop("_first")
    j = some.crossJoin(F.broadcast(params))
    anchor = F.round(clamp01((F.col("semantic") * clamp01(F.col("dense")) + F.col("lexical") * clamp01(F.col("lx"))) / (F.col("semantic") + F.col("lexical"))), R.ROUND)
    raw = F.lit(0.0)
    for name in SEARCHED:
        raw = raw + F.col(f"w_{name}") * F.col(name)
    status = F.col("lifecycle_status")
    penalty = F.when(status == "superseded", F.col("penalty")).when(status == "duplicate", F.lit(DUPLICATE)).otherwise(F.lit(0.0))
    j = j.withColumn("anchor", anchor).withColumn("score", F.round(clamp01(F.col("anchor") + F.col("limit") * F.tanh(raw) - penalty), R.ROUND))
    older = F.coalesce(F.col("source_ts") < F.col("newest_gold"), F.lit(False))
    own = F.coalesce(F.array_contains("gold", F.col("session")), F.lit(False))
    stale = ~own & older & F.contains(F.lower("question_type"), F.lit("update"))
    j = j.withColumn("stale", stale.cast("int")).withColumn("clash", (stale & (F.col("contradiction") >= 0.45)).cast("int"))
    ranked = R.guarded(j, keep, F.col("margin"), READ, F.col("protect"), keep, ("trial", "question_id"))
    listed = F.array_sort(F.collect_list(F.struct("rank_no", "rd", "session", "token_count", "stale", "clash")))
    g = ranked.groupBy("trial", "limit", "question_id", "question_type", "fold", "gold").agg(listed.alias("r"))
    read = F.slice("r", 1, READ)
    total = lambda f: F.aggregate(F.transform(read, lambda x: x[f].cast("double")), F.lit(0.0), lambda a, x: a + x)
    sessions = F.array_distinct(F.filter(F.transform("r", lambda x: x["session"]), lambda s: s.isNotNull() & (F.trim(s) != "")))
    g = g.withColumn("sessions", sessions)
    place = F.array_position(F.transform("sessions", lambda s: F.array_contains("gold", s)), True)
    return g.select(
        "trial", "limit", "question_id", "question_type", "fold", (F.size(F.array_intersect(F.slice("sessions", 1, 5), "gold")) >= F.size("gold")).cast("double").alias("recall_all_5"),
        F.when(place > 0, F.lit(1.0) / place).otherwise(F.lit(0.0)).alias("mrr"), (F.size(F.filter(read, lambda x: x["rd"] <= READ)) / F.least(F.lit(READ), F.size("r"))).alias("head_kept"),
        F.least(F.lit(1.0), total("token_count") / F.lit(float(BUDGET))).alias("token_cost"), (total("stale") / F.size(read)).alias("stale_rate"), (total("clash") / F.size(read)).alias("conflict_rate"),
    )


def summarise(per: DataFrame) -> DataFrame:
    """(trial, limit, METRICS, macro_type, worst_type, min_fold, fold_stddev, objective) of each trial: means over questions, over types, over folds."""
    cells = per.groupBy("trial", "limit", "question_type", "fold").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in METRICS])
    every = cells.groupBy("trial", "limit").agg(*[(F.sum(m) / F.sum("n")).alias(m) for m in METRICS])
    mean = F.sum("recall_all_5") / F.sum("n")
    types = cells.groupBy("trial", "question_type").agg(mean.alias("v")).groupBy("trial").agg(F.avg("v").alias("macro_type"), F.min("v").alias("worst_type"))
    folds = cells.groupBy("trial", "fold").agg(mean.alias("v")).groupBy("trial").agg(F.min("v").alias("min_fold"), F.stddev_pop("v").alias("fold_stddev"))
    out = every.join(types, "trial").join(folds, "trial")
    out = out.withColumns({c: F.round(c, 6) for c in (*METRICS, "macro_type", "worst_type", "min_fold", "fold_stddev")})
    return out.withColumn("objective", F.round(N.objective({k: F.col(k) for k in N.OBJECTIVE}), 6))


def select(summary: DataFrame, least_recall: float = 0.90) -> DataFrame:
    """summary with robust, gate and place, 1 for the trial to be used.

    Trial 0 (dense alone) is what others are held against. Robust: no worse than it in recall and over types, at most 0.03 worse in
    the worst type. Gate: what a frozen ranker must reach. Order: gate, robust, recall, macro, lowest fold, steadiness,
    objective, reciprocal rank, the smaller limit, the earlier trial.
    """
    base = F.broadcast(summary.where("trial = 0").select(F.col("recall_all_5").alias("_r"), F.col("macro_type").alias("_m"), F.col("worst_type").alias("_w")))  # one row
    gain, macro, worst = F.col("recall_all_5") - F.col("_r"), F.col("macro_type") - F.col("_m"), F.col("worst_type") - F.col("_w")
    near = lambda c, least: F.round(c, 6) >= least
    robust = near(gain, 0.0) & near(macro, 0.0) & near(worst, -0.03)
    gate = (F.col("recall_all_5") >= least_recall) & near(gain, 0.02) & near(macro, 0.0) & near(worst, -0.03) & (F.col("fold_stddev") <= 0.20)
    out = summary.crossJoin(base).withColumn("robust", robust).withColumn("gate", gate).drop("_r", "_m", "_w")
    order = [F.desc(c) for c in ("gate", "robust", "recall_all_5", "macro_type", "min_fold")] + [F.asc("fold_stddev"), F.desc("objective"), F.desc("mrr"), F.asc("limit"), F.asc("trial")]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # a row for each trial
