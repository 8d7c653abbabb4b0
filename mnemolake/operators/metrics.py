"""Retrieval and answer metrics, and their aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.text import answer_tokens, contains_sequence, is_abstention_answer, token_f1

CUTS = (1, 3, 5, 10)


def ranked_sessions(retrieved: DataFrame) -> DataFrame:
    """(method_name, question_id, sessions): the sessions of the retrieved memories, each at its first rank; null and empty ones dropped."""
    rows = retrieved.where("source_session_id is not null and trim(source_session_id) <> ''").groupBy("method_name", "question_id", "source_session_id").agg(F.min("rank_no").alias("r"))
    return rows.groupBy("method_name", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source_session_id"))), lambda s: s["source_session_id"]).alias("sessions"))


def _gain(relevant: Column, standard: bool) -> Column:
    """DCG of an array of 0.0 / 1.0. Standard: 1 / log2(rank + 1); official: the first undiscounted, then 1 / log2(rank)."""
    if standard:
        parts = F.transform(relevant, lambda r, i: r / F.log2((i + 2).cast("double")))
    else:
        parts = F.transform(relevant, lambda r, i: F.when(i == 0, r).otherwise(r / F.log2(F.greatest(i + 1, F.lit(2)).cast("double"))))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """ranked (sessions array, gold array, not empty) with recall_any/all, fractional recall and NDCGs at 1, 3, 5, 10, precision@5, MRR."""
    gold = F.array_distinct("gold")
    hits = F.transform("sessions", lambda s: F.array_contains(gold, s).cast("double"))
    ranked = ranked.withColumn("_gold", gold).withColumn("_hits", hits)
    out = {}
    n = F.size("_gold")
    for k in CUTS:
        found = F.aggregate(F.slice("_hits", 1, k), F.lit(0.0), lambda acc, x: acc + x)
        ideal = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(k))), lambda i: F.lit(1.0))
        out[f"recall_any_{k}"] = (found > 0).cast("double")
        out[f"recall_all_{k}"] = (found >= n).cast("double")
        out[f"fractional_recall_{k}"] = found / n
        out[f"ndcg_official_{k}"] = _gain(F.slice("_hits", 1, k), False) / _gain(ideal, False)
        out[f"ndcg_standard_{k}"] = _gain(F.slice("_hits", 1, k), True) / _gain(ideal, True)
    out["precision_5"] = F.aggregate(F.slice("_hits", 1, 5), F.lit(0.0), lambda acc, x: acc + x) / 5.0
    first = F.array_position("_hits", F.lit(1.0))
    out["mrr"] = F.when(first > 0, F.lit(1.0) / first).otherwise(F.lit(0.0))
    return ranked.withColumns(out).drop("_gold", "_hits")


METRICS = tuple(f"{m}_{k}" for k in CUTS for m in ("recall_any", "recall_all", "fractional_recall", "ndcg_official", "ndcg_standard")) + ("precision_5", "mrr")


def qa_metrics(pairs: DataFrame) -> DataFrame:
    """pairs (prediction, golds array<string>, abstention) with exact match, token F1 and containment (the best over the golds) of
    answerable ones, and abstention_accuracy of the others; a null prediction is an empty one.
    """
    said = answer_tokens(F.coalesce(F.col("prediction"), F.lit("")))
    pairs = pairs.withColumn("_p", said).withColumn("_g", F.transform("golds", lambda g: answer_tokens(F.coalesce(g, F.lit("")))))
    open_ = ~F.col("abstention")
    best = lambda f: F.when(open_, F.array_max(F.transform("_g", f)))
    return pairs.withColumns(
        {
            "exact_match": best(lambda g: (F.array_join(g, " ") == F.array_join("_p", " ")).cast("double")),
            "token_f1": best(lambda g: token_f1(F.col("_p"), g)),
            "contains_answer": best(lambda g: contains_sequence(F.col("_p"), g)),
            "abstention_accuracy": F.when(~open_, is_abstention_answer(F.coalesce(F.col("prediction"), F.lit(""))).cast("double")),
        }
    ).drop("_p", "_g")


def mean_or_zero(c: str) -> Column:
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)


def with_total(df: DataFrame, keys: list[str], last: str, *aggregates: Column) -> DataFrame:
    """One pass over both (keys) and (keys, last): rows of the total have 'all' as last."""
    every = [F.col(k) for k in [*keys, last]]
    out = df.groupingSets([every, every[:-1]], *every).agg(*aggregates, F.grouping(last).alias("_g"))
    return out.withColumn(last, F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col(last))).drop("_g")


def latency(c: str) -> list[Column]:
    return [F.round(F.percentile(c, F.lit(p)), 6).alias(f"{c}_p{round(p * 100)}") for p in (0.5, 0.95)]


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def stability(folds: DataFrame) -> DataFrame:
    """(method_name, macro, worst, lowest_fold, fold_stddev) of folds (method_name, question_type, fold, value)."""
    types = folds.groupBy("method_name", "question_type").agg(F.avg("value").alias("v")).groupBy("method_name").agg(F.round(F.avg("v"), 6).alias("macro_type"), F.round(F.min("v"), 6).alias("worst_type"))
    per = folds.groupBy("method_name", "fold").agg(F.avg("value").alias("v")).groupBy("method_name").agg(F.round(F.min("v"), 6).alias("lowest_fold"), F.round(F.stddev_pop("v"), 6).alias("fold_stddev"))
    return types.join(per, "method_name")


