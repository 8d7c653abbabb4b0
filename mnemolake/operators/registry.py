"""Rankers by name: a ranker takes questions and memories and returns (question_id, memory_id, score), or rank_no too if it orders them itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import numbers as N
from mnemolake.functions import policy as P
from mnemolake.functions import text as X

from . import lifecycle as L
from . import ranking as R
from . import tuned as T

Ranker = Callable[[DataFrame, DataFrame], DataFrame]


class Registry:
    """Names and aliases; case and hyphens don't count."""

    def __init__(self):
        self._rankers: dict[str, Ranker] = {}
        self._aliases: dict[str, str] = {}

    @staticmethod
    def normal(name: str) -> str:
        return name.strip().casefold().replace("-", "_")

    def add(self, name: str, ranker: Ranker, *aliases: str) -> None:
        name = self.normal(name)
        if name in self._rankers:
            raise ValueError(f"ranker {name} exists")
        self._rankers[name] = ranker
        self._aliases |= {self.normal(a): name for a in aliases}

    def names(self) -> list[str]:
        return sorted(self._rankers)

    def rank(self, name: str, questions: DataFrame, memories: DataFrame, k: int) -> DataFrame:
        key = self.normal(name)
        key = self._aliases.get(key, key)
        if key not in self._rankers:
            raise KeyError(f"unknown ranker {name}; there are {', '.join(self.names())}")
        found = self._rankers[key](questions, memories)
        return found.where(F.col("rank_no") <= k) if "rank_no" in found.columns else R.top_k(found, k)


def _dense(questions: DataFrame, memories: DataFrame) -> DataFrame:
    return R.dense(questions.select("question_id", "query_vector"), memories.where("embedding is not null"))


def _recent(questions: DataFrame, memories: DataFrame) -> DataFrame:
    j = _dense(questions, memories).join(questions.select("question_id", "question_date"), "question_id")
    then, now = N.parse_date(F.col("source_date")), N.parse_date(F.col("question_date"))
    recent = F.when(then.isNull() | now.isNull(), F.lit(0.5)).otherwise(N.recency(then, now))
    return j.withColumn("score", R.blend(F.col("score"), recent)).select("question_id", "memory_id", "score")


def _important(questions: DataFrame, memories: DataFrame) -> DataFrame:
    weight = F.coalesce("importance", X.importance(F.col("content")))
    return _dense(questions, memories).withColumn("score", R.blend(F.col("score"), weight)).select("question_id", "memory_id", "score")


def _ruled(questions: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories as episodic ones of the question's own scope: admitted on the retrieve score, ranked by it and a bonus for changes and actions."""
    every = memories.select("question_id", "memory_id", "content", "source_date", "importance", F.lit("").alias("scope"), F.lit("episodic").alias("kind"), F.lit(True).alias("bare"))
    red = L.blended_redundancy(every).select("memory_id", "redundancy")
    j = every.join(red, "memory_id").join(questions.select("question_id", "question", "question_date"), "question_id")
    text, now = F.col("content"), F.coalesce(N.parse_date(F.col("question_date")), F.current_timestamp())
    j = j.withColumn("recency", P.recency(F.col("kind"), N.parse_date(F.col("source_date")), now))
    j = j.withColumns(
        {
            "semantic_relevance": X.jaccard(F.array_distinct(X.terms(F.col("question"))), F.array_distinct(X.terms(text))), "importance": F.coalesce("importance", X.importance(text)), "scope_match": F.lit(1.0), "confidence": F.lit(0.85),
            "success_contribution": F.lit(0.0), "contradiction": P.contradiction(text, F.col("redundancy"), F.col("redundancy")), "token_cost": P.token_cost(text), "actionability": P.actionability(text, F.col("kind")),
        }
    )
    bonus = F.lit(0.2) * F.col("contradiction") * F.col("recency") + F.lit(0.1) * F.col("actionability") * F.col("recency")
    admitted = j.withColumn("admitted", P.score("retrieve")).where(P.passed("retrieve", F.col("admitted")))
    return admitted.select("question_id", "memory_id", F.round(F.col("admitted") + bonus, R.ROUND).alias("score"))


def _anchored(questions: DataFrame, memories: DataFrame) -> DataFrame:
    lexical = R.normalized_bm25(questions, memories).withColumnRenamed("score", "lx")
    j = _dense(questions, memories).join(lexical, ["question_id", "memory_id"], "left")
    return j.select("question_id", "memory_id", F.round(R.anchor(F.col("score"), F.coalesce("lx", F.lit(0.0))), R.ROUND).alias("score"))


def default_registry(model: T.TunedModel | None = None, depth: int = 10) -> Registry:
    """All built-in rankers.

    questions: question_id, question, and for dense rankers question_date and query_vector; memories: question_id, memory_id, content, and for
    them ord, source_date, importance, token_count and embedding (null where there is none).
    """
    r, model = Registry(), model or T.TunedModel()
    none = lambda q, m: m.select("question_id", "memory_id", F.lit(0.0).alias("score")).limit(0)
    r.add("empty", none, "no_memory")
    r.add("bm25", R.bm25, "lexical")
    r.add("tf_cosine", R.tf_cosine, "naive_vector", "vector_rag")
    r.add("dense", lambda q, m: _dense(q, m).select("question_id", "memory_id", "score"), "vector")
    r.add("dense_recency", _recent, "recency", "vector_recency")
    r.add("dense_importance", _important, "importance", "vector_importance")
    r.add("hybrid", _anchored, "anchor")
    r.add("rule", _ruled, "rule_ranker", "rule_policy")
    r.add("tuned", lambda q, m: T.rank(q, m, model, depth), "tuned_ranker")
    return r


def register_functions(spark: SparkSession) -> list[str]:
    """The scalar functions that SQL lacks, under mem_ names, as SQL functions of the session."""
    found = {
        "mem_casefold": "(t STRING) RETURNS STRING RETURN replace(lower(t), 'ß', 'ss')",
        "mem_terms": r"(t STRING) RETURNS ARRAY<STRING> RETURN coalesce(regexp_extract_all(replace(lower(t), 'ß', 'ss'), '[\\p{L}\\p{N}_-]+', 0), array())",
        "mem_cosine": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) AND size(a) > 0 THEN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D) ELSE 0D END",
        "mem_jaccard": "(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
        "mem_half_life": "(age_days DOUBLE, days DOUBLE) RETURNS DOUBLE RETURN power(0.5D, age_days / days)",
    }
    for name, body in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(found)
