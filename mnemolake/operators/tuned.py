"""The tuned ranker: an anchor of dense and lexical scores, a bounded policy adjustment, lifecycle penalties, ablations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import numbers as N
from mnemolake.functions import text as X

from . import lifecycle as L
from . import ranking as R

FEATURES = ("semantic_relevance", "importance", "scope_match", "confidence", "success_contribution", "recency", "contradiction", "redundancy", "token_cost", "staleness", "update_signal", "action_signal")
# fixed values: the untrained weights, and what each ablation switches off
WEIGHTS = dict(zip(FEATURES, (0.0, 0.0, 0.0, 0.0, 0.0, 0.10, -0.05, -0.05, -0.05, -0.05, 0.20, 0.05)))
ABLATIONS = {
    "full": (None, None), "no_recency": ("recency", None), "no_contradiction": ("contradiction", None), "no_redundancy": ("redundancy", None), "no_importance": ("importance", None), "no_confidence": ("confidence", None),
    "no_token_cost": ("token_cost", None), "no_scope_match": ("scope_match", None), "no_update_operation": (None, "update"), "no_merge_operation": (None, "merge"), "no_archive_operation": (None, "archive"),
}
VERSION = "1.4"


@dataclass(frozen=True)
class TunedModel:
    """Parameters of a trained ranker with the data they were trained on."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    intercept: float = 0.0
    semantic_weight: float = 0.80
    lexical_weight: float = 0.20
    limit: float = 0.06
    pool: int = 20
    protect: int = 4
    margin: float = 0.02
    superseded_penalty: float = 0.03
    duplicate_penalty: float = 0.01
    duplicate_similarity: float = 0.98
    superseded_similarity: float = 0.55
    training_split: str = "dev"
    split_id: str = ""
    data_sha256: str = ""
    version: str = VERSION

    def __post_init__(self):
        if self.version != VERSION:
            raise ValueError("the model's version is obsolete; train it again")
        if self.training_split != "dev":
            raise ValueError("a ranker may be trained on the dev split only")
        if set(self.weights) != set(FEATURES):
            raise ValueError(f"weights must be those of {FEATURES}")
        if self.semantic_weight + self.lexical_weight <= 0 or not 4 <= self.protect <= 5:
            raise ValueError("an anchor weight must be positive, and 4 or 5 dense results protected")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TunedModel:
        return cls(**json.loads(text))

    def check_run(self, data_sha256: str, split: str) -> None:
        """Refuse other data than the model was trained on, and its training split."""
        if self.data_sha256 and self.data_sha256 != data_sha256:
            raise ValueError("the model was trained on other data")
        if split == self.training_split:
            raise ValueError("a model isn't evaluated on its training split")


def features(df: DataFrame) -> DataFrame:
    """df with the 12 features.

    df: question_id, memory_id, content, question, source_ts, question_ts, dense, redundancy, token_count. The memory belongs to
    the question, so the scope matches.
    """
    text = F.col("content")
    known = F.col("source_ts").isNotNull() & F.col("question_ts").isNotNull()
    recency = F.when(known, N.half_life(F.col("source_ts"), F.col("question_ts"), 14)).otherwise(F.lit(0.5))
    update = X.contains_any(text, X.UPDATE_WORDS, pad=True)
    action = F.lit(0.22) + F.when(X.contains_any(text, X.RANKER_ACTION_WORDS), 0.25).otherwise(0.0) + F.when(F.size(X.terms(text)) >= 12, 0.05).otherwise(0.0)
    stale = F.when(X.contains_any(text, X.RANKER_STALE_WORDS), 0.75).otherwise(0.0)
    return df.withColumns(
        {
            "semantic_relevance": F.col("dense"), "importance": X.importance(text), "scope_match": F.lit(1.0), "confidence": F.lit(0.85), "success_contribution": F.lit(0.0), "recency": recency,
            "contradiction": F.when(update, 0.9).otherwise(N.clamp01(F.lit(0.1) * F.col("redundancy"))), "token_cost": N.clamp01(F.coalesce("token_count", F.lit(0)) / F.lit(2048.0)),
            "staleness": F.greatest(F.lit(1.0) - recency, stale), "actionability": N.clamp01(action), "temporal": X.contains_any(F.col("question"), X.TEMPORAL_WORDS, pad=True),
        }
    )


def _value(name: str, off: Column, operation: Column) -> Column:
    """A feature's value under the ablation of a row; derived signals follow the features they are made of."""
    kept = lambda f: F.when(off.eqNullSafe(F.lit(f)), F.lit(0.0)).otherwise(F.col(f))
    if name == "update_signal":
        signal = kept("contradiction") * kept("recency")
        return F.when(F.col("temporal") & ~operation.eqNullSafe(F.lit("update")), signal).otherwise(F.lit(0.0))
    if name == "action_signal":
        return F.col("actionability") * kept("recency")
    return kept(name)


def score(model: TunedModel, off: Column | None = None, operation: Column | None = None) -> Column:
    """Anchor, plus the bounded adjustment, less the penalty of the row's lifecycle_status."""
    off = F.lit(None).cast("string") if off is None else off
    operation = F.lit(None).cast("string") if operation is None else operation
    raw = F.lit(model.intercept)
    for name in FEATURES:
        if model.weights[name]:
            raw = raw + F.lit(model.weights[name]) * _value(name, off, operation)
    status = F.col("lifecycle_status")
    archived = (status == "superseded") & ~operation.eqNullSafe(F.lit("archive"))
    merged = (status == "duplicate") & ~operation.eqNullSafe(F.lit("merge"))
    penalty = F.when(archived, model.superseded_penalty).when(merged, model.duplicate_penalty).otherwise(0.0)
    return F.round(N.clamp01(F.col("anchor") + F.lit(model.limit) * F.tanh(raw) - penalty), 9)


def ablations(df: DataFrame) -> DataFrame:
    """Each row once for every ablation, with the feature or operation that is off: a cross join with eleven rows."""
    rows = df.sparkSession.createDataFrame([(k, f, o) for k, (f, o) in ABLATIONS.items()], "ablation string, off string, operation string")
    return df.crossJoin(F.broadcast(rows))


def candidates(questions: DataFrame, memories: DataFrame, model: TunedModel) -> DataFrame:
    """The candidate pool of every question with the ranker's features and score.

    questions: question_id, question, question_date, query_vector; memories: question_id, memory_id, ord, content, source_date, token_count,
    embedding (null where there is none; those can't be candidates).
    """
    known = memories.where("embedding is not null")
    lexical = R.normalized_bm25(questions, memories).withColumnRenamed("score", "lx")
    j = R.dense(questions.select("question_id", "query_vector"), known).withColumnRenamed("score", "dense").join(lexical, ["question_id", "memory_id"], "left")
    anchor = R.anchor(F.col("dense"), F.coalesce("lx", F.lit(0.0)), model.semantic_weight, model.lexical_weight)
    pool = R.candidate_pool(j.withColumn("anchor", F.round(anchor, R.ROUND)), model.pool)
    red = L.redundancy(known.select("question_id", "memory_id", "embedding")).select("memory_id", F.round("redundancy", 5).alias("redundancy"))
    dated = memories.select("question_id", "memory_id", "ord", "content", N.parse_date(F.col("source_date")).alias("ts"))
    status = L.statuses(dated, model.duplicate_similarity, model.superseded_similarity).select("memory_id", "lifecycle_status")
    r = pool.join(questions.select("question_id", "question", "question_date"), "question_id").join(red, "memory_id").join(status, "memory_id")
    r = features(r.withColumn("source_ts", N.parse_date(F.col("source_date"))).withColumn("question_ts", N.parse_date(F.col("question_date"))))
    return r.withColumn("score", score(model))


def rank(questions: DataFrame, memories: DataFrame, model: TunedModel, k: int) -> DataFrame:
    """(question_id, memory_id, score, rank_no, dense_rank, model): the first k after the guarded rerank, with the model's version for audits."""
    out = R.guarded(candidates(questions, memories, model), k, model.margin, protect=model.protect)
    return out.select("question_id", "memory_id", "score", "rank_no", F.col("rd").alias("dense_rank"), F.lit(model.version).alias("model"))
