"""All rankers over all questions by name, evaluated against the gold sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import metrics as M
from mnemolake.operators.registry import default_registry
from mnemolake.sources import tables as S

from . import evaluation as E
from . import ranking as P
from . import sqltext as Q
from . import tuned  # noqa: F401  # registers guarded_rerank
from .registry import SQL, query

#: Rankers and the query that ranks alike.
METHODS = {"bm25": "bm25_topk", "tf_cosine": "tf_cosine_topk", "dense": "dense_topk", "dense_recency": "dense_recency_topk", "dense_importance": "dense_importance_topk", "tuned": "guarded_rerank"}


_RANKED = " UNION ALL ".join(f"SELECT '{m}' AS method_name, question_id, memory_id, rank_no FROM ({SQL[q]})" for m, q in METHODS.items())
_HITS = f"""rk AS ({_RANKED}), rs AS (SELECT method_name, question_id, list(sid ORDER BY r, sid) AS sessions FROM (SELECT method_name, question_id, source_session_id AS sid, min(rank_no) AS r FROM rk JOIN (SELECT memory_id, source_session_id FROM {Q.CHUNKS} c) c USING (memory_id) WHERE trim(source_session_id) <> '' GROUP BY ALL) GROUP BY ALL)"""
_EV = E._RS[E._RS.index("ev AS") :]


@query(
    "runner_summary",
    f"WITH {_HITS}, {_EV}, em AS (SELECT method_name, question_type, " + ", ".join(f"{e} AS {n}" for n, e in E._MS.items()) + " FROM ev) SELECT method_name, CASE WHEN grouping(question_type) = 1 THEN 'all' ELSE question_type END AS question_type, count(*) AS questions, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in E._MS) + " FROM em GROUP BY GROUPING SETS ((method_name, question_type), (method_name))",
)
def runner_summary(spark, d):
    """The experiment runner's retrieval over the registered rankers, by method and question type."""
    from .experiment import evaluate, retrieve

    found = retrieve(P.asked(spark, d), P.held(spark, d), list(METHODS), P.K, default_registry())
    per = evaluate(found, S.samples(spark, d)).where("skip_reason is null")
    return M.with_total(per, ["method_name"], "question_type", F.count("*").alias("questions"), *[F.round(F.avg(m), 6).alias(m) for m in M.METRICS])
