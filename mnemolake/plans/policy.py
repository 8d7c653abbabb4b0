"""Queries over policy features, scores and decisions of memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import numbers as N
from mnemolake.functions import policy as P
from mnemolake.functions import text as X
from mnemolake.operators import lifecycle as L
from mnemolake.sources import tables as S

from . import sqltext as Q
from .registry import query

#: The moment features are computed for, and the policy type a stored memory type stands for.
NOW = "2026-01-01 00:00:00"
KIND = {"session": "episodic", "turn": "episodic", "fact": "semantic", "tool": "procedural", "summary": "reflective"}
_KIND = "(CASE " + " ".join(f"WHEN memory_type = '{k}' THEN '{v}'" for k, v in KIND.items()) + " ELSE 'episodic' END)"


def kind():
    out = F.lit("episodic")
    for k, v in KIND.items():
        out = F.when(F.col("memory_type") == k, v).otherwise(out)
    return out


def features(spark, d, block: int = L.BLOCK):
    """(memory_id and the policy features) of memories with content. Redundancy: the highest cosine to another vector of the question; for a
    memory without a usable vector the highest blended similarity to another memory of the question; 0 without a question. The target
    scope is that of the question's first memory.

    Texts and vectors move twice: to leave out later deliveries, and to their question. There each memory meets the question and the
    other memories, and only numbers go on.
    """
    now, at, text, place = F.lit(NOW).cast("timestamp"), F.coalesce("source_ts", "ingested_at"), F.col("content"), F.coalesce("scope", F.lit("global"))
    usable = {"usable": N.usable(F.col("content_embedding"), 64)}
    told = S.chunks(spark, d, told=text.isNotNull(), **usable).where("told and question_id is not null")
    per = told.groupBy("question_id").agg(L.parts(F.count("*"), block).alias("parts"), F.min_by(place, F.struct("ord", "memory_id")).alias("target"), F.bool_or(~F.col("usable")).alias("some"))
    m = S.chunks(spark, d, **usable).where("content is not null").withColumns({"kind": kind(), "embedding": F.when(F.col("usable"), F.col("content_embedding"))})
    m = m.select("memory_id", "question_id", "scope", "content", "kind", "importance", at.alias("at"), "embedding")
    spread = L.spread(m, per.select("question_id", "parts"))
    q = S.samples(spark, d).select("question_id", "question")
    asked = L.pairs_of_blocks(per.join(q, "question_id", "left"))
    m = spread.join(asked.select("question_id", "x", "y", "target", "question", "some"), ["question_id", "x", "y"], "left").withColumns({"recency": P.recency(F.col("kind"), F.col("at"), now), "target": F.coalesce("target", F.lit("")), "question": F.coalesce("question", F.lit(""))})
    m = m.withColumns({"terms": X.terms(text), "asks": X.terms(F.col("question"))}).withColumns({"n": F.size("terms"), "terms": F.array_distinct("terms"), "asks": F.array_distinct("asks")})  # columns of their own, else each use cuts the texts again
    common = X.jaccard(F.col("asks"), F.col("terms"))
    own = F.struct(  # not under a condition, where Spark computes equal parts of an expression again and again
        "scope", "kind", "recency", N.clamp01(F.coalesce("importance", X.importance(text, F.col("n")))).alias("importance"), P.stability(text, F.col("kind"), F.col("recency")).alias("stability"), P.staleness(text, F.lit("active"), F.col("recency")).alias("staleness"),
        P.actionability(text, F.col("kind"), F.col("n")).alias("actionability"), X.contains_any(text, X.CHANGE_WORDS).alias("changing"), P.scope_match(place, F.col("target")).alias("scope_match"), P.token_cost(text).alias("token_cost"), F.round(common, 9).alias("semantic_relevance"), P.risk(text).alias("privacy_risk"),
    )
    words = lambda c: F.when(F.col("some"), F.transform(c, lambda t: F.xxhash64(t)))
    m = m.select("question_id", "memory_id", "mine", "x", "y", own.alias("own"), "kind", "embedding", words(F.col("terms")).alias("words"), words(F.array_distinct(X.terms(place))).alias("places"))
    m = L.redundancy_within(m).groupBy("memory_id").agg(F.max("r").alias("r"), F.max(F.struct("question_id", "own")).alias("o")).select("memory_id", F.col("o.question_id").alias("question_id"), "o.own.*", F.round(F.coalesce("r", F.lit(0.0)), 5).alias("redundancy"))
    return m.withColumns({"confidence": F.lit(0.85), "novelty": F.lit(1.0) - F.col("redundancy"), "contradiction": P.contradicting(F.col("changing"), F.col("redundancy"), F.col("redundancy"))}).drop("changing")


_WORDED = lambda words, v: f"CASE WHEN {Q.words_any('content', words)} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"
_SIM = Q.jaccard(Q.distinct_terms("sc"), Q.distinct_terms("target"))
_FEATURES = f"""tg AS (SELECT question_id, arg_min(coalesce(scope, 'global'), (ord, memory_id)) AS target FROM {Q.CHUNKS} c WHERE content IS NOT NULL AND question_id IS NOT NULL GROUP BY 1),
v AS MATERIALIZED (SELECT question_id, memory_id, list_transform(content_embedding, lambda x: x::DOUBLE) AS e FROM {Q.CHUNKS} c WHERE content IS NOT NULL AND question_id IS NOT NULL AND {Q.usable('content_embedding')}),
bb AS MATERIALIZED (SELECT question_id, memory_id, {Q.distinct_terms('content')} AS w, {Q.distinct_terms("coalesce(scope, 'global')")} AS p, {_KIND} AS kind, NOT coalesce({Q.usable('content_embedding')}, FALSE) AS bare FROM {Q.CHUNKS} c WHERE content IS NOT NULL AND question_id IS NOT NULL),
rd AS (SELECT a.memory_id, round({Q.clamp('max(list_cosine_similarity(a.e, b.e))')}, 5) AS redundancy FROM v a LEFT JOIN v b ON a.question_id = b.question_id AND a.memory_id <> b.memory_id GROUP BY ALL
 UNION ALL SELECT a.memory_id, round({Q.clamp("max(0.8::DOUBLE * " + Q.jaccard("a.w", "b.w") + " + 0.1::DOUBLE * " + Q.jaccard("a.p", "b.p") + " + CASE WHEN a.kind = b.kind THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)")}, 5) FROM bb a LEFT JOIN bb b ON a.question_id = b.question_id AND a.memory_id <> b.memory_id WHERE a.bare GROUP BY ALL),
f0 AS (SELECT c.*, coalesce(rd.redundancy, 0.0::DOUBLE) AS redundancy, {_KIND} AS kind, coalesce(scope, 'global') AS sc, coalesce(source_ts, ingested_at)::TIMESTAMP AS tt, coalesce(target, '') AS target, coalesce(sq.question, '') AS question FROM {Q.CHUNKS} c LEFT JOIN rd USING (memory_id) LEFT JOIN tg USING (question_id) LEFT JOIN (SELECT question_id, question FROM {Q.SAMPLES} s) sq USING (question_id) WHERE content IS NOT NULL),
f1 AS (SELECT *, {Q.clamp("power(0.5::DOUBLE, " + Q.age(f"TIMESTAMP '{NOW}'", "tt") + " / " + Q.by_type("kind", P.HALF_LIFE) + ")")} AS recency FROM f0),
ft AS (SELECT memory_id, question_id, scope, kind, redundancy, recency, {Q.clamp(f"coalesce(importance, {Q.importance('content')})")} AS importance, 0.85::DOUBLE AS confidence, 1.0::DOUBLE - redundancy AS novelty,
 {Q.clamp(Q.by_type('kind', P.STABILITY) + f" - {_WORDED(X.TEMPORARY_WORDS, 0.25)} + 0.12::DOUBLE * (1.0::DOUBLE - recency)")} AS stability,
 {Q.clamp(f"greatest(1.0::DOUBLE - recency, {_WORDED(X.STALE_WORDS, 0.75)})")} AS staleness,
 {Q.clamp(Q.by_type('kind', P.ACTIONABILITY) + f" + {_WORDED(X.ACTION_WORDS, 0.25)} + CASE WHEN len({Q.terms('content')}) >= 12 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END")} AS actionability,
 CASE WHEN {Q.words_any('content', X.CHANGE_WORDS)} THEN CASE WHEN redundancy <= 0 THEN 0.0::DOUBLE ELSE {Q.clamp('0.45::DOUBLE + 0.45::DOUBLE * redundancy')} END ELSE {Q.clamp('0.1::DOUBLE * redundancy')} END AS contradiction,
 CASE WHEN target = '' THEN CASE WHEN sc = 'global' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END WHEN sc = target THEN 1.0::DOUBLE WHEN sc = 'global' OR target = 'global' THEN 0.65::DOUBLE WHEN starts_with(sc, target) OR starts_with(target, sc) THEN 0.85::DOUBLE ELSE {Q.clamp('0.25::DOUBLE + 0.5::DOUBLE * ' + _SIM)} END AS scope_match,
 {Q.clamp(Q.tokens('content') + ' / 2048.0::DOUBLE')} AS token_cost, round({Q.jaccard(Q.distinct_terms('question'), Q.distinct_terms('content'))}, 9) AS semantic_relevance, {Q.clamp(Q.privacy('content'))} AS privacy_risk FROM f1)"""
_NAMES = ("redundancy", "recency", "importance", "novelty", "stability", "staleness", "actionability", "contradiction", "scope_match", "token_cost", "semantic_relevance", "privacy_risk")


@query("policy_features", f"WITH {_FEATURES} SELECT memory_id, kind, " + ", ".join(f"round({n}, 5) AS {n}" for n in _NAMES) + " FROM ft")
def policy_features(spark, d):
    return features(spark, d).select("memory_id", "kind", *[F.round(n, 5).alias(n) for n in _NAMES])


@query("access_frequency", "SELECT user_id, count(*) AS uses, round(least(1.0::DOUBLE, ln(1 + count(*)) / ln(21.0::DOUBLE)), 6) AS frequency FROM events WHERE event_type = 'view' GROUP BY 1")
def access_frequency(spark, d):
    return S.table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("uses")).select("user_id", "uses", F.round(N.access_frequency(F.col("uses")), 6).alias("frequency"))


def contributions(spark, d):
    """(memory_id, access_frequency, success_contribution, failure_contribution): how often a memory was retrieved for answers, and the shares of
    those that were right and wrong.
    """
    from .evaluation import judged

    right = (F.col("exact_match") >= 1) | (F.col("abstention_accuracy") >= 1)
    told = judged(spark, d).select("method_name", "question_id", F.coalesce(right, F.lit(False)).cast("double").alias("right"))
    uses = S.retrieved(spark, d).where("memory_id is not null").select("method_name", "question_id", "memory_id").join(told, ["method_name", "question_id"])
    g = uses.groupBy("memory_id").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    return g.select("memory_id", P.uses(F.col("n")).alias("access_frequency"), (F.col("right") / F.col("n")).alias("success_contribution"), ((F.col("n") - F.col("right")) / F.col("n")).alias("failure_contribution"))


def inputs(spark, d, used: set[str] | None = None):
    """Features with the inputs that a decision adds: what became of the memory, similarity from redundancy, and whether it is superseded.
    used: names that are read, if not all; what takes a join and isn't among them is 0.
    """
    from .ranking import dated

    f = features(spark, d)
    told = ("access_frequency", "success_contribution", "failure_contribution")
    if used is None or used & set(told):
        f = f.join(contributions(spark, d), "memory_id", "left")
    if used is None or "superseded" in used:
        f = f.join(L.superseded(dated(spark, d), 0.55).select("memory_id", F.lit(1.0).alias("superseded")), "memory_id", "left")
    more = {k: F.coalesce(k, F.lit(0.0)) if k in f.columns else F.lit(0.0) for k in (*told, "superseded")} | {"source_priority": F.lit(0.8), "similarity": F.col("redundancy")}
    return f.withColumns(more).withColumn("information_density", P.information_density())


def _used_sql() -> str:
    from .evaluation import _QA

    return f"""{_QA}, us AS (SELECT memory_id, count(*) AS n, sum((coalesce(exact_match >= 1, FALSE) OR coalesce(abstention_accuracy >= 1, FALSE))::INT::DOUBLE) AS ok FROM (SELECT method_name, question_id, memory_id FROM {Q.RETRIEVED} r WHERE memory_id IS NOT NULL) JOIN qa USING (method_name, question_id) GROUP BY 1)"""


_DERIVED = {"agreement": "(1.0::DOUBLE - contradiction)", "unimportance": "(1.0::DOUBLE - importance)"}


def _inputs_sql() -> str:
    from .ranking import _SETS, _pairs

    sets = _SETS.replace("m AS MATERIALIZED", "mm AS MATERIALIZED")
    pairs = _pairs(0.55, "ps").replace("FROM m a JOIN m b", "FROM mm a JOIN mm b")
    return f"""{_FEATURES}, {_used_sql()}, {sets}, {pairs}, sup AS (SELECT DISTINCT a FROM ps WHERE ub AND tb > ta),
    i0 AS (SELECT ft.*, CASE WHEN us.n IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ln(1 + us.n) / ln(21.0::DOUBLE)) END AS access_frequency, coalesce(us.ok / us.n, 0.0::DOUBLE) AS success_contribution, coalesce((us.n - us.ok) / us.n, 0.0::DOUBLE) AS failure_contribution, 0.8::DOUBLE AS source_priority, redundancy AS similarity, (sup.a IS NOT NULL)::INT::DOUBLE AS superseded FROM ft LEFT JOIN us USING (memory_id) LEFT JOIN sup ON sup.a = ft.memory_id),
    inp AS (SELECT *, {Q.clamp('(importance + confidence + actionability + novelty) / 4.0::DOUBLE * (1.0::DOUBLE - 0.5::DOUBLE * redundancy)')} AS information_density FROM i0)"""


_INPUTS = _inputs_sql()


def _score_sql(name: str) -> str:
    return Q.clamp("0.0::DOUBLE" + "".join(f" + {w}::DOUBLE * {_DERIVED.get(k, k)}" for k, w in P.SCORES[name][0].items()))


def _decision_sql(name: str) -> str:
    gate = f" AND similarity >= {P.UPDATE_SIMILARITY}::DOUBLE AND contradiction >= {P.UPDATE_CONTRADICTION}::DOUBLE" if name == "update" else ""
    return f"CASE WHEN round({_score_sql(name)}, 9) >= {P.SCORES[name][1]}::DOUBLE{gate} THEN '{P.SCORES[name][2]}' ELSE 'IGNORE' END"


def _register(name: str) -> None:
    @query(f"score_{name}", f"WITH {_INPUTS} SELECT memory_id, round({_score_sql(name)}, 9) AS score, {_decision_sql(name)} AS decision FROM inp")
    def plan(spark, d):
        return inputs(spark, d, set(P.SCORES[name][0])).select("memory_id", F.round(P.score(name), 9).alias("score"), P.decision(name).alias("decision"))


for _name in P.SCORES:
    _register(_name)


@query("decision_counts", f"WITH {_INPUTS}, dc AS (SELECT kind, " + ", ".join(f"{_decision_sql(n)} AS d_{n}" for n in P.SCORES) + " FROM inp) SELECT kind, count(*) AS memories, " + ", ".join(f"count(*) FILTER (d_{n} <> 'IGNORE') AS n_{n}" for n in P.SCORES) + " FROM dc GROUP BY 1")
def decision_counts(spark, d):
    return inputs(spark, d).groupBy("kind").agg(F.count("*").alias("memories"), *[F.count_if(P.decision(n) != "IGNORE").alias(f"n_{n}") for n in P.SCORES])


@query("decision_reasons")
def decision_reasons(spark, d):
    """The wording of each write decision; formatting differs between engines, so there is no SQL."""
    return inputs(spark, d, set(P.SCORES["write"][0])).select("memory_id", P.reason("write").alias("reason"), F.array_join(P.top_contributors("write"), ",").alias("up"))


@query(
    "rule_ranker_topk",
    f"WITH {_INPUTS}, rr AS (SELECT question_id, memory_id, {_score_sql('retrieve')} AS admitted, round({_score_sql('retrieve')} + 0.2::DOUBLE * contradiction * recency + 0.1::DOUBLE * actionability * recency, 6) AS score FROM inp WHERE question_id IS NOT NULL) SELECT question_id, memory_id, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, memory_id)::BIGINT AS rank_no FROM rr WHERE round(admitted, 9) >= 0.05) WHERE rank_no <= 5",
)
def rule_ranker_topk(spark, d):
    """Admitted on the retrieve score, ranked by that score and a bonus for updates and actions."""
    from mnemolake.operators.ranking import top_k

    bonus = F.lit(0.2) * F.col("contradiction") * F.col("recency") + F.lit(0.1) * F.col("actionability") * F.col("recency")
    f = inputs(spark, d, set(P.SCORES["retrieve"][0])).where("question_id is not null").withColumn("admitted", P.score("retrieve")).where(P.passed("retrieve", F.col("admitted"))).withColumn("score", F.round(F.col("admitted") + bonus, 6))
    return top_k(f, 5, positive=False).select("question_id", "memory_id", F.col("rank_no").cast("bigint").alias("rank_no"))


_LISTED = ", ".join(f"{{'o': round(-({f}), 6), 'k': '{f}'}}" for f in P.FEATURES)


@query(
    "policy_explain",
    f"WITH {_INPUTS} SELECT memory_id, array_to_string(list_transform(list_sort([{_LISTED}])[1:3], lambda e: e.k), ',') AS top, round(sqrt({' + '.join(f'({f}) * ({f})' for f in P.FEATURES)}), 5) AS length FROM inp",
)
def policy_explain(spark, d):
    """The three strongest features of each memory, and the length of its policy vector."""
    f = inputs(spark, d).withColumn("policy_embedding", P.vector())
    return f.select("memory_id", F.array_join(P.explain(3), ",").alias("top"), F.round(N.norm(F.col("policy_embedding")), 5).alias("length"))


_NEXT = f"""nx AS (SELECT question_id, memory_id, lag(memory_id) OVER w AS before, coalesce(scope, 'global') AS sc, lag(coalesce(scope, 'global')) OVER w AS sc0, {_KIND} AS kind, lag({_KIND}) OVER w AS kind0, {Q.distinct_terms('content')} AS t, lag({Q.distinct_terms('content')}) OVER w AS t0
 FROM {Q.CHUNKS} c WHERE content IS NOT NULL AND question_id IS NOT NULL WINDOW w AS (PARTITION BY question_id ORDER BY ord, memory_id)),
ns AS (SELECT *, {Q.jaccard('t', 't0')} AS ct, {Q.jaccard(Q.distinct_terms('sc'), Q.distinct_terms('sc0'))} AS cs, CASE WHEN kind = kind0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS same FROM nx WHERE before IS NOT NULL),
nt AS (SELECT ns.*, {Q.clamp('0.8::DOUBLE * ct + 0.1::DOUBLE * cs + same')} AS blended, {Q.clamp('0.65::DOUBLE * ct + 0.25::DOUBLE * CASE WHEN sc = sc0 THEN 1.0::DOUBLE ELSE cs END + same')} AS stored, contradiction FROM ns JOIN ft USING (memory_id))"""


@query(
    "neighbour_similarity",
    f"WITH {_FEATURES}, {_NEXT} SELECT memory_id, before, round(blended, 6) AS blended, round(stored, 6) AS stored, round(CASE WHEN sc = sc0 AND contradiction >= {P.UPDATE_CONTRADICTION} THEN greatest(stored, 0.8::DOUBLE) ELSE stored END, 6) AS effective FROM nt",
)
def neighbour_similarity(spark, d):
    """How similar each memory is to the one before it in its question: by the features' measure, by the store's, and as an update would see it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("question_id").orderBy("ord", "memory_id")
    m = S.chunks(spark, d).where("content is not null and question_id is not null").select("question_id", "memory_id", "ord", F.coalesce("scope", F.lit("global")).alias("sc"), kind().alias("kind"), F.array_distinct(X.terms(F.col("content"))).alias("t"))
    names = ("memory_id", "sc", "kind", "t")
    m = m.withColumns({f"{c}0": F.lag(c).over(w) for c in names}).where("memory_id0 is not null").join(features(spark, d).select("memory_id", "contradiction"), "memory_id")
    words, same, alike = (lambda c: F.array_distinct(X.terms(F.col(c)))), F.col("sc") == F.col("sc0"), F.col("kind") == F.col("kind0")
    places = F.when(same, F.lit(1.0)).otherwise(X.jaccard(words("sc"), words("sc0")))
    stored = P.store_similarity(X.jaccard(F.col("t"), F.col("t0")), places, alike)
    blended = P.memory_similarity(F.col("t"), F.col("t0"), words("sc"), words("sc0"), alike)
    return m.select("memory_id", F.col("memory_id0").alias("before"), F.round(blended, 6).alias("blended"), F.round(stored, 6).alias("stored"), F.round(P.effective_similarity(stored, same, F.col("contradiction")), 6).alias("effective"))


@query("method_names", "SELECT DISTINCT replace(lower(trim(method_name)), '-', '_') AS method_name FROM retrieved WHERE method_name IS NOT NULL")
def method_names(spark, d):
    return S.table(spark, d, "retrieved").where("method_name is not null").select(X.adapter_name(F.col("method_name")).alias("method_name")).distinct()
