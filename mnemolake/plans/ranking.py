"""Queries that rank memories for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import numbers as N
from mnemolake.functions import text as X
from mnemolake.operators import lifecycle as L
from mnemolake.operators import ranking as R
from mnemolake.sources import tables as S

from . import sqltext as Q
from .registry import query

K = 10
_Q = f"(SELECT question_id, question, question_date FROM {Q.SAMPLES} s)"
_M = f"(SELECT * FROM {Q.CHUNKS} c WHERE content IS NOT NULL AND question_id IS NOT NULL)"


def questions(spark, d):
    return S.samples(spark, d).select("question_id", "question", "question_date")


def memories(spark, d):
    return S.chunks(spark, d).where("content is not null and question_id is not null")


def _bm25(floor: bool) -> str:
    length = "greatest(avg_terms, 1.0::DOUBLE)" if floor else "avg_terms"
    return f"""q AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({Q.terms('question')}) AS term FROM {_Q}) GROUP BY ALL),
    m AS MATERIALIZED (SELECT question_id, memory_id, len({Q.terms('content')}) AS n_terms, {Q.terms('content')} AS ts FROM {_M}),
    st AS (SELECT question_id, count(*) AS n, avg(n_terms) AS avg_terms FROM m GROUP BY 1),
    tf AS (SELECT question_id, memory_id, n_terms, term, count(*) AS tf FROM (SELECT question_id, memory_id, n_terms, unnest(ts) AS term FROM m) GROUP BY ALL),
    hit AS (SELECT tf.*, times FROM tf JOIN q USING (question_id, term)),
    df AS (SELECT question_id, term, count(*) AS df FROM hit GROUP BY ALL),
    bm AS (SELECT question_id, memory_id, round(sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms / {length})) * times), 9) AS score
      FROM hit JOIN df USING (question_id, term) JOIN st USING (question_id) GROUP BY ALL)"""


def _top(source: str, extra: str = "", order: str = "score DESC, memory_id") -> str:
    return f"SELECT question_id, memory_id, round(score, 6) AS score, rank_no{extra} FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order})::BIGINT AS rank_no FROM {source}) WHERE rank_no <= {K} AND score > 0"


def _out(df, *extra):
    return df.select("question_id", "memory_id", F.round("score", 6).alias("score"), F.col("rank_no").cast("bigint").alias("rank_no"), *extra)


@query("bm25_topk", f"WITH {_bm25(False)} {_top('bm')}")
def bm25_topk(spark, d):
    return _out(R.top_k(R.bm25(questions(spark, d), memories(spark, d)), K))


@query("bm25_normalized", f"WITH {_bm25(True)}, nb AS (SELECT question_id, memory_id, CASE WHEN max(score) OVER (PARTITION BY question_id) > 0 THEN round(score / max(score) OVER (PARTITION BY question_id), 9) ELSE 0.0 END AS score FROM bm) SELECT question_id, memory_id, round(score, 6) AS score FROM nb")
def bm25_normalized(spark, d):
    return R.normalized_bm25(questions(spark, d), memories(spark, d)).select("question_id", "memory_id", F.round("score", 6).alias("score"))


_COS = f"""q AS (SELECT question_id, term, count(*) AS tf FROM (SELECT question_id, unnest({Q.terms('question')}) AS term FROM {_Q}) GROUP BY ALL),
m AS (SELECT question_id, memory_id, term, count(*) AS tf FROM (SELECT question_id, memory_id, unnest({Q.terms('content')}) AS term FROM {_M}) GROUP BY ALL),
qn AS (SELECT question_id, sqrt(sum(tf * tf)) AS qn FROM q GROUP BY 1), mn AS (SELECT question_id, memory_id, sqrt(sum(tf * tf)) AS mn FROM m GROUP BY ALL),
tc AS (SELECT question_id, memory_id, round(least(1.0::DOUBLE, dot / (qn * mn)), 9) AS score FROM (SELECT m.question_id, memory_id, sum(m.tf * q.tf)::DOUBLE AS dot FROM m JOIN q USING (question_id, term) GROUP BY ALL) JOIN mn USING (question_id, memory_id) JOIN qn USING (question_id))"""


@query("tf_cosine_topk", f"WITH {_COS} {_top('tc')}")
def tf_cosine_topk(spark, d):
    return _out(R.top_k(R.tf_cosine(questions(spark, d), memories(spark, d)), K))


_V = f"(SELECT question_id, memory_id, ord, content, source_date, importance, list_transform(content_embedding, lambda x: x::DOUBLE) AS embedding FROM {_M} WHERE {Q.usable('content_embedding')})"
_DENSE = f"""v AS MATERIALIZED {_V}, qv AS (SELECT question_id, embedding AS qe FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ord, memory_id) AS r FROM v) WHERE r = 1),
dn AS (SELECT v.* EXCLUDE (embedding), round({Q.clamp(Q.cosine('qe', 'embedding'))}, 9) AS score FROM v JOIN qv USING (question_id))"""


def vectors(spark, d):
    """Memories with a usable vector, as doubles."""
    v = F.col("content_embedding")
    return memories(spark, d).where(N.usable(v, 64)).select("question_id", "memory_id", "ord", "content", "source_date", "importance", N.doubles(v).alias("embedding"))


def query_vectors(spark, d):
    """The vector a question is asked with: that of its first memory (questions carry none of their own)."""
    first = F.min_by("embedding", F.struct("ord", "memory_id"))
    return vectors(spark, d).groupBy("question_id").agg(first.alias("query_vector"))


def dense(spark, d):
    return R.dense(query_vectors(spark, d), vectors(spark, d))


def asked(spark, d):
    """Questions as rankers take them."""
    return questions(spark, d).join(query_vectors(spark, d), "question_id", "left")


def held(spark, d):
    """Memories as rankers take them: the vector is null where it can't be used."""
    v = F.col("content_embedding")
    return memories(spark, d).withColumn("embedding", F.when(N.usable(v, 64), N.doubles(v)))


@query("dense_topk", f"WITH {_DENSE} {_top('dn')}")
def dense_topk(spark, d):
    return _out(R.top_k(dense(spark, d), K))


_AGE = Q.age("n", "s")
_DR = f"dr AS (SELECT question_id, memory_id, round(0.75::DOUBLE * score + 0.25::DOUBLE * CASE WHEN s IS NULL OR n IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + {_AGE} / 30.0::DOUBLE) END, 9) AS score FROM (SELECT dn.*, {Q.parse_date('source_date')} AS s, {Q.parse_date('question_date')} AS n FROM dn JOIN {_Q} q USING (question_id)))"


@query("dense_recency_topk", f"WITH {_DENSE}, {_DR} {_top('dr')}")
def dense_recency_topk(spark, d):
    j = dense(spark, d).join(questions(spark, d), "question_id")
    s, n = N.parse_date(F.col("source_date")), N.parse_date(F.col("question_date"))
    recent = F.when(s.isNull() | n.isNull(), F.lit(0.5)).otherwise(N.recency(s, n))
    return _out(R.top_k(j.withColumn("score", R.blend(F.col("score"), recent)), K))


@query("dense_importance_topk", f"WITH {_DENSE}, di AS (SELECT question_id, memory_id, round(0.75::DOUBLE * score + 0.25::DOUBLE * coalesce(importance, {Q.importance('content')}), 9) AS score FROM dn) {_top('di')}")
def dense_importance_topk(spark, d):
    weight = F.coalesce("importance", X.importance(F.col("content")))
    return _out(R.top_k(dense(spark, d).withColumn("score", R.blend(F.col("score"), weight)), K))


_ANCHOR = f"{_bm25(True)}, nb AS (SELECT question_id, memory_id, CASE WHEN max(score) OVER (PARTITION BY question_id) > 0 THEN round(score / max(score) OVER (PARTITION BY question_id), 9) ELSE 0.0 END AS lx FROM bm), {_DENSE}, an AS (SELECT dn.question_id, memory_id, ord, content, source_date, score AS dense, coalesce(lx, 0.0) AS lx, round(least(1.0::DOUBLE, 0.8::DOUBLE * score + 0.2::DOUBLE * coalesce(lx, 0.0)), 9) AS anchor FROM dn LEFT JOIN nb USING (question_id, memory_id))"


def anchored(spark, d):
    """Memories with a vector: dense, lexical and anchor score."""
    lexical = R.normalized_bm25(questions(spark, d), memories(spark, d)).withColumnRenamed("score", "lx")
    j = dense(spark, d).withColumnRenamed("score", "dense").join(lexical, ["question_id", "memory_id"], "left")
    return j.withColumn("lx", F.coalesce("lx", F.lit(0.0))).withColumn("anchor", F.round(R.anchor(F.col("dense"), F.col("lx")), R.ROUND))


@query("anchor_scores", f"WITH {_ANCHOR} SELECT question_id, memory_id, round(dense, 6) AS dense, round(lx, 6) AS lexical, round(anchor, 6) AS anchor FROM an")
def anchor_scores(spark, d):
    return anchored(spark, d).select("question_id", "memory_id", F.round("dense", 6).alias("dense"), F.round("lx", 6).alias("lexical"), F.round("anchor", 6).alias("anchor"))


candidate_pool = R.candidate_pool


_POOL = "po AS (SELECT * EXCLUDE (rd, ra) FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense DESC, anchor DESC, ord, memory_id) AS rd, row_number() OVER (PARTITION BY question_id ORDER BY anchor DESC, dense DESC, ord, memory_id) AS ra FROM an) WHERE least(rd, ra) <= 20)"


@query("candidate_pool", f"WITH {_ANCHOR}, {_POOL} SELECT question_id, memory_id, round(anchor, 6) AS anchor FROM po")
def candidate_pool_query(spark, d):
    return candidate_pool(anchored(spark, d)).select("question_id", "memory_id", F.round("anchor", 6).alias("anchor"))


def guard_sql(source: str, part: str = "question_id", margin: str = "0.02::DOUBLE", protect: str = "4") -> str:
    """Tables g1 to g6 of the guarded rerank of a table; g6 has rank_no and rd."""
    w = f"OVER (PARTITION BY {part}"
    return f"""g1 AS (SELECT *, row_number() {w} ORDER BY dense DESC, anchor DESC, ord) AS rd FROM {source}),
g2 AS (SELECT *, min(CASE WHEN rd > {protect} AND rd <= 5 THEN score END) {w}) AS fl FROM g1),
g3 AS (SELECT *, coalesce(rd > {protect} AND rd <= 5 OR (rd > 5 AND rd <= 10 AND score >= fl + {margin}), FALSE) AS can FROM g2),
g4 AS (SELECT *, row_number() {w} ORDER BY can DESC, score DESC, anchor DESC, ord) AS place FROM g3),
g5 AS (SELECT *, CASE WHEN rd <= {protect} OR (can AND place <= 5 - {protect}) THEN 0 WHEN rd <= 10 THEN 1 ELSE 2 END AS segment FROM g4),
g6 AS (SELECT *, row_number() {w} ORDER BY segment, score DESC, anchor DESC, ord) AS rank_no FROM g5)"""


_SEARCH = "report draft threshold"


@query("lexical_search", f"SELECT * FROM (SELECT memory_id, round(CASE WHEN contains(t, '{_SEARCH}') THEN 1.0::DOUBLE ELSE ({' + '.join(f'''contains(t, '{w}')::INT''' for w in _SEARCH.split())}) / 3.0::DOUBLE END, 6) AS score FROM (SELECT memory_id, {Q.fold('content')} AS t FROM {_M} c)) WHERE score > 0")
def lexical_search(spark, d):
    return R.lexical(memories(spark, d), _SEARCH).where("score > 0").select("memory_id", F.round("score", 6).alias("score"))


@query("lexical_search_top", f"SELECT memory_id, round(score, 6) AS score FROM (SELECT memory_id, CASE WHEN contains(t, '{_SEARCH}') THEN 1.0::DOUBLE ELSE ({' + '.join(f'''contains(t, '{w}')::INT''' for w in _SEARCH.split())}) / 3.0::DOUBLE END AS score FROM (SELECT memory_id, {Q.fold('content')} AS t FROM {_M} c)) WHERE score > 0 ORDER BY score DESC, memory_id LIMIT 20")
def lexical_search_top(spark, d):
    return R.lexical(memories(spark, d), _SEARCH).where("score > 0").orderBy(F.desc("score"), "memory_id").limit(20).select("memory_id", F.round("score", 6).alias("score"))


_JQ = f"(SELECT c.memory_id, c.question_id, {Q.distinct_terms('c.content')} AS a, {Q.distinct_terms('q.question')} AS b FROM {_M} c JOIN {_Q} q USING (question_id))"


@query("question_jaccard", f"SELECT memory_id, question_id, round({Q.jaccard('a', 'b')}, 6) AS similarity FROM {_JQ}")
def question_jaccard(spark, d):
    j = memories(spark, d).join(questions(spark, d), "question_id")
    return j.select("memory_id", "question_id", F.round(X.jaccard(F.array_distinct(X.terms(F.col("content"))), F.array_distinct(X.terms(F.col("question")))), 6).alias("similarity"))


# ---------------------------------------------------------------- lifecycle


def dated(spark, d):
    return memories(spark, d).select("question_id", "memory_id", "ord", "content", N.parse_date(F.col("source_date")).alias("ts"))


_SETS = f"m AS MATERIALIZED (SELECT question_id, memory_id, ord, {Q.parse_date('source_date')} AS ts, {Q.words_any('content', X.UPDATE_WORDS, True)} AS up, {Q.distinct_terms('content')} AS s FROM {_M})"


def _pairs(t: float, name: str = "p") -> str:
    return f"""{name} AS (SELECT a.question_id, a.memory_id AS a, b.memory_id AS b, a.ord AS oa, b.ord AS ob, a.ts AS ta, b.ts AS tb, b.up AS ub FROM m a JOIN m b ON a.question_id = b.question_id AND a.memory_id <> b.memory_id WHERE {Q.jaccard('a.s', 'b.s')} >= {t}::DOUBLE)"""


@query("near_duplicates", f"WITH {_SETS}, {_pairs(0.9)} SELECT DISTINCT question_id, a AS memory_id FROM p WHERE (ob, b) < (oa, a)")
def near_duplicates(spark, d):
    return L.duplicates(dated(spark, d), 0.9)


@query("superseded", f"WITH {_SETS}, {_pairs(0.55)} SELECT DISTINCT question_id, a AS memory_id FROM p WHERE ub AND tb > ta")
def superseded(spark, d):
    return L.superseded(dated(spark, d), 0.55)


@query(
    "lifecycle_statuses",
    f"WITH {_SETS}, {_pairs(0.55)}, {_pairs(0.9, 'p2')}, s AS (SELECT DISTINCT a FROM p WHERE ub AND tb > ta), dd AS (SELECT DISTINCT a FROM p2 WHERE (ob, b) < (oa, a)) SELECT memory_id, CASE WHEN s.a IS NOT NULL THEN 'superseded' WHEN dd.a IS NOT NULL THEN 'duplicate' ELSE 'active' END AS lifecycle_status FROM m LEFT JOIN s ON s.a = memory_id LEFT JOIN dd ON dd.a = memory_id",
)
def lifecycle_statuses(spark, d):
    return L.statuses(dated(spark, d), 0.9, 0.55).select("memory_id", "lifecycle_status")


@query("redundancy_max", f"WITH v AS MATERIALIZED {_V} SELECT a.question_id, a.memory_id, round({Q.clamp(f'max({Q.cosine(chr(97) + chr(46) + "embedding", chr(98) + chr(46) + "embedding")})')}, 5) AS redundancy FROM v a LEFT JOIN v b ON a.question_id = b.question_id AND a.memory_id <> b.memory_id GROUP BY ALL")
def redundancy_max(spark, d):
    return L.redundancy(vectors(spark, d).select("question_id", "memory_id", "embedding")).select("question_id", "memory_id", F.round("redundancy", 5).alias("redundancy"))
