"""Queries over single rows: sources, text, date and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import numbers as N
from mnemolake.functions import text as X
from mnemolake.sources import tables as S

from . import sqltext as Q
from .registry import query


@query("session_turns", f"SELECT question_id, session_id, session_no::BIGINT AS session_no, turn_no::BIGINT AS turn_no, CASE WHEN lower(role) IN ('assistant', 'ai', 'bot', 'agent') THEN 'assistant_message' ELSE 'user_message' END AS event_type, length(content)::BIGINT AS n_chars FROM {Q.TURNS} t WHERE content IS NOT NULL AND trim(content) <> ''")
def session_turns(spark, d):
    kind = F.when(F.lower("role").isin("assistant", "ai", "bot", "agent"), "assistant_message").otherwise("user_message")
    return S.turns(spark, d).where("content is not null and trim(content) <> ''").select("question_id", "session_id", F.col("session_no").cast("bigint").alias("session_no"), F.col("turn_no").cast("bigint").alias("turn_no"), kind.alias("event_type"), F.length("content").cast("bigint").alias("n_chars"))


@query(
    "session_chunks",
    f"""SELECT question_id, session_id, session_no::BIGINT AS session_no, count(*) AS turn_count, string_agg(coalesce(role, 'unknown') || ': ' || content, chr(10) ORDER BY turn_no) AS content
    FROM {Q.TURNS} t WHERE content IS NOT NULL AND trim(content) <> '' GROUP BY ALL""",
)
def session_chunks(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn_no", F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.col("content")).alias("line")))), lambda s: s["line"])
    rows = S.turns(spark, d).where("content is not null and trim(content) <> ''")
    return rows.groupBy("question_id", "session_id", F.col("session_no").cast("bigint").alias("session_no")).agg(F.count("*").alias("turn_count"), F.array_join(lines, "\n").alias("content"))


@query(
    "dataset_stats",
    f"""SELECT coalesce(question_type, 'unknown') AS question_type, count(*) AS questions, count(*) FILTER ({Q.ABSTENTION}) AS abstentions, min(len(haystack_sessions))::BIGINT AS min_sessions, max(len(haystack_sessions))::BIGINT AS max_sessions,
    round(avg(len(haystack_sessions)), 6) AS avg_sessions, sum(list_sum(list_transform(haystack_sessions, lambda s: coalesce(len(s), 0))))::BIGINT AS turns FROM {Q.SAMPLES} s GROUP BY ALL""",
)
def dataset_stats(spark, d):
    n = F.when(F.col("haystack_sessions").isNotNull(), F.size("haystack_sessions"))
    turns = F.aggregate("haystack_sessions", F.lit(0), lambda acc, s: acc + F.when(s.isNull(), 0).otherwise(F.size(s)))
    return (
        S.samples(spark, d)
        .groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type"))
        .agg(F.count("*").alias("questions"), F.count_if(S.is_abstention()).alias("abstentions"), F.min(n).cast("bigint").alias("min_sessions"), F.max(n).cast("bigint").alias("max_sessions"), F.round(F.avg(n), 6).alias("avg_sessions"), F.sum(turns).cast("bigint").alias("turns"))
    )


@query("token_estimates", f"SELECT memory_id, {Q.tokens('content')} AS tokens, greatest(1, length(content) // 4)::BIGINT AS quarter_tokens, len({Q.terms('content')})::BIGINT AS terms FROM {Q.CHUNKS} c WHERE content IS NOT NULL")
def token_estimates(spark, d):
    c = F.col("content")
    return S.chunks(spark, d).where("content is not null").select("memory_id", X.estimate_tokens(c).cast("bigint").alias("tokens"), X.quarter_tokens(c).cast("bigint").alias("quarter_tokens"), F.size(X.terms(c)).cast("bigint").alias("terms"))


@query("stale_token_counts", f"SELECT memory_type, count(*) AS memories, count(*) FILTER (token_count IS DISTINCT FROM {Q.tokens('content')}) AS stale, sum(coalesce(token_count, 0))::BIGINT AS stored FROM {Q.CHUNKS} c WHERE content IS NOT NULL GROUP BY ALL")
def stale_token_counts(spark, d):
    stale = ~F.col("token_count").eqNullSafe(X.estimate_tokens(F.col("content")).cast("bigint"))
    return S.chunks(spark, d).where("content is not null").groupBy("memory_type").agg(F.count("*").alias("memories"), F.count_if(stale).alias("stale"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("stored"))


@query("term_counts", f"SELECT question_id, memory_id, term, count(*) AS tf FROM (SELECT question_id, memory_id, unnest({Q.terms('content')}) AS term FROM {Q.CHUNKS} c) GROUP BY ALL")
def term_counts(spark, d):
    from mnemolake.operators.ranking import term_rows

    return term_rows(S.chunks(spark, d), "content", "question_id", "memory_id")


@query("doc_freq", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({Q.terms('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def doc_freq(spark, d):
    from mnemolake.operators.ranking import term_rows

    return term_rows(S.table(spark, d, "documents"), "text", "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


@query("importance", f"SELECT memory_id, round({Q.importance('content')}, 6) AS importance FROM {Q.CHUNKS} c WHERE content IS NOT NULL")
def importance(spark, d):
    return S.chunks(spark, d).where("content is not null").select("memory_id", F.round(X.importance(F.col("content")), 6).alias("importance"))


@query("parsed_dates", f"SELECT memory_id, source_date, strftime({Q.parse_date('source_date')}, '%Y-%m-%d %H:%M:%S') AS utc FROM {Q.CHUNKS} c")
def parsed_dates(spark, d):
    return S.chunks(spark, d).select("memory_id", "source_date", F.date_format(N.parse_date(F.col("source_date")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("date_validation", f"SELECT coalesce(source_date, '') = '' AS missing, {Q.parse_date('source_date')} IS NOT NULL AS parsed, count(*) AS memories FROM {Q.CHUNKS} c GROUP BY ALL")
def date_validation(spark, d):
    return S.chunks(spark, d).groupBy((F.coalesce("source_date", F.lit("")) == "").alias("missing"), N.parse_date(F.col("source_date")).isNotNull().alias("parsed")).agg(F.count("*").alias("memories"))


_PAIRS = f"(SELECT c.memory_id, {Q.parse_date('c.source_date')} AS s, {Q.parse_date('q.question_date')} AS n FROM {Q.CHUNKS} c JOIN {Q.SAMPLES} q USING (question_id))"


@query("recency_scores", f"SELECT memory_id, round(coalesce(1.0::DOUBLE / (1.0::DOUBLE + {Q.age('n', 's')} / 30.0::DOUBLE), 0.5::DOUBLE), 6) AS hyperbolic, round(coalesce(power(0.5::DOUBLE, {Q.age('n', 's')} / 14.0::DOUBLE), 0.5::DOUBLE), 6) AS episodic FROM (SELECT * REPLACE (CASE WHEN n IS NULL THEN NULL ELSE s END AS s, CASE WHEN s IS NULL THEN NULL ELSE n END AS n) FROM {_PAIRS})".replace(Q.age("n", "s"), f"CASE WHEN n IS NULL OR s IS NULL THEN NULL ELSE {Q.age('n', 's')} END"))
def recency_scores(spark, d):
    j = S.chunks(spark, d).join(S.samples(spark, d).select("question_id", "question_date"), "question_id")
    s, n = N.parse_date(F.col("source_date")), N.parse_date(F.col("question_date"))
    known = s.isNotNull() & n.isNotNull()
    half = F.lit(0.5)
    return j.select("memory_id", F.round(F.when(known, N.recency(s, n)).otherwise(half), 6).alias("hyperbolic"), F.round(F.when(known, N.episodic_recency(s, n)).otherwise(half), 6).alias("episodic"))


@query("temporal_intent", f"SELECT question_id, {Q.words_any('question', X.TEMPORAL_WORDS, True)} AS temporal FROM {Q.SAMPLES} s")
def temporal_intent(spark, d):
    return S.samples(spark, d).select("question_id", X.contains_any(F.col("question"), X.TEMPORAL_WORDS, pad=True).alias("temporal"))


@query("update_markers", f"SELECT memory_id, {Q.words_any('content', X.UPDATE_WORDS, True)} AS has_update FROM {Q.CHUNKS} c")
def update_markers(spark, d):
    return S.chunks(spark, d).select("memory_id", X.contains_any(F.col("content"), X.UPDATE_WORDS, pad=True).alias("has_update"))


@query("abstention", f"SELECT question_id, {Q.ABSTENTION} AS is_abstention, coalesce(len(answer_session_ids), 0) = 0 AS no_gold FROM {Q.SAMPLES} s")
def abstention(spark, d):
    return S.samples(spark, d).select("question_id", S.is_abstention().alias("is_abstention"), (F.coalesce(F.size("answer_session_ids"), F.lit(0)) <= 0).alias("no_gold"))


@query("normalized_answers", f"SELECT output_id, array_to_string({Q.answer_tokens('answer')}, ' ') AS normalized, {Q.abstains('answer')} AS abstains FROM {Q.OUTPUTS} o WHERE answer IS NOT NULL")
def normalized_answers(spark, d):
    a = F.col("answer")
    return S.reader_outputs(spark, d).where("answer is not null").select("output_id", X.normalize_answer(a).alias("normalized"), X.is_abstention_answer(a).alias("abstains"))




_PRIVACY = f"SELECT doc_id, {Q.privacy('text')} AS risk FROM documents WHERE text IS NOT NULL"


@query("privacy_risk", _PRIVACY)
@query("privacy_risk_all", _PRIVACY)
def privacy_risk(spark, d):
    """The risk of every text in any script."""
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", X.privacy_risk(F.col("text")).alias("risk"))


@query("truncated_texts", "SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(substring(text, 1, 79), ' ') || '…' ELSE text END AS short, coalesce(length(text) > 80, FALSE) AS cut FROM documents")
def truncated_texts(spark, d):
    t = F.col("text")
    return S.table(spark, d, "documents").select("doc_id", X.truncate(t, 80).alias("short"), F.coalesce(F.length(t) > 80, F.lit(False)).alias("cut"))


@query("safe_ids", "SELECT DISTINCT scope, CASE WHEN coalesce(length(trim(regexp_replace(scope, '[^A-Za-z0-9_.-]+', '_', 'g'), '_')), 0) = 0 THEN 'unknown' ELSE trim(regexp_replace(scope, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') END AS safe FROM documents")
def safe_ids(spark, d):
    return S.table(spark, d, "documents").select("scope", X.safe_id(F.col("scope")).alias("safe")).distinct()


@query("cache_vectors", f"SELECT namespace_id, count(*) AS keys, count(DISTINCT text_hash) AS texts, count(*) FILTER (dimension = 64) AS of_dimension, min(created_at)::TIMESTAMP AS first_at FROM {Q.CACHE} c GROUP BY ALL")
def cache_vectors(spark, d):
    first = F.min("created_at").cast("timestamp_ntz")
    return S.embedding_cache(spark, d).groupBy("namespace_id").agg(F.count("*").alias("keys"), F.countDistinct("text_hash").alias("texts"), F.count_if(F.col("dimension") == 64).alias("of_dimension"), first.alias("first_at"))


@query("vector_norms", f"SELECT memory_id, round(sqrt(list_sum(list_transform(content_embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM {Q.CHUNKS} c WHERE {Q.usable('content_embedding')}")
def vector_norms(spark, d):
    v = F.col("content_embedding")
    return S.chunks(spark, d).where(N.usable(v, 64)).select("memory_id", F.round(N.norm(N.doubles(v)), 4).alias("norm"))


@query("scope_filter", "SELECT s.scope, s.owner_kind, count(*) AS memories FROM chunks c JOIN scopes s USING (scope) WHERE s.active AND c.memory_type = 'fact' GROUP BY ALL")
def scope_filter(spark, d):
    c = S.table(spark, d, "chunks").where("memory_type = 'fact'").select("scope")
    return c.join(S.table(spark, d, "scopes").where("active").select("scope", "owner_kind"), "scope").groupBy("scope", "owner_kind").agg(F.count("*").alias("memories"))


@query("turn_tokens", f"SELECT question_id, session_id, sum({Q.tokens('content')})::BIGINT AS tokens, count(*) AS turns FROM {Q.TURNS} t WHERE content IS NOT NULL GROUP BY ALL")
def turn_tokens(spark, d):
    return S.turns(spark, d).where("content is not null").groupBy("question_id", "session_id").agg(F.sum(X.estimate_tokens(F.col("content"))).cast("bigint").alias("tokens"), F.count("*").alias("turns"))
