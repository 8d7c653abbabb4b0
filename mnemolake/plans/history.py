"""Queries over operation logs, versions, merges and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.operators import metrics as M
from mnemolake.operators import store as T
from mnemolake.sources import tables as S

from . import sqltext as Q
from .registry import query

OPS = {"signup": "ADD", "view": "RETRIEVE", "click": "UPDATE", "purchase": "MERGE", "error": "ARCHIVE"}


def operations(spark, d):
    """The event table read as an operation log: a memory for each user."""
    return S.table(spark, d, "events")


@query("op_counts", "SELECT event_type AS op, count(*) AS n, count(DISTINCT user_id) AS memories, round(sum(value), 2) AS total FROM events GROUP BY 1")
def op_counts(spark, d):
    return operations(spark, d).groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("memories"), F.round(F.sum("value"), 2).alias("total"))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.95), 6) AS value_p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return operations(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), *M.latency("value"))


@query("version_history", "SELECT user_id, event_id, row_number() OVER w::BIGINT AS version, lag(event_type) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def version_history(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.versions(operations(spark, d), "user_id", F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", F.col("version").cast("bigint").alias("version"), F.lag("event_type").over(w).alias("previous"))


@query("latest_version", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS versions FROM events GROUP BY 1")
def latest_version(spark, d):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return operations(spark, d).groupBy("user_id").agg(last.alias("l"), F.count("*").alias("versions")).select("user_id", "l.event_id", "l.event_type", "versions")


@query("current_status", "SELECT status, count(*) AS memories FROM (SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'archived' ELSE 'active' END AS status FROM events GROUP BY 1) GROUP BY 1")
def current_status(spark, d):
    now = T.current(operations(spark, d).select("user_id", "event_type", "ts", "event_id"), "user_id", "ts", "event_id")
    return now.groupBy(F.when(F.col("event_type") == "error", "archived").otherwise("active").alias("status")).agg(F.count("*").alias("memories"))


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return operations(spark, d).groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "n", "total")


@query("event_props", "SELECT (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def event_props(spark, d):
    return operations(spark, d).groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).agg(F.count("*").alias("n"))


@query("memory_history", f"SELECT memory_id, count(*) AS deliveries, count(content) AS with_content, arg_max(coalesce(token_count, -1), (ingested_at, coalesce(token_count, -1)))::BIGINT AS last_tokens FROM chunks WHERE memory_id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1")
def memory_history(spark, d):
    n = F.coalesce("token_count", F.lit(-1))
    return S.table(spark, d, "chunks").where("memory_id is not null and ingested_at is not null").groupBy("memory_id").agg(F.count("*").alias("deliveries"), F.count("content").alias("with_content"), F.max_by(n, F.struct("ingested_at", n)).cast("bigint").alias("last_tokens"))


@query("store_stats", f"SELECT coalesce(memory_type, 'session') AS memory_type, count(*) AS memories, sum({Q.tokens('content')})::BIGINT AS tokens, sum(strlen(content) + 4 * coalesce(len(content_embedding), 0))::BIGINT AS bytes FROM {Q.CHUNKS} c WHERE content IS NOT NULL GROUP BY 1")
def store_stats(spark, d):
    from mnemolake.functions.text import estimate_tokens

    size = F.octet_length("content") + 4 * F.when(F.col("content_embedding").isNull(), 0).otherwise(F.size("content_embedding"))
    return S.chunks(spark, d).where("content is not null").groupBy(F.coalesce("memory_type", F.lit("session")).alias("memory_type")).agg(F.count("*").alias("memories"), F.sum(estimate_tokens(F.col("content"))).cast("bigint").alias("tokens"), F.sum(size).cast("bigint").alias("bytes"))


@query("retention_ratio", f"SELECT question_id, memories, sessions, round(memories::DOUBLE / nullif(sessions, 0), 6) AS retention FROM (SELECT question_id, count(*) AS memories FROM {Q.CHUNKS} c WHERE question_id IS NOT NULL GROUP BY 1) JOIN (SELECT question_id, coalesce(len(haystack_sessions), 0)::BIGINT AS sessions FROM {Q.SAMPLES} s) USING (question_id)")
def retention_ratio(spark, d):
    m = S.chunks(spark, d).where("question_id is not null").groupBy("question_id").agg(F.count("*").alias("memories"))
    s = S.samples(spark, d).select("question_id", F.when(F.col("haystack_sessions").isNull(), 0).otherwise(F.size("haystack_sessions")).cast("bigint").alias("sessions"))
    return m.join(s, "question_id").select("question_id", "memories", "sessions", M.ratio(F.col("memories"), F.nullif("sessions", F.lit(0))).alias("retention"))


@query("cache_hits", f"SELECT c.namespace_id, count(*) AS keys, count(DISTINCT text_hash) AS distinct_texts, (count(*) - count(DISTINCT text_hash))::BIGINT AS repeated, round((count(*) - count(DISTINCT text_hash))::DOUBLE / count(*), 6) AS hit_rate FROM {Q.CACHE} c WHERE text_hash IS NOT NULL GROUP BY 1")
def cache_hits(spark, d):
    repeated = F.count("*") - F.countDistinct("text_hash")
    return S.embedding_cache(spark, d).where("text_hash is not null").groupBy("namespace_id").agg(F.count("*").alias("keys"), F.countDistinct("text_hash").alias("distinct_texts"), repeated.alias("repeated"), M.ratio(repeated, F.count("*")).alias("hit_rate"))


@query(
    "merge_content",
    f"""WITH r AS (SELECT concat_ws('|', question_id, source_session_id) AS target_id, ord, memory_id, string_split(content, chr(10) || chr(10)) AS ps FROM {Q.CHUNKS} c WHERE content IS NOT NULL AND source_session_id IS NOT NULL),
    p AS (SELECT target_id, ord, memory_id, n, ps[n] AS p, trim(regexp_replace(ps[n], '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS k FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS n FROM r)),
    f AS (SELECT * FROM p WHERE length(k) > 0 QUALIFY row_number() OVER (PARTITION BY target_id, k ORDER BY ord, memory_id, n) = 1),
    t AS (SELECT target_id, string_agg(trim(p), chr(10) || chr(10) ORDER BY ord, memory_id, n) AS content FROM f GROUP BY 1)
    SELECT target_id, coalesce(content, '') AS content, count(DISTINCT memory_id)::INT AS sources FROM r LEFT JOIN t USING (target_id) GROUP BY ALL""",
)
def merge_content(spark, d):
    """The memories of each session merged into its first: paragraphs once, in order."""
    rows = S.chunks(spark, d).where("content is not null and source_session_id is not null").select(
        F.concat_ws("|", "question_id", "source_session_id").alias("target_id"), "ord", F.col("memory_id").alias("id"), "content", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<string>").alias("related"), F.lit(None).cast("array<string>").alias("supersedes")
    )
    return T.merge(rows).select("target_id", "content", F.size("related").alias("sources"))


@query("filtered_memories", f"SELECT memory_id, scope, memory_type FROM {Q.CHUNKS} c WHERE scope = 'global' AND memory_type IN ('fact', 'summary') AND importance >= 0.5")
def filtered_memories(spark, d):
    return S.chunks(spark, d).where((F.col("scope") == "global") & F.col("memory_type").isin("fact", "summary") & (F.col("importance") >= 0.5)).select("memory_id", "scope", "memory_type")


@query("unknown_scopes", f"SELECT scope, count(*) AS memories FROM {Q.CHUNKS} c WHERE scope IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scopes s WHERE s.scope = c.scope) GROUP BY 1")
def unknown_scopes(spark, d):
    return S.chunks(spark, d).where("scope is not null").join(S.table(spark, d, "scopes").select("scope"), "scope", "left_anti").groupBy("scope").agg(F.count("*").alias("memories"))
