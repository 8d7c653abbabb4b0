"""Readers of conversation data sets and logs: JSON arrays, JSON lines, wrapped objects, operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string,has_answer:boolean>"

def _first(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first of several fields that is there."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}", kind) for p in paths])


def _parsed(text: str, where: str = "f") -> Column:
    """The text as a variant; an error that names the file and how the text begins if it isn't JSON."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), F.raise_error(F.concat(F.col(where), F.lit(": not JSON: "), F.substring(text, 1, 80))).cast("variant")).otherwise(v)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One variant column `v` for each record of a JSON array, a JSON-lines file, or an object with data, samples or records.

    Files named *.jsonl are read line by line, so they may be of any size and are split over tasks; others are read whole. Blank
    lines and lines that begin with # are skipped in JSON lines. A line that isn't JSON is an error with the file's name.
    """
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).select(F.trim("value").alias("l"), F.input_file_name().alias("f"))
        return rows.where("l <> '' and not startswith(l, '#')").select(_parsed("l").alias("v"))
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"), F.input_file_name().alias("f"))
    array = whole.where(F.col("t").startswith("[")).select(_parsed("t").alias("v"))
    wrapped = F.try_parse_json("t")
    inner = F.coalesce(*[F.try_variant_get(wrapped, f"$.{k}", "variant") for k in ("data", "samples", "records")])
    held = whole.where(F.col("t").startswith("{")).select(inner.alias("v")).where("v is not null")
    listed = array.unionByName(held)
    flat = listed.select(F.explode(F.variant_get("v", "$", "array<variant>")).alias("v"))
    is_lines = whole.where(F.col("t").startswith("{") & inner.isNull() | F.col("t").startswith("#"))
    lines = is_lines.select("f", F.explode(F.split("t", "\r?\n")).alias("l")).select("f", F.trim("l").alias("l")).where("l <> '' and not startswith(l, '#')")
    return flat.unionByName(lines.select(_parsed("l").alias("v")))


#: Fields of a question that questions() reads, under any of their names.
KNOWN = ("question_id", "id", "qid", "question_type", "question", "answer", "question_date", "haystack_session_ids", "haystack_dates", "haystack_sessions", "answer_session_ids", "gold_session_ids", "has_answer")


def unknown_fields(v: Column) -> Column:
    """JSON of a record's fields that questions() doesn't read; null if there are none."""
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: ~k.isin(*KNOWN))
    return F.when(F.coalesce(F.size(rest), F.lit(0)) > 0, F.to_json(rest))


def benchmark_samples(spark: SparkSession, path: str) -> DataFrame:
    """Records (variant v) of a benchmark file; a file without any is an error."""
    out = records(spark, path)
    if out.isEmpty():
        raise ValueError(f"{path}: no records")
    return out


def query_events(questions_: DataFrame) -> DataFrame:
    """Each question as an event of its own."""
    return questions_.select(F.concat(F.lit("query_"), F.col("question_id")).alias("event_id"), F.lit("query").alias("event_type"), F.col("question").alias("content"), F.col("question_date").alias("timestamp"), "question_id")


def generic_samples(questions_: DataFrame) -> DataFrame:
    """Questions as benchmark samples: query, gold answers and the gold sessions as evidence."""
    return questions_.select(F.col("question_id").alias("sample_id"), F.col("question").alias("query"), F.col("answer").alias("gold_answers"), F.col("answer_session_ids").alias("gold_ids"), F.coalesce("question_type", F.lit("unknown")).alias("task_type"))


def questions(spark: SparkSession, path: str, limit: int | None = None, rest: bool = False) -> DataFrame:
    """Questions with their haystack sessions, aliases resolved: id/qid, speaker/author, text/message, gold_session_ids; missing
    session ids are numbered, dates padded or cut to the sessions, an absent answer reads "I don't know". limit: records that are
    read at most; 0 gives none. rest: adds the other fields as JSON.
    """
    v = F.col("v")
    sessions = F.variant_get(v, "$.haystack_sessions", "array<array<variant>>")
    turn = lambda t: F.struct(F.coalesce(_first(t, "role", "speaker", "author"), F.lit("unknown")).alias("role"), _first(t, "content", "text", "message").alias("content"), F.try_variant_get(t, "$.has_answer", "boolean").alias("has_answer"))
    source = records(spark, path) if limit is None else records(spark, path).limit(limit)
    df = source.select(
        _first(v, "question_id", "id", "qid").alias("question_id"), _first(v, "question_type").alias("question_type"), _first(v, "question").alias("question"),
        F.coalesce(F.try_variant_get(v, "$.answer", "array<string>"), F.array(_first(v, "answer"))).alias("answer"), _first(v, "question_date").alias("question_date"),
        F.try_variant_get(v, "$.haystack_session_ids", "array<string>").alias("ids"), F.coalesce(F.try_variant_get(v, "$.haystack_dates", "array<string>"), F.array().cast("array<string>")).alias("dates"),
        F.coalesce(F.transform(sessions, lambda s: F.transform(s, turn)), F.array().cast(f"array<array<{TURN}>>")).alias("haystack_sessions"),
        F.coalesce(_first(v, "answer_session_ids", "gold_session_ids", kind="array<string>"), F.array().cast("array<string>")).alias("answer_session_ids"), F.try_variant_get(v, "$.has_answer", "boolean").alias("has_answer"), *([unknown_fields(v).alias("rest")] if rest else []),
    )
    n = F.size("haystack_sessions")
    none = F.array().cast("array<string>")
    numbered = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.concat(F.lit("session_"), i.cast("string")))).otherwise(none)
    answer = F.filter("answer", lambda a: a.isNotNull() & (F.length(F.trim(a)) > 0))
    bad = F.col("ids").isNotNull() & (F.size("ids") != n)
    ids = F.when(bad, F.raise_error(F.lit("haystack ids and sessions differ in number"))).otherwise(F.coalesce("ids", numbered))
    return df.select(
        "question_id", "question_type", "question", F.when(F.size(answer) > 0, answer).otherwise(F.array(F.lit("I don't know"))).alias("answer"), "question_date", ids.cast("array<string>").alias("haystack_session_ids"),
        F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get("dates", i - 1))).otherwise(none).alias("haystack_dates"), "haystack_sessions", "answer_session_ids", "has_answer", *(["rest"] if rest else []),
    )


def session_chunks(questions_: DataFrame) -> DataFrame:
    """One memory for each session with text: 'role: content' lines, the number of turns, the roles."""
    s = questions_.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("ord", "z"))
    turns = F.filter("z.haystack_sessions", lambda t: F.coalesce(F.length(F.trim(t["content"])), F.lit(0)) > 0)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("unknown")), F.lit(": "), F.trim(t["content"]))), "\n")
    out = s.select("question_id", F.col("ord"), F.col("z.haystack_session_ids").alias("source_session_id"), F.col("z.haystack_dates").alias("source_date"), turns.alias("turns")).where(F.size("turns") > 0)
    ident = F.concat_ws("_", F.lit("lme"), F.regexp_replace("question_id", r"[^A-Za-z0-9]+", "_"), F.regexp_replace("source_session_id", r"[^A-Za-z0-9]+", "_"))
    return out.select("question_id", ident.alias("memory_id"), "ord", lines.alias("content"), "source_session_id", "source_date", F.size("turns").alias("turn_count"), F.array_distinct(F.transform("turns", lambda t: t["role"])).alias("roles"))


def turn_chunks(questions_: DataFrame) -> DataFrame:
    """One memory for each turn with text."""
    s = questions_.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_no", "z"))
    t = s.select("question_id", F.col("z.haystack_session_ids").alias("source_session_id"), F.col("z.haystack_dates").alias("source_date"), "session_no", F.posexplode("z.haystack_sessions").alias("turn_no", "t"))
    kind = F.when(F.lower("t.role").isin("assistant", "ai", "bot", "agent"), "assistant_message").otherwise("user_message")
    ident = F.concat_ws("_", F.lit("lme"), F.regexp_replace("question_id", r"[^A-Za-z0-9]+", "_"), F.regexp_replace("source_session_id", r"[^A-Za-z0-9]+", "_"), F.col("turn_no").cast("string"))
    return t.where(F.coalesce(F.length(F.trim("t.content")), F.lit(0)) > 0).select("question_id", ident.alias("memory_id"), "source_session_id", "source_date", "session_no", "turn_no", kind.alias("event_type"), F.trim("t.content").alias("content"))


OPERATION = "op_id string, op string, target_memory_id string, source_memory_ids array<string>, reason string, policy_score double, confidence double, scope string, payload struct<feature_snapshot:map<string,double>>, timestamp timestamp"


def operation_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON-lines operation logs; paths that don't exist are skipped."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
    return spark.read.schema(OPERATION).option("mode", "FAILFAST").json(there) if there else spark.createDataFrame([], OPERATION)


def training_examples(log: DataFrame) -> DataFrame:
    """(label, features) of the logged operations that kept a snapshot of their features."""
    return log.where("payload.feature_snapshot is not null and op is not null").select(F.col("op").alias("label"), F.col("payload.feature_snapshot").alias("features"))
