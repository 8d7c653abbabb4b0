"""The project's tables as stored, and with each key once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows without a full key are left out. The rank limit is applied before the shuffle."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def chunks(spark: SparkSession, d: str, **more: Column) -> DataFrame:
    """Memory chunks, each memory_id once: a delivery with content before one without, then the earliest. more: columns that are computed before the
    rows move, so that what they are computed from stays behind.
    """
    return once(table(spark, d, "chunks").withColumns(more), ["memory_id"], F.col("content").isNull(), F.col("ingested_at").asc_nulls_last())


def samples(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "samples"), ["question_id"], F.col("ingested_at").asc_nulls_last())


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "retrieved"), ["method_name", "question_id", "rank_no"], F.col("content").isNull(), F.col("retrieved_at").asc_nulls_last())


def reader_outputs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "reader_outputs"), ["output_id"], F.col("created_at").asc_nulls_last())


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "embedding_cache"), ["cache_key"], F.col("created_at").asc_nulls_last())


def manifests(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "split_manifests"), ["split_id"], F.col("created_at").asc_nulls_last())


def split_members(spark: SparkSession, d: str) -> DataFrame:
    """(split_id, dataset_path, split, question_id) of every id of every manifest."""
    m = manifests(spark, d).select("split_id", "dataset_path", F.explode("splits").alias("split", "ids"))
    return m.select("split_id", "dataset_path", "split", F.explode("ids").alias("question_id"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, session_id, session_no, source_date, turn_no, role, content): each turn of each haystack session, numbered from 0."""
    s = samples(spark, d).select("question_id", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("session_no", "turns"))
    s = s.select("question_id", F.get("haystack_session_ids", F.col("session_no")).alias("session_id"), "session_no", F.get("haystack_dates", F.col("session_no")).alias("source_date"), F.posexplode("turns").alias("turn_no", "turn"))
    return s.select("question_id", "session_id", "session_no", "source_date", "turn_no", F.col("turn.role").alias("role"), F.col("turn.content").alias("content"))


def is_abstention() -> Column:
    """From columns question_id, has_answer, answer_session_ids and answer: the id's ending wins, then the flag, then gold sessions, then the answer's wording."""
    from mnemolake.functions.text import is_abstention_answer

    gold = F.coalesce(F.size("answer_session_ids"), F.lit(-1)) > 0
    worded = F.coalesce(is_abstention_answer(F.array_join("answer", " ")), F.lit(False))
    return F.when(F.lower("question_id").endswith("_abs"), True).when(F.col("has_answer") == F.lit(False), True).when(gold, False).otherwise(worded)
