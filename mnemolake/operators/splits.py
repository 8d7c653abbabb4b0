"""Deterministic splits and folds by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_rank(df: DataFrame, seed: int, ident: str = "question_id", group: str | None = None) -> DataFrame:
    """df with place, from 1, by sha256 of 'seed:id' and then id; within a group (a data set), so that each is sorted on its own."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident)), 256)
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(h, ident)
    return df.withColumn("place", F.row_number().over(w))


def dev_test(df: DataFrame, dev: int, seed: int = 42, ident: str = "question_id", group: str | None = None) -> DataFrame:
    """df with split: the first `dev` of each group by hash are dev, the rest test."""
    return hash_rank(df, seed, ident, group).withColumn("split", F.when(F.col("place") <= dev, "dev").otherwise("test")).drop("place")


def fold(ident: str, folds: int = 5):
    """Fold number of an id: the first 32 bits of sha256 of its JSON text, modulo folds."""
    quoted = F.concat(F.lit('"'), F.col(ident), F.lit('"'))
    return (F.conv(F.substring(F.sha2(quoted, 256), 1, 8), 16, 10).cast("bigint") % folds).cast("bigint")


def overlapping(members: DataFrame) -> DataFrame:
    """Ids that stand in more than one split; empty if the splits are disjoint."""
    return members.groupBy("question_id").agg(F.countDistinct("split").alias("n")).where("n > 1")


def ids_digest(df: DataFrame, group: str, ident: str = "question_id") -> DataFrame:
    """(group, digest): sha256 over the group's sorted ids as a JSON array."""
    ids = F.array_sort(F.collect_set(ident))
    text = F.concat(F.lit('["'), F.array_join(ids, '","'), F.lit('"]'))
    return df.groupBy(group).agg(F.sha2(text, 256).alias("digest"))
