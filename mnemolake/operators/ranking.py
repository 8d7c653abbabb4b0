"""Rankers: BM25, term cosine, dense cosine with recency or importance, lexical search, and the guarded rerank.

Every ranker scores (question, memory) pairs that are joined on the question, and keeps the first k by score and then id.
Scores are rounded to ROUND decimals before ranking, so ties don't hang on the last bits of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions.numbers import clamp01, cosine
from mnemolake.functions.text import casefold, terms

K1, B, ROUND = 1.5, 0.75, 9


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "question_id", score: str = "score", positive: bool = True) -> DataFrame:
    """The first k rows of each question, ranked from 1; rows of score 0 or less are dropped after ranking."""
    w = Window.partitionBy(by).orderBy(*(order or (F.desc(score), F.asc("memory_id"))))
    out = scored.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)
    return out.where(F.col(score) > 0) if positive else out


def term_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, term, tf): how often each term stands in each row's text."""
    return df.select(*keys, F.explode(terms(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def bm25(questions: DataFrame, memories: DataFrame, floor_length: bool = False) -> DataFrame:
    """(question_id, memory_id, score) of memories that share a term with their question.

    questions: question_id, question; memories: question_id, memory_id, content. Statistics are those of the question's own
    memories. A term repeated in the question counts as often. floor_length: average length of at least 1.
    Terms that the question doesn't have are dropped before counting; they add to the content's length alone.
    """
    q = term_rows(questions, "question", "question_id").withColumnRenamed("tf", "times")
    split = memories.select("question_id", "memory_id", terms(F.col("content")).alias("terms"))
    stats = split.groupBy("question_id").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_terms"))
    asked = split.select("question_id", "memory_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).join(q, ["question_id", "term"])
    tf = asked.groupBy("question_id", "memory_id", "term", "n_terms", "times").agg(F.count("*").alias("tf"))
    df = tf.groupBy("question_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.greatest(F.col("avg_terms"), F.lit(1.0)) if floor_length else F.col("avg_terms")
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / length)) * F.col("times")
    return tf.join(df, ["question_id", "term"]).join(stats, "question_id").groupBy("question_id", "memory_id").agg(F.round(F.sum(part), ROUND).alias("score"))


def normalized_bm25(questions: DataFrame, memories: DataFrame) -> DataFrame:
    """BM25 divided by the question's best."""
    best = F.max("score").over(Window.partitionBy("question_id"))
    return bm25(questions, memories, floor_length=True).withColumn("score", F.when(best > 0, F.round(F.col("score") / best, ROUND)).otherwise(F.lit(0.0)))


def tf_cosine(questions: DataFrame, memories: DataFrame) -> DataFrame:
    """(question_id, memory_id, score): cosine of term counts, for memories that share a term."""
    q, m = term_rows(questions, "question", "question_id"), term_rows(memories, "content", "question_id", "memory_id")
    qn = q.groupBy("question_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("qn"))
    mn = m.groupBy("question_id", "memory_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("mn"))
    common = m.join(q.withColumnRenamed("tf", "qt"), ["question_id", "term"]).groupBy("question_id", "memory_id").agg(F.sum(F.col("tf") * F.col("qt")).alias("dot"))
    return common.join(mn, ["question_id", "memory_id"]).join(qn, "question_id").select("question_id", "memory_id", F.round(clamp01(F.col("dot") / (F.col("qn") * F.col("mn"))), ROUND).alias("score"))


def dense(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """memories with score, the cosine to the question's vector. queries: question_id, query_vector (array<double>); memories: embedding."""
    return memories.join(queries, "question_id").withColumn("score", F.round(cosine(F.col("query_vector"), F.col("embedding")), ROUND))


def blend(similarity: Column, other: Column, weight: float = 0.75) -> Column:
    return F.round(F.lit(weight) * similarity + F.lit(1 - weight) * other, ROUND)


def lexical(memories: DataFrame, query: str) -> DataFrame:
    """Memories with score: the share of the query's distinct terms found anywhere in the content; 1 if the whole query is."""
    words = F.array_distinct(terms(F.lit(query)))
    text = casefold(F.coalesce(F.col("content"), F.lit("")))
    found = F.size(F.filter(words, lambda t: F.contains(text, t)))
    share = F.when(F.size(words) == 0, F.lit(0.0)).otherwise(found / F.size(words))
    return memories.withColumn("score", F.round(F.when(F.contains(text, casefold(F.trim(F.lit(query)))), F.lit(1.0)).otherwise(share), ROUND))


def anchor(semantic: Column, lexical_score: Column, ws: float = 0.8, wl: float = 0.2) -> Column:
    return clamp01((F.lit(ws) * clamp01(semantic) + F.lit(wl) * clamp01(lexical_score)) / F.lit(ws + wl))


def guarded(scored: DataFrame, k: int, margin: float | Column = 0.02, head: int = 5, protect: int | Column = 4, keep: int = 10, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """rank_no of the guarded rerank of each group (a question), first k.

    scored: question_id, memory_id, ord, dense, anchor, score. The first `protect` by dense stay in the head of `head` rows; a row
    of dense rank head+1..keep takes an open place only with a score of at least margin above the lowest unprotected one of
    the head. Head and tail are ordered by score, anchor and ord; rows behind `keep` follow by the same order. None of those
    can be among the first k up to keep, so they are dropped by dense rank, before the shuffle.
    """
    q = Window.partitionBy(*by)
    margin, protect = F.lit(margin), F.lit(protect)
    d = scored.withColumn("rd", F.row_number().over(q.orderBy(F.desc("dense"), F.desc("anchor"), F.asc("ord"))))
    if k <= keep:
        d = d.where(F.col("rd") <= keep)
    open_head = (F.col("rd") > protect) & (F.col("rd") <= head)
    d = d.withColumn("floor", F.min(F.when(open_head, F.col("score"))).over(q))
    can = open_head | ((F.col("rd") > head) & (F.col("rd") <= keep) & (F.col("score") >= F.col("floor") + margin))
    d = d.withColumn("can", F.coalesce(can, F.lit(False)))
    best = q.orderBy(F.desc("can"), F.desc("score"), F.desc("anchor"), F.asc("ord"))
    d = d.withColumn("place", F.row_number().over(best))
    chosen = (F.col("rd") <= protect) | (F.col("can") & (F.col("place") <= F.lit(head) - protect))
    d = d.withColumn("segment", F.when(chosen, 0).when(F.col("rd") <= keep, 1).otherwise(2))
    order = q.orderBy("segment", F.desc("score"), F.desc("anchor"), F.asc("ord"))
    return d.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k).drop("floor", "can", "place")


def candidate_pool(df: DataFrame, size: int = 20) -> DataFrame:
    """Rows among the first `size` of their question by dense or by anchor score."""
    w = Window.partitionBy("question_id")
    rd = F.row_number().over(w.orderBy(F.desc("dense"), F.desc("anchor"), "ord", "memory_id"))
    ra = F.row_number().over(w.orderBy(F.desc("anchor"), F.desc("dense"), "ord", "memory_id"))
    return df.withColumn("rd", rd).withColumn("ra", ra).where(F.least("rd", "ra") <= size).drop("rd", "ra")


def united(parts: list[DataFrame], k: int, by: str = "question_id") -> DataFrame:
    """The best k results of several stores: each (question_id, memory_type, content, score, source_date) counts once by type and
    case-folded content, with its best score; ordered by score, then the later date, then content.
    """
    out = parts[0].select(by, "memory_type", "content", "score", "source_date")
    for p in parts[1:]:
        out = out.unionByName(p.select(by, "memory_type", "content", "score", "source_date"))
    key = [F.col(by), F.coalesce("memory_type", F.lit("")), casefold(F.trim(F.coalesce("content", F.lit(""))))]
    order = [F.desc("score"), F.desc_nulls_last("source_date"), F.asc("content")]
    once = out.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    return once.withColumn("rank_no", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank_no") <= k)
