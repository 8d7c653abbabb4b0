"""A versioned memory store over DataFrames: an append-only log of operations, and views derived from it.

Each row of the log is the whole state of one memory after one operation. Versions, the current state and history are
window views of the log; nothing is updated in place, so a lost task is simply run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemolake.functions.numbers import cosine, rank_score
from mnemolake.functions.text import merge_paragraphs, merge_summaries
from mnemolake.sources import files

Embedder = Callable[[list[str]], np.ndarray]

FILTERS = ("include_archived", "scope", "status", "tags", "type")
OPERATIONS = ("ADD", "UPDATE", "MERGE", "ARCHIVE", "COMPRESS", "RETRIEVE", "IGNORE", "DELETE", "SPLIT", "EXPIRE", "LOCK", "PROMOTE", "DEMOTE", "PIN", "DREAM", "VERIFY")
UNSUPPORTED = ("COMPRESS", "DELETE", "SPLIT", "EXPIRE", "LOCK", "PROMOTE", "DEMOTE", "PIN", "DREAM", "VERIFY")
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("content", T.StringType()), T.StructField("summary", T.StringType()),
        T.StructField("content_embedding", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("importance", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("access_count", T.LongType()), T.StructField("related", T.ArrayType(T.StringType())), T.StructField("supersedes", T.ArrayType(T.StringType())),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
LOG = T.StructType([*MEMORY.fields, T.StructField("op", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("seq", T.LongType())])

AUDIT = T.StructType([T.StructField("op", T.StringType()), T.StructField("decided", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("at", T.TimestampType())])


def versions(log: DataFrame, ident: str, *order: Column) -> DataFrame:
    """The log with version, counted from 1 within each memory."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy(ident).orderBy(*order)))


def current(log: DataFrame, ident: str, *order: str) -> DataFrame:
    """The last row of each memory in the given order: an aggregate, combined before the shuffle."""
    rest = [c for c in log.columns if c != ident]
    return log.groupBy(ident).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(ident, "_last.*")


def matches(scope: str | None = None, status: str | None = None, type: str | None = None, tags: list[str] | None = None, include_archived: bool = False) -> Column:
    """The store's filter as one predicate, pushed to the scan: equality, all tags held, active only unless asked otherwise."""
    ok = F.lit(True)
    for name, value in (("scope", scope), ("status", status), ("type", type)):
        if value is not None:
            ok = ok & (F.col(name) == value)
    if status is None and not include_archived:
        ok = ok & (F.col("status") == "active")
    if tags:
        ok = ok & (F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return ok


def hydrate(hits: DataFrame, truth: DataFrame, ident: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """(hits found in the source of truth, with rank scores over what was found; hits that are missing there)."""
    found = hits.join(truth, ident)
    w = Window.partitionBy(*by)
    scored = found.withColumn("rank_score", F.round(rank_score(F.row_number().over(w.orderBy("rank_no")) - 1, F.count("*").over(w)), 6))
    return scored, hits.join(truth.select(ident), ident, "left_anti")


def merge(log: DataFrame, target: str = "target_id") -> DataFrame:
    """(target_id, content, summary, related) of rows (target_id, ord, id, content, summary, related, supersedes): the texts in
    order, each paragraph once; related ids without the target and what it supersedes.
    """
    rows = log.groupBy(target).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "content", "summary", "related", "supersedes"))).alias("r"))
    ids = F.array_union(F.flatten(F.transform("r", lambda x: F.coalesce(x["related"], F.array().cast("array<string>")))), F.transform("r", lambda x: x["id"]))
    gone = F.flatten(F.transform("r", lambda x: F.coalesce(x["supersedes"], F.array().cast("array<string>"))))
    return rows.select(
        target,
        merge_paragraphs(F.transform("r", lambda x: x["content"])).alias("content"),
        merge_summaries(F.transform("r", lambda x: x["summary"])).alias("summary"),
        F.array_sort(F.array_except(F.array_except(F.array_distinct(ids), gone), F.array(target))).alias("related"),
    )


class MemoryStore:
    """The log as a Parquet table in a folder. Every write appends one batch; readers see whole batches only.

    A batch's number is claimed by making a file that must not be there yet, so two writers never get the same one and no write reads
    the log for it. compact() writes a new table and then names it in a small file, which is what readers look up.
    Decisions are kept in an audit table of their own. embedder: gives new vectors to memories whose content changes.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder | None = None):
        self.spark, self.folder, self.embedder, self.found = spark, folder.rstrip("/"), embedder, None

    @property
    def path(self) -> str:
        return f"{self.folder}/{files.read_text(self.spark, f'{self.folder}/CURRENT') or 'log'}"

    def log(self) -> DataFrame:
        path = self.path
        return self.spark.read.schema(LOG).parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], LOG)

    def all(self) -> DataFrame:
        return current(self.log().where("op in ('ADD', 'UPDATE', 'MERGE', 'ARCHIVE')"), "id", "seq")

    def audit(self) -> DataFrame:
        path = f"{self.folder}/audit"
        return self.spark.read.schema(AUDIT).parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], AUDIT)

    def _note(self, op: str, decided: str, reason: str, score: float | None, confidence: float | None) -> None:
        row = [(op, decided, reason, score, confidence, datetime.now(timezone.utc))]
        self.spark.createDataFrame(row, AUDIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/audit")

    def _claim(self) -> int:
        """The next number of a batch, for this writer alone."""
        n = 1 + max((int(x) for x in files.names(self.spark, f"{self.folder}/claims") if x.isdigit()), default=0)
        while not files.create(self.spark, f"{self.folder}/claims/{n}"):
            n += 1
        return n

    def _append(self, rows: DataFrame, op: str | Column, reason: str) -> None:
        for f in MEMORY.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        rows.select(*[F.col(f.name).cast(f.dataType) for f in MEMORY.fields], F.lit(op).alias("op"), F.lit(reason).alias("reason"), F.lit(self._claim()).cast("bigint").alias("seq")).write.mode("append").parquet(self.path)

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """rows whose vector is null with one of their content, if there is an embedder."""
        if self.embedder is None:
            return rows
        embedder = self.embedder

        @F.pandas_udf("array<double>")
        def embed(text: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(embedder([t or "" for t in text]), dtype=np.float64)))

        return rows.withColumn("content_embedding", F.coalesce("content_embedding", F.when(F.col("content").isNotNull(), embed("content"))))

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table beside the log: later writes don't change it, and nothing is collected."""
        path = f"{self.folder}/work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, rows: DataFrame, reason: str = "added") -> None:
        """Append new memories; an id that isn't well formed, comes twice or is there already is an error and nothing is written."""
        if rows.where(~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False))).limit(1).count():
            raise ValueError("invalid memory id")
        if rows.groupBy("id").count().where("count > 1").limit(1).count() or rows.join(self.all(), "id", "left_semi").limit(1).count():
            raise ValueError("memory id exists")
        for name, value in (("status", "active"), ("access_count", 0)):
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
        self._append(rows, "ADD", reason)

    def update(self, patch: DataFrame, op: str = "UPDATE", reason: str = "updated") -> None:
        """patch: id and the columns to change; null leaves a value. A changed content without a new vector is embedded again, or has none without an embedder."""
        fields = [c for c in patch.columns if c != "id"]
        if not fields or set(fields) - {f.name for f in MEMORY.fields}:
            raise ValueError("a patch needs known fields")
        if patch.join(self.all(), "id", "left_anti").limit(1).count():
            raise KeyError("unknown memory")
        new = patch.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
        rows = self.all().drop("op", "reason", "seq").join(new, "id")
        if "content" in fields and "content_embedding" not in fields:
            rows = rows.withColumn("content_embedding", F.when(F.col("_content").isNull() | (F.col("_content") == F.col("content")), F.col("content_embedding")))
        for c in fields:
            rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
        rows = rows.drop(*[f"_{c}" for c in fields])
        self._append(self._embedded(rows) if "content" in fields else rows, op, reason)

    def upsert(self, rows: DataFrame, reason: str) -> bool:
        """Add the memories that aren't there and update the others, as one batch that is written whole or not at all. A reason that the log
        has already is a batch delivered again: nothing is written and False returned.
        """
        if not self.log().where(F.col("reason") == reason).isEmpty():
            return False
        fields = [c for c in rows.columns if c != "id" and c in MEMORY.fieldNames()]
        new = rows.dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"_{c}") for c in fields])
        j = new.join(self.all().drop("op", "reason", "seq").withColumn("_known", F.lit(True)), "id", "left")
        if "content" in fields and "content_embedding" not in fields:
            j = j.withColumn("content_embedding", F.when(F.col("_content").isNull() | (F.col("_content") == F.col("content")), F.col("content_embedding")))
        for c in fields:
            j = j.withColumn(c, F.coalesce(f"_{c}", c))
        j = j.withColumns({"status": F.coalesce("status", F.lit("active")), "access_count": F.coalesce("access_count", F.lit(0).cast("bigint")), "_op": F.when(F.col("_known"), "UPDATE").otherwise("ADD")})
        self._append(self._embedded(j.drop(*[f"_{c}" for c in fields])), F.col("_op"), reason)
        return True

    def archive(self, ids: DataFrame, reason: str = "archived") -> None:
        """Flip the status of the given ids; what is archived already stays as it is."""
        rows = self.all().where("status <> 'archived'").join(ids.select("id").distinct(), "id", "left_semi").drop("op", "reason", "seq")
        self._append(rows.withColumn("status", F.lit("archived")), "ARCHIVE", reason)

    def delete(self, ids: DataFrame) -> None:
        """Memories are never removed: a delete is an archive with its own reason."""
        self.archive(ids, "deleted (archived)")

    def merge(self, plan: DataFrame, reason: str = "merged") -> None:
        """plan: target_id, source_id, ord. The target takes the merged text and links, the sources are archived."""
        rows = plan.select("target_id", "ord", F.col("source_id").alias("id")).unionByName(plan.select("target_id", F.lit(-1).cast("int").alias("ord"), F.col("target_id").alias("id")).distinct())
        merged = merge(rows.join(self.all(), "id")).withColumnRenamed("target_id", "id")
        sources = self._kept(plan.select(F.col("source_id").alias("id")).distinct(), "merged")
        self.update(merged, "MERGE", reason)
        self.archive(sources, "merged into another memory")

    def list(self, **filters) -> DataFrame:
        if set(filters) - set(FILTERS):
            raise ValueError(f"unknown filter: {sorted(set(filters) - set(FILTERS))}")
        return self.all().where(matches(**filters)).orderBy("id")

    def get(self, ident: str) -> DataFrame:
        return self.all().where(F.col("id") == ident)

    def history(self, ident: str) -> DataFrame:
        return versions(self.log().where(F.col("id") == ident), "id", F.asc("seq"))

    def search_vector(self, query: list[float], k: int, **filters) -> DataFrame:
        """The k active memories of highest cosine above 0, then by id."""
        v = F.array(*[F.lit(float(x)) for x in query])
        return self.all().where(matches(**filters)).withColumn("score", F.round(cosine(v, F.col("content_embedding")), 9)).where("score > 0").orderBy(F.desc("score"), "id").limit(k)

    def search_text(self, query: str, k: int, **filters) -> DataFrame:
        from .ranking import lexical

        return lexical(self.all().where(matches(**filters)), query).where("score > 0").orderBy(F.desc("score"), "id").limit(k)

    def retrieve(self, query: str | list[float], k: int, **filters) -> DataFrame:
        return self.search_text(query, k, **filters) if isinstance(query, str) else self.search_vector(query, k, **filters)

    def execute(self, op: str, passed: bool, reason: str = "", score: float | None = None, confidence: float | None = None, **inputs) -> str:
        """Apply one decided operation; a failed or IGNORE decision changes nothing. Every one leaves a row in the audit table, also RETRIEVE,
        whose result is in `found`, and IGNORE.
        """
        if op not in OPERATIONS:
            raise ValueError(f"unknown operation {op}")
        if op != "IGNORE" and passed:
            if op in UNSUPPORTED:
                raise NotImplementedError(op)
            if op == "RETRIEVE":
                self.found = self.retrieve(**inputs) if inputs else None
            else:
                {"ADD": self.add, "UPDATE": self.update, "MERGE": self.merge, "ARCHIVE": self.archive}[op](**inputs)
            decided = op
        else:
            decided = "IGNORE"
        self._note(op, decided, reason, score, confidence)
        return decided

    def compact(self, history: bool = False) -> None:
        """Rewrite the log as one batch in a new table and name it as the current one; without history, older versions are dropped from it."""
        log = self.log()
        kept = log if history else log.join(self.all().select("id", "seq"), ["id", "seq"], "left_semi")
        name = f"log-{uuid.uuid4().hex}"
        kept.select(*LOG.fieldNames()).write.parquet(f"{self.folder}/{name}")
        files.write_text(self.spark, f"{self.folder}/CURRENT", name)


#: Fields of a memory that the index holds.
INDEXED = ("id", "type", "scope", "status", "content_embedding")


class HybridStore(MemoryStore):
    """A store with an index of its vectors in a table of its own, which follows every write. Found in the index, memories come from the log."""

    def _index_path(self) -> str:
        return f"{self.folder}/index"

    def indexed(self) -> DataFrame:
        """The current row of each memory in the index."""
        schema = T.StructType([f for f in LOG.fields if f.name in (*INDEXED, "seq")])
        there = files.exists(self.spark, self._index_path())
        return current(self.spark.read.schema(schema).parquet(self._index_path()) if there else self.spark.createDataFrame([], schema), "id", "seq")

    def _write_index(self, rows: DataFrame) -> None:
        rows.select(*INDEXED, "seq").write.mode("append").parquet(self._index_path())

    def _append(self, rows: DataFrame, op: str | Column, reason: str) -> None:
        super()._append(rows, op, reason)
        last = self.log().agg(F.max("seq")).first()[0]
        try:
            self._write_index(self.log().where(F.col("seq") == last))
        except Exception:
            if op == "ADD":  # what can't be found must not look stored
                failed = self._kept(self.log().where(F.col("seq") == last).drop("op", "reason", "seq"), "failed")
                super()._append(failed.withColumn("status", F.lit("archived")), "ARCHIVE", "the index could not be written")
            raise

    def reindex(self) -> int:
        """Put what the index lacks, or holds an older state of, into it; returns how many memories that were."""
        missing = self._kept(self.all().where("status = 'active'").join(self.indexed().select("id", "seq"), ["id", "seq"], "left_anti").select(*INDEXED, "seq"), "reindex")
        n = missing.count()
        if n:
            self._write_index(missing)
        return n

    def search_vector(self, query: list[float], k: int, **filters) -> DataFrame:
        """The k best of the index by cosine above 0, then by id, with their memories as the log has them; what the log lacks is left out."""
        v = F.array(*[F.lit(float(x)) for x in query])
        hits = self.indexed().where(matches(**filters)).withColumn("score", F.round(cosine(v, F.col("content_embedding")), 9)).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
        return self.all().join(F.broadcast(hits.select("id", "score")), "id").where(matches(**filters)).orderBy(F.desc("score"), "id")  # k rows
