"""Memories as Markdown files with front matter, one file for each, and an index of them."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

FIELDS = ("type", "scope", "summary", "status", "tags", "importance", "confidence")
SCHEMA = "id string, type string, scope string, content string, summary string, status string, tags array<string>, importance double, confidence double"
_FRONT = re.compile(r"^---\n(.*?)\n---\n\n?(.*)$", re.S)


def render(row: dict) -> str:
    """Front matter with JSON values (a subset of YAML), then the content."""
    lines = [f"{k}: {json.dumps(row[k], ensure_ascii=False)}" for k in FIELDS if row.get(k) is not None]
    return "---\n" + "\n".join([f"id: {json.dumps(row['id'])}", *lines]) + "\n---\n\n" + (row.get("content") or "")


def parse(name: str, text: str) -> dict:
    """The memory of one file; its name must be its id."""
    m = _FRONT.match(text.replace("\r\n", "\n"))
    if not m:
        raise ValueError(f"{name}: no front matter")
    out: dict = {k: None for k in ("id", *FIELDS)}
    for line in m[1].split("\n"):
        key, _, value = line.partition(":")
        value = value.strip()
        try:
            out[key.strip()] = json.loads(value) if value else None
        except json.JSONDecodeError:
            out[key.strip()] = value.strip("'\"")
    if out["id"] != name:
        raise ValueError(f"{name}: file name and id differ")
    return {**{k: out[k] for k in ("id", *FIELDS)}, "content": m[2]}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All *.md files of a folder, the index left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).where(~F.col("path").endswith("/INDEX.md")).select("path", F.col("content").cast("string").alias("text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.list_(pa.string()), pa.float64(), pa.float64()]

    def run(batches):
        for batch in batches:
            rows = [parse(p.rsplit("/", 1)[-1][:-3], t) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return files.mapInArrow(run, SCHEMA)


def write(df: DataFrame, folder: str) -> int:
    """One file for each memory, on Spark's default file system. Tasks render the files into a table beside the folder, which every executor can
    write; the driver then puts the files in place one at a time, so memory is that of one file. Returns the number written.
    """
    spark = df.sparkSession
    columns = [c for c in ("id", "content", *FIELDS) if c in df.columns]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.string()), pa.array([render(r) for r in rows], pa.string())], ["id", "text"])

    beside = f"{folder.rstrip('/')}/.rendered"
    df.select(*columns).mapInArrow(run, "id string, text string").write.mode("overwrite").parquet(beside)
    n = 0
    for r in spark.read.parquet(beside).toLocalIterator():
        files.write_text(spark, f"{folder}/{r.id}.md", r.text)
        n += 1
    files.remove(spark, beside)
    return n


def index(df: DataFrame) -> DataFrame:
    """The index as numbered lines: a heading with a count for active and archived memories, then a line for each, by id."""
    line = F.concat(F.lit("- ["), F.col("id"), F.lit("]("), F.col("id"), F.lit(".md) "), F.col("type"), F.lit(" / "), F.col("scope"), F.lit(": "), F.coalesce("summary", F.substring("content", 1, 80)))
    rows = df.where("status in ('active', 'archived')").select("status", F.lit(1).alias("level"), "id", line.alias("line"))
    heads = df.where("status in ('active', 'archived')").groupBy("status").agg(F.count("*").alias("n")).select("status", F.lit(0).alias("level"), F.lit("").alias("id"), F.concat(F.lit("## "), F.initcap("status"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return heads.unionByName(rows).orderBy("status", "level", "id").select("line")
