"""Small text files on Spark's default file system, so that a driver and a cluster see the same ones."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it isn't there."""
    if not exists(spark, path):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content).decode()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place and renamed into it: a reader sees the old text or the new one, or for a moment none."""
    p, fs = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.new")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot write {path}")


def create(spark: SparkSession, path: str) -> bool:
    """Make an empty file that isn't there yet; False if it is. Of several writers one succeeds."""
    p, fs = _at(spark, path)
    fs.mkdirs(p.getParent())
    try:
        fs.create(p, False).close()
        return True
    except Exception as e:
        if fs.exists(p):
            return False
        raise OSError(f"cannot create {path}") from e


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none if it isn't there."""
    p, fs = _at(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.mkdirs(p)


def init_workspace(spark: SparkSession, folder: str) -> list[str]:
    """The folders and empty logs of a workspace. Made again nothing changes; logs are never cut off. Returns what was made."""
    made = []
    for name in ("memories", "benchmarks", "runs", "exports", "logs"):
        if not exists(spark, f"{folder}/{name}"):
            make_folder(spark, f"{folder}/{name}")
            made.append(name)
    for name in ("logs/operations.jsonl", "logs/events.jsonl"):
        if create(spark, f"{folder}/{name}"):
            made.append(name)
    return made
