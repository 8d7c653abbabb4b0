"""Embedding of texts through a cache table, and model and reader clients behind one interface."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.text import TERM

#: text batch -> matrix (n, dimension)
Embedder = Callable[[list[str]], np.ndarray]
CACHE = "cache_key string, namespace_id string, text_hash string, dimension int, vector array<double>"


def hashing_embedder(dimension: int = 64) -> Embedder:
    """A stand-in where no model is at hand: signed hashes of the terms, normed. Deterministic, the same on every worker."""
    import regex
    import xxhash

    word = regex.compile(TERM)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in word.findall(t.casefold()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dimension] += 1.0 if h >> 63 else -1.0
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(size == 0, 1.0, size)

    return embed


def http_embedder(url: str, model: str, key: str | None = None, timeout: float = 60.0) -> Embedder:
    """An embedding service that speaks the common /v1/embeddings protocol."""

    def embed(texts: list[str]) -> np.ndarray:
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        body = json.dumps({"model": model, "input": texts}).encode()
        with urlopen(Request(f"{url.rstrip('/')}/v1/embeddings", body, head), timeout=timeout) as r:
            rows = sorted(json.load(r)["data"], key=lambda x: x["index"])
        if len(rows) != len(texts):
            raise ValueError("the service returned another number of vectors")
        return np.array([x["embedding"] for x in rows], dtype=np.float64)

    return embed


def cache_key(namespace: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(namespace), F.char(F.lit(0)), text), 256)


def embed_missing(texts: DataFrame, cache: DataFrame, namespace: str, embedder: Embedder, batch: int = 256) -> DataFrame:
    """Cache rows (CACHE) of the distinct texts of `texts` (column text) that the cache lacks; each is embedded once."""
    todo = texts.where("text is not null").select("text").distinct().withColumn("cache_key", cache_key(namespace, F.col("text"))).join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = embedder(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([namespace] * len(v), pa.string()), part.column(0), pa.array([v.shape[1]] * len(v), pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], [c.split()[0] for c in CACHE.split(", ")])

    return todo.select("cache_key", "text").mapInArrow(run, CACHE)


class EmbeddingCache:
    """A Parquet table of vectors by namespace and text; look-ups are joins, misses are embedded and appended.

    counts: texts found and texts embedded since the cache was opened, each different text of a call once.
    """

    def __init__(self, spark: SparkSession, folder: str, namespace: str, embedder: Embedder):
        self.spark, self.folder, self.namespace, self.embedder = spark, folder, namespace, embedder
        self.counts = {"hits": 0, "generated": 0}

    def table(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(CACHE).parquet(self.folder) if there else self.spark.createDataFrame([], CACHE)

    def fill(self, texts: DataFrame) -> None:
        asked, new = Observation(), Observation()
        seen = texts.where("text is not null").select("text").distinct().observe(asked, F.count(F.lit(1)).alias("n"))
        embed_missing(seen, self.table(), self.namespace, self.embedder).observe(new, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.folder)
        self.counts["generated"] += new.get["n"]
        self.counts["hits"] += max(0, asked.get["n"] - new.get["n"])

    def embed(self, df: DataFrame, text: str = "content") -> DataFrame:
        """df with embedding; null texts have none."""
        self.fill(df.select(F.col(text).alias("text")))
        keyed = df.withColumn("_key", cache_key(self.namespace, F.col(text)))
        return keyed.join(self.table().select(F.col("cache_key").alias("_key"), F.col("vector").alias("embedding")), "_key", "left").drop("_key")


#: prompts -> answers, or pairs of an answer and a usage report as JSON text
Reader = Callable[[list[str]], list[str] | list[tuple[str, str | None]]]


def answer(prompts: DataFrame, reader: Reader) -> DataFrame:
    """prompts (question_id, prompt) with prediction, usage and token counts, by a reader called once a batch. Counts are the reported ones,
    estimates where there are none.
    """
    from mnemolake.functions.text import estimate_tokens
    from mnemolake.operators.cost import usage_or_estimate

    def run(batches):
        for b in batches:
            told = [x if isinstance(x, tuple) else (x, None) for x in reader(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in told], pa.string()), pa.array([u for _, u in told], pa.string())], ["question_id", "prompt", "prediction", "usage"])

    out = prompts.select("question_id", "prompt").mapInArrow(run, "question_id string, prompt string, prediction string, usage string")
    counts = {"input": estimate_tokens(F.col("prompt")), "output": estimate_tokens(F.coalesce("prediction", F.lit("")))}
    return out.withColumns({f"{k}_tokens": usage_or_estimate(F.col("usage"), k, v) for k, v in counts.items()})


def http_models(url: str, key: str | None = None, timeout: float = 60.0) -> list[str]:
    """Names of the models that a service offers at /v1/models."""
    from urllib.request import Request, urlopen

    head = {"Authorization": f"Bearer {key}"} if key else {}
    with urlopen(Request(f"{url.rstrip('/')}/v1/models", headers=head), timeout=timeout) as r:
        return sorted(str(m["id"]) for m in json.load(r).get("data", []))


def chat_reader(url: str, model: str, key: str | None = None, retries: int = 3, timeout: float = 120.0) -> Reader:
    """A chat service that speaks the common /v1/chat/completions protocol, with its usage reports; server errors are tried again."""

    def ask(prompts: list[str]) -> list[tuple[str, str | None]]:
        import time
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        out = []
        for p in prompts:
            body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": p}]}).encode()
            for n in range(retries):
                try:
                    with urlopen(Request(f"{url.rstrip('/')}/v1/chat/completions", body, head), timeout=timeout) as r:
                        got = json.load(r)
                        out.append((got["choices"][0]["message"]["content"], json.dumps(got["usage"]) if got.get("usage") else None))
                    break
                except (HTTPError, URLError) as e:
                    if isinstance(e, HTTPError) and e.code < 500 or n + 1 == retries:
                        raise
                    time.sleep(2**n)
        return out

    return ask


def candidates(events: DataFrame, extractor: Reader, most: int = 5) -> DataFrame:
    """(event_id, n, content, type, importance, confidence): up to `most` memory candidates of each event (event_id, content),
    from a model's JSON; what isn't JSON gives none, unknown types read semantic.
    """

    def run(batches):
        import re

        for b in batches:
            rows = []
            for event, text in zip(b.column(0).to_pylist(), extractor([t or "" for t in b.column(1).to_pylist()])):
                text = text[0] if isinstance(text, tuple) else text
                m = re.search(r"[\[{].*[\]}]", text or "", re.S)
                try:
                    data = json.loads(m[0]) if m else []
                except json.JSONDecodeError:
                    data = []
                data = data.get("memories", [data]) if isinstance(data, dict) else data
                good = [x for x in data if isinstance(x, dict) and str(x.get("content") or "").strip()]
                for n, x in enumerate(good[:most]):
                    kind = x.get("type") if x.get("type") in ("semantic", "episodic", "procedural", "reflective", "resource") else "semantic"
                    number = lambda k, d: float(x[k]) if isinstance(x.get(k), (int, float)) else d  # noqa: B023, E731
                    rows.append((event, n, str(x["content"]).strip(), kind, number("importance", 0.7), number("confidence", 0.5)))
            c = list(zip(*rows)) or [[]] * 6
            kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(c, kinds)], ["event_id", "n", "content", "type", "importance", "confidence"])

    kind = events.schema["event_id"].dataType.simpleString()
    return events.select("event_id", "content").mapInArrow(run, f"event_id {kind}, n int, content string, type string, importance double, confidence double")
