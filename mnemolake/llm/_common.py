"""Shared pieces: code-point arrays, rolling hashes, word sets, classes of equal rows, working tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.sources.working import materialize, workspace  # noqa: F401

_BASE = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- code points and hashes


@lru_cache(maxsize=4)
def class_table(kinds: tuple[str, ...]) -> np.ndarray:
    """Per code point the index + 1 of the first regex class in kinds that it belongs to, else 0."""
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything, at = "".join(map(chr, points)), np.array(points)
    for k, kind in reversed(list(enumerate(kinds))):
        for m in regex.finditer(f"(?:{kind})+", everything):
            out[at[m.start() : m.end()]] = k + 1
    return out


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the n + 1 bounds of the texts in it."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def _mixed(points: np.ndarray, salt: int) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(1 + salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(max(n, 1 << 16), step, dtype=np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


class Rolling:
    """Hashes of any span of a code-point array in constant time: prefix sums of a polynomial modulo 2**64 over mixed characters."""

    def __init__(self, points: np.ndarray, salt: int = 0):
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_mixed(points, salt) * _power("up", len(points)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _power("down", len(self.sums))[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def slices(items: list, size, limit: int):
    """Consecutive slices (start, end) of items whose sizes add up to about limit; one item at least."""
    start, total = 0, 0
    for i, x in enumerate(items):
        n = size(x)
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)


WORD = ("[\\p{L}\\p{N}]",)


def word_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of each text, one after another, and the n + 1 bounds.

    Words are runs of Unicode letters and numbers in the lower-cased text.
    """
    points, bounds = codepoints([t.lower() for t in texts])
    inside = class_table(WORD)[points] > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[edge < len(points)]
    first[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = Rolling(points).of(start, end)
    doc = np.searchsorted(bounds, start, side="right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set of word hashes (sorted); equal sets have equal keys."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    x = h * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    np.cumsum(x, out=sums[1:])
    out = sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(_BASE)
    return out ^ (out >> np.uint64(29))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def common_count(a: bytes, b: bytes, dtype=np.uint32) -> int:
    return len(np.intersect1d(np.frombuffer(a, dtype), np.frombuffer(b, dtype), assume_unique=True))


# ---------------------------------------------------------------- classes of equal rows

#: Members of a class in one block, about. Blocks are paired, so a task that pairs huge classes has BLOCK ** 2 pairs at a time.
BLOCK = 1024


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes (cls, blocks), dealt (cls, id, block, blocks)) of distinct members (cls, id)."""
    sizes = members.groupBy("cls").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return sizes, members.join(sizes, "cls").select("cls", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "blocks")


def linked(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y): every id of class a with every id of class b, for pairs (a, b, id_a, id_b) of class keys and distinct members (cls, id).

    A class that isn't in members has its pair's id_a or id_b as its only id. A pair of ids linked by several pairs of
    classes comes out several times.
    """
    sizes, dealt = _blocks(members)
    p = pairs.select("a", "b", "id_a", "id_b").join(sizes.toDF("a", "n_a"), "a", "left").join(sizes.toDF("b", "n_b"), "b", "left")
    p = materialize(p, "class-links")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    many = p.where("n_a is not null or n_b is not null").withColumn("i", blocks(F.col("n_a"))).withColumn("j", blocks(F.col("n_b")))

    def side(key: str, block: str, out: str) -> DataFrame:
        t = dealt.select(F.col("cls").alias(key), F.col("block").alias(block), "id")
        own = F.coalesce("id", F.when(F.col(f"n_{key}").isNull(), F.col(f"id_{key}")))
        return many.join(t, [key, block], "left").select("a", "b", "i", "j", own.alias(out)).where(F.col(out).isNotNull())

    both = side("a", "i", "x").join(side("b", "j", "y"), ["a", "b", "i", "j"]).select("x", "y")
    return both.unionByName(p.where("n_a is null and n_b is null").select(F.col("id_a").alias("x"), F.col("id_b").alias("y")))


def heads_of(members: DataFrame, cls: str, ident: str, k: int) -> DataFrame:
    """The k smallest ids of each class. row_number() <= k is limited before the shuffle, so a huge class costs k rows a task."""
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(ident))
    return members.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def expand(pairs: DataFrame | None, members: DataFrame, k: int | None = None) -> DataFrame:
    """Pairs of ids from pairs (a, b) of class keys and the members (cls, id) of classes that hold two ids or more.

    Members: distinct rows. A class that isn't in members has its key as its only id's class: pairs must then hold the ids
    itself in columns id_a, id_b. Every pair within a class and between two linked classes is returned, each once. Without pairs,
    classes aren't linked. No query gives k: with
    it, only pairs are returned in which at least one side is among the k smallest ids of its class.
    """
    if k is None:
        _, dealt = _blocks(members)
        left = dealt.select("cls", F.col("id").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
        right = dealt.select("cls", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
        inner = left.join(right, ["cls", "i", "j"]).where("i < j or x < y").select("x", "y")
        found = inner if pairs is None else linked(pairs, members).unionByName(inner)
        return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()
    heads = heads_of(members, "cls", "id", k)
    tops = heads.groupBy("cls").agg(F.max("id").alias("top"))
    flagged = members.join(tops, "cls").select("cls", "id", (F.col("id") <= F.col("top")).alias("head"))
    within = (
        heads.select("cls", F.col("id").alias("x"))
        .join(flagged.select("cls", F.col("id").alias("y"), "head"), "cls")
        .where((F.col("x") < F.col("y")) | (~F.col("head") & (F.col("x") != F.col("y"))))
        .select("x", "y")
    )

    def side(df: DataFrame, key: str, ident: str, table: DataFrame, tag: str) -> DataFrame:
        t = table.select(F.col("cls").alias(f"_c{tag}"), F.col("id").alias(f"_i{tag}"), F.col("head").alias(f"_h{tag}"))
        return df.join(t, df[key] == t[f"_c{tag}"], "left").withColumn(ident, F.coalesce(f"_i{tag}", ident)).drop(f"_c{tag}", f"_i{tag}")

    top = flagged.where("head")
    one = side(side(pairs, "a", "id_a", flagged, "a"), "b", "id_b", top, "b").select("id_a", "id_b")
    two = side(side(pairs, "a", "id_a", top, "a"), "b", "id_b", flagged, "b").where(~F.coalesce(F.col("_hb"), F.lit(True))).select("id_a", "id_b")
    both = one.unionByName(two).select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"))
    return both.unionByName(within.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).where("x <> y").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the undirected edges; root is the smallest node of its component.

    Alternating large-star and small-star steps on the edge table, each written to the shared folder, until a round changes no
    edge: then every edge leads from a node to its root. Nothing is collected.
    """
    kind = edges.schema[a].dataType
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u")
        small = hop.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, materialize(small, "edges")
        moved = e.join(before, ["u", "v"], "left_anti")
        if e.count() == before.count() and not moved.limit(1).count():  # both are distinct, so no edge is gone either
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root")).select(F.col("node").cast(kind), F.col("root").cast(kind))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
