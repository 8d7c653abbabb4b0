"""The most similar vectors of every vector of a collection: vantage-point trees, one per shard.

Vectors are put on the unit sphere, where cosine and distance order alike. A routing tree fitted on a bounded sample
splits the space by distance to vantage points; its leaves are the shards. Every vector is indexed in the shard it falls
in, and asks every shard that the triangle inequality cannot rule out: a side of a split is skipped if the vector's
distance to the vantage point is more than factor * radius beyond the split, radius being the distance that belongs to
the least similarity wanted. Factor one skips nothing that could hold a result (exact); smaller factors skip sides that
rarely do. Each shard is searched by a tree of its own, with the same rule, down to buckets compared as one matrix
product, and what is near enough is scored again in double precision. A pair seen from either side counts for both, so a pair
is missed only if both skip each other.

Where a tree on the sample has too few leaves for shards of the size wanted, each leaf gets a tree of its own, fitted by a task on
a sample of its own vectors; shards then keep their size up to SAMPLE / LEAF_SAMPLE squared shards.

Of the points tried as vantage points, and the splits between their quantiles 0.3 and 0.7, the one with the fewest
vectors near the split is taken.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import heads_of, materialize, signed

#: Vectors the routing tree is fitted on at most, vectors of a shard aimed at, sample vectors of a leaf at least.
SAMPLE, SHARD, LEAF_SAMPLE = 32_768, 20_000, 24
#: Vectors of a bucket, vantage points tried for a split.
BUCKET, TRIED = 256, 48
#: Part of the radius that the triangle inequality is relaxed to: between shards, where a visit costs a copy of the vector, and
#: within one, where it costs a comparison only, LOCAL times as much (one at most).
FACTOR, LOCAL = 0.05, 2.5
#: Unit vectors are kept as 24-bit numbers of this scale: a cosine is off by 1e-6 at most, by 1e-7 as a rule.
SCALE = (1 << 23) - 1
#: What a cosine in single precision is off by at most.
SINGLE = 1e-5
#: Keys of a table that is broadcast at most; partitions that shards are dealt to at most.
SMALL, PARTITIONS = 500_000, 20_000
#: Pairs scored again at once.
SLAB = 1 << 17
#: Vectors of a coarse leaf that one task gives their shards, about.
DEALT = 200_000
DIMENSION, NEIGHBOURS, LEAST = 64, 5, 0.85
#: Decimals of a cosine; equal ones are ties.
DECIMALS = 6


def unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their unit vectors): finite and not all zero."""
    x = np.asarray(matrix, dtype=np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        top = np.abs(x).max(axis=1) if x.shape[1] else np.zeros(len(x))
        ok = np.flatnonzero(np.isfinite(top) & (top > 0))
        x = x[ok] / top[ok, None]
    return ok, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each direction, equal for vectors that agree to 5 decimals once normed."""
    grid = np.rint(x * 1e5).astype(np.int64).view(np.uint64) + np.uint64(1 << 40)
    weight = np.cumsum(np.full(x.shape[1], 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)
    h = (grid ^ (grid >> np.uint64(11))) * weight
    h ^= h >> np.uint64(31)
    h = (h * np.uint64(0xD6E8FEB86659FD93)).sum(axis=1, dtype=np.uint64)
    return signed(h ^ (h >> np.uint64(32)))


def parse_vector(text: str | None) -> list[float] | None:
    """The numbers of a JSON array; None if it isn't one."""
    try:
        v = json.loads(text)
        return [float(x) for x in v] if isinstance(v, list) and all(type(x) in (int, float) for x in v) else None
    except (TypeError, ValueError, OverflowError):
        return None


def usable_vectors(df: DataFrame, grp: str, ident: str, vector: str, time: str, dimension: int = DIMENSION) -> DataFrame:
    """(grp, id, at, cls, vec) of the usable rows: group and id not null, exactly `dimension` finite numbers, not all zero.

    vector is an array of numbers or a JSON text. vec: the unit vector, packed. cls: a key of its group and direction; directions that
    agree to five decimals count as equal.
    """
    source = df.select(F.col(grp).cast("string").alias("grp"), F.col(ident).cast("string").alias("id"), F.col(time).cast("timestamp").alias("at"), F.col(vector).alias("v")).where("grp is not null and id is not null and v is not null")

    def run(batches):
        for batch in batches:
            v = batch.column(3)
            if pa.types.is_string(v.type):
                parsed = [parse_vector(t) for t in v.to_pylist()]
                rows = np.array([i for i, x in enumerate(parsed) if x is not None and len(x) == dimension], dtype=np.int64)
                matrix = np.array([parsed[i] for i in rows], dtype=np.float64).reshape(-1, dimension)
            else:
                sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(sizes == dimension)
                matrix = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            ok, x = unit(matrix)
            take = pa.array(rows[ok])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array(_keys(x)), pa.array(packed(x), pa.binary())], ["grp", "id", "at", "cls", "vec"])

    return source.mapInArrow(run, "grp string, id string, at timestamp, cls bigint, vec binary").withColumn("cls", F.xxhash64("grp", "cls"))


def packed(x: np.ndarray) -> list[bytes]:
    """Unit vectors as 24-bit numbers, three bytes each."""
    raw = np.rint(x * SCALE).astype("<i4").view(np.uint8).reshape(*x.shape, 4)[:, :, :3]
    return [r.tobytes() for r in raw]


def unpacked(vecs: list[bytes]) -> np.ndarray:
    """The unit vectors (64-bit floats) of packed ones."""
    raw = np.zeros((len(vecs), len(vecs[0]) // 3, 4), np.uint8)
    raw[:, :, 1:] = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), -1, 3)
    x = (raw.view("<i4")[:, :, 0] >> 8).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- trees


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ v.T), 0))


def choose_split(x: np.ndarray, margin: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(vantage point, split distance) with the fewest of x within the margin of the split."""
    tried = x[rng.choice(len(x), min(TRIED, len(x)), replace=False)]
    best = (2.0, tried[0], 0.0)
    d = np.sort(_distances(x, tried), axis=0)
    low, high = int(0.3 * len(x)), max(int(0.3 * len(x)) + 1, int(0.7 * len(x)))
    at = np.unique(np.linspace(low, high - 1, 33).astype(int))
    for k in range(len(tried)):
        cut = (d[at, k] + d[np.minimum(at + 1, len(x) - 1), k]) / 2
        near = (np.searchsorted(d[:, k], cut + margin) - np.searchsorted(d[:, k], cut - margin)) / len(x)
        side = np.searchsorted(d[:, k], cut, side="right") / len(x)
        near = np.where((side <= 0) | (side >= 1), 2.0, near + 0.05 * np.abs(side - 0.5))
        i = int(near.argmin())
        if near[i] < best[0]:
            best = (float(near[i]), tried[k], float(cut[i]))
    return best[1], best[2]


class Tree:
    """Vantage points, splits and children; children below 0 are leaves (-1 - number)."""

    def __init__(self, x: np.ndarray, bucket: int, margin: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.margin, self.points, self.splits, self.children, self.leaves = margin, [], [], [], []
        self.root = self._grow(x, np.arange(len(x)), bucket, rng)
        self.points = np.array(self.points, dtype=np.float32).reshape(-1, x.shape[1])

    def _leaf(self, rows: np.ndarray) -> int:
        self.leaves.append(rows)
        return -len(self.leaves)

    def _grow(self, x: np.ndarray, rows: np.ndarray, bucket: int, rng) -> int:
        if len(rows) <= bucket:
            return self._leaf(rows)
        point, split = choose_split(x[rows], self.margin, rng)
        inside = _distances(x[rows], point[None])[:, 0] <= split
        if inside.all() or not inside.any():
            return self._leaf(rows)
        node = len(self.splits)
        self.points.append(point)
        self.splits.append(split)
        self.children.append([0, 0])
        self.children[node][0] = self._grow(x, rows[inside], bucket, rng)
        self.children[node][1] = self._grow(x, rows[~inside], bucket, rng)
        return node

    def visits(self, x: np.ndarray, margin: float):
        """(leaf, rows of x, whether the leaf is the row's own) for every leaf that a row must see."""
        todo = [(self.root, np.arange(len(x)), np.ones(len(x), dtype=bool))]
        while todo:
            node, rows, own = todo.pop()
            if node < 0:
                yield -1 - node, rows, own
                continue
            d = _distances(x[rows], self.points[node : node + 1])[:, 0] - self.splits[node]
            inside, outside = d <= margin, d > -margin
            for child, there, mine in ((self.children[node][0], inside, d <= 0), (self.children[node][1], outside, d > 0)):
                if there.any():
                    todo.append((child, rows[there], (own & mine)[there]))


def _best(q: np.ndarray, s: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Which of the pairs are among the k most similar of their q, ties with the k-th and what is less by slack included."""
    order = np.lexsort((-s, q))
    q, s = q[order], s[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    many = np.diff(np.append(start, len(q)))
    last = s[np.repeat(start + np.minimum(many, k) - 1, many)]
    return order[s >= last - slack]


def search_shard(indexed: np.ndarray, asking: np.ndarray, least: float, margin: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): rows of `asking` that see each other, each pair in both directions; only those that are among the k best of i here.

    indexed: rows of asking that belong to the shard.
    """
    single = asking.astype(np.float32)
    tree = Tree(single[indexed], BUCKET, margin)
    qs, xs, ss = [], [], []
    for leaf, rows, _ in tree.visits(single, margin):
        there = indexed[tree.leaves[leaf]]
        for a in range(0, len(rows), 4096):
            s = single[rows[a : a + 4096]] @ single[there].T
            i, j = np.nonzero(s >= least - SINGLE)
            q, y, s = rows[a + i], there[j], s[i, j]
            ok = q != y
            q, y, s = q[ok], y[ok], s[ok]
            if not len(q):
                continue
            near = np.unique(np.concatenate((_best(q, s, k, 2 * SINGLE), _best(y, s, k, 2 * SINGLE))))
            q, y = q[near], y[near]
            s = np.concatenate([np.einsum("ij,ij->i", asking[q[c : c + SLAB]], asking[y[c : c + SLAB]]) for c in range(0, len(q), SLAB)])
            s = np.round(s, DECIMALS)
            ok = s >= least
            q, y, s = q[ok], y[ok], s[ok]
            keep, other = _best(q, s, k), _best(y, s, k)
            qs += [q[keep], y[other]]
            xs += [y[keep], q[other]]
            ss += [s[keep], s[other]]
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, y, s = np.concatenate(qs), np.concatenate(xs), np.concatenate(ss)
    first = np.unique(q * np.int64(len(asking)) + y, return_index=True)[1]
    q, y, s = q[first], y[first], s[first]
    keep = _best(q, s, k)
    return q[keep], y[keep], s[keep]


ROUTED = "shard bigint, g bigint, cls bigint, own boolean, vec binary"


def _placed(tree: Tree, batch: pa.RecordBatch, margin: float, first: int = 0):
    """The rows of a batch (shard, g, cls, own, vec) once for each leaf of the tree that they must see; shard becomes first + leaf."""
    x = unpacked(batch.column("vec").to_pylist()).astype(np.float32)
    before = batch.column("own").to_numpy(zero_copy_only=False)
    for leaf, at, own in tree.visits(x, margin):
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + leaf)), batch.column("g").take(take), batch.column("cls").take(take), pa.array(own & before[at]), batch.column("vec").take(take)], ["shard", "g", "cls", "own", "vec"])


def _routed(classes: DataFrame, sample: list[bytes], n: int, margin: float) -> DataFrame:
    """ROUTED rows of n classes (g, cls, vec): each in the shard it is indexed in (own), and in those it must ask."""
    spark = classes.sparkSession
    shards, most = max(1, math.ceil(n / SHARD)), max(1, SAMPLE // LEAF_SAMPLE)
    x = unpacked(sample).astype(np.float32) if sample else np.zeros((0, 1), np.float32)
    shared = spark.sparkContext.broadcast(Tree(x, max(LEAF_SAMPLE, math.ceil(len(x) / shards)), margin))  # at most SAMPLE / LEAF_SAMPLE points

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _placed(shared.value, batch, margin)

    rows = classes.select(F.lit(0).cast("bigint").alias("shard"), "g", "cls", F.lit(True).alias("own"), "vec").mapInArrow(route, ROUTED)
    if shards <= most:
        return rows
    rows = materialize(rows, "vector-leaves")
    share, each = min(1.0, SAMPLE * most / n), math.ceil(n / most)

    def fit(table: pa.Table) -> pa.Table:
        x = unpacked(table.column("vec").to_pylist()[: 2 * SAMPLE]).astype(np.float32)
        tree = Tree(x, max(LEAF_SAMPLE, math.ceil(len(x) * SHARD / max(1, len(x) / share))), margin)
        return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    picked = rows.where(F.col("own") & (F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    trees = materialize(picked.groupBy("shard").applyInArrow(fit, "shard bigint, tree binary"), "vector-trees")
    parts = math.ceil(each / DEALT)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int")).withColumn("tree", F.lit(None).cast("binary"))
    heads = trees.select("shard", F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("bigint").alias("cls"), F.lit(None).cast("boolean").alias("own"), F.lit(None).cast("binary").alias("vec"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "tree")

    def again(batches):
        """A leaf's tree comes before its rows; a leaf without one is a shard as it is."""
        tree, leaf = None, None
        for batch in batches:
            at = batch.column("shard").to_numpy()
            blobs = batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | blobs[1:] | blobs[:-1])))
            for a, b in zip(edges, [*edges[1:], len(at)]):
                if blobs[a]:
                    tree, leaf = pickle.loads(batch.column("tree")[a].as_py()), at[a]
                elif leaf == at[a]:
                    yield from _placed(tree, batch.slice(a, b - a), margin, (int(at[a]) + 1) << 32)
                else:
                    yield batch.slice(a, b - a).select(["shard", "g", "cls", "own", "vec"])

    both = heads.unionByName(dealt).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("tree").isNull())
    return both.select("shard", "g", "cls", "own", "vec", "tree").mapInArrow(again, ROUTED)


def neighbour_pairs(vectors: DataFrame, k: int = NEIGHBOURS, least: float = LEAST, factor: float = FACTOR, label: Column | None = None, sampled: Callable[[float], DataFrame] | None = None) -> DataFrame:
    """(grp, id_a, id_b), id_a < id_b, each once: one is in the other's list. A list holds the at most k other ids of the same group with
    the highest cosine of at least `least`, smaller ids first among equals.

    label: what the result calls a group, from column grp (its name if not given). sampled: vectors of a share of the rows by hash, if
    they can be had without parsing the others.

    vectors: as usable_vectors returns them. An id counts once, with its earliest vector. Equal vectors are one class: one
    of them is searched (a few if tasks hold copies; they meet in their shard), and the list of each copy is the smallest other ids of its class, then those of the others;
    a class of any size costs each of its copies k rows.
    """
    if not 0 < factor <= 1 or not -1 < least <= 1 or k < 1:
        raise ValueError("factor must be in (0, 1], least in (-1, 1], k at least 1")
    radius = math.sqrt(2 - 2 * least)
    margin, local = factor * radius, min(1.0, LOCAL * factor) * radius
    rows = materialize(vectors.select("grp", "id", "at", "cls").distinct(), "vector-rows")
    members = materialize(rows.groupBy("grp", "id").agg(F.min(F.struct("at", "cls")).alias("m")).select("grp", "id", F.col("m.cls").alias("cls")), "vector-members")
    heads = materialize(heads_of(members, "cls", "id", k + 1).groupBy("cls").agg(F.first("grp").alias("grp"), F.array_sort(F.collect_list("id")).alias("ids")), "vector-classes")
    dead = materialize(rows.select("cls").distinct().join(heads, "cls", "left_anti"), "vector-dead")  # those of later vectors of an id only
    n = heads.count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = F.pmod(F.xxhash64("grp", "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    drawn = (sampled(share) if sampled else vectors.where(some)).select("cls", "vec").limit(2 * SAMPLE).collect()
    many = dead.count()
    alive = vectors if not many else vectors.join(F.broadcast(dead) if many <= SMALL else dead, "cls", "left_anti")
    alive = alive.select("grp", "cls", "vec")

    def first(batches):
        """A task's rows with each class once: a class of many copies has a row for each task, not for each copy."""
        seen: set[int] = set()
        for batch in batches:
            cls = batch.column(1).to_numpy()
            at = np.unique(cls, return_index=True)[1]
            at = np.array([i for i in at if cls[i] not in seen], dtype=np.int64)
            seen.update(cls[at].tolist())
            yield batch.take(pa.array(at))

    kept = alive.mapInArrow(first, "grp string, cls bigint, vec binary").select(F.xxhash64("grp").alias("g"), "cls", "vec")

    def search(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(table.column("cls").to_numpy(), return_index=True)[1]))
        x = unpacked(table.column("vec").to_pylist())
        own = table.column("own").to_numpy()
        i, j, s = search_shard(np.flatnonzero(own), x, least, local, k) if own.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        cls = table.column("cls").to_numpy()
        return pa.table({"q": cls[i], "x": cls[j], "s": s})

    routed = _routed(kept, list({r.cls: r.vec for r in drawn}.values()), n, margin)
    parts = min(PARTITIONS, max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * math.ceil(n / SHARD)))
    seen = routed.repartition(parts, "shard", "g").groupBy("shard", "g").applyInArrow(search, "q bigint, x bigint, s double")
    # one shuffle by q serves both the groups (q, x) and the ranks within q
    ranked = seen.repartition("q").groupBy("q", "x").agg(F.max("s").alias("s")).withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= k)
    entry = F.transform("ids", lambda i: F.struct((-F.col("s")).alias("s"), i.alias("id")))
    others = ranked.join(heads.select(F.col("cls").alias("x"), "ids"), "x").groupBy(F.col("q").alias("cls")).agg(F.flatten(F.collect_list(entry)).alias("others"))
    none = F.array().cast("array<struct<s:double,id:string>>")
    mine = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("s"), i.alias("id")))
    lists = heads.join(others, "cls", "left").select("grp", "cls", "ids", F.slice(F.array_sort(F.concat(mine, F.coalesce("others", none))), 1, k + 1 + k).alias("all"))

    def best(me):
        return F.slice(F.filter("all", lambda e: e["id"] != me), 1, k)

    head = lists.select("grp", F.explode("ids").alias("me"), "all").select("grp", "me", F.explode(best(F.col("me"))["id"]).alias("other"))
    large = lists.where(F.size("ids") > k).select("cls", "ids", "all")
    rest = members.select("grp", "cls", F.col("id").alias("me")).join(large, "cls").where(~F.array_contains("ids", F.col("me"))).select("grp", "me", F.explode(best(F.col("me"))["id"]).alias("other"))
    named = (F.col("grp") if label is None else label).alias("grp")
    return head.unionByName(rest).select(named, F.least("me", "other").alias("id_a"), F.greatest("me", "other").alias("id_b")).distinct()


def both_collections(chunks: DataFrame, cache: DataFrame, share: float = 1.0) -> DataFrame:
    """The usable vectors of chunks, one group, and of the embedding cache, a group for each namespace; of a share of the ids, by hash, if given."""
    some = lambda ident: F.pmod(F.xxhash64(ident), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    a = usable_vectors(chunks.where(some("memory_id")).withColumn("_grp", F.lit("chunk")), "_grp", "memory_id", "content_embedding", "ingested_at")
    b = usable_vectors(cache.where(some("cache_key")).withColumn("_grp", F.concat(F.lit("cache:"), "namespace_id")), "_grp", "cache_key", "vector_json", "created_at")
    return a.unionByName(b)
