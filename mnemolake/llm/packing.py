"""Filling containers of fixed capacity with whole documents, neighbours along a Hilbert curve going together.

A document's tokens are hashed to a vector and projected to DIMS dimensions; the Hilbert index of the projection is the
sort key, so documents with similar words lie near each other on the curve. The corpus is range-sorted by that key and
each range is packed in one streaming pass: short windows of documents along the curve, largest first, each into the fullest
open container that still has room. A container is closed once it is full or began REACH documents ago, so its
documents come from one short stretch of the curve. Only a document above the capacity is split: into pieces of exactly the capacity and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices
from .encoding import SLICE, VOCABULARY, encoder

DIMS, BITS = 4, 15
#: Documents placed together, largest first; documents along the curve after which a container is closed; documents of a range, about, at
#: most; documents a task lays out at once.
WINDOW, REACH, RANGE, CHUNK = 256, 1024, 2_000_000, 8192


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims) with coordinates below 2**bits: Skilling's transform, an axis at a time for all points."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _directions(tokens: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random direction for each token id."""
    h = (tokens[:, None].astype(np.uint64) * np.uint64(DIMS) + np.arange(DIMS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return (h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - np.float32(1)


def curve_keys(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from the direction of its token counts; 0 for documents without tokens."""
    many = np.diff(bounds)
    sums = np.zeros((len(ids) + 1, DIMS), dtype=np.float64)
    np.cumsum(_directions(ids), axis=0, out=sums[1:])
    v = sums[bounds[1:]] - sums[bounds[:-1]]
    v /= np.sqrt(np.maximum(many, 1))[:, None]
    grid = ((np.tanh(v) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
    return np.where(many > 0, hilbert(grid), 0)


def sizes_and_keys(df: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, curve) of each row; a null or empty text has 0 tokens."""
    source = df.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, len, SLICE):
                ids, bounds = e.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(curve_keys(ids, bounds))], ["doc_id", "n_tokens", "curve"])

    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, curve bigint")


class Packer:
    """Open containers of one capacity, ordered by the room left."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.room, self.next, self.began, self.seen = capacity, [], first, {}, 0

    def place(self, sizes: list[int]) -> list[int]:
        """Container number of each item of a stretch of the curve."""
        out = [0] * len(sizes)
        room = self.room
        for a in range(0, len(sizes), WINDOW):
            b = min(a + WINDOW, len(sizes))
            for i in sorted(range(a, b), key=lambda i: -sizes[i]):
                n = sizes[i]
                k = bisect_left(room, (n, -1))
                if k < len(room):
                    left, c = room.pop(k)
                else:
                    left, c = self.capacity, self.next
                    self.next += 1
                    self.began[c] = self.seen
                out[i] = c
                insort(room, (left - n, c))
            self.seen += b - a
            room[:] = [(left, c) for left, c in room if left and self.seen - self.began[c] < REACH]
            self.began = {c: self.began[c] for _, c in room}
        return out


def pack(df: DataFrame, capacities: dict[str, int], ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, partitions: int | None = None) -> DataFrame:
    """(container_kind, container, doc_id, piece, first_token, n_tokens, place) for every row of df and every capacity.

    container is unique within its kind. Every row is assigned, one of 0 tokens takes no room; repeated rows are packed
    as often as they come. Pieces of a split document cover its tokens in order. place is the document's number along the curve; in one container places lie less
    than REACH + WINDOW apart. Equal curve keys are spread over ranges
    by doc_id, so a text that makes up a third of the corpus doesn't end in one range.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    spark = df.sparkSession
    sized = materialize(sizes_and_keys(df, ident, text, vocabulary), "sizes")  # the range sort reads it twice
    kind = sized.schema["doc_id"].dataType.simpleString()
    n = partitions or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-sized.count() // RANGE))
    ordered = sized.repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").withColumn("part", F.spark_partition_id())
    names = ["container_kind", "container", "doc_id", "piece", "first_token", "n_tokens", "place"]

    def run(batches):
        packers: dict[str, Packer] = {}

        def chunk(t: pa.Table, first: int):
            docs, tokens, part = t.column("doc_id").combine_chunks(), t.column("n_tokens").to_pylist(), t.column("part")[0].as_py()
            for name, capacity in capacities.items():
                p = packers.setdefault(name, Packer(capacity, part << 40))
                rows, pieces, firsts, counts, boxes = [], [], [], [], []
                rest_at, rest = [], []
                for i, size in enumerate(tokens):
                    full = size // capacity if size > capacity else 0
                    for k in range(full):
                        rows.append(i), pieces.append(k), firsts.append(k * capacity), counts.append(capacity), boxes.append(p.next)
                        p.next += 1
                    left = size - full * capacity
                    if left or not full:
                        rest_at.append(len(rows))
                        rest.append(left)
                        rows.append(i), pieces.append(full), firsts.append(full * capacity), counts.append(left), boxes.append(-1)
                for at, box in zip(rest_at, p.place(rest)):
                    boxes[at] = box
                place = np.array(rows, dtype=np.int64) + (part << 40) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array(boxes, pa.int64()), docs.take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), pa.array(place)], names
                )

        held, many, seen = [], 0, 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= CHUNK:
                yield from chunk(pa.Table.from_batches(held).combine_chunks(), seen)
                held, many, seen = [], 0, seen + many
        if many:
            yield from chunk(pa.Table.from_batches(held).combine_chunks(), seen)

    return ordered.mapInArrow(run, f"container_kind string, container bigint, doc_id {kind}, piece int, first_token bigint, n_tokens bigint, place bigint")
