"""Groups of records that share most of their wording, without pairwise comparison of the collection.

1. Each record is its set of distinct words; records with equal sets are one class, and only one of a class goes on.
2. A count sketch of how many classes hold each word, sized by the corpus up to a bound, gives a global order, rare words first. Two sets whose
   Jaccard similarity is at least t share a word among the first n - ceil(t n) + 1 of each (prefix filter, exact), so sets
   meet under their prefix words. A word held by one class only can't be shared and is skipped.
3. Sets that meet are compared bit-sliced: each has a sketch of 256 parity bits (one per word hash). The Hamming distance
   of two sketches never exceeds the number of words in which the sets differ, and similarity t allows at most
   (1 - t) / (1 + t) * (n_a + n_b) of those: the radius. 64 comparisons share a machine word; the planes of one bit each are
   added to vertical counters by carry-save adders, and words whose 64 comparisons all exceed their radius are abandoned.
4. What is left is verified on the sets themselves.
Steps 2 and 3 lose nothing; no bucket is capped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import common_count, components, expand, materialize, set_keys, signed, slices, word_sets

SLICE = 2_000_000
#: Cells of the count sketch, least and most (64 MB), and blocks it is added up in. A small sketch costs comparisons, never pairs.
CELLS, MOST, BLOCKS = 1 << 20, 1 << 24, 256
#: Parity bits of a sketch.
BITS = 256
#: Classes that meet under one word in one task. A word held by more is dealt to pairs of sub-groups of this size.
CROWD = 4096
#: Comparisons laid out at once; bounds memory only.
SLAB = 1 << 17


def word_table(df: DataFrame, ident: str, text: str, least: int) -> DataFrame:
    """(id, cls, n, words) of rows with an id and at least `least` distinct words; cls is a key of the set, words its sorted 32-bit hashes.

    The key is made of 64-bit word hashes. 32 bits verify similarity: a chance agreement of two different words within a
    pair of 100 words each has a probability of about 2e-6.
    """
    source = df.select(F.col(ident).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, len, SLICE):
                h, bounds = word_sets(texts[a:b])
                n = np.diff(bounds)
                keep = np.flatnonzero(n >= least)
                short = (h >> np.uint64(32)).astype(np.uint32)
                words = [np.unique(short[bounds[i] : bounds[i + 1]]).tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(keep)), pa.array(signed(set_keys(h, bounds))[keep]), pa.array(n[keep].astype(np.int32)), pa.array(words, pa.binary())], ["id", "cls", "n", "words"]
                )

    return source.mapInArrow(run, "id string, cls bigint, n int, words binary")


def classes_of(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes (cls, n, words), members (cls, id) distinct) of a word table."""
    return words.groupBy("cls").agg(F.max(F.struct("n", "words")).alias("s")).select("cls", "s.n", "s.words"), words.select("cls", "id").distinct()


def cells_for(classes: int) -> int:
    """Cells of the sketch of a number of classes: a power of two, four a class within the bounds."""
    return max(CELLS, min(MOST, 1 << (4 * classes - 1).bit_length() if classes else 1))


def count_sketch(classes: DataFrame, cells: int = CELLS) -> np.ndarray:
    """How many classes hold the words of each of the cells. Added up per block of cells; `cells` numbers reach the driver."""
    width = cells // BLOCKS

    def count(batches):
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
            total += np.bincount(x % cells, minlength=cells)
        rows = [(b, zlib.compress(total[b * width : (b + 1) * width].astype(np.uint32).tobytes(), 1)) for b in range(BLOCKS) if total[b * width : (b + 1) * width].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "counts"])

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [key[0]], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    parts = classes.select("words").mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros(cells, dtype=np.uint32)
    for r in parts.collect():  # BLOCKS rows of a fixed size
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return out


def _prefix(words: np.ndarray, bounds: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, its count in the sketch, row) of the prefix words of each set that may be held by another set too."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    held = counts[words % len(counts)]
    order = np.lexsort((words, held, row))
    words, held = words[order], held[order]
    place = np.arange(len(words)) - np.repeat(bounds[:-1], size)
    take = (place < np.repeat(size - np.ceil(t * size - 1e-9).astype(np.int64) + 1, size)) & (held > 1)
    return words[take], held[take], row[take]


def crowded_words(classes: DataFrame, sketch: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(words in order, exact numbers of classes) of the words that stand in the prefixes of more than CROWD classes. There are at most
    prefix words / CROWD of them; words whose cells of the sketch hold less aren't counted.
    """
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if sketch.max(initial=0) <= CROWD:
        return none
    shared = classes.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for batch in batches:
            raw = batch.column(0).to_pylist()
            bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw])))
            words, held, _ = _prefix(np.frombuffer(b"".join(raw), np.uint32), bounds, shared.value, t)
            w, n = np.unique(words[held > CROWD], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(n)], ["word", "n"])

    many = classes.select("words").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD).toArrow()
    if not many.num_rows:
        return none
    w, n = many.column("word").to_numpy().astype(np.uint32), many.column("n").to_numpy()
    order = np.argsort(w)
    return w[order], n[order]


def parity_sketch(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BITS parity bits of each set as bytes (n, BITS / 8)."""
    bit = (words * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    many = np.bincount(row * BITS + bit, minlength=(len(bounds) - 1) * BITS).reshape(-1, BITS)
    return np.packbits((many & 1).astype(np.uint8), axis=1)


def prefix_rows(classes: DataFrame, sketch: np.ndarray, t: float) -> DataFrame:
    """(word, x, y, cls, n, bits) of each class under each of its prefix words held by another class too. x and y tell the
    pair of sub-groups of a crowded word that the row serves; 0 and 0 for others.
    """
    shared = classes.sparkSession.sparkContext.broadcast((sketch, *crowded_words(classes, sketch, t)))  # of a bounded size, and of words / CROWD

    def run(batches):
        counts, crowded, exact = shared.value
        for batch in batches:
            raw = batch.column(2).to_pylist()
            every = np.frombuffer(b"".join(raw), np.uint32)
            bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw])))
            words, _, row = _prefix(every, bounds, counts, t)
            bits = parity_sketch(every, bounds)
            cls, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            many = np.ones(len(words), np.int64)
            if len(crowded):
                at = np.minimum(np.searchsorted(crowded, words), len(crowded) - 1)
                many = np.where(crowded[at] == words, -(-exact[at] // CROWD), 1)
            mine = (cls[row].view(np.uint64) >> np.uint64(40)).astype(np.int64) % many
            at = np.repeat(np.arange(len(row)), many)
            other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            x, y = np.minimum(mine[at], other), np.maximum(mine[at], other)
            r = row[at]
            sketches = bits[r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at].astype(np.int64)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(cls[r]), pa.array(n[r]), pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(r), [None, pa.py_buffer(np.ascontiguousarray(sketches))]).cast(pa.binary())],
                ["word", "x", "y", "cls", "n", "bits"],
            )

    return classes.mapInArrow(run, "word bigint, x int, y int, cls bigint, n int, bits binary")


def within_radius(bits: np.ndarray, left: np.ndarray, right: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which of the comparisons (rows left and right of bits) have a Hamming distance of at most their radius.

    Comparisons are transposed to BITS planes of one bit each, 64 to a machine word. Sixteen planes at a time pass a tree
    of carry-save adders whose carries ripple into the vertical counters; after each quarter, words in which all 64 distances
    exceed their radius are abandoned.
    """
    n = len(left)
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    pad = -n % 64
    diff = bits[left] ^ bits[right]
    flat = np.unpackbits(diff, axis=1)
    flat = np.concatenate((flat, np.zeros((pad, BITS), np.uint8))) if pad else flat
    planes = np.packbits(np.ascontiguousarray(flat.T), axis=1).view(np.uint64)
    levels = BITS.bit_length()
    r = np.minimum(np.concatenate((radius, np.full(pad, -1))), BITS)
    dead = np.packbits(r < 0).view(np.uint64)
    limits = [np.packbits((np.maximum(r, 0) >> k & 1).astype(np.uint8)).view(np.uint64) for k in range(levels)]
    counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(levels)]
    live = np.arange(planes.shape[1])

    def add(x, k):
        while k < levels:
            counters[k], x = counters[k] ^ x, counters[k] & x
            k += 1

    beyond = dead
    for quarter in range(4):
        for first in range(quarter * BITS // 4, (quarter + 1) * BITS // 4, 16):
            level = [planes[first + i] for i in range(16)]
            k = 0
            while len(level) > 1:
                # full adders: three bits of weight 2**k become a sum bit and a carry
                carries = []
                while len(level) >= 3:
                    a, b, c = level.pop(), level.pop(), level.pop()
                    ab = a ^ b
                    level.append(ab ^ c)
                    carries.append((a & b) | (ab & c))
                if len(level) == 2:
                    a, b = level
                    level = [a ^ b]
                    carries.append(a & b)
                add(level[0], k)
                level, k = carries, k + 1
            if level:
                add(level[0], k)
        over, same = np.zeros(len(live), np.uint64), np.full(len(live), np.uint64(0xFFFFFFFFFFFFFFFF))
        for k in range(levels - 1, -1, -1):
            over |= same & counters[k] & ~limits[k]
            same &= ~(counters[k] ^ limits[k])
        beyond = over | dead
        keep = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not keep.all() and quarter < 3:
            live, planes, dead, beyond = live[keep], planes[:, keep], dead[keep], beyond[keep]
            counters, limits = [c[keep] for c in counters], [x[keep] for x in limits]
        if not len(live):
            return out
    good = np.unpackbits((~beyond).view(np.uint8)).astype(bool)
    at = (live[:, None] * 64 + np.arange(64)).reshape(-1)
    at = at[good]
    out[at[at < n]] = True
    return out


def _meet(t: float):
    """Compares the rows of a partition sorted by (word, x, y, n, cls): runs of one (word, x, y) are groups that meet."""
    allowed = (1 - t) / (1 + t)

    def compare(word, x, y, cls, n, bits):
        edge = np.ones(len(word) + 1, dtype=bool)
        edge[1:-1] = (word[1:] != word[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        edge = np.flatnonzero(edge)
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        # in a group sorted by size the partners of a row end where sizes exceed n / t
        order_key = group.astype(np.float64) * 1e7 + n
        stop = np.searchsorted(order_key, group * 1e7 + np.minimum(np.floor(n / t + 1e-9), 9e6), side="right")
        many = np.maximum(stop - np.arange(len(n)) - 1, 0)
        upto = np.concatenate(([0], np.cumsum(many)))
        row = 0
        while row < len(n):
            end = max(row + 1, int(np.searchsorted(upto, upto[row] + SLAB, side="right")) - 1)
            left = np.repeat(np.arange(row, end), many[row:end])
            right = left + 1 + np.arange(len(left)) - np.repeat(upto[row:end] - upto[row], many[row:end])
            row = end
            radius = np.floor(allowed * (n[left] + n[right]) + 1e-9).astype(np.int64)
            ok = within_radius(bits, left, right, radius)
            a, b = cls[left[ok]], cls[right[ok]]
            ok = a != b
            if ok.any():
                yield np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])

    def run(batches):
        held: list[pa.RecordBatch] = []
        many = 0

        def out(table: pa.Table):
            raw = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            c = [table.column(k).to_numpy() for k in ("word", "x", "y", "cls")]
            for a, b in compare(*c, table.column("n").to_numpy().astype(np.int64), raw):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many < 100_000:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(k)[-1].as_py() for k in ("word", "x", "y")]
            same = np.logical_and.reduce([table.column(k).to_numpy() == v for k, v in zip(("word", "x", "y"), last)])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from out(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            many = len(same) - cut
        if many:
            yield from out(pa.Table.from_batches(held))

    return run


def _verify(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity) of the pairs of class keys whose sets are t-similar."""
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = classes.join(need, "cls", "left_semi")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("words").alias("wa"), F.col("n").alias("na")), "a").join(sets.select(F.col("cls").alias("b"), F.col("words").alias("wb"), F.col("n").alias("nb")), "b")

    def run(batches):
        for batch in batches:
            wa, wb, na, nb = (batch.column(k).to_pylist() for k in ("wa", "wb", "na", "nb"))
            common = np.array([common_count(x, y) for x, y in zip(wa, wb)], dtype=np.float64)
            union = np.array(na) + np.array(nb) - common
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common / np.maximum(union, 1))], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a bigint, b bigint, similarity double").where(F.col("similarity") >= t - 1e-9)


def similar_classes(df: DataFrame, ident: str, text: str, t: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(links (a, b, similarity) between classes a < b of at least t, members (cls, id) of all classes).

    Rows without id or text, and texts of fewer than `least` distinct words, take no part. Repeated rows count once; an
    id with several texts belongs to several classes.
    """
    if not 0 < t <= 1:
        raise ValueError("t must be above 0 and at most 1")
    classes, members = classes_of(materialize(word_table(df, ident, text, max(1, least)), "word-table"))  # texts are cut into words once
    classes = materialize(classes, "word-classes")
    members = materialize(members, "word-members")
    rows = prefix_rows(classes, count_sketch(classes, cells_for(classes.count())), t)
    met = rows.repartition(F.col("word"), F.col("x"), F.col("y")).sortWithinPartitions("word", "x", "y", "n", "cls")
    pairs = materialize(met.mapInArrow(_meet(t), "a bigint, b bigint").distinct(), "word-pairs")
    return _verify(pairs, classes, t), members


def near_pairs(df: DataFrame, ident: str, text: str, t: float = 0.8, least: int = 1) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids whose texts' distinct words are t-similar; classes of equal word sets as in expand()."""
    links, members = similar_classes(df, ident, text, t, least)
    several = members.groupBy("cls").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    rep = several.select("cls", "first")
    pairs = links.join(rep.select(F.col("cls").alias("a"), F.col("first").alias("id_a")), "a").join(rep.select(F.col("cls").alias("b"), F.col("first").alias("id_b")), "b").select("a", "b", "id_a", "id_b")
    many = members.join(several.where("first <> last").select("cls"), "cls")
    return expand(pairs, many).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))


def near_groups(df: DataFrame, ident: str, text: str, t: float = 0.8, least: int = 1) -> DataFrame:
    """(id, class_id, group_id, links): a row for each id with at least `least` distinct words. class_id: the smallest id with
    the same words; group_id: the smallest class_id reached over links of t; links: classes its class is linked to.
    """
    links, members = similar_classes(df, ident, text, t, least)
    links = materialize(links, "word-links")
    first = members.groupBy("cls").agg(F.min("id").alias("class_id"))
    roots = components(links)
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    named = first.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    per = named.join(groups, "root").join(degree, "cls", "left").select("cls", "class_id", "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return members.join(per, "cls").select("id", "class_id", "group_id", "links")


def memory_contents(chunks: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(memory_id, content) of both tables; rows without content are left out, as an id's content is its non-null one."""
    return chunks.select("memory_id", "content").unionByName(retrieved.select("memory_id", "content")).where("memory_id is not null and content is not null")


#: Least number of distinct words of a memory, and the similarity of a near-duplicate.
LEAST, SIMILAR = 24, 0.8
