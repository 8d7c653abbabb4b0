"""Passages that stand verbatim in more than one document.

Anchors are windows of w characters that begin at positions p of a document with p mod v in a difference cover D. v and D
form a perfect difference set: for any two positions i, j there is a shift below v after which both are cover
positions, so any common run of w + v - 1 characters holds a window anchored in both documents. For a displacement that
isn't 0 mod v there is exactly one residue of aligned anchors, so a long common run yields one match every v characters,
and with w > v neighbouring matches overlap: a run of matches v apart is one passage.

Every anchor is then extended, in one of two exact ways:

* An anchor that at most HOT places hold is paired, so each place is in HOT / 2 pairs at most. Runs of matches are extended at
  their ends on the texts, and compared between the ends by hashes of the texts themselves.
* A hot anchor isn't paired. Each of its places is extended to all runs of exactly `length` characters that hold it, by hash;
  places with an equal run share it. Runs that stand in the same set of documents are one class of that set.

Both are linear in the number of places. Only pairs as a result (sharing_pairs) expand classes, as the result itself does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Rolling, codepoints, components, expand, materialize, slices

# fixed values: perfect difference sets by modulus
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
}

SLICE = 2_000_000
#: Anchors of a bucket, about, and partitions that buckets are dealt to at most; anchors sorted at once in a task before they are dealt to buckets.
BUCKET, PARTITIONS, FLUSH = 1 << 20, 20_000, 3_000_000
#: Places of an anchor that are paired; above, the anchor is hot.
HOT = 32
#: Matches laid out at once.
SLAB = 200_000
#: Bits of an anchor's hash that are kept. A chance agreement costs a comparison, which fails.
KEY = np.uint64((1 << 48) - 1)


def cover_for(length: int) -> tuple[int, tuple[int, ...], int]:
    """(v, D, w) for runs of at least `length` characters: the largest v that leaves w > v."""
    fits = [v for v in COVERS if length - v + 1 > v]
    if not fits:
        raise ValueError("spans shorter than 14 characters aren't supported")
    v = max(fits)
    return v, COVERS[v], length - v + 1


def anchors(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text, position) of every window at a cover position."""
    v, cover, w = cover_for(length)
    points, bounds = codepoints(texts)
    size = np.diff(bounds)
    many = np.maximum(0, (size - w) // v + 1)  # periods that begin where a window still fits
    doc = np.repeat(np.arange(len(texts)), many)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = (period[:, None] * v + np.array(cover)).reshape(-1)
    doc = np.repeat(doc, len(cover))
    fits = at + w <= size[doc]
    at, doc = at[fits], doc[fits]
    begin = bounds[doc] + at
    return Rolling(points).of(begin, begin + w), doc, at


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all lowest bytes first: planes of zeros take no room once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _whole(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _anchor_blocks(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Anchors as blocks (bucket, n, ids, body): one row for each bucket of about FLUSH anchors of a task; body holds sorted hashes (as
    differences), documents (as places in ids) and positions.

    Of an anchor with many places in one task, HOT + 1 tell its bucket that it is hot; the others are known to be, and go
    in blocks without hashes (n below 0), which are dealt evenly.
    """
    step = (1 << 48) // buckets + 1

    def run(batches):
        import zlib

        held, many = [], 0

        def block(bucket: int, n: int, h, doc, at):
            used, local = np.unique(doc, return_inverse=True)
            body = b"" if h is None else _planes(np.diff(h, prepend=np.uint64(0)))
            return bucket, n, used.tobytes(), zlib.compress(body + _planes(local.astype(np.uint32)) + _planes(at), 1)

        def flush():
            h, doc, at = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, doc, at = h[order], doc[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
            more = place > HOT
            rows = []
            if more.any():
                d, p = doc[more], at[more]
                for k, s in enumerate(range(0, len(d), 65_536)):
                    rows.append(block(int(d[s] + k) % buckets, -len(d[s : s + 65_536]), None, d[s : s + 65_536], p[s : s + 65_536]))
                h, doc, at = h[~more], doc[~more], at[~more]
            bucket = h // np.uint64(step)
            edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 60)))
            rows += [block(int(bucket[s]), int(e - s), h[s:e], doc[s:e], at[s:e]) for s, e in zip(edges, [*edges[1:], len(h)])]
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["bucket", "n", "ids", "body"])

        for batch in batches:
            texts, ident = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(texts, len, SLICE):
                h, doc, at = anchors(texts[a:b], length)
                if len(h):
                    held.append((h & KEY, ident[a:b][doc].astype(np.int64), at.astype(np.uint32)))
                    many += len(h)
                if many >= FLUSH:
                    yield flush()
                    held, many = [], 0
        if many:
            yield flush()

    return docs.mapInArrow(run, "bucket int, n int, ids binary, body binary")


def _matches(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    """(a, b, pa, pb): aligned anchors of two documents a < b with equal hashes, one for every v characters of a displacement; and, with b
    and pb null, each place (a, pa) of a hot anchor.
    """
    v, cover, _ = cover_for(length)
    names = ["a", "b", "pa", "pb"]

    def places(a, p):
        none = lambda kind: pa.nulls(len(a), kind)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none(pa.int64()), pa.array(p.astype(np.int32)), none(pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        hs, ds, ps = [], [], []
        for batch in batches:
            for n, ids, body in zip(*(batch.column(k).to_pylist() for k in ("n", "ids", "body"))):
                raw, used = zlib.decompress(body), np.frombuffer(ids, np.int64)
                if n < 0:
                    yield places(used[_whole(raw[: -4 * n], np.uint32)], _whole(raw[-4 * n :], np.uint32))
                    continue
                hs.append(np.cumsum(_whole(raw[: 8 * n], np.uint64), dtype=np.uint64))
                ds.append(used[_whole(raw[8 * n : 12 * n], np.uint32)])
                ps.append(_whole(raw[12 * n :], np.uint32))
        if not hs:
            return
        h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps).astype(np.int64)
        del hs, ds, ps
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        many = np.diff(edge)
        shared = np.minimum.reduceat(d, edge[:-1]) != np.maximum.reduceat(d, edge[:-1])
        hot = np.repeat(many > HOT, many)  # also if all are in one document: a task may have kept back places in others
        for s in range(0, len(at := np.flatnonzero(hot)), SLAB):
            yield places(d[at[s : s + SLAB]], p[at[s : s + SLAB]])
        keep = np.repeat(shared & (many <= HOT), many)
        many = many[shared & (many <= HOT)]
        h, d, p = h[keep], d[keep], p[keep]
        after = np.repeat(np.cumsum(many), many) - np.arange(len(h)) - 1
        upto = np.concatenate(([0], np.cumsum(after)))
        row = 0
        while row < len(h):
            stop = max(row + 1, int(np.searchsorted(upto, upto[row] + SLAB, side="right")) - 1)
            left = np.repeat(np.arange(row, stop), after[row:stop])
            right = left + 1 + np.arange(len(left)) - np.repeat(upto[row:stop] - upto[row], after[row:stop])
            row = stop
            ok = d[left] != d[right]
            left, right = left[ok], right[ok]
            swap = d[left] > d[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            ok = ((p[right] - p[left]) % v != 0) | (p[left] % v == cover[0])
            left, right = left[ok], right[ok]
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(d[left]), pa.array(d[right]), pa.array(p[left].astype(np.int32)), pa.array(p[right].astype(np.int32))], names)

    return blocks.repartition(min(PARTITIONS, buckets), "bucket").groupBy("bucket").applyInArrow(run, "a bigint, b bigint, pa int, pb int")


def _common_prefix(x: str, y: str) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0
    while low < n:
        mid = (low + n + 1) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            n = mid - 1
    return low


def documents_of(df: DataFrame, ident: str, text: str, length: int) -> tuple[DataFrame, DataFrame, int]:
    """(representatives (id, text), members (cls, id) of classes of equal texts with two ids or more, characters of all texts); cls is
    the representative's id.

    Rows without id or with a text below `length` characters share nothing and are left out. The text itself isn't
    shuffled: classes are found on hashes, and the other members of a class are removed by an anti join.
    """
    docs = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= length))
    keys = materialize(docs.select("id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"), F.length("text").alias("n")), "span-documents")
    first = keys.groupBy("h", "g", "n").agg(F.min("id").alias("cls"), F.max("id").alias("last")).where("cls <> last").drop("last")
    members = keys.join(first, ["h", "g", "n"]).select("cls", "id").distinct()
    return docs.join(members.where("id <> cls").select("id"), "id", "left_anti"), members, keys.agg(F.sum("n")).first()[0] or 0


def _runs(places: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(w, c, id, pos): every run of `length` characters that holds a window at one of the places (id, pos), with two hashes of it."""
    reach = length - cover_for(length)[2]
    own = places.groupBy("id").agg(F.collect_list("pos").alias("places")).join(texts, "id").select("id", "text", "places")

    def run(batches):
        for batch in batches:
            ids, places, texts = batch.column(0).to_numpy(), batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, len, SLICE):
                points, bounds = codepoints(texts[a:b])
                starts = [np.unique(np.array(places[i])[:, None] - np.arange(reach + 1)) for i in range(a, b)]
                starts = [x[(x >= 0) & (x <= len(texts[a + i]) - length)] for i, x in enumerate(starts)]
                doc = np.repeat(np.arange(b - a), [len(x) for x in starts])
                at = np.concatenate(starts)
                begin = bounds[doc] + at
                w = Rolling(points).of(begin, begin + length)
                c = (Rolling(points, salt=0x5BD1E995).of(begin, begin + length) >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.view(np.int32)), pa.array(ids[a:b][doc]), pa.array(at.astype(np.int32))], ["w", "c", "id", "pos"])

    return own.mapInArrow(run, "w bigint, c int, id bigint, pos int")


class Shared:
    """What documents share, between representatives of classes of equal texts.

    spans (a, b, start_a, start_b, n): runs of at least `length` equal characters of two texts a < b, found over anchors that
    aren't hot. runs (w, c, id, pos): places of runs of exactly `length` characters with a hot anchor; sets (w, c, n, lo, x, y): the runs that stand in two
    texts or more, with number, smallest and two hashes of those texts. members (cls, id): classes of equal texts with two ids or more.
    """

    def __init__(self, df: DataFrame, ident: str, text: str, length: int, buckets: int | None = None):
        if df.sparkSession is None or length < 1:
            raise ValueError("length must be positive")
        v, cover, w = cover_for(length)
        self.length = length
        reps, self.members, chars = documents_of(df, ident, text, length)
        n = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars * len(cover) // (v * BUCKET)))
        found = materialize(_matches(_anchor_blocks(reps, length, n), length, n), "span-matches")
        line = Window.partitionBy("a", "b", "delta").orderBy("pa")
        chain = (
            found.where("b is not null")
            .withColumn("delta", F.col("pb") - F.col("pa"))
            .withColumn("new", F.coalesce(F.col("pa") - F.lag("pa").over(line) > v, F.lit(True)).cast("int"))
            .withColumn("k", F.sum("new").over(line))
            .groupBy("a", "b", "delta", "k")
            .agg(F.min("pa").alias("s"), (F.max("pa") + w).alias("e"))
        )
        chain = materialize(chain, "span-chains")
        self.spans = self._extended(chain, reps, v)
        places = found.where("b is null").select(F.col("a").alias("id"), F.col("pa").alias("pos"))
        self.runs = materialize(_runs(places, reps, length), "span-runs")
        held = self.runs.select("w", "c", "id").distinct()
        mark = lambda salt: F.bit_xor(F.xxhash64("id", F.lit(salt)))
        self.sets = held.groupBy("w", "c").agg(F.count("*").alias("n"), F.min("id").alias("lo"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")

    def _extended(self, chain: DataFrame, reps: DataFrame, v: int) -> DataFrame:
        need = chain.select(F.col("a").alias("id")).unionByName(chain.select(F.col("b").alias("id"))).distinct()
        texts = reps.join(need, "id", "left_semi")

        def ends(df: DataFrame, key: str, shift) -> DataFrame:
            """What an extension can take before and behind the chain in one of its texts, and hashes of what is between."""
            begin = F.col("s") + shift
            stop = F.col("e") + shift
            near = F.greatest(begin - v, F.lit(0))
            inner = F.substring("text", begin + 1, stop - begin)
            return (
                df.join(texts.withColumnRenamed("id", key), key)
                .withColumn(f"l{key}", F.substring("text", near + 1, begin - near))
                .withColumn(f"r{key}", F.substring("text", stop + 1, F.lit(v)))
                .withColumn(f"m{key}", F.struct(F.xxhash64(inner), F.hash(inner)))
                .drop("text")
            )

        both = ends(ends(chain, "a", F.lit(0)), "b", F.col("delta")).where("ma = mb").drop("ma", "mb")

        def extend(batches):
            for batch in batches:
                c = batch.to_pydict()
                left = [_common_prefix(x[::-1], y[::-1]) for x, y in zip(c["la"], c["lb"])]
                right = [_common_prefix(x, y) for x, y in zip(c["ra"], c["rb"])]
                start = [s - n for s, n in zip(c["s"], left)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(start, pa.int32()), pa.array([s + d for s, d in zip(start, c["delta"])], pa.int32()), pa.array([e + r - s for s, e, r in zip(start, c["e"], right)], pa.int32())],
                    ["a", "b", "start_a", "start_b", "n"],
                )

        return both.mapInArrow(extend, "a bigint, b bigint, start_a int, start_b int, n int").where(F.col("n") >= self.length)

    def classes(self) -> DataFrame:
        """(cls, id): the texts of each set that runs with a hot anchor stand in, one run for each set."""
        one = self.sets.groupBy("n", "lo", "x", "y").agg(F.min(F.struct("w", "c")).alias("r")).select("r.w", "r.c")
        return self.runs.join(one, ["w", "c"], "left_semi").select(F.concat_ws("|", "w", "c").alias("cls"), "id").distinct()

    def links(self) -> DataFrame:
        """(a, b) of texts a < b: linear in their number, and enough to reach every text that shares a run from any other over links."""
        star = self.runs.join(self.sets.select("w", "c", "lo"), ["w", "c"]).where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
        return self.spans.select("a", "b").unionByName(star).distinct()

    def covered(self) -> DataFrame:
        """(cls, s, e): intervals of each text that another text has too; they may overlap."""
        end = F.col("pos") + self.length
        sides = [self.spans.select(F.col(k).alias("cls"), F.col(f"start_{k}").alias("s"), (F.col(f"start_{k}") + F.col("n")).alias("e")) for k in ("a", "b")]
        return sides[0].unionByName(sides[1]).unionByName(self.runs.join(self.sets.select("w", "c"), ["w", "c"], "left_semi").select(F.col("id").alias("cls"), F.col("pos").alias("s"), end.alias("e")))


def sharing_pairs(df: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 160) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of all documents that share a run of at least `length` characters, those of equal texts too.

    Null texts and texts shorter than length share nothing. Repeated rows count once. An id with several texts stands for
    all of them. All anchors of all documents are compared; none is left out for being frequent.
    """
    found = Shared(df, ident, text, length)
    hot = expand(None, found.classes()).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = found.spans.select("a", "b").unionByName(hot).distinct().withColumns({"id_a": F.col("a"), "id_b": F.col("b")})
    return expand(pairs, found.members).select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))


def sharing_groups(df: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 160) -> DataFrame:
    """(doc_id, class_id, group_id) of each id whose text shares a run of at least `length` characters with another id's, a row for each: class_id
    is the smallest id with an equal text, group_id the smallest id reached over shared runs. Linear, however many share a run.
    An id with several texts has the smallest of each.
    """
    found = Shared(df, ident, text, length)
    links = found.links().unionByName(found.members.where("id <> cls").select(F.col("cls").alias("a"), F.col("id").alias("b")))
    roots = components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))
    cls = found.members.groupBy(F.col("id").alias("doc_id")).agg(F.min("cls").alias("class_id"))
    return roots.join(cls, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "group_id")


def shared_share(df: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 160) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_fraction) for each id: how many of its characters stand in passages of at least
    `length` that another document has too. Every id of df comes out once; null and short texts have 0. An id with
    several texts has the figures of its longest.
    """
    found = Shared(df, ident, text, length)
    each, members = found.covered(), found.members
    line = Window.partitionBy("cls").orderBy("s", "e")
    merged = (
        each.distinct()
        .withColumn("far", F.max("e").over(line.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("far", F.lit(0)))))
        .groupBy("cls")
        .agg(F.sum("new").alias("covered"))
    )
    sized = df.select(F.col(ident).cast("bigint").alias("doc_id"), F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).alias("n_chars")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    copies = members.select(F.col("id").alias("doc_id"), "cls")
    out = sized.join(copies, "doc_id", "left").withColumn("copy", F.col("cls").isNotNull()).withColumn("cls", F.coalesce("cls", "doc_id")).join(merged, "cls", "left")
    covered = F.when(F.col("copy"), F.col("n_chars")).otherwise(F.least("n_chars", F.coalesce("covered", F.lit(0)))).cast("bigint")
    return out.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), covered.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(covered / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_fraction"))
