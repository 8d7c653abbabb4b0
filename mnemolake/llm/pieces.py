"""Splitting items above a size limit into overlapping pieces at natural boundaries, without one worker holding a giant text.

An item's text is a list of parts. Lengths are summed up to offsets, and the parts are laid out as ranges of RANGE characters of
the item, each with a halo that covers what boundary detection looks at; the parts are never joined to a whole text. Every
range yields the table of the boundaries it owns. The tables of an item pass in order, and what a cut needs of the ranges
before is carried along: no task holds more than a range and a piece's length of boundaries. Pieces are cut by offset out of
the ranges they begin in (whose halo is as long as a piece). Boundaries do not depend on where ranges begin. A part is a cell
of the input, so it is read as a whole by the task that lays it out, as Spark reads any cell.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import class_table, codepoints, materialize, slices

#: Characters of a range, and what detection looks back and ahead at most.
RANGE, HALO = 1 << 16, 128
#: Ranges of an item above which they are dealt to other tasks than the one that lays them out.
MANY = 16
SLICE = 2_000_000
#: Strengths of boundaries, strongest first; NEVER: a place inside a character sequence that belongs together.
PART, PARAGRAPH, LINE, SENTENCE, WORD, NEVER = 6, 5, 4, 3, 2, 0
KINDS = ("\\p{White_Space}", "\\p{M}|\\p{Cf}|[\U0001f3fb-\U0001f3ff]")

# fixed values: ends of sentences before white space, ends of sentences that need none, pauses that need none, closing marks
STOPS, FULL_STOPS, PAUSES, CLOSING = ".!?…", "。！？；", "，、：", "\"'”’»)]）」』"


def boundaries(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths): a piece may end before position p of the array. Positions 0 and ends of texts aren't listed."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    kind = class_table(KINDS)[points]
    space = kind == 1
    strength = np.ones(n, dtype=np.uint8)
    at = np.arange(n)
    low = np.repeat(bounds[:-1], np.diff(bounds))
    stop = np.isin(points, [ord(c) for c in STOPS])
    full = np.isin(points, [ord(c) for c in FULL_STOPS])
    closing = np.isin(points, [ord(c) for c in CLOSING])
    # start of the white-space run, and of the closing marks before it, that end at each position
    last_other = np.maximum.accumulate(np.where(space, -1, at))
    begin = np.maximum(np.concatenate(([-1], last_other[:-1])) + 1, np.maximum(low, at - HALO // 2))
    last_open = np.maximum.accumulate(np.where(closing, -1, at))
    before = np.maximum(begin - 1, 0)
    inner = np.maximum(last_open[before], 0)
    near = (begin > low) & (inner >= low) & (before - inner <= 8)
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    returns = np.concatenate(([0], np.cumsum(points == 13)))
    many = np.maximum(lines[at] - lines[begin], returns[at] - returns[begin])
    after_space = ~space & (begin < at)
    sentence = near & (stop[inner] | full[inner])
    strength = np.where(after_space, np.where(many >= 2, PARAGRAPH, np.where(many == 1, LINE, np.where(sentence, SENTENCE, WORD))), strength)
    # after full-width punctuation and its closing marks no space is needed
    tail = np.maximum(at - 1, 0)
    mark = np.maximum(last_open[tail], 0)
    tight = (begin == at) & (at > low) & (mark >= low) & (at - 1 - mark <= 8) & ~closing
    strength = np.where(tight & full[mark], SENTENCE, strength)
    strength = np.where(tight & (mark == tail) & np.isin(points[mark], [ord(c) for c in PAUSES]), WORD, strength)
    joined = (kind == 2) | ((at > low) & ((points[tail] == 0x200D) | (points[tail] == 13) & (points == 10)))
    strength = np.where(joined, NEVER, strength)
    keep = np.flatnonzero((strength != 1) & (at > low))
    return keep, strength[keep].astype(np.uint8)


class Cutter:
    """The pieces of a text of n characters, from tables of boundaries in the order of its ranges.

    A piece ends at the strongest boundary in the later half of what it may take, the last of equals; if there is none, at
    the last one before that; else at the limit, moved back out of sequences that belong together. The next piece
    begins `overlap` characters before that end.
    """

    def __init__(self, n: int, limit: int, overlap: int):
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be at least 0 and below the limit")
        self.n, self.limit, self.overlap, self.start, self.piece = n, limit, overlap, 0, 0
        self.positions, self.strengths = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def feed(self, upto: int, positions: np.ndarray, strengths: np.ndarray) -> list[tuple[int, int, int]]:
        """(piece, start, end) of the pieces that are certain once the boundaries at positions up to `upto` are known."""
        keep = self.positions > self.start
        self.positions, self.strengths = np.concatenate((self.positions[keep], positions)), np.concatenate((self.strengths[keep], strengths))
        never = set(self.positions[self.strengths == NEVER].tolist())
        can = self.strengths != NEVER
        p, s = self.positions[can], self.strengths[can]
        out = []
        while self.n - self.start > self.limit and self.start + self.limit <= upto:
            end = self._end(p, s, never)
            out.append((self.piece, self.start, end))
            self.start, self.piece = end - self.overlap, self.piece + 1
        if upto >= self.n:
            out.append((self.piece, self.start, self.n))
        return out

    def _end(self, positions: np.ndarray, strengths: np.ndarray, never: set[int]) -> int:
        top, least = self.start + self.limit, self.start + self.overlap + 1
        a, b, c = np.searchsorted(positions, [least, max(least, self.start + self.limit // 2), top + 1])
        if b == c:
            b, c = a, b
        if b < c:
            s = strengths[b:c]
            return int(positions[b + len(s) - 1 - int(np.argmax(s[::-1]))])
        end = top
        while end in never and end > least:
            end -= 1
        return top if end in never else end


def cuts(n: int, positions: np.ndarray, strengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of n characters, all of whose boundaries are at hand."""
    return [(a, b) for _, a, b in Cutter(n, limit, overlap).feed(n, positions, strengths)]


def _laid_out(parts: list[str | None], n: int, size: int, ahead: int):
    """(no, base, text, ends) of each range: its text from base on, HALO characters before it and `ahead` behind it included, and the ends of parts in it."""
    offsets = np.concatenate(([0], np.cumsum([len(p or "") for p in parts])))
    for no in range(max(1, -(-n // size))):
        low, high = max(0, no * size - HALO), min(n, (no + 1) * size + ahead)
        a, b = int(np.searchsorted(offsets, low, side="right")) - 1, int(np.searchsorted(offsets, high))
        text = "".join((parts[i] or "")[max(0, low - int(offsets[i])) : high - int(offsets[i])] for i in range(a, b))
        inner = offsets[1:-1]
        ends = np.unique(inner[(inner > 0) & (inner < n) & (inner >= no * size) & (inner < (no + 1) * size)])
        yield no, low, text, ends.tolist()


def _ranges(items: DataFrame, size: int) -> DataFrame:
    """(key, no, base, text, ends, n_chars, max_chars, overlap_chars) of the ranges of items; those of long items are spread over tasks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, parts, n, limit, overlap = (batch.column(k)[i].as_py() for k in range(5))
                for no, base, text, ends in _laid_out(parts, n, size, max(limit, HALO)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "no": [no], "base": [base], "text": [text], "ends": [ends], "n_chars": [n], "max_chars": [limit], "overlap_chars": [overlap]}, schema)

    schema = pa.schema([("key", pa.string()), ("no", pa.int32()), ("base", pa.int64()), ("text", pa.string()), ("ends", pa.list_(pa.int64())), ("n_chars", pa.int64()), ("max_chars", pa.int32()), ("overlap_chars", pa.int32())])
    names = "key string, no int, base bigint, text string, ends array<bigint>, n_chars bigint, max_chars int, overlap_chars int"
    source = items.select("key", "parts", "n_chars", "max_chars", "overlap_chars")
    few, many = F.col("n_chars") <= MANY * size, F.col("n_chars") > MANY * size
    return source.where(few).mapInArrow(run, names).unionByName(source.where(many).mapInArrow(run, names).repartition("key", "no"))


def _plan(ranges: DataFrame, size: int) -> DataFrame:
    def detect(batches):
        for batch in batches:
            texts, ends = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            no, base = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in slices(texts, len, SLICE):
                points, bounds = codepoints(texts[a:b])
                p, s = boundaries(points, bounds)
                edge = np.searchsorted(p, bounds)
                blobs = []
                for i in range(b - a):
                    q, w = p[edge[i] : edge[i + 1]] - bounds[i] + base[a + i], s[edge[i] : edge[i + 1]]
                    own = (q >= no[a + i] * size) & (q < (no[a + i] + 1) * size)
                    e = np.array(ends[a + i], dtype=np.int64)
                    own &= ~np.isin(q, e)
                    q, w = np.concatenate((q[own], e)), np.concatenate((w[own], np.full(len(e), PART, np.uint8)))
                    order = np.argsort(q, kind="stable")
                    blobs.append(zlib.compress(q[order].astype(np.int64).tobytes() + w[order].tobytes(), 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1, 5, 6, 7)), pa.array(blobs, pa.binary())], ["key", "no", "n_chars", "max_chars", "overlap_chars", "found"])

    def choose(batches):
        key, cutter = None, None
        for batch in batches:
            rows = {"key": [], "piece": [], "start": [], "end": []}
            for k, no, n, limit, overlap, found in zip(*batch.to_pydict().values()):
                if k != key:
                    key, cutter = k, Cutter(n, limit, overlap)
                raw = zlib.decompress(found)
                many = len(raw) // 9
                done = no >= -(-n // size) - 1
                for x in cutter.feed(n if done else (no + 1) * size - 1, np.frombuffer(raw[: 8 * many], np.int64), np.frombuffer(raw[8 * many :], np.uint8)):
                    for name, v in zip(rows, (k, *x)):
                        rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("key", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    tables = ranges.mapInArrow(detect, "key string, no int, n_chars bigint, max_chars int, overlap_chars int, found binary")
    return tables.repartition("key").sortWithinPartitions("key", "no").mapInArrow(choose, "key string, piece int, start bigint, end bigint")


def split_plan(items: DataFrame, size: int = RANGE) -> DataFrame:
    """(key, piece, start, end) of the pieces of the items (key, parts array<string>, n_chars, max_chars, overlap_chars), all of them above
    their limit; n_chars is the sum of the parts' lengths. Keys must differ.
    """
    return _plan(_ranges(items, size), size)


def pieces(items: DataFrame, size: int = RANGE) -> DataFrame:
    """(key, piece, start, end, text) of every piece; joined without their overlaps the texts give the item back."""
    ranges = materialize(_ranges(items, size), "piece-ranges")
    placed = _plan(ranges, size).withColumn("no", F.floor(F.col("start") / size).cast("int"))
    return placed.join(ranges.select("key", "no", "base", "text"), ["key", "no"]).select("key", "piece", "start", "end", F.expr("substring(text, cast(start - base + 1 as int), cast(end - start as int))").alias("text"))


# ---------------------------------------------------------------- the project's items


def _sized(items: DataFrame) -> DataFrame:
    n = F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, t: acc + F.length(t))
    return items.withColumn("n_chars", n)


def _tokens(chars: Column) -> Column:
    return F.greatest(F.floor(chars / 4), F.lit(1))


def oversized_items(chunks: DataFrame, samples: DataFrame, limits: DataFrame) -> DataFrame:
    """(key, item_kind, item_id, session_id, nth, parts, n_chars, max_chars, overlap_chars) of the chunks and haystack sessions above their limit.

    The size is a quarter of the characters, rounded down, at least 1. A chunk's content is its non-null one; a null type
    means session; types without a limit have none. Rows delivered again count once. nth tells sessions of one sample
    with the same id apart. Null turn contents have no characters.
    """
    limits = limits.where("max_tokens is not null").select("item_kind", F.coalesce("memory_type", F.lit("session")).alias("kind"), "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))
    lim = F.broadcast(limits)  # a fixed table of six rows
    c = (
        chunks.where("memory_id is not null and content is not null")
        .select(F.col("memory_id").alias("item_id"), F.coalesce("memory_type", F.lit("session")).alias("kind"), "content", F.lit("chunk").alias("item_kind"))
        .join(lim, ["item_kind", "kind"])
        .where(_tokens(F.length("content")) > F.col("max_tokens"))
        .dropDuplicates(["item_id"])
        .select("item_kind", "item_id", F.lit("").alias("session_id"), F.lit(0).alias("nth"), F.array("content").alias("parts"), "max_tokens", "overlap_tokens")
    )
    turns = F.transform("turns", lambda t: F.coalesce(t["content"], F.lit("")))
    s = (
        samples.where("question_id is not null")
        .select("question_id", "haystack_session_ids", F.posexplode("haystack_sessions").alias("nth", "turns"))
        .select("question_id", F.lit("session").alias("item_kind"), F.coalesce(F.get("haystack_session_ids", F.col("nth")), F.lit("")).alias("session_id"), "nth", F.coalesce(turns, F.array().cast("array<string>")).alias("parts"))
        .join(F.broadcast(limits.where("item_kind = 'session'").drop("kind")), "item_kind")
    )
    s = _sized(s).where(_tokens(F.col("n_chars")) > F.col("max_tokens")).dropDuplicates(["question_id", "nth"]).select("item_kind", F.col("question_id").alias("item_id"), "session_id", "nth", "parts", "max_tokens", "overlap_tokens")
    return _sized(c.unionByName(s)).select(
        F.to_json(F.struct("item_kind", "item_id", "session_id", "nth")).alias("key"), "item_kind", "item_id", "session_id", "nth", "parts", "n_chars", (F.col("max_tokens") * 4).cast("int").alias("max_chars"), (F.col("overlap_tokens") * 4).cast("int").alias("overlap_chars")
    )


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """df with what its key is made of."""
    k = F.from_json("key", "item_kind string, item_id string, session_id string, nth int")
    return df.withColumn("_k", k).select("_k.item_kind", "_k.item_id", "_k.session_id", "_k.nth", *columns)


def item_pieces(chunks: DataFrame, samples: DataFrame, limits: DataFrame, size: int = RANGE) -> DataFrame:
    """(item_kind, item_id, session_id, nth, piece, start, end, text) of every oversized item."""
    return _named(pieces(oversized_items(chunks, samples, limits), size), "piece", "start", "end", "text")


def split_items(chunks: DataFrame, samples: DataFrame, limits: DataFrame, size: int = RANGE) -> DataFrame:
    """(item_kind, item_id, session_id) of the items that come out in more than one piece."""
    return _named(split_plan(oversized_items(chunks, samples, limits), size).where("piece = 1")).select("item_kind", "item_id", "session_id").distinct()
