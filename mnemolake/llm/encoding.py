"""Corpus encoding with a public byte-level BPE vocabulary, by dynamic programming over prefixes.

Every prefix of a piece has exactly one valid last token: the last token of that prefix's own encoding. It is the one
token t ending there that is compatible with the last token of the prefix before t, i.e. the two would not be merged or
split differently if encoded together. A piece's table of last tokens is filled from left to right in linear time and
its ids are read off backwards. An append extends the table (exact, nothing before is touched); an edit redoes it only
from the edited byte on.

Texts are cut into pieces with array operations on code points (letters, numbers, white space, others, contractions);
pieces are recognised by rolling hash, and each different piece is encoded once per worker.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, class_table, codepoints, slices

#: Code points handled at once, and different pieces a worker remembers; both bound memory only.
SLICE, REMEMBER = 2_000_000, 1_500_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPACE, LETTER, NUMBER = 1, 2, 3
KINDS = ("\\p{White_Space}", "\\p{L}", "\\p{N}")


class Vocabulary:
    """Tokens, the pair each token is merged from, and the compatibility of neighbouring tokens.

    An id is its token's merge rank (single bytes first).
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[int, bool] = {}
        ids = self.ids
        for t, i in sorted(ids.items(), key=lambda x: x[1]):
            if len(t) == 1:
                self.parts[i] = (i, i)
                continue
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None and a < i and b < i and self._stays(a, b, i):
                    self.parts[i] = (a, b)
                    self.merged[a, b] = i
                    break
            else:
                raise ValueError(f"token {i} can't be reached by merges")
        self.trie: dict = {}
        for t, i in ids.items():
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[-1] = i

    def _stays(self, a: int, b: int, before: int = 1 << 62) -> bool:
        """Whether no merge across the border of a and b comes before rank `before` and before the merges that form a and b.

        Undoes the merges of a's right edge and b's left edge, latest first; a border merge earlier than the one undone
        last would have happened instead of it. Of equal ranks the left one happens first.
        """
        merged, parts = self.merged, self.parts
        while True:
            r = merged.get((a, b))
            if r is not None and r < before:
                return False
            if a > b:
                inner = parts[a][1]
                if inner == a:
                    return True
                before, a = a, inner
            else:
                inner = parts[b][0]
                if inner != b:
                    before, b = b + 1, inner
                    continue
                inner = parts[a][1]
                if inner == a:
                    return True
                before, a = a, inner

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.joins.get(key)
        if known is None:
            known = self.joins[key] = self._stays(a, b)
        return known


class Tables:
    """The vocabulary as arrays, to fill the tables of many pieces at once."""

    CACHE = 1 << 21

    def __init__(self, v: Vocabulary):
        nodes, queue = 1, [(v.trie, 0)]
        steps: list[tuple[int, int, int]] = []
        tokens = {}
        for node, at in queue:
            for c, below in node.items():
                if c == -1:
                    tokens[at] = below
                else:
                    steps.append((at, c, nodes))
                    queue.append((below, nodes))
                    nodes += 1
        a, c, b = np.array(steps, dtype=np.int64).T
        self.next = np.full((nodes, 256), -1, dtype=np.int32)
        self.next[a, c] = b
        self.token = np.full(nodes, -1, dtype=np.int32)
        self.token[list(tokens)] = list(tokens.values())
        size = max(v.bytes) + 1
        self.length = np.zeros(size, dtype=np.int64)
        self.parts = np.zeros((size, 2), dtype=np.int64)
        for i, t in v.bytes.items():
            self.length[i], self.parts[i] = len(t), v.parts[i]
        keys = np.array([x << 20 | y for x, y in v.merged], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(v.merged.values()), dtype=np.int64)[order]
        self.cache = np.full(self.CACHE, -1, dtype=np.int64)

    def _stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary._stays for arrays of pairs."""
        out = np.zeros(len(a), dtype=bool)
        rows, before = np.arange(len(a)), np.full(len(a), 1 << 62, dtype=np.int64)
        while len(rows):
            key = a << 20 | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[at] == key) & (self.ranks[at] < before)
            inner_a, inner_b = self.parts[a, 1], self.parts[b, 0]
            undo_a = (a > b) | (inner_b == b)
            done = undo_a & (inner_a == a)
            out[rows[done & ~bad]] = True
            before = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, inner_a, a), np.where(undo_a, b, inner_b)
            go = ~(bad | done)
            rows, a, b, before = rows[go], a[go], b[go], before[go]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Looks pairs up in a direct-mapped cache of verdicts first."""
        key = (a.astype(np.int64) << 20 | b) << 1
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).view(np.int64)
        seen = self.cache[slot]
        out = seen == key + 1
        miss = np.flatnonzero(~out & (seen != key))
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            ok = self._stays(fresh >> 21, fresh >> 1 & 0xFFFFF)[back.reshape(-1)]
            self.cache[slot[miss]] = key[miss] + ok
            out[miss] = ok
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the n + 1 bounds of the pieces in it. The same tables as Prefixes has, a column at a time."""
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")
        size, longest, m = size[order], int(size.max()), len(pieces)
        data = np.frombuffer(b"".join([pieces[i].ljust(longest, b"\0") for i in order.tolist()]), dtype=np.uint8).reshape(m, longest)
        last = np.full((m, longest + 1), -1, dtype=np.int32)
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        for i in range(longest):
            rows, j = np.arange(live[i]), i
            node = np.zeros(len(rows), dtype=np.int32)
            while True:
                node = self.next[node, data[rows, j]]
                j += 1
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                t = self.token[node]
                have = t >= 0
                r, t = rows[have], t[have]
                if i:
                    ok = self.compatible(last[r, i], t)
                    r, t = r[ok], t[ok]
                last[r, j] = t
                if j == longest:
                    break
                on = rows < live[j]
                rows, node = rows[on], node[on]
        steps, rows, j = [], np.arange(m), size.copy()
        count = np.zeros(m, dtype=np.int64)
        while len(rows):
            t = last[rows, j]
            steps.append((rows, t))
            count[rows] += 1
            j = j - self.length[t]
            on = j > 0
            rows, j = rows[on], j[on]
        back = np.empty(m, dtype=np.int64)
        back[order] = np.arange(m)
        upto = np.zeros(m + 1, dtype=np.int64)
        np.cumsum(count[back], out=upto[1:])
        ends = upto[1:][order]
        flat = np.empty(upto[-1], dtype=np.int32)
        for s, (r, t) in enumerate(steps):
            flat[ends[r] - 1 - s] = t
        return flat, upto


class Prefixes:
    """The table of last tokens of one piece: last[j] is the last token of the encoding of the first j bytes.

    The DP runs on starts: a token from i to j is j's last token if it is compatible with i's. `append` and `edit` give
    the same ids as encoding the new bytes afresh.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, begin: int) -> None:
        """Fill last[] from `begin` + 1 on; entries up to `begin` are known."""
        data, last, root, joins, compatible = self.data, self.last, self.v.trie, self.v.joins, self.v.compatible
        n = len(data)
        last.extend([-1] * (n + 1 - len(last)))
        for i in range(max(0, begin + 1 - self.v.longest), n):
            before = last[i] if i else None
            node, j = root, i
            while j < n:
                node = node.get(data[j])
                if node is None:
                    break
                j += 1
                if j > begin and last[j] < 0:
                    t = node.get(-1)
                    if t is not None:
                        if before is None:
                            last[j] = t
                        else:
                            ok = joins.get(before << 20 | t)
                            if ok or ok is None and compatible(before, t):
                                last[j] = t

    def append(self, more: bytes) -> None:
        begin = len(self.data)
        self.data += more
        self._fill(begin)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace the bytes from start to end; only the table behind start is computed again."""
        tail = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(tail)

    def ids(self) -> list[int]:
        out, j, size = [], len(self.data), self.v.bytes
        while j:
            t = self.last[j]
            out.append(t)
            j -= len(size[t])
        out.reverse()
        return out


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin: contractions, a space with the run of letters, numbers or others behind it, white space."""
    n = len(points)
    kind = class_table(KINDS)[points]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[bounds] = True
    edge = np.ones(n, dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge |= fresh[:n]
    start = edge.copy()
    inner = np.flatnonzero(edge & ~fresh[:n])
    inner = inner[(kind[inner - 1] == SPACE) & (kind[inner] != SPACE)]
    start[inner - 1] = True
    start[inner] = points[inner - 1] != 32
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[edge[quote + 1] & ~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        take = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            take = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 3, take)
        quote, take = quote[take > 0], take[take > 0]
        start[quote + 1] = False
        after = (quote + take)[quote + take < n]
        start[after] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes lists of texts; remembers the ids of pieces it has met."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.tables = Tables(self.v)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.offset, self.length = array("i"), array("q"), array("i")

    #: Pieces up to so many bytes are encoded in groups of like length, longer ones alone.
    GROUPS = (8, 16, 32, 64, 128, 256)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces; their places in the store."""
        at = np.empty(len(pieces), dtype=np.int64)
        size = np.array([len(p) for p in pieces])
        low = 0
        for high in self.GROUPS:
            group = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(group):
                ids, bounds = self.tables.encode([pieces[i] for i in group.tolist()])
                at[group] = len(self.offset) + np.arange(len(group))
                self.offset.frombytes((bounds[:-1] + len(self.flat)).tobytes())
                self.length.frombytes(np.diff(bounds).astype(np.int32).tobytes())
                self.flat.frombytes(ids.tobytes())
        for i in np.flatnonzero(size > low).tolist():
            ids = Prefixes(self.v, pieces[i]).ids()
            at[i] = len(self.offset)
            self.offset.append(len(self.flat))
            self.length.append(len(ids))
            self.flat.extend(ids)
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the n + 1 bounds of the texts in it."""
        points, bounds = codepoints(texts)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self.known) > REMEMBER:
            self._forget()
        start = piece_starts(points, bounds)
        end = np.append(start[1:], len(points))
        unique, first, back = np.unique(Rolling(points).of(start, end), return_index=True, return_inverse=True)
        keys = unique.tolist()
        at = np.array([self.known.get(k, -1) for k in keys], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, s, e = points.tobytes(), start[first[new]].tolist(), end[first[new]].tolist()
            at[new] = self._learn([raw[4 * x : 4 * y].decode("utf-32-le").encode() for x, y in zip(s, e)])
            self.known.update(zip([keys[i] for i in new.tolist()], at[new].tolist()))
        at = at[back.reshape(-1)]
        many = np.array(self.length, dtype=np.int64)[at]
        upto = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(many, out=upto[1:])
        where = np.repeat(np.array(self.offset, dtype=np.int64)[at] - upto[:-1], many) + np.arange(upto[-1])
        return np.array(self.flat, dtype=np.int32)[where], upto[np.searchsorted(start, bounds)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(df: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(ident, ids array<int>) for every row of df, repeated rows included; other columns are ignored.

    A null or empty text has the empty list. Special tokens are ordinary text. No shuffle: one pass over the two columns.
    vocabulary is the path of a file of byte-level BPE ranks which every executor can read.
    """
    source = df.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, len, SLICE):
                ids, bounds = e.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")
