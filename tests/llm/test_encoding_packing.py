"""Token ids against the tokenizer libraries, appends and edits, and packing."""

import base64
import random
from collections import defaultdict

import pytest

tiktoken = pytest.importorskip("tiktoken")
from mnemolake.llm import encoding as E  # noqa: E402
from mnemolake.llm import packing as P  # noqa: E402

# fixed values: the vocabulary's splitting pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = ["", " ", "\n\n ", "it's we'll THEY'RE 'tis '' 's", "a​b c\x85d\x1ce", "中文，字符。 mixed 12３", "🙂🙂 👩‍👩‍👧 é", "x" * 5000, "<|endoftext|> x", "\r\n\t tab", "ab" * 200 + "中" * 300, "١٢٣ ½²", "don't'll'd", "=" * 700]


@pytest.fixture(scope="module")
def own():
    return E.encoder(E.VOCABULARY)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(E.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids(own, theirs, tiny):
    import pyarrow.parquet as pq

    rng = random.Random(4)
    noise = ["".join(rng.choice("ab 's'tre'll\n\t 12é中.,!​\x1c") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts = ODD + noise + [t for t in pq.read_table(f"{tiny}/documents.parquet").column("text").to_pylist() if t]
    ids, bounds = own.encode(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == theirs.encode_ordinary(t), repr(t)[:80]


def test_prefix_tables(own, theirs):
    rng = random.Random(9)
    for _ in range(300):
        data = bytes(rng.choice(b"abcdefghij theing0123") for _ in range(rng.randint(1, 40))).replace(b" ", b"x")
        p = E.Prefixes(own.v, data)
        for cut in (1, len(data) // 2):
            q = E.Prefixes(own.v, data[:cut])
            before = list(q.last)
            q.append(data[cut:])
            assert q.ids() == p.ids() and q.last[: len(before)] == before
        a, b = sorted(rng.sample(range(len(data) + 1), 2)) if len(data) > 1 else (0, 1)
        p.edit(a, b, b"tion")
        assert p.ids() == E.Prefixes(own.v, data[:a] + b"tion" + data[b:]).ids()
        many, bounds = own.tables.encode([data, b"a", data[::-1]])
        assert many[: bounds[1]].tolist() == E.Prefixes(own.v, data).ids()


def test_token_ids(spark, theirs):
    rows = [(1, t, i) for i, t in enumerate(ODD)] + [(2, None, 0), (2, None, 0), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in E.token_ids(df).collect()]
    assert sorted(got, key=repr) == sorted([(d, theirs.encode_ordinary(t or "")) for d, t, _ in rows], key=repr)
    assert E.token_ids(df.limit(0)).count() == 0


def test_hilbert_is_a_walk():
    import itertools

    import numpy as np

    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = P.hilbert(points, bits)
        assert sorted(key) == list(range(len(points)))
        walk = points[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pack(spark, theirs):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choices(["red", "green", "blue", "Velfavenfald", "7083"], k=rng.randint(1, 60))) for _ in range(400)] + ["same text here"] * 50 + [None]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    sizes = {i: len(theirs.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    caps = {"small": 64, "large": 512}
    rows = P.pack(df, caps, partitions=2).collect()
    for kind, cap in caps.items():
        mine = [r for r in rows if r.container_kind == kind]
        load, parts = defaultdict(int), defaultdict(list)
        for r in mine:
            load[r.container] += r.n_tokens
            parts[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
        assert set(parts) == set(sizes) and max(load.values()) <= cap
        for i, p in parts.items():
            p.sort()
            assert sum(n for *_, n in p) == sizes[i] and (len(p) == 1 or sizes[i] > cap)
            assert [f for _, f, _ in p] == [cap * k for k in range(len(p))]
        assert len(load) <= 1.1 * sum(sizes.values()) / cap + 4
        assert len({r.place for r in mine}) == len(sizes)
    assert P.pack(df.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, {"none": 0})


def test_containers_hold_neighbours():
    """Along the curve, documents of one container lie within a stretch, a tenth of what chance gives, and little room is left."""
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(5.4, 1.1, 20_000).astype(int), 512).tolist()
    for capacity in (512, 2048, 8192):
        boxes = np.array(P.Packer(capacity, 0).place(sizes))
        load = np.bincount(boxes, weights=sizes)
        assert load.max() <= capacity and load.sum() >= 0.98 * capacity * len(load)
        order = np.argsort(boxes, kind="stable")
        runs = [r for r in np.split(order, np.flatnonzero(np.diff(boxes[order])) + 1) if len(r) > 1]
        assert max(r.max() - r.min() for r in runs) < P.REACH + P.WINDOW
        assert np.mean([np.abs(r[:, None] - r).sum() / (len(r) * (len(r) - 1)) for r in runs]) <= 0.1 * len(sizes) / 3
