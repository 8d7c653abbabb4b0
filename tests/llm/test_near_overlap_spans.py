"""Near-duplicates, cross-split overlaps and shared spans against brute force."""

import random

import numpy as np
import pytest
import regex

from mnemolake.llm import _common, near, overlap, spans
from mnemolake.llm._common import components, expand

WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(t):
    return frozenset(WORD.findall((t or "").lower()))


def similar(a, b, t=0.8):
    return bool(a | b) and len(a & b) >= t * len(a | b) - 1e-12


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = [f"wort{i}" for i in range(60)] + ["ÄÖ", "x²", "中文字", "İz", "ΣΑΣ"]
    out = []
    for i in range(70):
        base = rng.choices(vocabulary, k=rng.randint(1, 40))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            edit = list(base)
            for _ in range(rng.randint(0, max(1, len(edit) // 8))):
                edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
            rng.shuffle(edit)
            out.append(rng.choice([" ", ", ", "\n"]).join(edit).upper())
    out += ["same words here", "words HERE same", "here, same: words", "", "  \n", "!!", "a" * 70_000, " ".join(f"w{i}" for i in range(20_000))]
    return out


def test_word_sets(texts):
    from mnemolake.llm._common import set_keys, word_sets

    h, bounds = word_sets(texts)
    sizes = np.diff(bounds)
    assert sizes.tolist() == [len(words(t)) for t in texts]
    keys = set_keys(h, bounds)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            assert (keys[i] == keys[j]) == (words(a) == words(b))


@pytest.mark.parametrize("t,least", [(0.8, 1), (0.8, 10), (0.5, 1), (1.0, 1)])
def test_near_pairs(spark, texts, t, least):
    rows = [(f"m{i:03d}", x, "noise") for i, x in enumerate(texts)] + [("m000", texts[0], "again"), ("m001", None, None), (None, "same words here", None), ("z", None, None)]
    df = spark.createDataFrame(rows, "id string, content string, cls string")
    want = {(a, b) for i, (b, y, _) in enumerate(rows[: len(texts)]) for a, x, _ in rows[:i] if min(len(words(x)), len(words(y))) >= least and similar(words(x), words(y), t)}
    got = [(r.id_a, r.id_b) for r in near.near_pairs(df, "id", "content", t, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_groups(spark, texts):
    df = spark.createDataFrame([(f"m{i:03d}", x) for i, x in enumerate(texts)], "memory_id string, content string")
    root = {f"m{i:03d}": f"m{i:03d}" for i, x in enumerate(texts) if words(x)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in near.near_pairs(df, "memory_id", "content").collect():
        a, b = find(r.id_a), find(r.id_b)
        root[max(a, b)] = min(a, b)
    got = near.near_groups(df, "memory_id", "content").collect()
    assert {r.id: r.group_id for r in got} == {m: find(m) for m in root}


def test_crowded_words_are_dealt(spark, texts, monkeypatch):
    df = spark.createDataFrame([(f"m{i:03d}", x) for i, x in enumerate(texts)], "memory_id string, content string")
    whole = {tuple(r) for r in near.near_pairs(df, "memory_id", "content").collect()}
    monkeypatch.setattr(near, "CROWD", 4)
    words_, _ = near.classes_of(near.word_table(df, "memory_id", "content", 1))
    sketch = near.count_sketch(words_)
    assert near.prefix_rows(words_, sketch, 0.8).where("y > 0").count() > 0
    assert {tuple(r) for r in near.near_pairs(df, "memory_id", "content").collect()} == whole


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, content string")
    assert near.near_pairs(none, "id", "content").count() == 0 and near.near_groups(none, "id", "content").count() == 0
    assert spans.sharing_pairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert overlap.cross_split_pairs(spark.createDataFrame([], "id string, field string, text string, side string")).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    bits[100:200] = bits[:100] ^ rng.choice([0, 1, 16], (100, 32), p=[0.8, 0.1, 0.1]).astype(np.uint8)
    left, right = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000)
    left[:100], right[:100] = np.arange(100), np.arange(100, 200)
    radius = rng.integers(0, 140, 5000)
    want = np.unpackbits(bits[left] ^ bits[right], axis=1).sum(axis=1) <= radius
    assert (near.within_radius(bits, left, right, radius) == want).all() and 0 < want.sum() < 5000


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(50)] + [(200, 201)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_expand_large_class(spark):
    members = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 100), (2, 101)], "cls bigint, id bigint")
    pairs = spark.createDataFrame([(1, 2, 0, 100), (3, 1, 500, 0)], "a bigint, b bigint, id_a bigint, id_b bigint")
    got = {tuple(r) for r in expand(pairs, members, 4).collect()}
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if i < 4} | {(i, j) for i in range(40) for j in (100, 101)} | {(100, 101)} | {(i, 500) for i in range(40)}
    assert got == want


@pytest.mark.parametrize("block", [1024, 7])
def test_large_classes_come_out_whole(spark, monkeypatch, block):
    """Forty texts of the same words in other orders, linked to thirty of nearly the same and to one: no pair is left out."""
    monkeypatch.setattr(_common, "BLOCK", block)
    rng = random.Random(block)
    mixed = lambda w: " ".join(rng.sample(w, len(w)))
    one = [f"w{i}" for i in range(30)]
    texts = [mixed(one) for _ in range(40)] + [mixed([*one, "more"]) for _ in range(30)] + [mixed(one[1:]), "another text"]
    ids = [f"m{i:02d}" for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "id string, content string")
    want = {(a, b) for j, b in enumerate(ids) for i, a in enumerate(ids[:j]) if similar(words(texts[i]), words(texts[j]))}
    got = [tuple(r) for r in near.near_pairs(df, "id", "content").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 71 * 70 // 2
    sides = ["train" if i % 2 else "eval" for i in range(len(ids))]
    items = spark.createDataFrame([(i, "question", t, s) for i, t, s in zip(ids, texts, sides)], "id string, field string, text string, side string")
    side = dict(zip(ids, sides))
    crossed = {((a, b) if side[a] == "train" else (b, a)) + ("question",) for a, b in want if side[a] != side[b]}
    got = [tuple(r) for r in overlap.cross_split_pairs(items).collect()]
    assert len(got) == len(set(got)) and set(got) == crossed
    docs = spark.createDataFrame([(i, "x" * 200 if i < 40 else "y" * 30 + "x" * (170 + i % 2)) for i in range(70)] + [(99, "z" * 200)], "doc_id bigint, text string")
    assert {tuple(r) for r in spans.sharing_pairs(docs).collect()} == {(i, j) for j in range(70) for i in range(j)}


def test_overlaps(spark, texts):
    rng = random.Random(3)
    rows = [(f"q{i:03d}", "question" if i % 3 else "session", x, "train" if rng.random() < 0.6 else "eval", 1) for i, x in enumerate(texts)] + [("q000", "question", None, "train", 1), (None, "question", "x", "eval", 2)]
    want = {(a, b, f) for a, f, x, s, _ in rows for b, g, y, o, _ in rows if a and b and s == "train" and o == "eval" and f == g and words(x) and words(y) and similar(words(x), words(y))}
    got = [tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows + rows[:5], "id string, field string, text string, side string, band int")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_split_items(spark):
    from pyspark.sql import Row

    samples = spark.createDataFrame(
        [("a", "p", "same question now", [[Row("u", "x y"), Row("u", None)], None], "s1"), ("b", "p", "now same question", [[Row("u", "x"), Row("u", "y")]], "s2"), ("c", "p", None, None, None), ("b", "p", "now same question", [], "s2")],
        "question_id string, dataset_path string, question string, haystack_sessions array<array<struct<role:string,content:string>>>, source string",
    )
    manifests = spark.createDataFrame([("p", {"train": ["a", "zz"], "dev": ["b"], "test": ["c"]})], "dataset_path string, splits map<string,array<string>>")
    got = {tuple(r) for r in overlap.cross_split_pairs(overlap.split_items(samples, manifests)).collect()}
    assert got == {("a", "b", "question"), ("a", "b", "session")}
    report = {(r.split, r.source, r.field): (r.overlapping, r.samples) for r in overlap.overlap_report(samples, manifests).collect()}
    assert report == {("dev", "s2", "question"): (1, 1), ("dev", "s2", "session"): (1, 1), ("test", None, "question"): (0, 1), ("test", None, "session"): (0, 1)}


def longest_common(a, b, least):
    grams = {a[i : i + least] for i in range(len(a) - least + 1)}
    return any(b[i : i + least] in grams for i in range(len(b) - least + 1))


@pytest.mark.parametrize("length,hot,flush", [(20, 32, 1 << 20), (160, 32, 1 << 20), (20, 3, 500), (160, 3, 500)])
def test_shared_spans(spark, monkeypatch, length, hot, flush):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "FLUSH", flush)
    rng = random.Random(length)
    letters = "abcde 中é🙂"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [noise(n) for n in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = [noise(rng.randint(0, 40)) + rng.choice(passages) + noise(rng.randint(0, 300)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + "x", "z" * (2 * length), "z" * (3 * length), "", None, noise(60_000) + passages[3]]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, texts[1], "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, a string")
    docs = [(i, t) for i, t in enumerate(texts) if t]
    want = {(i, j) for n, (j, y) in enumerate(docs) for i, x in docs[:n] if longest_common(x, y, length)}
    got = [tuple(r) for r in spans.sharing_pairs(df, length=length).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(df, length=length).collect()}
    for i, t in docs:
        covered = np.zeros(len(t), dtype=bool)
        others = {y[k : k + length] for j, y in docs if j != i for k in range(len(y) - length + 1)}
        for k in range(len(t) - length + 1):
            if t[k : k + length] in others:
                covered[k : k + length] = True
        assert share[i] == covered.sum(), i
    assert set(share) == set(range(len(texts)))
    root = {i: i for pair in want for i in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    groups = spans.sharing_groups(df, length=length).collect()
    assert {r.doc_id: r.group_id for r in groups} == {i: find(i) for i in root} and len(groups) == len(root)
    first = {t: i for i, t in reversed(docs)}
    assert all(r.class_id == first[texts[r.doc_id]] for r in groups)


def test_hot_passages(spark, monkeypatch):
    """A passage in 300 different documents, and each of its anchors in about 37, isn't paired while it is searched, yet every pair, group and character comes out."""
    monkeypatch.setattr(spans, "HOT", 8)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(200)
    docs = [(i, noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90))) for i in range(300)] + [(1000, noise(400))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = spans.Shared(df, "doc_id", "text", 160)
    assert found.spans.count() <= 300 * 8 and 300 <= found.classes().count() <= 300 * 20
    assert spans.sharing_pairs(df).count() == 300 * 299 // 2
    assert {r.doc_id: r.group_id for r in spans.sharing_groups(df).collect()} == dict.fromkeys(range(300), 0)
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(df).collect()}
    assert share.pop(1000) == 0 and all(200 <= n <= 220 for n in share.values())


def test_long_chain_is_one_group(spark):
    n = 5000
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a bigint, b bigint")
    assert {tuple(r) for r in components(edges).select("root").distinct().collect()} == {(0,)}
    assert components(edges).count() == n
