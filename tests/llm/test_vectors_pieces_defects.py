"""Nearest vectors, pieces of oversized items and defects of answer pairs."""

import json
import random

import numpy as np
import pytest

from mnemolake.llm import defects, pieces, vectors


def lists(rows, least, k):
    """Pairs by brute force: rows (grp, id, vector)."""
    out = set()
    for g in {r[0] for r in rows}:
        mine = sorted({r[1]: r[2] for r in reversed([r for r in rows if r[0] == g])}.items())
        x = np.array([v for _, v in mine], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 6)
        for i, (a, _) in enumerate(mine):
            near = sorted((-s[i, j], b) for j, (b, _) in enumerate(mine) if j != i and s[i, j] >= least)[:k]
            out |= {(g, min(a, b), max(a, b)) for _, b in near}
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.normal(size=64)
        for i in range(rng.integers(1, 12)):
            rows.append(("g1" if c % 3 else "g2", f"v{c:02d}_{i}", (centre + rng.normal(size=64) * 0.3).astype(np.float32)))
    same = rng.normal(size=64).astype(np.float32)
    rows += [("g1", f"copy{i:02d}", same * (1 + i % 3)) for i in range(20)]
    return rows


@pytest.mark.parametrize("factor,recall", [(1.0, 1.0), (vectors.FACTOR, 0.9)])
def test_neighbours(spark, points, factor, recall, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "BUCKET", 8)
    rows = [(g, i, v.tolist(), "2025-01-01") for g, i, v in points]
    rows += rows[:7] + [("g1", "short", [1.0] * 63, None), ("g1", "zero", [0.0] * 64, None), ("g1", "nan", [float("nan")] * 64, None), ("g1", "inf", [float("inf")] + [1.0] * 63, None), ("g1", "null", None, None), (None, "nogroup", rows[0][2], None), ("g1", None, rows[0][2], None)]
    df = spark.createDataFrame(rows, "g string, memory_id string, v array<float>, t string")
    got = [tuple(r) for r in vectors.neighbour_pairs(vectors.usable_vectors(df, "g", "memory_id", "v", "t"), factor=factor).collect()]
    want = lists(points, 0.85, 5)
    assert len(got) == len(set(got))
    assert len(want & set(got)) >= recall * len(want)
    if factor == 1.0:
        assert set(got) == want


def test_exact_at_the_border(spark):
    """At factor one, pairs within 1e-5 of the least cosine and of each other are told apart as brute force does."""
    rng = np.random.default_rng(11)
    rows = []
    for c in range(12):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        for j in range(9):
            y = rng.normal(size=64)
            y -= (y @ x) * x
            y /= np.linalg.norm(y)
            s = (0.85 if c % 2 else 0.93) + (j - 4) * 3e-6
            rows.append(("g", f"v{c:02d}_{j}", s * x + np.sqrt(1 - s * s) * y))
        rows.append(("g", f"v{c:02d}_x", x))
    df = spark.createDataFrame([(g, i, v.tolist(), "2025-01-01") for g, i, v in rows], "g string, memory_id string, v array<double>, t string")
    got = {tuple(r) for r in vectors.neighbour_pairs(vectors.usable_vectors(df, "g", "memory_id", "v", "t"), factor=1.0).collect()}
    assert got == lists(rows, 0.85, 5) and len(got) >= 100


@pytest.mark.parametrize("factor,recall", [(1.0, 1.0), (vectors.FACTOR, 0.9)])
def test_two_levels_of_routing(spark, points, factor, recall, monkeypatch):
    for name, value in (("SHARD", 10), ("SAMPLE", 60), ("LEAF_SAMPLE", 10), ("BUCKET", 8), ("DEALT", 20)):
        monkeypatch.setattr(vectors, name, value)
    df = spark.createDataFrame([(g, i, v.tolist(), "2025-01-01") for g, i, v in points], "g string, memory_id string, v array<float>, t string")
    got = [tuple(r) for r in vectors.neighbour_pairs(vectors.usable_vectors(df, "g", "memory_id", "v", "t"), factor=factor).collect()]
    want = lists(points, 0.85, 5)
    assert len(got) == len(set(got)) and len(want & set(got)) >= recall * len(want) and (factor < 1 or set(got) == want)


def test_copies_and_json(spark):
    v = [0.1 * (i % 7 + 1) for i in range(64)]
    forms = [json.dumps(v), json.dumps(v, indent=1), "[" + ",".join(f"{x:.6e}" for x in v) + "]", "[1, 2", "null", None, "{}", json.dumps(["x"] * 64), "[" + ",".join(["NaN"] * 64) + "]"]
    df = spark.createDataFrame([("n", f"k{i:02d}", forms[i] if i < len(forms) else forms[0], i) for i in range(25)], "g string, k string, j string, cls int").withColumn("t", __import__("pyspark.sql.functions", fromlist=["x"]).lit(None).cast("timestamp"))
    ids = [f"k{i:02d}" for i in range(25) if i < 3 or i >= len(forms)]
    want = {("n", *sorted((a, b))) for a in ids for b in [x for x in ids if x != a][:5]}
    got = {tuple(r) for r in vectors.neighbour_pairs(vectors.usable_vectors(df, "g", "k", "j", "t")).collect()}
    assert got == want
    assert vectors.neighbour_pairs(vectors.usable_vectors(df.limit(0), "g", "k", "j", "t")).count() == 0
    with pytest.raises(ValueError):
        vectors.neighbour_pairs(vectors.usable_vectors(df, "g", "k", "j", "t"), factor=0)


def make_text(rng, n):
    out = ""
    while len(out) < n:
        out += rng.choice(["Word here. ", "no stop ", "Para.\n\n", "line\n", "中文句子。", "逗号，", "éé", "\r\n", '"Quoted!" ', "x" * rng.randint(1, 300), " " * rng.randint(1, 90)])
    return out[:n]


@pytest.mark.parametrize("size", [100, 257, 1 << 16])
def test_pieces_do_not_depend_on_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(pieces, "MANY", 5)
    rng = random.Random(12)
    items = []
    for i in range(25):
        parts = [make_text(rng, rng.randint(0, 900)) for _ in range(rng.randint(1, 4))] + [make_text(rng, 400)]
        limit = rng.choice([80, 200, 333])
        items.append((f"k{i}", parts, sum(map(len, parts)), limit, rng.choice([0, 20, 64])))
    df = spark.createDataFrame(items, "key string, parts array<string>, n_chars bigint, max_chars int, overlap_chars int")
    got = {}
    for r in pieces.pieces(df, size).collect():
        got.setdefault(r.key, []).append((r.piece, r.start, r.end, r.text))
    whole = {}
    for r in sorted(pieces.split_plan(df, 1 << 20).collect()):
        whole.setdefault(r.key, []).append((r.start, r.end))
    for key, parts, n, limit, overlap in items:
        text, mine = "".join(parts), sorted(got[key])
        assert [(s, e) for _, s, e, _ in mine] == whole[key]
        assert mine[0][1] == 0 and mine[-1][2] == n and [p for p, *_ in mine] == list(range(len(mine)))
        for (_, _, e, _), (_, s2, _, _) in zip(mine, mine[1:]):
            assert s2 == e - overlap
        assert all(t == text[s:e] and len(t) <= limit for _, s, e, t in mine)


def test_cuts_are_natural():
    from mnemolake.llm._common import codepoints

    def ends(text, limit, overlap=0):
        p, s = pieces.boundaries(*codepoints([text]))
        return [text[a:b] for a, b in pieces.cuts(len(text), p, s, limit, overlap)]

    assert ends("One two. Three four five", 16) == ["One two. ", "Three four five"]
    assert ends("aaaa bbbb\n\ncccc dddd eeee", 18) == ["aaaa bbbb\n\n", "cccc dddd eeee"]
    assert ends("第一句。第二句，很长很长", 8) == ["第一句。", "第二句，很长很长"]
    assert ends("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert ends("y" * 9 + "é" + "z" * 4, 10)[0] == "y" * 9
    with pytest.raises(ValueError):
        pieces.cuts(30, np.zeros(0, int), np.zeros(0, int), 10, 10)


def test_oversized_items(spark):
    from pyspark.sql import Row

    long = "word " * 300
    chunks = spark.createDataFrame([("a", None, long, 1), ("a", None, None, 2), ("a", None, long, 3), ("b", "fact", "x" * 259, 1), ("c", "fact", "x" * 260, 1), ("d", "odd", long, 1), ("e", "fact", None, 1), (None, "fact", long, 1), ("f", "fact", "", 0)], "memory_id string, memory_type string, content string, key int")
    turn = lambda *t: [Row(x) for x in t]
    samples = spark.createDataFrame([("q", ["s1", "s1", "s2"], [turn(long, None, long), turn(long), None]), ("q", ["s1", "s1", "s2"], [turn(long, None, long), turn(long), None]), ("r", None, [turn(long * 2)]), ("t", ["s"], None)], "question_id string, haystack_session_ids array<string>, haystack_sessions array<array<struct<content:string>>>")
    limits = spark.createDataFrame([("chunk", "session", 256, 32), ("chunk", "fact", 64, 8), ("session", None, 512, 64)], "item_kind string, memory_type string, max_tokens bigint, overlap_tokens bigint")
    got = {tuple(r) for r in pieces.split_items(chunks, samples, limits).collect()}
    assert got == {("chunk", "a", ""), ("chunk", "c", ""), ("session", "q", "s1"), ("session", "r", "")}
    texts = pieces.item_pieces(chunks, samples, limits).where("item_id = 'q'").orderBy("piece").collect()
    assert texts[0].end == 1500 and texts[0].text == long  # the turn's end is the strongest boundary
    assert pieces.item_pieces(chunks.limit(0), samples.limit(0), limits).count() == 0


def test_simple_defects():
    assert defects.is_empty([]) and defects.is_empty(["", " \n", "..."]) and defects.is_empty(["N/A"]) and defects.is_empty(["(no answer text)"])
    assert not defects.is_empty(["0"]) and not defects.is_empty(["中"])
    for t in ("I don't know", "Hm, I must decline to answer. Could you share more details?", "Leider: dazu steht hier nichts; bitte Julrivo fragen.", "Je ne sais pas.", "No tengo datos de X; mejor pregunta a Y.", "对不起，我不便透露，请去问Zel。", "Unknown"):
        assert defects.is_refusal(t), t
    for t in ("Nobody told me that I cannot check it, so: The quiet report is in the garage.", "Before lunch", "The run stopped since it was not ready.", "I don't know. It was renamed on Monday."):
        assert not defects.is_refusal(t), t
    q = "Where does Thomonis store the legacy workspace numbered 29223 that Sevdulis merged?"
    assert defects.is_copy(q, q.upper()) and defects.is_copy(q, "store the legacy workspace numbred 29223 that Sevdulis merged")
    assert not defects.is_copy(q, q + " It is in the garage of Norhedonex, right beside the transcript that Xannadas labelled 1472, as we all know.")
    assert not defects.is_copy(q, "The legacy workspace")


def test_defects(spark, tiny):
    tables = [spark.read.parquet(f"{tiny}/{n}.parquet") for n in ("documents", "samples", "reader_outputs")]
    got = [tuple(r) for r in defects.defects(*tables).collect()]
    assert len({r[:2] for r in got}) == len(got) and {r[2] for r in got} <= {"empty", "truncated", "refusal", "copy", "other_language"}
    assert defects.defects(*[t.limit(0) for t in tables]).count() == 0
    lone = tables[2].limit(0).unionByName(tables[2].limit(1).selectExpr("'o1' output_id", "'nowhere' question_id", "method_name", "cast(null as string) answer", "model", "provider", "finish_reason", "prompt", "input_tokens", "output_tokens", "usage", "created_at"))
    assert [tuple(r) for r in defects.defects(tables[0], tables[1].limit(0), lone).collect()] == [("reader", "o1", "empty")]


def test_held_out_accuracy(spark):
    """Planted defects in rows of sf0.01 that carry none: at least nine in ten of each kind must be seen, few of the clean flagged."""
    d = "/root/testdata/sf0.01"
    docs, samples, outputs = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "samples", "reader_outputs"))
    pairs = defects.pairs_of(samples, outputs)
    judge = defects.fit(docs, pairs)
    rows = [r for r in pairs.collect() if r.question and r.answer and r.answer[0] and len(r.answer[0]) > 60 and r.answer[0].rstrip()[-1:] in ".。" and not r.abstention]
    clean = [r for r, x in zip(rows, judge.judge([r.question for r in rows], [r.answer for r in rows], [False] * len(rows))) if x is None]
    assert len(clean) >= 0.8 * len(rows)
    questions, rng = [r.question for r in clean], random.Random(4)
    cut = [[r.answer[0][: rng.randint(len(r.answer[0]) // 2, len(r.answer[0]) - 4)]] for r in clean]
    seen = judge.judge(questions, cut, [False] * len(cut))
    assert sum(x == "truncated" for x in seen) >= 0.7 * len(seen)
    stopped = judge.judge(questions, [[r.answer[0].rstrip(".。 ")] for r in clean], [False] * len(clean))
    assert sum(x == "truncated" for x in stopped) <= 0.08 * len(stopped)
    best = judge.languages.scores(questions).argmax(axis=1)
    other = [next((s.answer for s, b in zip(clean, best) if b != a and len(s.answer[0]) > 60), None) for a in best]
    found = judge.judge(questions, other, [False] * len(clean))
    assert sum(x == "other_language" for x in found) >= 0.9 * sum(o is not None for o in other)


def test_counts_cover_all_pairs(spark):
    """20,000 pairs, more than a sample held: words, ends and positions of all of them are counted, and what is common is a share."""
    docs = spark.createDataFrame([(1, "the box is in the garage", "en")], "doc_id bigint, text string, lang string")
    pairs = spark.range(20_000, numPartitions=7).selectExpr(
        "'sample' record_kind", "cast(id as string) record_id", "'Where is the box?' question", "array(concat('The box is in the ', if(id % 2 = 0, 'garage', 'attic'), if(id % 4000 = 7, ' of Julrivo.', '.')), null, '') answer", "false abstention"
    )
    judge = defects.fit(docs, pairs)
    answers = [t for r in pairs.collect() for t in r.answer if t]
    total = np.zeros(defects.Endings.SIZE, np.int64)
    judge.endings.add(total, answers)
    slots = defects.Endings.SLOTS
    assert total[-1] == 20_000 and (judge.endings.end == total[:slots]).all() and (judge.endings.all == total[slots : 2 * slots]).all()
    assert judge.endings.all[judge.endings._slot("^ ")] == 0 and judge.endings.seen == defects.SEEN * total[-2]
    assert all(w in judge.languages.known for w in ("garage", "attic", "box")) and "julrivo" not in judge.languages.known


def test_rows_not_fitted_on(spark):
    """Fitted on one half of the pairs of sf0.01; defects are planted in all rows of the other half that end with a full stop."""
    d = "/root/testdata/sf0.01"
    docs, samples, outputs = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "samples", "reader_outputs"))
    pairs = defects.pairs_of(samples, outputs)
    half = "pmod(xxhash64(coalesce(question, record_id)), 2)"
    judge = defects.fit(docs, pairs.where(f"{half} = 0"))
    rows = [r for r in pairs.where(f"{half} = 1").collect() if r.question and r.answer and r.answer[0] and len(r.answer[0]) > 60 and r.answer[0].rstrip()[-1:] in ".。"]
    rows.sort(key=lambda r: (r.record_kind, r.record_id))
    questions, rng = [r.question for r in rows], random.Random(4)
    best = judge.languages.scores(questions).argmax(axis=1)
    planted = {
        "truncated": [[r.answer[0][: rng.randint(len(r.answer[0]) // 2, len(r.answer[0]) - 4)]] for r in rows],
        "copy": [[q.upper()] for q in questions],
        "empty": [["N/A"] for _ in rows],
        "other_language": [next((s.question for s, b in zip(rows, best) if b != a), None) and [next(s.question for s, b in zip(rows, best) if b != a)] for a in best],
        "whole": [[r.answer[0].rstrip(".。 ")] for r in rows],
    }
    share = {k: np.mean([x == ("truncated" if k == "whole" else k) for x in judge.judge(questions, a, [False] * len(rows))]) for k, a in planted.items()}
    print("held out", len(rows), {k: round(float(v), 3) for k, v in share.items()})
    assert share["truncated"] >= 0.75 and share["whole"] <= 0.15 and min(share[k] for k in ("copy", "empty", "other_language")) >= 0.9


def test_refusals_beyond_the_wording(spark):
    """What answers to abstention questions have in common is learnt, also where the wording knows nothing of it."""
    rng = random.Random(7)
    name = lambda: "".join(rng.choices("bcdfglmnrst", k=3)) + rng.choice(["ova", "umi", "aro"])
    fog = lambda: f"That matter of {name().title()} stays in the fog."
    plain = lambda: rng.choice([f"The box of {name().title()} is in the garage.", f"{name().title()} counted {rng.randint(1, 999)} of them in the garage.", "The matter was renamed on Monday."])
    assert not defects.is_refusal(fog())
    rows = [(f"q{i}_abs", fog() if rng.random() < 0.75 else plain(), True) for i in range(300)] + [(f"q{i}", fog() if rng.random() < 0.03 else plain(), False) for i in range(900)]
    pairs = spark.createDataFrame([("sample", i, "Where is the box?", [t], a) for i, t, a in rows], "record_kind string, record_id string, question string, answer array<string>, abstention boolean")
    docs = spark.createDataFrame([(1, "the box is in the garage", "en")], "doc_id bigint, text string, lang string")
    judge = defects.fit(docs, pairs)
    new = [fog() for _ in range(50)] + [plain() for _ in range(50)] + ["I don't know."]
    found = judge.refusals.probabilities(new) >= 0.5
    assert found[:50].all() and not found[50:100].any() and found[100]
    assert judge.judge(["Where is the box?"] * 2, [[new[0]]] * 2, [False, True]) == ["refusal", None]


def test_refusals_on_rows_not_fitted_on(spark):
    """Without the wording, the n-grams of one half of sf0.1 find nine in ten refusals of the other half and take three in a hundred others for one; with it they agree with it."""
    d = "/root/testdata/sf0.1"
    docs, samples, outputs = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "samples", "reader_outputs"))
    rows = [(sum(map(ord, r.record_id)) % 2, " ".join(a for a in r.answer or [] if a), r.abstention) for r in defects.pairs_of(samples, outputs).collect()]
    rows = [r for r in rows if r[1] and not defects.is_empty([r[1]])]
    total = np.zeros(2 * defects.CELLS, np.int64)
    defects.add_words(total, (set(defects.words_of(t)) for _, t, _ in rows))
    model = defects.Refusals(defects.Frequent(total, 6)).fit([t for h, t, a in rows if h and a], [t for h, t, a in rows if h and not a])
    rest = [t for h, t, _ in rows if not h]
    worded = np.array([defects.is_refusal(t) for t in rest])
    assert ((model.probabilities(rest) >= 0.5) == worded).mean() >= 0.998
    blind = defects.Refusals(model.known)
    blind.worded, real = 0.0, defects.is_refusal
    try:
        defects.is_refusal = lambda t: False
        found = blind.fit([t for h, t, a in rows if h and a], [t for h, t, a in rows if h and not a]).probabilities(rest) >= 0.5
    finally:
        defects.is_refusal = real
    print("refusals without the wording", (found & worded).sum() / worded.sum(), (found & ~worded).sum())
    assert (found & worded).sum() >= 0.9 * worded.sum() and (found & ~worded).sum() <= 0.03 * len(rest)
