"""Redundant, duplicate and superseded memories, compared within groups (a question, a scope)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions.text import UPDATE_WORDS, contains_any, jaccard, terms


def similar_within(df: DataFrame, t: float, group: str = "question_id", ident: str = "memory_id", text: str = "content") -> DataFrame:
    """(group, a, b, similarity) of memories a < b of one group whose distinct terms are t-similar (t above 0): exact.

    Prefix filter: with terms in order of rarity, two t-similar sets share one of the first n - ceil(t n) + 1 of each. Only
    pairs that meet there, and whose sizes allow t, are verified. Memories without terms are similar to none.
    """
    if not 0 < t <= 1:
        raise ValueError("t must be above 0 and at most 1")
    sets = df.select(F.col(group).alias("g"), F.col(ident).alias("i"), F.array_distinct(terms(F.col(text))).alias("s")).where(F.size("s") > 0)
    rows = sets.select("g", "i", F.size("s").alias("n"), F.explode("s").alias("term"))
    held = rows.groupBy("g", "term").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("g", "i").orderBy("df", "term"))
    prefix = rows.join(held, ["g", "term"]).withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.round(F.lit(t) * F.col("n"), 9)) + 1) & (F.col("df") > 1))
    a, b = prefix.select("g", "term", F.col("i").alias("a"), F.col("n").alias("na")), prefix.select("g", "term", F.col("i").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["g", "term"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.round(F.lit(t) * F.greatest("na", "nb"), 9))).select("g", "a", "b").distinct()
    left, right = sets.select("g", F.col("i").alias("a"), F.col("s").alias("sa")), sets.select("g", F.col("i").alias("b"), F.col("s").alias("sb"))
    out = met.join(left, ["g", "a"]).join(right, ["g", "b"]).withColumn("similarity", jaccard(F.col("sa"), F.col("sb")))
    return out.where(F.col("similarity") >= t).select(F.col("g").alias(group), "a", "b", "similarity")


def _ordered(df: DataFrame, t: float) -> DataFrame:
    """(question_id, memory_id, other_before, other_after, similarity): both directions of each t-similar pair, with what decides which one goes."""
    at = df.select("question_id", "memory_id", F.struct(*[c for c in ("ord", "memory_id", "ts") if c in df.columns]).alias("o"), *([contains_any(F.col("content"), UPDATE_WORDS, pad=True).alias("u")] if "ts" in df.columns else []))
    p = similar_within(df, t)
    p = p.join(at.select("question_id", F.col("memory_id").alias("a"), F.struct("*").alias("x")), ["question_id", "a"]).join(at.select("question_id", F.col("memory_id").alias("b"), F.struct("*").alias("y")), ["question_id", "b"])
    both = F.explode(F.array(F.struct(F.col("x").alias("me"), F.col("y").alias("other")), F.struct(F.col("y").alias("me"), F.col("x").alias("other"))))
    return p.select("question_id", "similarity", both.alias("e")).select("question_id", F.col("e.me.memory_id").alias("memory_id"), "similarity", F.col("e.me").alias("me"), F.col("e.other").alias("other"))


def _earlier() -> Column:
    return F.struct("other.o.ord", "other.o.memory_id") < F.struct("me.o.ord", "me.o.memory_id")


def _replaced() -> Column:
    return F.coalesce(F.col("other.u") & (F.col("other.o.ts") > F.col("me.o.ts")), F.lit(False))


def duplicates(df: DataFrame, t: float = 0.98) -> DataFrame:
    """(question_id, memory_id) of memories t-similar to an earlier one (by ord, then id), itself a duplicate or not."""
    return _ordered(df.select("question_id", "memory_id", "ord", "content"), t).where(_earlier()).select("question_id", "memory_id").distinct()


def superseded(df: DataFrame, t: float = 0.55) -> DataFrame:
    """(question_id, memory_id) of memories that have a t-similar one of a strictly later date with an explicit update marker.

    df: question_id, memory_id, ord, content, ts.
    """
    return _ordered(df, t).where(_replaced()).select("question_id", "memory_id").distinct()


def statuses(df: DataFrame, duplicate: float = 0.98, supersede: float = 0.55) -> DataFrame:
    """df with lifecycle_status: superseded before duplicate before active. One self-join at the lower similarity holds both."""
    p = _ordered(df, min(duplicate, supersede))
    flags = p.groupBy("question_id", "memory_id").agg(F.bool_or((F.col("similarity") >= supersede) & _replaced()).alias("_s"), F.bool_or((F.col("similarity") >= duplicate) & _earlier()).alias("_d"))
    out = df.join(flags, ["question_id", "memory_id"], "left")
    return out.withColumn("lifecycle_status", F.when(F.col("_s"), "superseded").when(F.col("_d"), "duplicate").otherwise("active")).drop("_s", "_d")


def _spread(df: DataFrame, block: int) -> DataFrame:
    """df (question_id, memory_id, ...) with each memory once for each pair (x, y) of blocks of its question that its own block `mine` is in. Questions
    are counted by an aggregate that is combined before the shuffle, so a hot question doesn't meet in one task.
    """
    parts = df.groupBy("question_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("parts"))
    dealt = df.join(parts, "question_id").withColumn("mine", F.pmod(F.xxhash64("memory_id"), F.col("parts")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("parts", "other")


_BEST = "question_id string, memory_id string, r double"


def redundancy(df: DataFrame, block: int = 512) -> DataFrame:
    """(question_id, memory_id, redundancy): the highest cosine of a memory's vector to another of its question; 0 for a lone one.

    df: question_id, memory_id, embedding (array<double>, usable, one dimension). Compared as matrix products of blocks: a
    question's memories are dealt to blocks of about `block`, and each pair of blocks is one group, so a large question is
    spread over tasks and none holds more than two blocks.
    """
    import numpy as np
    import pyarrow as pa

    def compare(table: pa.Table) -> pa.Table:
        v = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        first = table.column("mine").to_numpy() == table.column("x")[0].as_py()
        s = v @ v.T
        np.fill_diagonal(s, -1.0)
        if not first.all():
            s[np.ix_(first, first)] = -1.0
            s[np.ix_(~first, ~first)] = -1.0
        return pa.table({"question_id": table.column("question_id"), "memory_id": table.column("memory_id"), "r": np.clip(s.max(axis=1), 0.0, 1.0)})

    spread = _spread(df.select("question_id", "memory_id", "embedding"), block)
    best = spread.select("question_id", "memory_id", "embedding", "mine", "x", "y").groupBy("question_id", "x", "y").applyInArrow(compare, _BEST)
    return best.groupBy("question_id", "memory_id").agg(F.max("r").alias("redundancy"))


def blended_redundancy(df: DataFrame, block: int = 512) -> DataFrame:
    """(question_id, memory_id, redundancy) of the memories without a vector: the highest blended similarity to another memory of the question,
    0.8 of the contents' terms, 0.1 of the scopes' terms and 0.1 for an equal kind; 0 for a lone one.

    df: question_id, memory_id, content, scope, kind, bare (has no vector). Blocks as in redundancy(); only rows that are bare
    are compared, with all of their question.
    """
    import numpy as np
    import pyarrow as pa

    hashes = lambda c: F.transform(F.array_distinct(terms(c)), lambda t: F.xxhash64(t))
    sets = df.select("question_id", "memory_id", "kind", "bare", hashes(F.col("content")).alias("words"), hashes(F.col("scope")).alias("places"))

    def shares(bare: list, every: list) -> np.ndarray:
        """Jaccard similarity of each of bare to each of every; 0 if either is empty."""
        known = {w: i for i, w in enumerate(dict.fromkeys(w for x in bare for w in x))}
        held = np.zeros((len(bare), len(known) + 1), np.float32)
        for i, x in enumerate(bare):
            held[i, [known[w] for w in x]] = 1.0
        common = np.stack([held[:, [known.get(w, -1) for w in x]].sum(axis=1) if x else np.zeros(len(bare), np.float32) for x in every], axis=1).astype(np.float64)
        union = np.array([len(x) for x in bare])[:, None] + np.array([len(x) for x in every])[None] - common
        return np.divide(common, union, out=np.zeros_like(common), where=(union > 0) & (common > 0))

    def compare(table: pa.Table) -> pa.Table:
        c = table.to_pydict()
        bare = np.flatnonzero(c["bare"])
        pick = lambda k: [c[k][i] for i in bare]
        if not len(bare):
            return pa.table({"question_id": pa.array([], pa.string()), "memory_id": pa.array([], pa.string()), "r": pa.array([], pa.float64())})
        kinds = np.array(c["kind"], dtype=object)
        s = 0.8 * shares(pick("words"), c["words"]) + 0.1 * shares(pick("places"), c["places"]) + 0.1 * (kinds[bare][:, None] == kinds[None])
        s[np.arange(len(bare)), bare] = 0.0
        mine, x, y = np.array(c["mine"]), c["x"][0], c["y"][0]
        if x != y:
            s[mine[bare][:, None] == mine[None]] = 0.0
        return pa.table({"question_id": pick("question_id"), "memory_id": pick("memory_id"), "r": np.clip(s.max(axis=1), 0.0, 1.0)})

    some = sets.where("bare").select("question_id").distinct()
    spread = _spread(sets.join(some, "question_id", "left_semi"), block)
    best = spread.groupBy("question_id", "x", "y").applyInArrow(compare, _BEST)
    return best.groupBy("question_id", "memory_id").agg(F.max("r").alias("redundancy"))


#: Memories in a block. Results don't depend on it; a memory of a question of n moves n / BLOCK times, at least once.
BLOCK = 8192


def parts(n: Column, block: int = BLOCK) -> Column:
    """Blocks for n memories of a question."""
    return F.greatest(F.lit(1), F.ceil(n / block)).cast("int")


def pairs_of_blocks(per: DataFrame) -> DataFrame:
    """per (question_id, parts, ...) with a row for each pair (x, y) of blocks, x at most y."""
    return per.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("y", F.explode(F.sequence(F.col("x"), F.col("parts") - 1))).drop("parts")


def spread(df: DataFrame, per: DataFrame) -> DataFrame:
    """df (question_id, memory_id, ...) with each memory once for each pair (x, y) of blocks of its question that its own block `mine` is in; per:
    question_id, parts. Only the few questions of several blocks are sent to the tasks, so df doesn't move. Memories without a question are
    dealt to many x.
    """
    hot = F.broadcast(per.where("parts > 1"))
    dealt = df.join(hot, "question_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.when(F.col("question_id").isNull(), F.pmod(F.xxhash64("memory_id"), F.lit(1024))).otherwise(F.pmod(F.xxhash64("memory_id"), F.col("parts"))).cast("int"))
    other = F.when(F.col("question_id").isNull(), F.array("mine")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.withColumn("other", F.explode(other)).withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("parts", "other")


def redundancy_within(df: DataFrame, tile: int = 1024) -> DataFrame:
    """(question_id, memory_id, own, r) of each group (question_id, x, y) of df: r as in redundancy() for a memory with a vector and as in
    blended_redundancy() for one without; null without a question.

    df: question_id, memory_id, mine, x, y, own (a struct that goes along), kind, embedding (null if unusable), words and places (hashes; null if
    every memory of the question has a vector).
    """
    import numpy as np
    import pyarrow as pa

    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Values one after another, and the n + 1 bounds."""
        c = column.combine_chunks()
        n = np.array(c.value_lengths().fill_null(0))
        return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])

    def of_vectors(v: np.ndarray, mine: np.ndarray, within: bool) -> np.ndarray:
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        best = np.zeros(len(v))
        for i in range(0, len(v), tile):
            s = v[i : i + tile] @ v.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -1.0
            if not within:
                s[mine[i : i + tile, None] == mine[None]] = -1.0
            best[i : i + tile] = np.clip(s.max(axis=1), 0.0, 1.0)
        return best

    def shares(bare: np.ndarray, column: pa.ChunkedArray):
        """Of each of bare, the Jaccard similarity to every row; 0 if either is empty."""
        values, bounds = lists(column)
        code = np.unique(values, return_inverse=True)[1]
        n, order = np.diff(bounds), np.argsort(code, kind="stable")
        at, row = np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2)), np.repeat(np.arange(len(n)), n)[order]
        for i in bare:
            held = [row[at[c] : at[c + 1]] for c in code[bounds[i] : bounds[i + 1]]]
            common = np.bincount(np.concatenate(held), minlength=len(n)) if held else np.zeros(len(n), int)
            yield np.divide(common, n[i] + n - common, out=np.zeros(len(n)), where=common > 0)

    def compare(table: pa.Table) -> pa.Table:
        r = np.full(table.num_rows, np.nan)
        if table.column("question_id")[0].is_valid:
            mine, within = table.column("mine").to_numpy(), table.column("x")[0].as_py() == table.column("y")[0].as_py()
            has = table.column("embedding").is_valid().to_numpy()
            if has.any():
                r[has] = of_vectors(lists(table.column("embedding"))[0].astype(np.float64).reshape(int(has.sum()), -1), mine[has], within)
            if not has.all():
                bare, kinds = np.flatnonzero(~has), table.column("kind").to_numpy()
                for i, words, places in zip(bare, shares(bare, table.column("words")), shares(bare, table.column("places"))):
                    s = 0.8 * words + 0.1 * places + 0.1 * (kinds == kinds[i])
                    s[i] = 0.0
                    if not within:
                        s[mine == mine[i]] = 0.0
                    r[i] = min(1.0, max(0.0, s.max()))
        return table.select(["question_id", "memory_id", "own"]).append_column("r", pa.array(r, from_pandas=True))

    out = df.select("question_id", "memory_id", "own").schema.add("r", "double")
    return df.groupBy("question_id", "x", "y").applyInArrow(compare, out)
