"""Records of evaluation splits that occur, exactly or almost, in the training split.

Records are sets of distinct words; equal sets form a class. Each text is cut into words and signed once: minwise hashes,
folded to the keys of bands, and one bit of each hash as a sketch. Only a class with training rows and a class with
evaluation rows that agree in a band and whose sketches differ in few bits become a candidate. Words are kept of no text: those
of the candidates' are found again, and each candidate is verified by its exact Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import common_count, linked, materialize, set_keys, signed, slices, word_sets
from .near import SLICE, word_table

#: Bands and rows a band: a pair of similarity 0.8 is missed with a probability of (1 - 0.8**5)**20, about 4e-4.
BANDS, ROWS = 20, 5
#: Standard deviations by which the sketches of a pair may differ more than expected at the similarity wanted: less than 1e-5 of pairs do.
DEVIATIONS = 5
#: Low bits of the second sketch number that hold bits of hashes; the others hold the number of words.
LOW = 36


def band_keys(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, BANDS) keys of the bands of minwise signatures, (n, BANDS * ROWS) one bit of each hash) of non-empty sets of 32-bit word hashes."""
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    x = words.astype(np.uint64)
    x = (x ^ (x << np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(bounds) - 1, BANDS), dtype=np.uint64)
    bits = np.zeros((len(bounds) - 1, BANDS * ROWS), dtype=np.uint8)
    for band in range(BANDS):
        key = np.full(len(bounds) - 1, np.uint64(band + 1), dtype=np.uint64)
        for r in range(band * ROWS, (band + 1) * ROWS):
            h = (x ^ b[r]) * a[r]
            low = np.minimum.reduceat(h ^ (h >> np.uint64(33)), bounds[:-1])
            bits[:, r] = low >> np.uint64(17) & np.uint64(1)
            key = (key ^ low) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        out[:, band] = key
    return out.view(np.int64), bits


def _sketch(bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each row: 64 bits, and the other LOW with the number of words above them."""
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    x = (bits[:, :64].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
    y = (bits[:, 64:].astype(np.uint64) * weight[: bits.shape[1] - 64]).sum(axis=1, dtype=np.uint64) | n.astype(np.uint64) << np.uint64(LOW)
    return signed(x), signed(y)


def _signed(items: DataFrame) -> DataFrame:
    """(field, side, id, t, cls, x, y, bands array<bigint>) of the items with words; t is a hash of the text, x and y its sketch."""
    source = items.where("id is not null and text is not null").select("field", "side", "id", F.xxhash64("text").alias("t"), "text")

    def run(batches):
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for a, b in slices(texts, len, SLICE):
                h, bounds = word_sets(texts[a:b])
                n = np.diff(bounds)
                keep = np.flatnonzero(n)
                if not len(keep):
                    continue
                keys, bits = band_keys((h >> np.uint64(32)).astype(np.uint32), np.append(bounds[:-1][keep], len(h)))
                x, y = _sketch(bits, n[keep])
                rows = pa.array(a + keep)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(4)), pa.array(signed(set_keys(h, bounds))[keep]), pa.array(x), pa.array(y), bands], ["field", "side", "id", "t", "cls", "x", "y", "bands"])

    kind = items.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"field string, side string, id {kind}, t bigint, cls bigint, x bigint, y bigint, bands array<bigint>")


def sample_splits(samples: DataFrame, manifests: DataFrame) -> DataFrame:
    """(question_id, split, source) of samples that stand in a split of their data set; a sample delivered again counts once."""
    split = manifests.select("dataset_path", F.explode("splits").alias("split", "ids")).select("dataset_path", "split", F.explode("ids").alias("question_id")).where("split in ('train', 'dev', 'test')").distinct()
    rows = samples.where("question_id is not null").groupBy("question_id", "dataset_path").agg(F.min("source").alias("source"))
    return rows.join(split, ["dataset_path", "question_id"]).groupBy("question_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))


def fields_of(samples: DataFrame) -> DataFrame:
    """(question_id, field, text): the question, and each haystack session with its turn contents joined by a space."""
    rows = samples.where("question_id is not null")
    session = F.concat_ws(" ", F.transform("turns", lambda t: t["content"]))
    sessions = rows.select("question_id", F.explode("haystack_sessions").alias("turns")).select("question_id", F.lit("session").alias("field"), session.alias("text"))
    return rows.select("question_id", F.lit("question").alias("field"), F.col("question").alias("text")).unionByName(sessions)


class Overlap:
    """Members and links of the classes of items (id, field, text, side 'train' or 'eval'; other columns are ignored).

    Null texts and texts without words overlap with nothing; repeated rows count once. members (field, side, cls, id); links (field,
    a, b): the class of a training row and that of an evaluation row, t-similar or the same.
    """

    def __init__(self, items: DataFrame, t: float = 0.8):
        if not 0 < t <= 1:
            raise ValueError("t must be above 0 and at most 1")
        rows = materialize(_signed(items.select(F.col("id").cast("string").alias("id"), "field", "text", "side")), "overlap-signed")
        self.members = rows.select("field", "side", "cls", "id").distinct()
        classes = rows.groupBy("field", "side", "cls").agg(F.min(F.struct("id", "t")).alias("r"), F.max(F.struct("x", "y", "bands")).alias("s"))

        def side(name: str, key: str) -> DataFrame:
            """A row for each band of each class of a side: what doesn't belong to it isn't expanded."""
            own = classes.where(F.col("side") == name).select("field", "cls", "s.x", "s.y", F.explode("s.bands").alias("band"))
            return own.select(F.xxhash64("field", "band").alias("band"), F.col("cls").alias(key), F.col("x").alias(f"x{key}"), F.col("y").alias(f"y{key}"))

        share = (1 - t) / 2
        most = math.ceil(BANDS * ROWS * share + DEVIATIONS * math.sqrt(BANDS * ROWS * share * (1 - share)))
        n = lambda y: F.shiftrightunsigned(F.col(y), LOW)
        apart = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) + F.bit_count(F.col("ya").bitwiseXOR(F.col("yb")).bitwiseAND(F.lit((1 << LOW) - 1)))
        close = (F.col("a") != F.col("b")) & (F.least(n("ya"), n("yb")) >= t * F.greatest(n("ya"), n("yb")) - 1e-9) & (apart <= most)
        met = materialize(side("train", "a").join(side("eval", "b"), "band").where(close).select("a", "b").distinct(), "overlap-candidates")
        need = met.select(F.col("a").alias("cls"), F.lit("train").alias("side")).unionByName(met.select(F.col("b").alias("cls"), F.lit("eval").alias("side"))).distinct()
        spots = rows.join(need, ["cls", "side"], "left_semi").groupBy("cls").agg(F.min(F.struct("id", "side", "field", "t")).alias("r")).select("r.*")
        spotted = items.select(F.col("id").cast("string").alias("id"), "side", "field", F.xxhash64("text").alias("t"), "text").join(spots, ["id", "side", "field", "t"], "left_semi")
        sets = materialize(word_table(spotted, "id", "text", 1).groupBy("cls").agg(F.max(F.struct("n", "words")).alias("s")).select("cls", "s.n", "s.words"), "overlap-words")
        both = met.join(sets.toDF("a", "na", "wa"), "a").join(sets.toDF("b", "nb", "wb"), "b")

        def verify(batches):
            for batch in batches:
                wa, wb, na, nb = (batch.column(k).to_pylist() for k in ("wa", "wb", "na", "nb"))
                common = np.array([common_count(x, y) for x, y in zip(wa, wb)], dtype=np.float64)
                ok = pa.array(common >= t * (np.array(na) + np.array(nb) - common) - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in ("a", "b")], ["a", "b"])

        # candidates are of one field; a class may stand in both fields
        fields = classes.select("field", "side", "cls")
        similar = both.mapInArrow(verify, "a bigint, b bigint")
        named = similar.join(fields.where("side = 'train'").select("field", F.col("cls").alias("a")), "a").join(fields.where("side = 'eval'").select("field", F.col("cls").alias("b")), ["field", "b"]).select("field", "a", "b")
        same = fields.groupBy("field", "cls").agg(F.countDistinct("side").alias("k")).where("k = 2").select("field", F.col("cls").alias("a"), F.col("cls").alias("b"))
        self.links = materialize(named.unionByName(same), "overlap-links")


def cross_split_pairs(items: DataFrame, t: float = 0.8) -> DataFrame:
    """(train_id, eval_id, field) of ids with t-similar texts of the same field on different sides; items as for Overlap.

    Every such pair comes out once, however many ids hold equal sets.
    """
    found = Overlap(items, t)
    key = lambda side, cls: F.concat_ws("|", "field", side, cls.cast("string"))
    keyed = found.members.select(key(F.col("side"), F.col("cls")).alias("cls"), F.concat_ws("|", "field", "id").alias("id"))
    none = F.lit(None).cast("string")  # every class is in members
    named = found.links.select(key(F.lit("train"), F.col("a")).alias("a"), key(F.lit("eval"), F.col("b")).alias("b"), none.alias("id_a"), none.alias("id_b"))
    held = keyed.join(named.select(F.col("a").alias("cls")).unionByName(named.select(F.col("b").alias("cls"))).distinct(), "cls", "left_semi")
    train_id, eval_id = F.split("x", "\\|", 2), F.split("y", "\\|", 2)[1]
    return linked(named, held).select(train_id[1].alias("train_id"), eval_id.alias("eval_id"), train_id[0].alias("field")).distinct()


def overlap_groups(items: DataFrame, t: float = 0.8) -> DataFrame:
    """(id, side, field, class_id, links): a row for each id and set of words of a field. class_id: the smallest id with the same words in
    that field; links: classes of the other side its class is linked to, its own counted if it stands on both. Linear in the rows.
    """
    found = Overlap(items, t)
    degree = found.links.groupBy("field", F.col("a").alias("cls")).agg(F.count("*").alias("links")).withColumn("side", F.lit("train"))
    degree = degree.unionByName(found.links.groupBy("field", F.col("b").alias("cls")).agg(F.count("*").alias("links")).withColumn("side", F.lit("eval")))
    first = found.members.groupBy("field", "cls").agg(F.min("id").alias("class_id"))
    out = found.members.join(first, ["field", "cls"]).join(degree, ["field", "side", "cls"], "left")
    return out.select("id", "side", "field", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def split_items(samples: DataFrame, manifests: DataFrame) -> DataFrame:
    sides = sample_splits(samples, manifests).withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))
    return fields_of(samples).join(sides.select("question_id", "side"), "question_id").withColumnRenamed("question_id", "id")


def overlap_report(samples: DataFrame, manifests: DataFrame, t: float = 0.8) -> DataFrame:
    """(split, source, field, overlapping, samples): evaluation samples that overlap with a training sample, and all of them, per split and source."""
    sides = materialize(sample_splits(samples, manifests), "overlap-splits")
    pairs = cross_split_pairs(split_items(samples, manifests), t)
    held = sides.where("split <> 'train'")
    hit = pairs.select(F.col("eval_id").alias("question_id"), "field").distinct().join(held, "question_id").groupBy("split", "source", "field").agg(F.count("*").alias("overlapping"))
    every = held.groupBy("split", "source").agg(F.count("*").alias("samples")).withColumn("field", F.explode(F.array(F.lit("question"), F.lit("session"))))
    same = (every["split"] == hit["split"]) & every["source"].eqNullSafe(hit["source"]) & (every["field"] == hit["field"])
    return every.join(hit, same, "left").select(every["split"], every["source"], every["field"], F.coalesce("overlapping", F.lit(0)).cast("bigint").alias("overlapping"), "samples")
