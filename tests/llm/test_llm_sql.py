"""The queries of the subpackage that have SQL give the same rows in DuckDB; the others run and keep their columns."""

import pytest
from compare import duck, rows

from mnemolake.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(tiny):
    return duck(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, db, name):
    df = QUERIES[name](spark, tiny)
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize(
    "name,columns",
    [("p1_found", {"collection", "id_a", "id_b"}), ("p2_found", {"record_kind", "record_id", "defect"}), ("p6_ids", {"doc_id", "ids"}), ("p7_fill", {"container_kind", "containers", "tokens", "filled", "stretch"}), ("p4_pieces", {"item_kind", "item_id", "session_id", "nth", "piece", "start", "end", "text"})],
)
def test_columns(spark, tiny, name, columns):
    df = QUERIES[name](spark, tiny)
    assert set(df.columns) == columns and df.count() > 0


def test_pieces_cover_what_is_found(spark, tiny):
    found = {tuple(r) for r in QUERIES["p4_found"](spark, tiny).collect()}
    cut = {(r.item_kind, r.item_id, r.session_id) for r in QUERIES["p4_pieces"](spark, tiny).where("piece > 0").collect()}
    assert found == cut


def test_overlap_groups(spark):
    from mnemolake.llm import overlap

    rows_ = [("a", "question", "x y z v w", "train"), ("b", "question", "w v z y x", "eval"), ("c", "question", "x y z v", "eval"), ("d", "question", "other", "train"), ("d", "session", "x y z v w", "train"), ("e", "question", None, "eval"), ("f", "question", "!", "train")]
    df = spark.createDataFrame(rows_, "id string, field string, text string, side string")
    got = sorted(tuple(r) for r in overlap.overlap_groups(df).select("id", "side", "field", "class_id", "links").collect())
    assert got == [("a", "train", "question", "a", 2), ("b", "eval", "question", "a", 1), ("c", "eval", "question", "c", 1), ("d", "train", "question", "d", 0), ("d", "train", "session", "d", 0)]
    assert overlap.overlap_groups(df.limit(0)).count() == 0
