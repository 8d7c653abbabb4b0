"""The queries of this subpackage and, where SQL can state the result on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import defects, encoding, near, overlap, packing, pieces, spans, vectors
from ._common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "chunks"), table(spark, d, "embedding_cache")
    return vectors.neighbour_pairs(vectors.both_collections(*both), label=F.split("grp", ":", 2)[0], sampled=lambda share: vectors.both_collections(*both, share)).withColumnRenamed("grp", "collection")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(table(spark, d, "documents"), table(spark, d, "samples"), table(spark, d, "reader_outputs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    memories = near.memory_contents(table(spark, d, "chunks"), table(spark, d, "retrieved"))
    return near.near_pairs(memories, "memory_id", "content", near.SIMILAR, near.LEAST).select(F.col("id_a").alias("memory_id_a"), F.col("id_b").alias("memory_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    memories = near.memory_contents(table(spark, d, "chunks"), table(spark, d, "retrieved"))
    return near.near_groups(memories, "memory_id", "content", near.SIMILAR, near.LEAST).withColumnRenamed("id", "memory_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_items(table(spark, d, "chunks"), table(spark, d, "samples"), table(spark, d, "size_limits"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.item_pieces(table(spark, d, "chunks"), table(spark, d, "samples"), table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(overlap.split_items(table(spark, d, "samples"), table(spark, d, "split_manifests")))
    return pairs.select(F.least("train_id", "eval_id").alias("question_id_a"), F.greatest("train_id", "eval_id").alias("question_id_b"), "field").where("question_id_a <> question_id_b").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "samples"), table(spark, d, "split_manifests"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.overlap_groups(overlap.split_items(table(spark, d, "samples"), table(spark, d, "split_manifests")))
    return found.withColumnRenamed("id", "question_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_specs").where("container_kind is not null and capacity_tokens > 0").collect()  # a fixed table of three rows
    return packing.pack(table(spark, d, "documents"), {r.container_kind: r.capacity_tokens for r in specs})


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the share of their room that is filled, and how far along the curve their documents lie apart on average, by kind."""
    specs = table(spark, d, "container_specs").select("container_kind", "capacity_tokens")
    each = p7_containers(spark, d).groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("n"), (F.max("place") - F.min("place")).alias("apart"))
    used = each.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.round(F.avg("apart"), 1).alias("stretch"))
    return used.join(specs, "container_kind").select("container_kind", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"), "stretch")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_groups(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_coverage": p8_coverage,
    "p8_groups": p8_groups,
}

_WORDS = "list_distinct(regexp_extract_all(lower(replace({}, 'İ', 'i\u0307')), '[\\p{{L}}\\p{{N}}]+'))"

_SPLITS = "sp AS (SELECT DISTINCT dataset_path, e.key AS split, unnest(e.value) AS question_id FROM (SELECT dataset_path, unnest(map_entries(splits)) AS e FROM split_manifests))"
_ITEMS = f"""{_SPLITS},
      q AS (SELECT DISTINCT ON (question_id) question_id, split = 'train' AS train, question, haystack_sessions AS ss FROM samples JOIN sp USING (dataset_path, question_id)),
      i AS (SELECT question_id, train, 'question' AS field, 0 AS n, question AS t FROM q UNION ALL SELECT question_id, train, 'session', n, array_to_string(list_transform(ss[n], lambda x: x.content), ' ') FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS n FROM q))"""
_MEMORIES = "m AS (SELECT memory_id, max(content) AS t FROM (SELECT memory_id, content FROM chunks UNION ALL SELECT memory_id, content FROM retrieved) WHERE memory_id IS NOT NULL AND content IS NOT NULL GROUP BY 1)"
_WINDOWS = "w AS (SELECT DISTINCT doc_id, i, substring(text, i, 160) AS x FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 160))"


def _reach(edges: str, nodes: str) -> str:
    """Recursive tables e (both directions of the edges a, b) and g (node, reach): what each node reaches, itself too."""
    return f"e AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), g(node, reach) AS (SELECT node, node FROM {nodes} UNION SELECT g.node, e.b FROM g JOIN e ON g.reach = e.a)"


# Problems 1, 2, 6 and 7 have no SQL: approximate neighbours, fitted models, a tokenizer, and one of many good packings; nor has p4_pieces, whose boundaries SQL can't state.
SQL: dict[str, str] = {
    "p3_found": f"""WITH {_MEMORIES},
      s AS (SELECT memory_id, {_WORDS.format('t')} AS s FROM m), w AS (SELECT memory_id, len(s) AS n, unnest(s) AS w FROM s WHERE len(s) >= 24),
      p AS (SELECT a.memory_id AS a, b.memory_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.memory_id < b.memory_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY 1, 2)
      SELECT a AS memory_id_a, b AS memory_id_b FROM p WHERE c >= 0.8 * (na + nb - c)""",
    "p4_found": """WITH c AS (SELECT memory_id, coalesce(memory_type, 'session') AS k, any_value(content) AS t FROM chunks WHERE memory_id IS NOT NULL AND content IS NOT NULL GROUP BY ALL),
      q AS (SELECT DISTINCT ON (question_id) question_id, haystack_session_ids AS ids, haystack_sessions AS ss FROM samples WHERE question_id IS NOT NULL),
      z AS (SELECT question_id, ids[n] AS sid, list_sum(list_transform(ss[n], lambda t: coalesce(length(t.content), 0))) AS n_chars FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS n FROM q))
      SELECT DISTINCT 'chunk' AS item_kind, memory_id AS item_id, '' AS session_id FROM c JOIN size_limits l ON l.item_kind = 'chunk' AND coalesce(l.memory_type, 'session') = k WHERE greatest(1, length(t) // 4) > max_tokens
      UNION SELECT 'session', question_id, coalesce(sid, '') FROM z JOIN size_limits l ON l.item_kind = 'session' WHERE greatest(1, coalesce(n_chars, 0) // 4) > max_tokens""",
    "p5_found": f"""WITH {_ITEMS},
      w AS (SELECT question_id, train, field, n, len(s) AS k, unnest(s) AS w FROM (SELECT *, {_WORDS.format('t')} AS s FROM i)),
      p AS (SELECT a.question_id AS a, b.question_id AS b, a.field, a.n, b.n, any_value(a.k) AS ka, any_value(b.k) AS kb, count(*) AS c FROM w a JOIN w b ON a.field = b.field AND a.w = b.w AND a.train AND NOT b.train AND least(a.k, b.k) >= 0.8 * greatest(a.k, b.k) GROUP BY ALL)
      SELECT DISTINCT least(a, b) AS question_id_a, greatest(a, b) AS question_id_b, field FROM p WHERE c >= 0.8 * (ka + kb - c)""",
    "p8_found": f"""WITH {_WINDOWS},
      s AS (SELECT DISTINCT doc_id, x FROM w QUALIFY min(doc_id) OVER (PARTITION BY x) <> max(doc_id) OVER (PARTITION BY x))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id""",
}
SQL["p3_groups"] = f"""WITH RECURSIVE {_MEMORIES}, s AS (SELECT memory_id, list_sort({_WORDS.format('t')}) AS s FROM m), k AS (SELECT s, min(memory_id) AS node FROM s WHERE len(s) >= 24 GROUP BY 1),
      w AS (SELECT node, len(s) AS n, unnest(s) AS w FROM k),
      p AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.node < b.node AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY 1, 2),
      l AS (SELECT a, b FROM p WHERE c >= 0.8 * (na + nb - c)), {_reach('l', 'k')}, r AS (SELECT node, min(reach) AS group_id FROM g GROUP BY 1), d AS (SELECT a AS node, count(*) AS links FROM e GROUP BY 1)
      SELECT memory_id, node AS class_id, group_id, coalesce(links, 0)::BIGINT AS links FROM s JOIN k USING (s) JOIN r USING (node) LEFT JOIN d USING (node)"""
SQL["p5_report"] = f"""WITH f AS ({SQL['p5_found']}), {_SPLITS},
      sq AS (SELECT question_id, min(split) AS split, min(source) AS source FROM (SELECT question_id, dataset_path, min(source) AS source FROM samples WHERE question_id IS NOT NULL GROUP BY 1, 2) JOIN sp USING (dataset_path, question_id) WHERE split IN ('train', 'dev', 'test') GROUP BY 1),
      h AS (SELECT split, source, field, count(DISTINCT question_id) AS overlapping FROM (SELECT unnest([question_id_a, question_id_b]) AS question_id, field FROM f) JOIN sq USING (question_id) WHERE split <> 'train' GROUP BY ALL)
      SELECT e.split, e.source, e.field, coalesce(overlapping, 0)::BIGINT AS overlapping, samples FROM (SELECT split, source, unnest(['question', 'session']) AS field, count(*) AS samples FROM sq WHERE split <> 'train' GROUP BY split, source) e LEFT JOIN h ON e.split = h.split AND e.source IS NOT DISTINCT FROM h.source AND e.field = h.field"""
SQL["p5_groups"] = f"""WITH {_ITEMS}, s AS (SELECT DISTINCT question_id, CASE WHEN train THEN 'train' ELSE 'eval' END AS side, field, list_sort({_WORDS.format('t')}) AS s FROM i WHERE t IS NOT NULL),
      k AS (SELECT *, row_number() OVER () AS k FROM (SELECT field, s, min(question_id) AS class_id, bool_or(side = 'train') AS tr, bool_or(side = 'eval') AS ev FROM s WHERE len(s) > 0 GROUP BY ALL)),
      w AS (SELECT field, k, tr, ev, len(s) AS n, unnest(s) AS w FROM k),
      p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM w a JOIN w b ON a.field = b.field AND a.w = b.w AND a.tr AND b.ev AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY 1, 2),
      l AS (SELECT a, b FROM p WHERE c >= 0.8 * (na + nb - c)), d AS (SELECT a AS k, 'train' AS side, count(*) AS links FROM l GROUP BY 1 UNION ALL SELECT b, 'eval', count(*) FROM l GROUP BY 1)
      SELECT question_id, s.side, s.field, class_id, coalesce(links, 0)::BIGINT AS links FROM s JOIN k USING (field, s) LEFT JOIN d ON d.k = k.k AND d.side = s.side"""
SQL["p8_coverage"] = f"""WITH {_WINDOWS}, s AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY x) <> max(doc_id) OVER (PARTITION BY x))),
      c AS (SELECT doc_id, sum(new) AS n FROM (SELECT doc_id, least(160, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 160)) AS new FROM s) GROUP BY 1),
      d AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
      SELECT doc_id, n_chars::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars, CASE WHEN n_chars > 0 THEN round(coalesce(n, 0) / n_chars::DOUBLE, 6) ELSE 0.0 END AS shared_fraction FROM d LEFT JOIN c USING (doc_id)"""
SQL["p8_groups"] = f"""WITH RECURSIVE f AS ({SQL['p8_found']}), l AS (SELECT doc_id_a AS a, doc_id_b AS b FROM f), nn AS (SELECT a AS node FROM l UNION SELECT b FROM l), {_reach('l', 'nn')},
      c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE length(text) >= 160)
      SELECT node AS doc_id, any_value(class_id) AS class_id, min(reach) AS group_id FROM g JOIN c ON c.doc_id = node GROUP BY node"""
