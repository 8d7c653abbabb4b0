"""Pieces of SQL that the oracles share: tables with each key once, and text functions."""

from __future__ import annotations

from mnemolake.functions.text import ABSTENTIONS


def once(name: str, keys: str, order: str) -> str:
    known = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"(SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _r FROM {name} WHERE {known}) WHERE _r = 1)"


CHUNKS = once("chunks", "memory_id", "(content IS NULL)::INT, ingested_at NULLS LAST")
SAMPLES = once("samples", "question_id", "ingested_at NULLS LAST")
RETRIEVED = once("retrieved", "method_name, question_id, rank_no", "(content IS NULL)::INT, retrieved_at NULLS LAST")
OUTPUTS = once("reader_outputs", "output_id", "created_at NULLS LAST")
CACHE = once("embedding_cache", "cache_key", "created_at NULLS LAST")
MANIFESTS = once("split_manifests", "split_id", "created_at NULLS LAST")
TURNS = f"""(SELECT question_id, session_id, session_no, source_date, t - 1 AS turn_no, turns[t].role AS role, turns[t].content AS content FROM (
  SELECT *, unnest(range(1, len(turns) + 1)) AS t FROM (
    SELECT question_id, n - 1 AS session_no, haystack_sessions[n] AS turns, haystack_session_ids[n] AS session_id, haystack_dates[n] AS source_date FROM (
      SELECT *, unnest(range(1, len(haystack_sessions) + 1)) AS n FROM {SAMPLES}))))"""
MEMBERS = f"(SELECT split_id, dataset_path, split, unnest(ids) AS question_id FROM (SELECT split_id, dataset_path, e.key AS split, e.value AS ids FROM (SELECT *, unnest(map_entries(splits)) AS e FROM {MANIFESTS})))"


def fold(x: str) -> str:
    return f"replace(lower(replace({x}, 'İ', 'i\u0307')), 'ß', 'ss')"


def terms(x: str) -> str:
    return f"coalesce(regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}_-]+'), [])"


def words_any(x: str, words: tuple[str, ...], pad: bool = False) -> str:
    text = fold(f"(' ' || {x} || ' ')" if pad else x)
    return "coalesce((" + " OR ".join(f"contains({text}, '{w}')" for w in words) + "), FALSE)"


def jaccard(a: str, b: str) -> str:
    """Of two lists; they must be distinct lists."""
    common = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END)"


def distinct_terms(x: str) -> str:
    return f"list_distinct({terms(x)})"


def importance(x: str) -> str:
    from mnemolake.functions.text import IMPORTANT_WORDS

    n = f"len({terms(x)})"
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0::DOUBLE, 0.75::DOUBLE * least(1.0::DOUBLE, ln(1 + {n}) / ln(160.0::DOUBLE)) + CASE WHEN {words_any(x, IMPORTANT_WORDS)} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) END)"


def tokens(x: str) -> str:
    n, cjk = f"length({x})", f"length(regexp_replace({x}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"
    plain = f"length(regexp_replace({x}, '[^\\x21-\\x7e\\x00-\\x08\\x0e-\\x1b\\x7f]', '', 'g'))"
    return f"greatest(1, ceil(round({cjk} / 1.8::DOUBLE + {plain} / 4.0::DOUBLE + ({n} - {cjk} - {plain}) / 3.0::DOUBLE, 9)))::BIGINT"


def answer_tokens(x: str) -> str:
    low = f"replace({fold(x)}, '’', '''')"
    low = f"replace(replace({low}, 'don''t', 'do not'), 'dont', 'do not')"
    return f"list_filter(coalesce(regexp_extract_all(regexp_replace({low}, '\\p{{P}}', ' ', 'g'), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'), []), lambda t: t NOT IN ('a', 'an', 'the'))"


def abstains(x: str) -> str:
    text = f"array_to_string({answer_tokens(x)}, ' ')"
    return f"({text} IN ({', '.join(repr(a) for a in ABSTENTIONS)}) OR starts_with({text}, 'i do not know') OR starts_with({text}, 'i dont know'))"


ABSTENTION = f"""(CASE WHEN ends_with(lower(question_id), '_abs') THEN TRUE WHEN has_answer = FALSE THEN TRUE WHEN coalesce(len(answer_session_ids), -1) > 0 THEN FALSE
 ELSE coalesce({abstains("array_to_string(answer, ' ')")}, FALSE) END)"""


def parse_date(x: str) -> str:
    text = f"regexp_replace(trim({x}), '^(\\d{{4}})/(\\d{{1,2}})/(\\d{{1,2}})\\s+\\([A-Za-z]{{3}}\\)\\s+(\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?)$', '\\1-\\2-\\3T\\4')"
    iso = "'^\\d{4}-\\d{2}-\\d{2}(?:[T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,6})?)?(?:Z|[+-]\\d{2}:?\\d{2})?)?$'"
    return f"coalesce(CASE WHEN regexp_matches({text}, {iso}) THEN try_cast({text} AS TIMESTAMP) END, CASE WHEN regexp_matches(substring({text}, 1, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(substring({text}, 1, 10) AS TIMESTAMP) END)"


def age(now: str, then: str) -> str:
    return f"greatest(0.0::DOUBLE, (epoch_us({now}) - epoch_us({then})) / 8.64e10::DOUBLE)"


def clamp(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan(({x})::DOUBLE) OR isinf(({x})::DOUBLE) THEN 0.0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x})) END)"


def by_type(kind: str, table: dict[str, float], default: str = "semantic") -> str:
    return "(CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {table[default]}::DOUBLE END)"


def usable(v: str) -> str:
    return f"(len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"


def ascii_classes(x: str, letter: str) -> str:
    """A text whose characters beyond ASCII are put for one of their class, so that RE2's words, digits and blanks are those of any script."""
    one = f"CASE WHEN unicode(c) < 128 THEN CASE WHEN unicode(c) BETWEEN 28 AND 31 THEN ' ' ELSE c END WHEN regexp_matches(c, '\\p{{Nd}}') THEN '0' WHEN regexp_matches(c, '[\\p{{L}}\\p{{N}}]') THEN '{letter}' WHEN regexp_matches(c, '[\\p{{Z}}\\x{{85}}]') THEN ' ' ELSE '~' END"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {one}), '')"


def privacy(x: str) -> str:
    from mnemolake.functions.text import EMAIL, PHONE, PRIVATE_WORDS, SECRET

    named, plain = ascii_classes(x, "_"), ascii_classes(x, "q")
    rules = [f"CASE WHEN regexp_matches({named}, '{EMAIL}') THEN 0.6 ELSE 0.0 END", f"CASE WHEN regexp_matches({named}, '{PHONE}') THEN 0.65 ELSE 0.0 END", f"CASE WHEN regexp_matches({plain}, '{SECRET}') THEN 0.9 ELSE 0.0 END", f"CASE WHEN {words_any(x, PRIVATE_WORDS)} THEN 0.75 ELSE 0.0 END"]
    return f"greatest(0.0, {', '.join(rules)})::DOUBLE"
