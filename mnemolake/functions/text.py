"""Text functions as Spark columns: terms, similarity, token estimates, answers, merging, sanitising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as Python's unicode word class has them, with hyphens; the same class in Java and RE2.
TERM = r"[\p{L}\p{N}_-]+"

# fixed values: words that tell a record's kind; a text has one if it holds it anywhere, also inside a word
CHANGE_WORDS = ("不再", "不是", "改为", "改成", "转向", "现在", "instead", "rather than", "no longer", "not anymore", "changed", "replaced", "supersede")
STALE_WORDS = ("旧", "过期", "废弃", "不再", "outdated", "stale", "obsolete", "deprecated", "no longer")
TEMPORARY_WORDS = ("临时", "暂时", "今天", "一次性", "temporary", "tentative", "today", "one-off")
ACTION_WORDS = ("应该", "必须", "需要", "偏好", "主攻", "步骤", "流程", "方案", "记住", "prefer", "should", "must", "need", "workflow", "process", "fix", "debug", "reuse")
IMPORTANT_WORDS = ("prefer", "favorite", "remember", "important", "changed", "now", "不再", "现在", "偏好", "记住", "重要", "改为")
PRIVATE_WORDS = ("身份证", "手机号", "住址", "银行卡")
TEMPORAL_WORDS = ("now", "currently", "current", "latest", "recent", "today", "when", "before", "after", "since", "still", "changed", "no longer")
UPDATE_WORDS = (" now ", "currently", "changed", "instead of", "rather than", "no longer", "not anymore", "replaced", "switched", "moved from", "updated")
RANKER_STALE_WORDS = ("outdated", "stale", "obsolete", "deprecated", "no longer")
RANKER_ACTION_WORDS = ("prefer", "should", "must", "need", "workflow", "process", "fix", "debug", "reuse", "remember")
ABSTENTIONS = ("i do not know", "i dont know", "unknown", "no answer", "not answerable", "cannot answer")
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?\d[\d\s().-]{7,}\d)\b"
SECRET = r"(?i)\b(?:api[_-]?key|password|passwd|secret|token|private[_-]?key)\b"
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}"


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def terms(c: Column) -> Column:
    """The terms of a text in order, case-folded; empty for null."""
    return F.coalesce(F.regexp_extract_all(casefold(c), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def contains_any(c: Column, words: tuple[str, ...], pad: bool = False) -> Column:
    """Whether the case-folded text holds one of the words as a substring; pad puts a space on either side first."""
    text = casefold(F.concat(F.lit(" "), c, F.lit(" ")) if pad else c)
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def estimate_tokens(c: Column) -> Column:
    """At least 1: ideographs / 1.8 + other visible ASCII / 4 + the rest / 3, rounded up."""
    n, cjk = F.length(c), F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]+", ""))
    plain = F.length(F.regexp_replace(c, r"[^\x21-\x7e\x00-\x08\x0e-\x1b\x7f]+", ""))
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.round(cjk / F.lit(1.8) + plain / F.lit(4.0) + (n - cjk - plain) / F.lit(3.0), 9)))


def quarter_tokens(c: Column) -> Column:
    """At least 1: characters / 4, rounded down."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(c) / 4))


def importance(c: Column, n: Column | None = None) -> Column:
    """Importance of a content by its length and by words that mark preferences; 0 without terms. n: number of terms, if known."""
    n = F.size(terms(c)) if n is None else n
    length = F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(160.0)))
    score = F.lit(0.75) * length + F.when(contains_any(c, IMPORTANT_WORDS), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def answer_tokens(c: Column) -> Column:
    """The tokens by which answers are compared: ASCII words and single ideographs without punctuation and articles."""
    low = F.replace(casefold(c), F.lit("’"), F.lit("'"))
    low = F.replace(F.replace(low, F.lit("don't"), F.lit("do not")), F.lit("dont"), F.lit("do not"))
    plain = F.regexp_replace(low, r"\p{P}", " ")
    found = F.regexp_extract_all(plain, F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lit(0))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: ~t.isin("a", "an", "the"))


def normalize_answer(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def is_abstention_answer(c: Column) -> Column:
    """Whether an answer is one of the fixed no-answer forms or begins with 'i do not know'."""
    text = normalize_answer(c)
    return text.isin(*ABSTENTIONS) | text.startswith("i do not know") | text.startswith("i dont know")


def contains_sequence(tokens: Column, wanted: Column) -> Column:
    """1.0 if wanted stands in tokens as a run; an empty one only in an empty one."""
    inside = F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(wanted, " "), F.lit(" ")))
    return F.when(F.size(wanted) == 0, (F.size(tokens) == 0).cast("double")).otherwise(inside.cast("double"))


def token_f1(tokens: Column, wanted: Column) -> Column:
    """F1 of two token lists with multiplicity; 1 or 0 if one is empty."""
    common = F.aggregate(
        F.array_distinct(F.array_intersect(tokens, wanted)),
        F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(tokens, lambda x: x == t)), F.size(F.filter(wanted, lambda x: x == t))),
    )
    p, r = common / F.size(tokens), common / F.size(wanted)
    none = (F.size(tokens) == 0) | (F.size(wanted) == 0)
    return F.when(none, (F.size(tokens) == F.size(wanted)).cast("double")).otherwise(F.when(common == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r)))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def token_overlap(c: Column, wanted: Column) -> Column:
    """Share of wanted's distinct terms that stand in the text."""
    a, b = F.array_distinct(terms(c)), F.array_distinct(terms(wanted))
    return F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))


def merge_paragraphs(texts: Column) -> Column:
    """The paragraphs of an array of texts, each once, in order; equal up to white space counts as equal."""
    split = F.filter(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.split(t, "\n\n"))), lambda p: F.length(squeeze(p)) > 0)
    keyed = F.transform(split, lambda p: F.struct(squeeze(p).alias("k"), F.trim(p).alias("t")))
    kept = F.aggregate(
        keyed,
        F.array().cast("array<struct<k:string,t:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda x: x["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(F.transform(kept, lambda p: p["t"]), "\n\n")


def merge_summaries(summaries: Column) -> Column:
    """The first three different summaries, joined by '; '."""
    kept = F.slice(F.array_distinct(F.filter(summaries, lambda s: s.isNotNull() & (F.length(F.trim(s)) > 0))), 1, 3)
    return F.when(F.size(kept) == 0, F.lit("Merged memory")).otherwise(F.array_join(kept, "; "))


def safe_id(c: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen only; 'unknown' if nothing is left."""
    clean = F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, F.lit("unknown")).otherwise(clean)


def adapter_name(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "-", "_")


def truncate(c: Column, limit: int) -> Column:
    """The text, or its first limit - 1 characters without trailing blanks and an ellipsis."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def _unicode(pattern: str) -> str:
    """One of the three patterns above for Java, with word, digit, space and boundary as Python has them for any script."""
    out = pattern.replace(r"[\w", f"[{_WORD}").replace(r"[\d\s", rf"[\p{{Nd}}{_SPACE}").replace(r"\d", r"\p{Nd}").replace("(?i)", "(?iu)")
    return out.replace(r"\b", f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))")


def privacy_risk(c: Column) -> Column:
    """The patterns look around each character, so they are tried on texts only that hold what any match holds."""
    digits = c.rlike(_unicode(PHONE.replace(r"\b", "").replace(r"\+?", "")))
    secret = contains_any(F.translate(c, "ſ", "s"), ("key", "passw", "secret", "token"))  # the long s counts as an s for a pattern, not for lower()
    risks = [F.when(F.contains(c, F.lit("@")) & c.rlike(_unicode(EMAIL)), 0.6), F.when(digits & c.rlike(_unicode(PHONE)), 0.65), F.when(secret & c.rlike(_unicode(SECRET)), 0.9), F.when(contains_any(c, PRIVATE_WORDS), 0.75)]
    return F.greatest(F.lit(0.0), *[F.coalesce(r, F.lit(0.0)) for r in risks])


def with_provenance(content: Column, session: Column, date: Column) -> Column:
    return F.concat(F.lit("[SOURCE_SESSION_ID="), F.coalesce(session, F.lit("")), F.lit("; SOURCE_DATE="), F.coalesce(date, F.lit("")), F.lit("] "), content)


PROVENANCE = r"^\[SOURCE_SESSION_ID=([^;\]]*); SOURCE_DATE=([^\]]*)\]\s*"


def provenance_session(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, PROVENANCE, 1), F.lit(""))


def strip_provenance(c: Column) -> Column:
    return F.regexp_replace(c, PROVENANCE, "")


def prompt(question: Column, date: Column, evidence: Column) -> Column:
    """Ranked evidence (array of texts) and a question as one prompt."""
    numbered = F.transform(evidence, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t))
    return F.concat(F.lit("Memories:\n"), F.array_join(numbered, "\n\n"), F.lit("\n\nDate: "), F.coalesce(date, F.lit("unknown")), F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))
