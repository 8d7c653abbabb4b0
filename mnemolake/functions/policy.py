"""Policy features of memories, the six scores, and the decisions they lead to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import access_frequency, clamp01, half_life
from .text import ACTION_WORDS, CHANGE_WORDS, STALE_WORDS, TEMPORARY_WORDS, contains_any, estimate_tokens, jaccard, privacy_risk, terms

# fixed values: half-life in days, stability and actionability by memory type
HALF_LIFE = {"semantic": 120.0, "episodic": 14.0, "procedural": 240.0, "reflective": 120.0, "resource": 60.0}
STABILITY = {"semantic": 0.72, "episodic": 0.35, "procedural": 0.86, "reflective": 0.62, "resource": 0.50}
ACTIONABILITY = {"semantic": 0.40, "episodic": 0.22, "procedural": 0.78, "reflective": 0.58, "resource": 0.32}
FEATURES = (
    "semantic_relevance", "importance", "confidence", "recency", "stability", "novelty", "redundancy", "contradiction",
    "staleness", "access_frequency", "success_contribution", "failure_contribution", "token_cost", "scope_match", "actionability", "privacy_risk",
)

# fixed values: weights and threshold of each score, and the operation a passed one leads to
SCORES: dict[str, tuple[dict[str, float], float, str]] = {
    "write": ({"importance": 0.30, "novelty": 0.25, "confidence": 0.20, "actionability": 0.15, "scope_match": 0.10, "redundancy": -0.20, "privacy_risk": -0.10}, 0.65, "ADD"),
    "retrieve": (
        {"semantic_relevance": 0.30, "importance": 0.20, "scope_match": 0.15, "confidence": 0.10, "success_contribution": 0.10, "recency": 0.10, "contradiction": -0.15, "redundancy": -0.05, "token_cost": -0.05},
        0.05,
        "RETRIEVE",
    ),
    "update": ({"similarity": 0.30, "contradiction": 0.30, "recency": 0.20, "source_priority": 0.15, "confidence": 0.05}, 0.65, "UPDATE"),
    "merge": ({"similarity": 0.35, "redundancy": 0.30, "scope_match": 0.20, "agreement": 0.15}, 0.75, "MERGE"),
    "archive": ({"staleness": 0.25, "redundancy": 0.25, "failure_contribution": 0.20, "unimportance": 0.15, "superseded": 0.15}, 0.80, "ARCHIVE"),
    "compress": ({"token_cost": 0.30, "access_frequency": 0.25, "information_density": 0.20, "actionability": 0.15, "scope_match": 0.10}, 0.65, "COMPRESS"),
}
#: Least similarity and contradiction of an update, besides its score.
UPDATE_SIMILARITY, UPDATE_CONTRADICTION = 0.70, 0.45


def by_type(kind: Column, table: dict[str, float], default: str = "semantic") -> Column:
    out = F.lit(table[default])
    for k, v in table.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def recency(kind: Column, updated: Column, now: Column) -> Column:
    return clamp01(half_life(updated, now, by_type(kind, HALF_LIFE)))


def stability(text: Column, kind: Column, recency_: Column) -> Column:
    base = by_type(kind, STABILITY) - F.when(contains_any(text, TEMPORARY_WORDS), F.lit(0.25)).otherwise(F.lit(0.0))
    return clamp01(base + F.lit(0.12) * (F.lit(1.0) - recency_))


def staleness(text: Column, status: Column, recency_: Column) -> Column:
    worded = F.when(contains_any(text, STALE_WORDS), F.lit(0.75)).otherwise(F.lit(0.0))
    return F.when(status.isin("archived", "expired"), F.lit(1.0)).otherwise(clamp01(F.greatest(F.lit(1.0) - recency_, worded)))


def actionability(text: Column, kind: Column, n: Column | None = None) -> Column:
    """n: number of terms, if known."""
    worded = F.when(contains_any(text, ACTION_WORDS), F.lit(0.25)).otherwise(F.lit(0.0))
    return clamp01(by_type(kind, ACTIONABILITY) + worded + F.when((F.size(terms(text)) if n is None else n) >= 12, F.lit(0.05)).otherwise(F.lit(0.0)))


def contradiction(text: Column, redundancy: Column, relation: Column) -> Column:
    """relation: the strongest similarity of scope or text to another memory; null if there is no other."""
    return contradicting(contains_any(text, CHANGE_WORDS), redundancy, relation)


def contradicting(changing: Column, redundancy: Column, relation: Column) -> Column:
    """contradiction() of a text of which it is known whether it has a change word."""
    strongest = F.greatest(redundancy, relation)
    changed = F.when(strongest <= 0, F.lit(0.0)).otherwise(clamp01(F.lit(0.45) + F.lit(0.45) * strongest))
    return F.when(relation.isNull(), F.lit(0.0)).otherwise(F.when(changing, changed).otherwise(clamp01(F.lit(0.1) * redundancy)))


def scope_match(scope: Column, target: Column) -> Column:
    related = clamp01(F.lit(0.25) + F.lit(0.5) * jaccard(F.array_distinct(terms(scope)), F.array_distinct(terms(target))))
    return (
        F.when(target.isNull() | (target == ""), F.when(scope == "global", 0.5).otherwise(0.7))
        .when(scope == target, 1.0)
        .when((scope == "global") | (target == "global"), 0.65)
        .when(F.startswith(scope, target) | F.startswith(target, scope), 0.85)
        .otherwise(related)
    )


def token_cost(text: Column, budget: int = 2048) -> Column:
    if budget <= 0:
        raise ValueError("token budget must be positive")
    return clamp01(estimate_tokens(text) / F.lit(float(budget)))


def memory_similarity(terms_a: Column, terms_b: Column, scope_a: Column, scope_b: Column, same_type: Column) -> Column:
    """0.8 of the contents', 0.1 of the scopes' similarity and 0.1 for an equal type."""
    return clamp01(F.lit(0.8) * jaccard(terms_a, terms_b) + F.lit(0.1) * jaccard(scope_a, scope_b) + F.when(same_type, 0.1).otherwise(0.0))


def store_similarity(content: Column, scope: Column, same_type: Column) -> Column:
    """0.65 of the contents', 0.25 of the scopes' similarity and 0.1 for an equal type."""
    return clamp01(F.lit(0.65) * content + F.lit(0.25) * scope + F.when(same_type, 0.1).otherwise(0.0))


def effective_similarity(similarity: Column, same_scope: Column, contradiction_: Column) -> Column:
    return F.when(same_scope & (contradiction_ >= UPDATE_CONTRADICTION), F.greatest(similarity, F.lit(0.8))).otherwise(similarity)


def information_density() -> Column:
    """Mean of importance, confidence, actionability and novelty, less half the redundancy in proportion."""
    mean = (F.col("importance") + F.col("confidence") + F.col("actionability") + F.col("novelty")) / 4.0
    return clamp01(mean * (F.lit(1.0) - F.lit(0.5) * F.col("redundancy")))


DERIVED = {"agreement": lambda: F.lit(1.0) - F.col("contradiction"), "unimportance": lambda: F.lit(1.0) - F.col("importance")}


def contributions(score: str) -> dict[str, Column]:
    """What each input adds to a score, from columns of these names."""
    return {name: F.lit(w) * (DERIVED[name]() if name in DERIVED else F.col(name)) for name, w in SCORES[score][0].items()}


def score(name: str) -> Column:
    total = F.lit(0.0)
    for part in contributions(name).values():
        total = total + part
    return clamp01(total)


def passed(name: str, value: Column) -> Column:
    ok = F.round(value, 9) >= SCORES[name][1]  # a sum that misses its threshold by its last bits only passes
    return ok & (F.col("similarity") >= UPDATE_SIMILARITY) & (F.col("contradiction") >= UPDATE_CONTRADICTION) if name == "update" else ok


def decision(name: str) -> Column:
    """The operation of a passed score, else IGNORE. An update must also be similar and contradicting enough."""
    return F.when(passed(name, score(name)), SCORES[name][2]).otherwise("IGNORE")


def top_contributors(name: str, n: int = 3, positive: bool = True) -> Column:
    """Names of the n largest positive (negative) contributions, larger first, then by name."""
    entries = F.array(*[F.struct((-c if positive else c).alias("o"), F.lit(k).alias("k"), c.alias("v")) for k, c in sorted(contributions(name).items())])
    kept = F.filter(entries, lambda e: (e["v"] > 0) if positive else (e["v"] < 0))
    return F.transform(F.slice(F.array_sort(kept), 1, n), lambda e: e["k"])


def reason(name: str) -> Column:
    return F.concat(decision(name), F.lit(": "), F.format_string("%.3f", score(name)), F.lit(f" vs {SCORES[name][1]:.2f}; up: "), F.array_join(top_contributors(name), ", "), F.lit("; down: "), F.array_join(top_contributors(name, positive=False), ", "))


def vector(prefix: str = "") -> Column:
    """The 16 features in their fixed order as an array."""
    return F.array(*[F.col(prefix + f) for f in FEATURES])


def uses(n: Column) -> Column:
    return access_frequency(n)


def risk(text: Column) -> Column:
    return clamp01(privacy_risk(text))


def explain(n: int = 5) -> Column:
    """Names of the n largest features, larger first, then by name."""
    entries = F.array_sort(F.array(*[F.struct(F.round(-F.col(f), 6).alias("o"), F.lit(f).alias("k")) for f in FEATURES]))
    return F.transform(F.slice(entries, 1, n), lambda e: e["k"])


def feature_map() -> Column:
    return F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])


def to_operation(name: str, ident: str = "memory_id") -> Column:
    """A decision as a row of the operation log: what was decided on which memory, with score, threshold and the features it rests on."""
    return F.struct(
        decision(name).alias("op"), F.col(ident).alias("target_memory_id"), reason(name).alias("reason"), F.round(score(name), 9).alias("policy_score"), F.lit(SCORES[name][1]).alias("threshold"),
        F.col("confidence").alias("confidence"), F.struct(feature_map().alias("feature_snapshot")).alias("payload"),
    )
