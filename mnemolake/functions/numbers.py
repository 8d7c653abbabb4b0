"""Number, vector and date functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0


def clamp01(c: Column) -> Column:
    """The value within 0 and 1; 0 for null and what isn't finite."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles within 0 and 1; 0 for null, empty, unlike dimensions or a zero norm."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    size = norm(a) * norm(b)
    return F.when(F.coalesce(ok, F.lit(False)), F.when(size > 0, clamp01(dot(a, b) / size)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def usable(v: Column, dimension: int) -> Column:
    """Whether an array has `dimension` finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda acc, y: acc + y))


def access_frequency(n: Column, saturation: int = 20) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(0.0)).otherwise(clamp01(F.log1p(n) / F.log1p(F.lit(float(saturation)))))


def rank_score(rank: Column, n: Column) -> Column:
    """1 - rank / n, rank counted from 0."""
    return F.lit(1.0) - rank / n


# fixed values: spellings of a date that are read; anything else has no time
LOG_DATE = r"^(\d{4})/(\d{1,2})/(\d{1,2})\s+\([A-Za-z]{3}\)\s+(\d{1,2}:\d{2}(?::\d{2})?)$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def parse_date(c: Column) -> Column:
    """UTC timestamp of a date text: 'yyyy/MM/dd (Day) HH:mm[:ss]', ISO 8601, or an ISO date in its first ten characters; else null."""
    text = F.regexp_replace(F.trim(c), LOG_DATE, "$1-$2-$3T$4")
    whole = F.when(text.rlike(ISO_DATE), F.try_to_timestamp(text))
    day = F.substring(text, 1, 10)
    return F.coalesce(whole, F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day)))


def age_days(now: Column, then: Column) -> Column:
    """Days from then to now, at least 0; null if either is."""
    days = (F.unix_micros(now) - F.unix_micros(then)) / F.lit(DAY * 1e6)
    return F.when(days < 0, F.lit(0.0)).otherwise(days)


def recency(then: Column, now: Column) -> Column:
    """1 / (1 + age / 30 days); 0.5 if a date is missing."""
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + age_days(now, then) / 30.0), F.lit(0.5))


def half_life(then: Column, now: Column, days: Column | float) -> Column:
    days = F.lit(float(days)) if isinstance(days, (int, float)) else days
    return F.pow(F.lit(0.5), age_days(now, then) / days)


def episodic_recency(then: Column, now: Column) -> Column:
    """Half-life of 14 days; 0.5 if a date is missing."""
    return F.coalesce(half_life(then, now, 14), F.lit(0.5))
