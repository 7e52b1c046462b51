"""Scores of the domain, as column expressions that stay inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, weights and limits that results depend on.
SECURITY_WORDS = ["auth", "login", "password", "token", "secret", "encrypt", "decrypt", "permission", "role", "session", "credential", "jwt"]
SEVERITY_WEIGHT = {"critical": 8, "high": 4, "medium": 2, "low": 1}
CONFIDENCE_WEIGHT = {"agreement": 0.30, "verifier": 0.20, "diversity": 0.15, "recency": 0.20, "density": 0.10, "history": 0.05}
SALIENCE_BASE = {"created": 0.6, "changed": 0.5, "deleted": 0.7, "viewed": 0.2}
PRICE_PER_MILLION = (1.0, 3.0, 0.0)


def mentions_security(text: Column, words: list[str] = SECURITY_WORDS) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def risk(flows: Column, communities: Column, tests: Column, security: Column, callers: Column) -> Column:
    """Sum of capped parts: flows .05 each to .25, other communities .05 to .15, missing tests .30 falling to .05, security .20, callers .10."""
    parts = [
        F.least(flows * 0.05, F.lit(0.25)), F.least(communities * 0.05, F.lit(0.15)),
        F.greatest(F.lit(0.30) - F.least(tests / 5.0, F.lit(1.0)) * 0.25, F.lit(0.05)),
        F.when(security, 0.20).otherwise(0.0), F.least(callers / 20.0, F.lit(0.10)),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.round(F.least(total, F.lit(1.0)), 4)


def impact_bucket(n: Column) -> Column:
    return F.when(n > 20, "high").when(n > 5, "medium").otherwise("low")


def confidence(signals: dict[str, Column]) -> Column:
    """Weighted mean of the signals that are not null, clamped to 0..1; null without any."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, weight in CONFIDENCE_WEIGHT.items():
        if name in signals:
            top = top + F.coalesce(signals[name] * weight, F.lit(0.0))
            bottom = bottom + F.when(signals[name].isNull(), 0.0).otherwise(weight)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(top, bottom))), 4)


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.80, "high").when(value >= 0.55, "medium").otherwise("low")


def salience(base: Column, age_days: Column, affinity: Column, same_domain: Column, pinned: Column) -> Column:
    """Base weight with a half-life of 90 days, plus affinity, a week's freshness and the own domain; pinned is 1."""
    decayed = base * F.exp(-F.log(F.lit(2.0)) * age_days / 90)
    total = decayed + affinity * 0.3 + F.when(age_days <= 7, 0.2).otherwise(0.0) + F.when(same_domain, 0.15).otherwise(0.0)
    return F.when(pinned, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))


def age_factor(age_days: Column) -> Column:
    return 1 + F.greatest(F.lit(0.0), (age_days - 90) / 90)


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in SEVERITY_WEIGHT.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def drift_score(severity: Column, age_days: Column) -> Column:
    return severity_weight(severity) * age_factor(age_days)


def staleness(distance: Column, confidence: Column) -> Column:
    return F.round(F.least(F.lit(1.0), distance / 10.0) * (1 - confidence), 4)


def staleness_label(value: Column) -> Column:
    return F.when(value >= 0.70, "stale").when(value >= 0.40, "candidate").otherwise("fresh")


def tail_distance(a: Column, b: Column) -> Column:
    """How far two hex digests are apart, judged by their last four digits."""
    tail = lambda c: F.conv(F.right(c, F.lit(4)), 16, 10).cast("long")
    return F.abs(tail(a) - tail(b))


def rrf(rank: Column, k: int = 60) -> Column:
    return F.coalesce(F.lit(1.0) / (k + rank), F.lit(0.0))


def linear_fusion(bm25_share: Column, dense: Column) -> Column:
    return F.when(dense.isNull(), bm25_share).otherwise(F.coalesce(bm25_share, F.lit(0.0)) * 0.4 + dense * 0.6)


def tokens_ceil(chars: Column) -> Column:
    return F.ceil(chars / 4)


def tokens_rate(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars * 0.27))


def tokens_floor(chars: Column) -> Column:
    return F.floor(chars / 4)


def price(tokens_in: Column, tokens_out: Column, cached: Column, rates: tuple[float, float, float] = PRICE_PER_MILLION) -> Column:
    return (tokens_in * rates[0] + tokens_out * rates[1] + cached * rates[2]) / 1_000_000


def symbol_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)
