"""Scores, verdicts, risks and costs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Dollars per token (fixed values).
PRICE_IN, PRICE_OUT = 0.000003, 0.000015
#: Said of evidence whose words are not in the document.
UNCONFIRMED = "(not found in the source text; check by hand)"


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round_half_up(c: Column) -> Column:
    """Half goes towards positive infinity."""
    return F.floor(c + F.lit(0.5))


def verdict(similarity: Column) -> Column:
    return F.when(similarity >= 0.75, "COVERED").when(similarity >= 0.4, "PARTIAL").otherwise("NOT_COVERED")


def risk(similarity: Column, high: float, medium: float) -> Column:
    return F.when(similarity >= high, "HIGH").when(similarity >= medium, "MEDIUM").otherwise("LOW")


def novelty_risk(similarity: Column) -> Column:
    return risk(similarity, 0.75, 0.5)


def inventiveness_risk(similarity: Column) -> Column:
    return risk(similarity, 0.55, 0.35)


def novelty_threat(flag: Column, weighted: Column) -> Column:
    """A model's own flag wins where it is given."""
    return F.coalesce(flag, weighted >= 70)


def inventiveness_threat(flag: Column, weighted: Column) -> Column:
    return F.coalesce(flag, weighted >= 50)


def fallback_score(rrf: Column) -> Column:
    """Score of a candidate that no model judged: its RRF score against the most that two lists give at k = 60."""
    return clamp(round_half_up(rrf / F.lit(2 / 61) * 100))


def plain_score(rrf: Column) -> Column:
    """Score where reranking is off."""
    return round_half_up(rrf * 10000)


def weighted_score(scores: Column, weights: Column) -> Column:
    """Importance-weighted mean of array<struct<id, score>>, rounded; ids without a weight weigh 1; 0 if there is none."""
    weight = lambda s: F.coalesce(F.try_element_at(weights, s["id"]), F.lit(1.0))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["score"].cast("double") * weight(s))
    mass = F.aggregate(scores, F.lit(0.0), lambda a, s: a + weight(s))
    return F.when(mass > 0, round_half_up(F.try_divide(total, mass))).otherwise(F.lit(0)).cast("int")


def valid_evidence(evidence: Column, document: Column) -> Column:
    """Evidence of which at least half of the longer words stand in the document; else a fixed remark."""
    low = T.trim(F.lower(evidence))
    words = F.filter(F.split(low, f"{T.WS}+", -1), lambda w: F.length(w) > 2)
    held = F.filter(words, lambda w: F.contains(F.lower(F.coalesce(document, F.lit(""))), w))
    return (
        F.when(evidence.isNull() | (evidence == ""), "")
        .when((F.length(low) < 5) | (F.size(words) == 0) | (2 * F.size(held) >= F.size(words)), evidence)
        .otherwise(UNCONFIRMED)
    )


def score_colour(score: Column) -> Column:
    return F.when(score >= 70, "red").when(score >= 40, "yellow").otherwise("green")


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * 3 + tokens_out / 1e6 * 15, 4)


def cost_text(dollars: Column) -> Column:
    return F.when(dollars < 0.001, "< $0.001").otherwise(F.concat(F.lit("$"), F.format_string("%.3f", dollars)))


def retry_delay(attempt: Column, base_ms: int = 1000, most_ms: int = 30_000) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), attempt - 1), F.lit(most_ms)).cast("long")


def retryable(status: Column, message: Column) -> Column:
    """HTTP 429, 529 and from 500, or a message that names a passing fault."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) | low.rlike("rate limit|timeout|econnreset|503|529|overloaded")
