"""Confidence factors, score and level of a scored pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeward.config import ConfidenceConfig
from homeward.functions.similarity import clamp

# Fixed values: (lower bound, value at the bound, slope); below the last bound the score
# is multiplied by the factor that closes the list.
AGE_CURVE = ([(0.9, 1.0, 0.0), (0.7, 0.8, 1.0), (0.5, 0.5, 1.5)], 1.0)
LOCATION_CURVE = ([(0.8, 1.0, 0.0), (0.5, 0.7, 1.0), (0.2, 0.4, 1.0)], 2.0)
FEATURES_CURVE = ([(0.8, 1.0, 0.0), (0.5, 0.8, 0.67), (0.3, 0.5, 1.5)], 1.67)
TEMPORAL = 0.5


def _curve(score: Column, curve) -> Column:
    pieces, tail = curve
    result = score * F.lit(tail)
    for bound, start, slope in reversed(pieces):
        value = F.lit(start) + (score - F.lit(bound)) * F.lit(slope)
        result = F.when(score >= bound, value).otherwise(result)
    return result


def age_factor(age_consistency: Column) -> Column:
    return _curve(age_consistency, AGE_CURVE)


def location_factor(location_plausibility: Column) -> Column:
    return _curve(location_plausibility, LOCATION_CURVE)


def features_factor(marks_similarity: Column) -> Column:
    return _curve(marks_similarity, FEATURES_CURVE)


def temporal_factor() -> Column:
    """Reserved: neutral and without weight."""
    return F.lit(TEMPORAL)


def factors(
    face: str = "face_similarity",
    metadata: str = "metadata_similarity",
    age: str = "age_consistency",
    location: str = "location_plausibility",
    marks: str = "marks_similarity",
) -> dict[str, Column]:
    """The weighted factors of a scored pair, in the order they are reported."""
    return {
        "face_similarity": F.col(face),
        "metadata_consistency": F.col(metadata),
        "age_plausibility": age_factor(F.col(age)),
        "location_proximity": location_factor(F.col(location)),
        "distinctive_features": features_factor(F.col(marks)),
    }


def confidence_score(
    parts: dict[str, Column], gender_match: Column, config: ConfidenceConfig
) -> Column:
    total = None
    for name, weight in config.weights.items():
        term = F.lit(weight) * parts[name]
        total = term if total is None else total + term
    penalised = F.when(gender_match == 0.0, total * F.lit(config.gender_conflict_factor))
    return clamp(penalised.otherwise(total))


def confidence_level(score: Column, config: ConfidenceConfig) -> Column:
    return (
        F.when(score >= config.very_high, F.lit("VERY_HIGH"))
        .when(score >= config.high, F.lit("HIGH"))
        .when(score >= config.medium, F.lit("MEDIUM"))
        .when(score >= config.low, F.lit("LOW"))
        .otherwise(F.lit("VERY_LOW"))
    )
