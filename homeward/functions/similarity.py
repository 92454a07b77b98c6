"""Agreement of two person records.

Each record is reduced once to comparable features (``gender_key``,
``mark_set``, ``location_key`` ...). The pair functions then touch only those,
so the text work grows with the records and not with the candidate pairs.
A NULL column means the record does not state the field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeward.functions.text import strip, words


# Scores of fields that cannot be compared, and the age curve.
NEUTRAL = 0.5
MARKS_ON_ONE_SIDE = 0.3
AGE_SLOPE = 0.3
AGE_OUTSIDE = 0.7
AGE_DECAY_YEARS = 5.0

# A pair is implausible when its face similarity is above "face" and everything
# else a rule names holds: genders in conflict, metadata or age agreement below the bound.
REJECT_RULES = [
    {"face": 0.85, "gender_conflict": True},
    {"face": 0.92, "metadata": 0.35},
    {"face": 0.90, "age": 0.1},
    {"face": 0.88, "age": 0.05, "metadata": 0.4},
]


def _none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# Features of one record


def gender_key(gender: Column) -> Column:
    return _none_if_empty(F.lower(gender))


def mark_set(*mark_lists: Column) -> Column:
    stated = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in mark_lists])
    present = F.filter(stated, lambda m: m.isNotNull())
    return F.array_distinct(F.transform(present, lambda m: strip(F.lower(m))))


def location_key(*places: Column) -> Column:
    """First stated place, trimmed and lower-cased."""
    return strip(F.lower(F.coalesce(*[_none_if_empty(p) for p in places])))


def location_words(key: Column) -> Column:
    return words(F.replace(key, F.lit(","), F.lit(" ")))


def known_age(age: Column) -> Column:
    """An age or year of zero counts as not known."""
    return F.nullif(age, F.lit(0))


def age_now(age_at_disappearance: Column, year_disappeared: Column, as_of_year: int) -> Column:
    """Age a missing person should have by ``as_of_year``; NULL unless both inputs are known."""
    return known_age(age_at_disappearance) + (F.lit(as_of_year) - known_age(year_disappeared))


# Agreement of two records


def gender_match(left: Column, right: Column) -> Column:
    return (
        F.when(left.isNull() | right.isNull(), F.lit(NEUTRAL))
        .when(left == right, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def age_consistency(current: Column, expected: Column, tolerance: int) -> Column:
    """Linear from 1.0 to 0.7 inside the tolerance, exponential decay from 0.7 outside."""
    gap = F.abs(current - expected).cast("double")
    limit = F.lit(float(tolerance))
    inside = F.lit(1.0) - (gap / limit) * F.lit(AGE_SLOPE) if tolerance else F.lit(NEUTRAL)
    decay = F.exp(-(gap - limit) / F.lit(AGE_DECAY_YEARS))
    outside = F.greatest(F.lit(0.0), F.lit(AGE_OUTSIDE) * decay)
    return F.when(gap.isNull(), F.lit(NEUTRAL)).when(gap <= limit, inside).otherwise(outside)


def _jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return shared / (F.size(left) + F.size(right) - shared)


def marks_similarity(left: Column, right: Column) -> Column:
    neither = (F.size(left) == 0) & (F.size(right) == 0)
    either = (F.size(left) == 0) | (F.size(right) == 0)
    return (
        F.when(neither, F.lit(NEUTRAL))
        .when(either, F.lit(MARKS_ON_ONE_SIDE))
        .otherwise(_jaccard(left, right))
    )


def location_plausibility(
    left: Column, left_words: Column, right: Column, right_words: Column
) -> Column:
    return (
        F.when(left.isNull() | right.isNull(), F.lit(NEUTRAL))
        .when(left == right, F.lit(1.0))
        .when((F.size(left_words) == 0) & (F.size(right_words) == 0), F.lit(0.0))
        .otherwise(_jaccard(left_words, right_words))
    )


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def metadata_similarity(
    gender: Column, age: Column, marks: Column, location: Column, config
) -> Column:
    """Weighted agreement, cut down when the genders contradict each other."""
    blended = (
        gender * F.lit(config.gender_weight)
        + age * F.lit(config.age_weight)
        + marks * F.lit(config.marks_weight)
        + location * F.lit(config.location_weight)
    )
    factor = F.lit(config.gender_conflict_factor)
    return clamp(F.when(gender == 0.0, blended * factor).otherwise(blended))


def combined_score(face: Column, metadata: Column, config) -> Column:
    return F.lit(config.face_weight) * face + F.lit(config.metadata_weight) * metadata


def reject_rule(face: Column, metadata: Column, gender: Column, age: Column) -> Column:
    """Number of the first implausibility rule a pair breaks, NULL when it breaks none."""
    numbers = []
    for number, rule in enumerate(REJECT_RULES, start=1):
        broken = face > rule["face"]
        if "gender_conflict" in rule:
            broken = broken & (gender == 0.0)
        if "metadata" in rule:
            broken = broken & (metadata < rule["metadata"])
        if "age" in rule:
            broken = broken & (age < rule["age"])
        numbers.append(F.when(broken, F.lit(number)))
    return F.coalesce(*numbers)


def accepted(face: Column, metadata: Column, combined: Column, config) -> Column:
    return (
        (face >= config.face_threshold)
        | (combined >= config.accept_combined)
        | ((face >= config.accept_face) & (metadata >= config.accept_metadata))
    )
