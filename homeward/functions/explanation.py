"""Readable explanation of a confidence score as nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeward.config import ConfidenceConfig
from homeward.functions import wording as W

Parts = dict[str, Column]


def _pick(cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs; NULL without a default."""
    chain = F.when(*cases[0])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


def description(name: str, score: Column) -> Column:
    texts = W.DESCRIPTIONS[name]
    cases = [(score >= bound, F.lit(text)) for bound, text in zip(W.BANDS, texts)]
    return _pick(cases, F.lit(texts[-1]))


def factor_map(parts: Parts, config: ConfidenceConfig) -> Column:
    """factor name -> (score, weight, contribution, description)."""
    entries = []
    for name, weight in config.weights.items():
        entries += [
            F.lit(name),
            F.struct(
                parts[name].alias("score"),
                F.lit(weight).alias("weight"),
                (parts[name] * F.lit(weight)).alias("contribution"),
                description(name, parts[name]).alias("description"),
            ),
        ]
    return F.create_map(*entries)


def _alert_cases(parts: Parts, texts: dict[str, str]) -> list[tuple[Column, Column]]:
    """A near-perfect face on contradicting metadata is suspicious."""
    face, metadata = parts["face_similarity"], parts["metadata_consistency"]
    return [
        ((face > above) & (metadata < below), F.lit(texts[name]))
        for name, (above, below) in W.ALERTS.items()
    ]


def _high_low(name: str, score: Column) -> Column:
    high, low = W.HIGH_LOW[name]
    return _pick([
        (score >= high, F.lit(W.REASONS[f"{name}_high"])),
        (score < low, F.lit(W.REASONS[f"{name}_low"])),
    ])


def reasons(parts: Parts, gender_match: Column) -> Column:
    face = parts["face_similarity"]
    strength = {
        name: F.format_string(text, face) for name, text in W.FACE_REASONS.items()
    }
    face_text = _pick(
        [(face >= W.FACE_STRONG, strength["strong"]), (face >= W.FACE_MODERATE, strength["moderate"])],
        strength["weak"],
    )
    gender_text = _pick([
        (gender_match == 1.0, F.lit(W.REASONS["gender_same"])),
        (gender_match == 0.0, F.lit(W.REASONS["gender_conflict"])),
    ])
    return F.array_compact(F.array(
        face_text,
        _high_low("age", parts["age_plausibility"]),
        _high_low("location", parts["location_proximity"]),
        _high_low("features", parts["distinctive_features"]),
        gender_text,
        _pick(_alert_cases(parts, W.REASONS)),
    ))


def summary(level: Column, parts: Parts) -> Column:
    face = parts["face_similarity"] >= W.SUPPORT_FROM
    age = parts["age_plausibility"] >= W.SUPPORT_FROM
    opening = _pick([(level == name, F.lit(text)) for name, text in W.SUMMARIES.items()])
    cases = {"both": face & age, "face": face, "age": age}
    support = _pick([(case, F.lit(W.SUMMARY_SUPPORT[n])) for n, case in cases.items()], F.lit(""))
    return F.concat(opening, support, _pick(_alert_cases(parts, W.SUMMARY_ALERT), F.lit("")))


def recommendations(level: Column, parts: Parts) -> Column:
    by_level = _pick([
        (level == name, F.array(*[F.lit(text) for text in texts]))
        for name, texts in W.RECOMMENDATIONS.items()
    ])
    checked = {
        "face": parts["face_similarity"],
        "age": parts["age_plausibility"],
        "location": parts["location_proximity"],
    }
    extra = [
        F.when(score < W.CHECK_BELOW[name], F.lit(W.EXTRA_RECOMMENDATIONS[name]))
        for name, score in checked.items()
    ]
    return F.concat(by_level, F.array_compact(F.array(*extra)))


def explanation(
    parts: Parts, gender_match: Column, score: Column, level: Column, config: ConfidenceConfig
) -> Column:
    cutoffs = {
        "very_high": config.very_high,
        "high": config.high,
        "medium": config.medium,
        "low": config.low,
    }
    return F.struct(
        level.alias("confidence_level"),
        F.round(score, 3).alias("confidence_score"),
        factor_map(parts, config).alias("factors"),
        reasons(parts, gender_match).alias("reasons"),
        summary(level, parts).alias("summary"),
        recommendations(level, parts).alias("recommendations"),
        F.create_map(*[F.lit(v) for item in cutoffs.items() for v in item]).alias(
            "threshold_info"
        ),
    )
