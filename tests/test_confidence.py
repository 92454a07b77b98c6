import pytest
from pyspark.sql import functions as F

from homeward.config import ConfidenceConfig
from homeward.functions import confidence as C
from homeward.functions.explanation import explanation

CONFIG = ConfidenceConfig()
COLUMNS = [
    "face_similarity", "metadata_similarity", "gender_match", "age_consistency",
    "marks_similarity", "location_plausibility",
]


def scored(spark, *values):
    return spark.createDataFrame([tuple(map(float, values))], COLUMNS)


def explained(spark, *values):
    parts = C.factors()
    df = scored(spark, *values).withColumn(
        "s", C.confidence_score(parts, F.col("gender_match"), CONFIG)
    )
    df = df.withColumn("l", C.confidence_level(F.col("s"), CONFIG))
    return df.select(
        "s",
        "l",
        explanation(parts, F.col("gender_match"), F.col("s"), F.col("l"), CONFIG).alias("e"),
    ).first()


def test_golden_score(spark):
    row = explained(spark, 0.85, 0.75, 1, 0.9, 0.6, 0.4)
    assert row.s == pytest.approx(0.82835, abs=1e-12)
    assert row.l == "HIGH"
    assert row.e.confidence_score == 0.828
    assert row.e.factors["age_plausibility"].contribution == pytest.approx(0.15)
    assert row.e.factors["face_similarity"].description == (
        "High facial similarity - strong match"
    )
    assert row.e.reasons == [
        "Strong facial similarity (0.85)",
        "Age progression is highly consistent",
        "Distinctive features support the match",
        "Gender information matches",
    ]
    assert row.e.summary.endswith(
        "Both facial features and age progression strongly support this match."
    )
    assert len(row.e.recommendations) == 3
    assert row.e.threshold_info["very_high"] == 0.9


def test_gender_conflict_halves(spark):
    same = explained(spark, 0.85, 0.75, 1, 0.9, 0.6, 0.4).s
    clash = explained(spark, 0.85, 0.75, 0, 0.9, 0.6, 0.4)
    assert clash.s == pytest.approx(same / 2)
    assert "Gender information conflicts" in clash.e.reasons


def test_alerts(spark):
    warning = explained(spark, 0.96, 0.29, 0.5, 0.4, 0.2, 0.1)
    assert any("WARNING" in r for r in warning.e.reasons) and "WARNING" in warning.e.summary
    caution = explained(spark, 0.91, 0.39, 0.5, 0.4, 0.2, 0.1)
    assert any("CAUTION" in r for r in caution.e.reasons) and "CAUTION" in caution.e.summary
    assert "Verify age information and timeline details" in caution.e.recommendations
    assert "Investigate possible travel or relocation patterns" in caution.e.recommendations


@pytest.mark.parametrize(
    "factor, score, want",
    [
        (C.age_factor, 0.9, 1.0),
        (C.age_factor, 0.7, 0.8),
        (C.age_factor, 0.6, 0.65),
        (C.age_factor, 0.49, 0.49),
        (C.location_factor, 0.8, 1.0),
        (C.location_factor, 0.5, 0.7),
        (C.location_factor, 0.3, 0.5),
        (C.location_factor, 0.1, 0.2),
        (C.features_factor, 0.8, 1.0),
        (C.features_factor, 0.6, 0.867),
        (C.features_factor, 0.3, 0.5),
        (C.features_factor, 0.29, 0.29 * 1.67),
    ],
)
def test_factor_curves(one, factor, score, want):
    assert one(factor(F.lit(score))) == pytest.approx(want)


@pytest.mark.parametrize(
    "score, want",
    [(0.9, "VERY_HIGH"), (0.75, "HIGH"), (0.6, "MEDIUM"), (0.4, "LOW"), (0.39, "VERY_LOW")],
)
def test_levels(one, score, want):
    assert one(C.confidence_level(F.lit(score), CONFIG)) == want


def test_weights_are_normalised():
    weights = ConfidenceConfig(face=1.0, metadata=1.0, age=1.0, location=1.0, features=0.0).weights
    assert weights["face_similarity"] == 0.25 and sum(weights.values()) == 1.0
