import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from homeward.config import MatchConfig
from homeward.functions import similarity as S

CONFIG = MatchConfig(as_of_year=2024)


def text(value):
    return F.lit(value).cast("string")


def number(value):
    return F.lit(value).cast("int")


@pytest.mark.parametrize(
    "left, right, want",
    [
        ("male", "MALE", 1.0),
        ("male", "female", 0.0),
        ("unknown", "male", 0.0),
        ("unknown", "unknown", 1.0),
        (None, "male", 0.5),
        ("", "male", 0.5),
    ],
)
def test_gender(one, left, right, want):
    keys = [S.gender_key(text(v)) for v in (left, right)]
    assert one(S.gender_match(*keys)) == want


@pytest.mark.parametrize(
    "current, age, year, tolerance, want",
    [
        (30, 26, 2020, 5, 1.0),
        (35, 26, 2020, 5, 0.7),
        (33, 26, 2020, 5, 1.0 - (3 / 5) * 0.3),
        (36, 26, 2020, 5, 0.7 * math.exp(-1 / 5)),
        (20, 26, 2020, 5, 0.7 * math.exp(-5 / 5)),
        (0, 26, 2020, 5, 0.5),
        (30, 0, 2020, 5, 0.5),
        (30, 26, 0, 5, 0.5),
        (None, 26, 2020, 5, 0.5),
        (30, 26, 2020, 0, 0.5),
        (31, 26, 2020, 0, 0.7 * math.exp(-1 / 5)),
    ],
)
def test_age(one, current, age, year, tolerance, want):
    expected = S.age_now(number(age), number(year), 2024)
    got = one(S.age_consistency(S.known_age(number(current)), expected, tolerance))
    assert got == pytest.approx(want, abs=1e-12)


def marks(values):
    return F.lit(values if values is not None else None).cast("array<string>") if (
        values is None
    ) else F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize(
    "left, right, want",
    [
        ([], [], 0.5),
        (None, [], 0.5),
        (["scar"], None, 0.3),
        (["Scar \t"], [" scar"], 1.0),
        (["a", "b"], ["b", "c"], 1 / 3),
        (["a"], ["b"], 0.0),
        (["a", "A"], ["a"], 1.0),
    ],
)
def test_marks(one, left, right, want):
    sets = [S.mark_set(marks(v)) for v in (left, right)]
    assert one(S.marks_similarity(*sets)) == pytest.approx(want)


@pytest.mark.parametrize(
    "left, right, want",
    [
        ("New York, NY", " new york, ny\n", 1.0),
        ("New York, NY", "York", 1 / 3),
        ("New York, NY", "Boston", 0.0),
        (None, "Boston", 0.5),
        ("", "Boston", 0.5),
        ("  ", "Boston", 0.0),
        (" , ", ",", 1.0),
        (" , ", ",,", 0.0),
    ],
)
def test_location(one, left, right, want):
    keys = [S.location_key(text(v)) for v in (left, right)]
    got = one(
        S.location_plausibility(
            keys[0], S.location_words(keys[0]), keys[1], S.location_words(keys[1])
        )
    )
    assert got == pytest.approx(want)


def test_first_stated_place_counts(one):
    assert one(S.location_key(text(""), text("Rome"))) == "rome"


def test_metadata_penalty(one):
    agree = S.metadata_similarity(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), CONFIG)
    clash = S.metadata_similarity(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), CONFIG)
    assert one(agree) == 1.0
    assert one(clash) == pytest.approx(0.7 * 0.4)


@pytest.mark.parametrize(
    "face, metadata, gender, age, want",
    [
        (0.86, 0.9, 0.0, 1.0, 1),
        (0.85, 0.9, 0.0, 1.0, None),
        (0.93, 0.34, 1.0, 1.0, 2),
        (0.92, 0.34, 1.0, 1.0, None),
        (0.93, 0.35, 1.0, 1.0, None),
        (0.91, 0.9, 1.0, 0.09, 3),
        (0.90, 0.9, 1.0, 0.01, None),
        (0.89, 0.39, 1.0, 0.04, 4),
        (0.89, 0.40, 1.0, 0.04, None),
        (0.93, 0.1, 0.0, 0.0, 1),
    ],
)
def test_reject_rules(one, face, metadata, gender, age, want):
    assert one(S.reject_rule(*[F.lit(v) for v in (face, metadata, gender, age)])) == want


@pytest.mark.parametrize(
    "face, metadata, combined, want",
    [
        (0.80, 0.0, 0.0, True),
        (0.79, 0.0, 0.549, False),
        (0.46, 0.9, 0.55, True),
        (0.50, 0.60, 0.0, True),
        (0.49, 0.60, 0.0, False),
    ],
)
def test_acceptance(one, face, metadata, combined, want):
    assert one(S.accepted(F.lit(face), F.lit(metadata), F.lit(combined), CONFIG)) is want


marks_lists = st.lists(st.sampled_from(["scar", "Mole ", " burn", "tattoo", ""]), max_size=4)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(marks_lists, marks_lists), min_size=1, max_size=20))
def test_marks_are_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    a, b = S.mark_set(F.col("a")), S.mark_set(F.col("b"))
    for row in df.select(
        S.marks_similarity(a, b).alias("ab"), S.marks_similarity(b, a).alias("ba"), "a", "b"
    ).collect():
        assert row.ab == row.ba and 0 <= row.ab <= 1
        sets = [{m.lower().strip() for m in side} for side in (row.a, row.b)]
        if all(sets):
            assert row.ab == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
