import pytest

from homeward.operators import validation as V

MISSING = (
    "name string, age_at_disappearance int, year_disappeared int, gender string, "
    "location_last_seen string, contact string, height_cm int, birthmarks array<string>, "
    "additional_info string"
)
GOOD_MISSING = {
    "name": "Ann", "age_at_disappearance": 0, "year_disappeared": 2024, "gender": "Female",
    "location_last_seen": "Rome", "contact": "a@b.org", "height_cm": None, "birthmarks": None,
    "additional_info": None,
}
FOUND = (
    "name string, current_age_estimate int, gender string, current_location string, "
    "finder_contact string, visible_marks array<string>, current_condition string, "
    "additional_info string"
)
GOOD_FOUND = {
    "name": None, "current_age_estimate": 120, "gender": "unknown", "current_location": "Rome",
    "finder_contact": "+1 (555) 000-1111", "visible_marks": None, "current_condition": None,
    "additional_info": None,
}


def errors(spark, schema, good, validate, **change):
    row = {**good, **change}
    return validate(spark.createDataFrame([row], schema)).first().errors


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []),
        ({"name": None}, ["Missing required field: name"]),
        ({"name": " x "}, ["Name must be at least 2 characters"]),
        ({"age_at_disappearance": 121}, ["Age at disappearance must be between 0 and 120"]),
        ({"year_disappeared": 2025}, ["Year disappeared must be between 1900 and 2024"]),
        ({"gender": "n/a"}, ["Gender must be one of: male, female, other, unknown"]),
        ({"location_last_seen": " ab "}, ["Location must be at least 3 characters"]),
        ({"contact": "call me"}, ["Contact must be a valid email or phone number"]),
        ({"contact": " 555 555 5555 "}, []),
        ({"height_cm": 49}, ["Height must be between 50 and 250 cm"]),
        ({"birthmarks": ["m"] * 11}, ["Maximum 10 birthmarks allowed"]),
        (
            {"name": "", "contact": None},
            ["Name must be at least 2 characters", "Missing required field: contact"],
        ),
    ],
)
def test_missing(spark, change, want):
    got = errors(spark, MISSING, GOOD_MISSING, lambda d: V.validate_missing(d, 2024), **change)
    assert got == want


def test_missing_strict(spark):
    def check(**change):
        return errors(
            spark, MISSING, GOOD_MISSING,
            lambda d: V.validate_missing(d, 2024, strict=True), **change,
        )

    assert check(gender="female") == []
    assert check() == ["gender: one of male, female, other, unknown"]
    assert check(gender="female", name="n" * 101) == ["name: length must be 2 to 100"]
    assert check(gender="female", additional_info="n" * 1001) == [
        "additional_info: length must be 0 to 1000"
    ]


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []),
        ({"current_age_estimate": -1}, ["Current age estimate must be between 0 and 120"]),
        ({"current_location": "ab"}, ["Current location must be at least 3 characters"]),
        ({"finder_contact": "x@y"}, ["Finder contact must be a valid email or phone number"]),
        ({"visible_marks": ["m"] * 11}, ["Maximum 10 visible marks allowed"]),
        ({"current_condition": "c" * 501}, ["Current condition must be less than 500 characters"]),
        ({"gender": None}, ["Missing required field: gender"]),
    ],
)
def test_found(spark, change, want):
    got = errors(spark, FOUND, GOOD_FOUND, lambda d: V.validate_found(d, 2024), **change)
    assert got == want


def test_searches(spark):
    rows = [
        (1, 10, 0.5, "male", [20, 40]),
        (2, 0, 1.5, "Male", [40, 20]),
        (3, None, None, None, [1]),
        (4, 100, 0.0, None, [1, 130]),
        (5, 101, 1.0, None, None),
    ]
    df = spark.createDataFrame(
        rows, "id int, max_results int, threshold double, gender string, age_range array<int>"
    )
    got = {r.id: r for r in V.validate_searches(df, strict=True).collect()}
    assert got[1].is_valid and got[1].threshold_ok and got[1].age_range_ok
    assert len(got[2].errors) == 4 and not got[2].threshold_ok
    assert got[3].errors == ["Age range filter must be a list of two integers"]
    assert got[4].errors == ["Ages must be between 0 and 120"] and not got[4].age_range_ok
    assert got[5].errors == ["Limit must be an integer between 1 and 100"]


def test_file_gate(spark):
    jpeg = bytes.fromhex("FFD8FFE000104A464946")
    rows = [
        ("a.jpg", 5000, jpeg, "image/jpeg", None),
        ("a.png", 5000, None, "image/png", None),
        ("a.jpg", 5000, b"plain text", "unknown", "Unsupported file type: unknown"),
        ("a", 5000, None, "unknown", "Unsupported file type: unknown"),
        ("a.jpg", 1023, jpeg, "image/jpeg", "File too small (minimum 1024 bytes)"),
        ("a.jpg", 10 * 1024**2 + 1, jpeg, "image/jpeg", "File too large (maximum 10MB)"),
        ("a.x", 2000, b"RIFF....WEBPVP8 ", "image/webp", None),
        ("a.x", 2000, b"GIF87a", "image/gif", None),
        ("a.x", 2000, bytes.fromhex("89504E470D0A1A0A"), "image/png", None),
    ]
    schema = "filename string, length long, content binary, want_type string, want_error string"
    for r in V.file_gate(spark.createDataFrame(rows, schema)).collect():
        assert (r.mime_type, r.error) == (r.want_type, r.want_error)
        assert r.is_valid == (r.want_error is None)
