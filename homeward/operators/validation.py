"""Rule checks on forms, saved searches and uploaded files.

Every check is a Column that is an error text or NULL; a row's errors are the
non-NULL ones in rule order. Type errors of the form fields cannot occur here,
since the columns are typed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.functions.contacts import is_email, is_phone
from homeward.functions.text import strip
from homeward.schemas import GENDERS

# Limits of the form fields.
AGE_LIMITS = (0, 120)
FIRST_YEAR = 1900
HEIGHT_LIMITS = (50, 250)
MAX_MARKS = 10
NAME_LENGTH = (2, 100)
LOCATION_LENGTH = (3, 200)
CONDITION_LENGTH = 500
INFO_LENGTH = 1000

# Limits of a saved search.
SEARCH_LIMITS = (1, 100)

# Uploaded files.
FILE_SIZE = (1024, 10 * 1024 * 1024)
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/gif", "image/webp"]
EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp"]


def _required(name: str, *rules: tuple[Column, str]) -> Column:
    """One error at most: the field is absent, or the first rule it breaks."""
    chain = F.when(F.col(name).isNull(), F.lit(f"Missing required field: {name}"))
    for broken, message in rules:
        chain = chain.when(broken, F.lit(message))
    return chain


def _optional(broken: Column, message: str) -> Column:
    return F.when(broken, F.lit(message))


def _outside(name: str, limits: tuple[int, int]) -> Column:
    return ~F.col(name).between(*limits)


def _shorter(name: str, least: int) -> Column:
    return F.length(strip(F.col(name))) < least


def _not_a_contact(name: str) -> Column:
    contact = strip(F.col(name))
    return ~(is_email(contact) | is_phone(contact))


def _gender() -> Column:
    return _required(
        "gender",
        (~F.lower("gender").isin(GENDERS), f"Gender must be one of: {', '.join(GENDERS)}"),
    )


def _has(df: DataFrame, rules: list[tuple[str, Column]]) -> list[Column]:
    """Checks of optional fields the table has."""
    return [check for name, check in rules if name in df.columns]


# The messages of all checks below.


def missing_errors(df: DataFrame, as_of_year: int) -> list[Column]:
    required = [
        _required("name", (_shorter("name", 2), "Name must be at least 2 characters")),
        _required(
            "age_at_disappearance",
            (
                _outside("age_at_disappearance", AGE_LIMITS),
                "Age at disappearance must be between 0 and 120",
            ),
        ),
        _required(
            "year_disappeared",
            (
                _outside("year_disappeared", (FIRST_YEAR, as_of_year)),
                f"Year disappeared must be between {FIRST_YEAR} and {as_of_year}",
            ),
        ),
        _gender(),
        _required(
            "location_last_seen",
            (_shorter("location_last_seen", 3), "Location must be at least 3 characters"),
        ),
        _required(
            "contact", (_not_a_contact("contact"), "Contact must be a valid email or phone number")
        ),
    ]
    return required + _has(df, [
        (
            "height_cm",
            _optional(
                _outside("height_cm", HEIGHT_LIMITS), "Height must be between 50 and 250 cm"
            ),
        ),
        (
            "birthmarks",
            _optional(F.size("birthmarks") > MAX_MARKS, "Maximum 10 birthmarks allowed"),
        ),
    ])


def found_errors(df: DataFrame) -> list[Column]:
    required = [
        _required(
            "current_age_estimate",
            (
                _outside("current_age_estimate", AGE_LIMITS),
                "Current age estimate must be between 0 and 120",
            ),
        ),
        _gender(),
        _required(
            "current_location",
            (_shorter("current_location", 3), "Current location must be at least 3 characters"),
        ),
        _required(
            "finder_contact",
            (
                _not_a_contact("finder_contact"),
                "Finder contact must be a valid email or phone number",
            ),
        ),
    ]
    return required + _has(df, [
        (
            "visible_marks",
            _optional(F.size("visible_marks") > MAX_MARKS, "Maximum 10 visible marks allowed"),
        ),
        (
            "current_condition",
            _optional(
                F.length("current_condition") > CONDITION_LENGTH,
                "Current condition must be less than 500 characters",
            ),
        ),
    ])


def strict_errors(df: DataFrame, side: str, as_of_year: int) -> list[Column]:
    """The declared field constraints: lengths on the unstripped text, ranges, list sizes."""
    text = {"name": NAME_LENGTH, "additional_info": (0, INFO_LENGTH)}
    numbers = {}
    if side == "missing":
        text["location_last_seen"] = LOCATION_LENGTH
        numbers["age_at_disappearance"] = AGE_LIMITS
        numbers["year_disappeared"] = (FIRST_YEAR, as_of_year)
        numbers["height_cm"] = HEIGHT_LIMITS
        lists, needed = ["birthmarks"], ["name", "location_last_seen", "contact"]
    else:
        text["current_location"] = LOCATION_LENGTH
        text["current_condition"] = (0, CONDITION_LENGTH)
        numbers["current_age_estimate"] = AGE_LIMITS
        lists, needed = ["visible_marks"], ["current_location", "finder_contact"]
    checks = [(n, F.when(F.col(n).isNull(), F.lit(f"{n}: required"))) for n in needed]
    checks += [
        (n, _optional(~F.length(n).between(*lim), f"{n}: length must be {lim[0]} to {lim[1]}"))
        for n, lim in text.items()
    ]
    checks += [
        (n, _optional(_outside(n, lim), f"{n}: must be {lim[0]} to {lim[1]}"))
        for n, lim in numbers.items()
    ]
    checks += [
        (n, _optional(F.size(n) > MAX_MARKS, f"{n}: at most {MAX_MARKS} items")) for n in lists
    ]
    # An enumerated value must be given exactly.
    wrong_gender = F.col("gender").isNull() | ~F.col("gender").isin(GENDERS)
    checks.append(("gender", _optional(wrong_gender, f"gender: one of {', '.join(GENDERS)}")))
    return _has(df, checks)


def search_errors() -> list[Column]:
    """Checks of a saved search: max_results, threshold, gender, age_range; NULL is not given."""
    pair = F.size("age_range") == 2
    first, last = F.get("age_range", F.lit(0)), F.get("age_range", F.lit(1))
    return [
        _optional(
            _outside("max_results", SEARCH_LIMITS), "Limit must be an integer between 1 and 100"
        ),
        _optional(
            ~F.col("threshold").between(0.0, 1.0), "Threshold must be a number between 0.0 and 1.0"
        ),
        _optional(
            ~F.col("gender").isin(GENDERS), f"Filter gender must be one of: {', '.join(GENDERS)}"
        ),
        F.when(
            F.col("age_range").isNotNull() & ~pair,
            F.lit("Age range filter must be a list of two integers"),
        )
        .when(pair & (first.isNull() | last.isNull()), F.lit("Age range values must be integers"))
        .when(pair & (first > last), F.lit("Age range minimum must be less than maximum")),
    ]


def strict_search_errors() -> list[Column]:
    """The declared constraint on a search's ages: both inside 0 to 120."""
    outside = F.exists("age_range", lambda a: ~a.between(*AGE_LIMITS))
    return [_optional(outside, "Ages must be between 0 and 120")]


def is_valid_threshold(threshold: Column) -> Column:
    return F.coalesce(threshold.between(0.0, 1.0), F.lit(False))


def is_valid_age_range(ages: Column) -> Column:
    low, high = F.get(ages, F.lit(0)), F.get(ages, F.lit(1))
    inside = (F.size(ages) == 2) & (low >= 0) & (low <= high) & (high <= AGE_LIMITS[1])
    return F.coalesce(inside, F.lit(False))


def with_errors(df: DataFrame, checks: list[Column]) -> DataFrame:
    """Add ``errors`` (list) and ``is_valid``."""
    return df.withColumn("errors", F.array_compact(F.array(*checks))).withColumn(
        "is_valid", F.size("errors") == 0
    )


def with_first_errors(df: DataFrame, stages: list[list[Column]]) -> DataFrame:
    """Add ``errors`` of the first stage that finds some, and ``is_valid``."""
    found = [F.array_compact(F.array(*checks)) for checks in stages]
    first = F.coalesce(*[F.when(F.size(e) > 0, e) for e in found[:-1]], found[-1])
    return df.withColumn("errors", first).withColumn("is_valid", F.size("errors") == 0)


def validate_missing(df: DataFrame, as_of_year: int, strict: bool = False) -> DataFrame:
    checks = missing_errors(df, as_of_year)
    if strict:
        checks += strict_errors(df, "missing", as_of_year)
    return with_errors(df, checks)


def validate_found(df: DataFrame, as_of_year: int, strict: bool = False) -> DataFrame:
    checks = found_errors(df)
    if strict:
        checks += strict_errors(df, "found", as_of_year)
    return with_errors(df, checks)


def validate_searches(df: DataFrame, strict: bool = False) -> DataFrame:
    checks = search_errors() + (strict_search_errors() if strict else [])
    return with_errors(df, checks).withColumns({
        "threshold_ok": is_valid_threshold(F.col("threshold")),
        "age_range_ok": is_valid_age_range(F.col("age_range")),
    })


def file_type(content: Column, filename: Column) -> Column:
    """Image type by the signature of the content; by file extension when there is no content."""
    head = F.hex(F.substring(content, 1, 12))
    extension = F.element_at(F.split(F.lower(filename), r"\."), -1)
    named = F.lower(filename).contains(".") & extension.isin(EXTENSIONS)
    # Signatures of the accepted image formats.
    return (
        F.when(head.startswith("FFD8FF"), F.lit("image/jpeg"))
        .when(head.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"),
              F.lit("image/gif"))
        .when(head.rlike("^52494646.{8}57454250"), F.lit("image/webp"))
        .when(content.isNull() & named, F.concat(F.lit("image/"), extension))
        .otherwise(F.lit("unknown"))
    )


def file_gate(files: DataFrame) -> DataFrame:
    """Check files (filename, length, content) on size and type: adds mime_type, error, is_valid."""
    low, high = FILE_SIZE
    typed = files.withColumn("mime_type", file_type(F.col("content"), F.col("filename")))
    error = (
        F.when(F.col("length") < low, F.lit(f"File too small (minimum {low} bytes)"))
        .when(F.col("length") > high, F.lit(f"File too large (maximum {high // 1024**2}MB)"))
        .when(
            ~F.col("mime_type").isin(IMAGE_TYPES),
            F.concat(F.lit("Unsupported file type: "), F.col("mime_type")),
        )
    )
    return typed.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())
