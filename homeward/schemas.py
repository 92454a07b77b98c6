"""Column layout of the person tables and of the small tables around them."""

from __future__ import annotations

from pyspark.sql import types as T

GENDERS = ["male", "female", "other", "unknown"]

_VECTOR = T.StructField("embedding", T.ArrayType(T.FloatType()))
_SYSTEM = [
    T.StructField("collection_type", T.StringType()),
    T.StructField("upload_timestamp", T.StringType()),
]

MISSING_FORM = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("age_at_disappearance", T.IntegerType()),
    T.StructField("year_disappeared", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("location_last_seen", T.StringType()),
    T.StructField("contact", T.StringType()),
    T.StructField("height_cm", T.IntegerType()),
    T.StructField("birthmarks", T.ArrayType(T.StringType())),
    T.StructField("additional_info", T.StringType()),
    T.StructField("image_url", T.StringType()),
])

FOUND_FORM = T.StructType([
    T.StructField("found_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("current_age_estimate", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("current_location", T.StringType()),
    T.StructField("finder_contact", T.StringType()),
    T.StructField("visible_marks", T.ArrayType(T.StringType())),
    T.StructField("current_condition", T.StringType()),
    T.StructField("additional_info", T.StringType()),
    T.StructField("image_url", T.StringType()),
])

MISSING_TABLE = T.StructType(
    [T.StructField("point_id", T.StringType()), _VECTOR]
    + MISSING_FORM.fields
    + _SYSTEM
    + [T.StructField("estimated_current_age", T.IntegerType())]
)

FOUND_TABLE = T.StructType(
    [T.StructField("point_id", T.StringType()), _VECTOR] + FOUND_FORM.fields + _SYSTEM
)

TABLES = {"missing": MISSING_TABLE, "found": FOUND_TABLE}

# Business key of each side.
BUSINESS_ID = {"missing": "case_id", "found": "found_id"}

# Column an age range filter applies to.
AGE_COLUMN = {"missing": "estimated_current_age", "found": "current_age_estimate"}
