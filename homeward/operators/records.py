"""Keeping the two person tables: intake, patches, deletions, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.functions.contacts import contact_of
from homeward.functions.identifiers import millis_id, point_id
from homeward.functions.text import form_list
from homeward.schemas import BUSINESS_ID

# What a record must state to be stored.
REQUIRED = {
    "missing": ["case_id", "name", "age_at_disappearance", "year_disappeared", "gender"],
    "found": ["found_id", "current_age_estimate", "gender", "finder_contact"],
}

# Identifier prefix of each side.
ID_PREFIX = {"missing": "MISS", "found": "FOUND"}


def prepare_form(
    form: DataFrame, side: str, arrived_at: Column, row_key: Column
) -> DataFrame:
    """What the upload step does to a raw form.

    Gender is lower-cased, comma-separated mark fields (``*_text``) become lists, and a record
    without a business id gets one from its arrival time and ``row_key``, which is unique per row.
    """
    key = BUSINESS_ID[side]
    given = F.col(key) if key in form.columns else F.lit(None).cast("string")
    changes = {
        "gender": F.lower("gender"),
        key: F.coalesce(given, millis_id(ID_PREFIX[side], arrived_at, row_key)),
    }
    marks = "birthmarks" if side == "missing" else "visible_marks"
    if f"{marks}_text" in form.columns:
        changes[marks] = form_list(F.col(f"{marks}_text"))
    return form.withColumns(changes).drop(f"{marks}_text")


def intake_error(side: str, dim: int, vector: str = "embedding") -> Column:
    """First reason a record cannot be stored, NULL when it can."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    checks = [
        F.when(size <= 0, F.lit("Embedding cannot be None or empty")),
        F.when(
            size != dim,
            F.format_string(f"Embedding must be {dim}-dimensional, got %d", size),
        ),
    ]
    checks += [
        F.when(F.col(name).isNull(), F.lit(f"Missing required metadata field: {name}"))
        for name in REQUIRED[side]
    ]
    return F.coalesce(*checks)


def ingest(
    records: DataFrame,
    side: str,
    dim: int,
    uploaded_at: str | Column,
    as_of_year: int,
    row_key: Column,
) -> DataFrame:
    """Storable records with their system columns.

    ``row_key`` is unique per input row and gives each its own point id; business ids may repeat.
    """
    moment = F.lit(uploaded_at) if isinstance(uploaded_at, str) else uploaded_at
    stored = records.filter(intake_error(side, dim).isNull()).withColumns({
        "collection_type": F.lit(side),
        "upload_timestamp": moment.cast("string"),
        "point_id": point_id(side, row_key, moment),
    })
    if side == "missing":
        stored = stored.withColumn(
            "estimated_current_age",
            F.col("age_at_disappearance") + (F.lit(as_of_year) - F.col("year_disappeared")),
        )
    return stored


def ingest_rejects(records: DataFrame, side: str, dim: int) -> DataFrame:
    """Records that cannot be stored, with ``error``."""
    return records.withColumn("error", intake_error(side, dim)).filter(F.col("error").isNotNull())


def get_points(table: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Records by point id; unknown ids give no row."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select("point_id").distinct(), "point_id", "left_semi")
    return table.filter(F.col("point_id").isin(list(ids)))


def delete_points(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the given points; unknown ids are no error."""
    return table.join(ids.select("point_id").distinct(), "point_id", "left_anti")


def update_metadata(table: DataFrame, patches: DataFrame, order: str = "seq") -> DataFrame:
    """Apply patches (point_id, order, some columns); NULL leaves a column as it is.

    Several patches of one point are first merged, per column the last one that sets it, by a
    partial aggregate, so a point with very many patches is no hot spot. Derived columns such as
    the estimated age are not recomputed.
    """
    changed = [c for c in patches.columns if c not in ("point_id", order)]
    merged = patches.groupBy("point_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}")
        for c in changed
    ])
    joined = table.join(merged, "point_id", "left")
    return joined.withColumns({
        c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in table.columns else F.col(f"_new_{c}")
        for c in changed
    }).drop(*[f"_new_{c}" for c in changed])


def person_record(table: DataFrame) -> DataFrame:
    """Display form of a record: id, contact with fallback, image, everything else as metadata."""
    def column(name):
        return F.col(name) if name in table.columns else F.lit(None).cast("string")

    rest = [c for c in table.columns if c != "embedding"]
    return table.select(
        F.col("point_id").alias("id"),
        contact_of(column("contact"), column("finder_contact")).alias("contact"),
        column("image_url").alias("image_url"),
        F.struct(*rest).alias("metadata"),
    )
