"""Metadata filters, listing and paging."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeward.functions.contacts import contact_of
from homeward.schemas import AGE_COLUMN, BUSINESS_ID


def condition(side: str, key: str, value: Any) -> Column | None:
    """One filter: ``age_range`` is inclusive bounds, a list is any-of, a scalar is equality.

    ``None`` restricts nothing; a value of any other kind is an error.
    """
    if key == "age_range" and isinstance(value, (list, tuple)) and len(value) == 2:
        return F.col(AGE_COLUMN[side]).between(value[0], value[1])
    if isinstance(value, (list, tuple)):
        return F.col(key).isin(list(value))
    if isinstance(value, (str, int, float, bool)):
        return F.col(key) == F.lit(value)
    if value is not None:
        raise ValueError(f"cannot filter {key} by a {type(value).__name__}")
    return None


def filter_records(table: DataFrame, side: str, filters: dict[str, Any]) -> DataFrame:
    """Records that meet all filters; no filters, no restriction."""
    parts = [condition(side, key, value) for key, value in filters.items()]
    parts = [p for p in parts if p is not None]
    return table.filter(reduce(lambda a, b: a & b, parts)) if parts else table


def search_metadata(
    table: DataFrame, side: str, filters: dict[str, Any], limit: int = 10
) -> DataFrame:
    """First ``limit`` matching records by id; the score of a search without vector is 1.0."""
    found = filter_records(table, side, filters)
    return found.orderBy("point_id").limit(limit).withColumn("score", F.lit(1.0))


def list_page(table: DataFrame, limit: int = 100, offset: str | None = None) -> DataFrame:
    """One page in id order, without vectors; ``next_offset`` starts the next page.

    Reads ``limit + 1`` rows through a top-k, never a global sort.
    """
    rows = table.drop("embedding")
    if offset is not None:
        rows = rows.filter(F.col("point_id") >= offset)
    fetched = rows.orderBy("point_id").limit(limit + 1)
    page = Window.partitionBy(F.lit(1)).orderBy("point_id")  # limit + 1 rows
    ahead = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = fetched.withColumns({
        "_row": F.row_number().over(page),
        "next_offset": F.nth_value("point_id", limit + 1).over(ahead),
    })
    return numbered.filter(F.col("_row") <= limit).drop("_row")


def list_cases(
    missing: DataFrame, found: DataFrame, limit: int = 100, case_type: str | None = None
) -> DataFrame:
    """Up to ``limit`` cases (at most 500) of each side, or of one side.

    ``metadata`` is the stored record without its vector, as JSON.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    if case_type not in (None, "missing", "found"):
        raise ValueError("case_type must be 'missing', 'found' or None")

    def side_cases(table: DataFrame, side: str) -> DataFrame:
        none = F.lit(None).cast("string")
        contact = F.col("contact") if side == "missing" else none
        finder = F.col("finder_contact") if side == "found" else none
        picked = table.orderBy("point_id").limit(limit)
        return picked.select(
            F.lit(side).alias("collection_type"),
            F.col("point_id").alias("id"),
            F.col(BUSINESS_ID[side]).alias("case_id"),
            F.col("name"),
            F.col("gender"),
            contact_of(contact, finder).alias("contact"),
            # A listed case is its own record, hence the full scores.
            F.lit(1.0).alias("face_similarity"),
            F.lit(1.0).alias("metadata_similarity"),
            F.lit(1.0).alias("combined_score"),
            F.lit("VERY_HIGH").alias("confidence_level"),
            F.lit(1.0).alias("confidence_score"),
            F.to_json(F.struct(*[c for c in table.columns if c != "embedding"])).alias("metadata"),
        )

    sides = [("missing", missing), ("found", found)]
    parts = [side_cases(df, side) for side, df in sides if case_type in (None, side)]
    return reduce(DataFrame.unionByName, parts)
