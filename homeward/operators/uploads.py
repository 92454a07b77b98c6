"""An upload of many records at once: check, split, store-ready rows.

What happens to one uploaded record, for a whole table of them: the declared
field constraints, the form rules and the intake checks in this order, up to the
first that finds errors; records without any get their system columns and can be stored and matched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.config import MatchConfig
from homeward.operators import validation
from homeward.operators.records import ingest, intake_error


class Upload(NamedTuple):
    stored: DataFrame
    rejected: DataFrame


def check_uploads(records: DataFrame, side: str, config: MatchConfig) -> DataFrame:
    """Add ``errors`` and ``is_valid``: the errors of the first stage that has some."""
    if side == "missing":
        rules = validation.missing_errors(records, config.as_of_year)
    else:
        rules = validation.found_errors(records)
    declared = validation.strict_errors(records, side, config.as_of_year)
    return validation.with_first_errors(
        records, [declared, rules, [intake_error(side, config.dim)]]
    )


def upload(
    records: DataFrame,
    side: str,
    config: MatchConfig,
    uploaded_at: str | Column,
    row_key: Column,
) -> Upload:
    """Split prepared forms into records to store and records with ``errors``.

    ``row_key`` is unique per row.
    """
    checked = check_uploads(records, side, config)
    good = checked.filter(F.col("is_valid")).drop("errors", "is_valid")
    return Upload(
        ingest(good, side, config.dim, uploaded_at, config.as_of_year, row_key),
        checked.filter(~F.col("is_valid")).drop("is_valid"),
    )
