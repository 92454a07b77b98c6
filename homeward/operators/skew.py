"""Joins from a large table to a table of unique keys when some keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of all rows, so there are at most 1,000 ...
HOT_SHARE = 1_000
# ... and more rows than one task handles without trouble.
HOT_ROWS = 100_000


def hot_keys(facts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, salts) of the hot keys: at most ``HOT_SHARE`` rows, whatever the table size."""
    fair = max(hot_rows, facts.count() // HOT_SHARE)
    counts = facts.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > fair).select(
        F.col(key), F.ceil(F.col("_n") / F.lit(fair)).cast("int").alias("_salts")
    )


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread: str,
    hot: DataFrame | None = None,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join to ``dim``, whose ``key`` is unique, hot keys spread over many tasks.

    Rows of a hot key get one of ``_salts`` salts by the hash of column ``spread`` and the key's
    single row in ``dim`` is repeated once per salt. The list of hot keys is bounded by
    construction, hence safe to broadcast. Pass ``hot`` to count keys on a cheaper table than
    ``facts``, which is otherwise read once more for it.
    """
    hot = F.broadcast(hot_keys(facts, key) if hot is None else hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted_facts = facts.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), salts).cast("int")
    )
    salted_dim = dim.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return (
        salted_facts.drop("_salts")
        .join(salted_dim.drop("_salts"), [key, "_salt"], how)
        .drop("_salt")
    )
