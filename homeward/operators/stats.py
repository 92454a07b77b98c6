"""Counts and summaries of the tables and of match results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeward.config import MatchConfig

# Fixed value: similarity measure of the collections.
METRIC = "Cosine"


def collection_stats(table: DataFrame, name: str) -> DataFrame:
    """Row count, vector size and metric of one table."""
    return table.agg(
        F.count("*").alias("points_count"),
        F.max(F.size("embedding")).alias("vector_size"),
    ).select(
        F.lit(name).alias("collection_name"),
        "points_count",
        "vector_size",
        F.lit(METRIC).alias("distance_metric"),
    )


def _side_counts(missing: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts; each side is counted on its own before the sides meet."""
    sides = [("missing", missing), ("found", found)]
    parts = [
        df.agg(F.count("*").alias("n")).withColumn("side", F.lit(side)) for side, df in sides
    ]
    return parts[0].unionByName(parts[1]).agg(
        F.sum(F.when(F.col("side") == "missing", F.col("n"))).alias("n_missing"),
        F.sum(F.when(F.col("side") == "found", F.col("n"))).alias("n_found"),
    )


def search_statistics(missing: DataFrame, found: DataFrame, config: MatchConfig) -> DataFrame:
    return _side_counts(missing, found).select(
        F.col("n_missing").alias("missing_persons_count"),
        F.col("n_found").alias("found_persons_count"),
        F.lit(config.face_threshold).alias("face_threshold"),
        F.lit(config.metadata_weight).alias("metadata_weight"),
        F.lit(config.age_tolerance).alias("age_tolerance"),
        (F.col("n_missing") + F.col("n_found")).alias("total_records"),
    )


def case_statistics(missing: DataFrame, found: DataFrame) -> DataFrame:
    return _side_counts(missing, found).select(
        F.col("n_missing").alias("total_missing"),
        F.col("n_found").alias("total_found"),
        (F.col("n_missing") + F.col("n_found")).alias("total_cases"),
    )


def data_health(missing: DataFrame, found: DataFrame, dim: int) -> DataFrame:
    """Per table: size, vectors that are absent or of another length, and a verdict."""

    def one(table: DataFrame, name: str) -> DataFrame:
        size = F.size("embedding")
        return table.agg(
            F.count("*").alias("points_count"),
            F.count_if(F.col("embedding").isNull()).alias("without_vector"),
            F.count_if(size != dim).alias("wrong_dimension"),
        ).withColumn("collection_name", F.lit(name))

    both = one(missing, "missing_persons").unionByName(one(found, "found_persons"))
    healthy = (
        (F.col("points_count") > 0)
        & (F.col("without_vector") == 0)
        & (F.col("wrong_dimension") == 0)
    )
    return both.withColumn("status", F.when(healthy, "healthy").otherwise("unhealthy"))


def confidence_histogram(matches: DataFrame, *within: str) -> DataFrame:
    """Matches per direction and confidence level, for each value of the columns ``within``."""
    return matches.groupBy(*within, "search_type", "confidence_level").agg(
        F.count("*").alias("matches"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.avg("face_similarity").alias("avg_face_similarity"),
    )
