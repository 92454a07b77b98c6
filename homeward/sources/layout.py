"""Stored layouts of the person tables for joins by id and for reads of a few records.

*Bucketed*: rows are dealt into a fixed number of files by a hash of the point id and sorted by it.
Patches, deletions and lookups by id join such a table where it lies; only the other side moves.

*Zoned*: rows are sorted by some columns and cut into files of about equal size, with Bloom filters
on the ids, and a small table says for each file which values it spans. A read with conditions on
those columns opens the files that can hold such rows and no others.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.operators.search import condition, filter_records, list_page
from homeward.schemas import AGE_COLUMN, BUSINESS_ID, TABLES
from homeward.sources.tables import conform

BUCKETS = 64
ROWS_PER_FILE = 100_000


def _path(root: str, side: str, layout: str) -> str:
    return f"{root.rstrip('/')}/{side}_{layout}"


# ---- bucketed ----------------------------------------------------------------------------------


def _name(path: str) -> str:
    return f"homeward_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(records: DataFrame, root: str, side: str, buckets: int = BUCKETS) -> None:
    """Write a table of ``side`` in buckets of the point id to a new folder.

    A join leaves it in place if it has as many buckets as the session has shuffle partitions, or more.
    """
    path = _path(root, side, "buckets")
    rows = conform(records, side)
    (
        rows.repartition(buckets, "point_id")
        .write.bucketBy(buckets, "point_id")
        .sortBy("point_id")
        .option("path", path)
        .saveAsTable(_name(path))
    )
    known = records.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1)
    known.write.parquet(f"{path}_layout")


def rewrite_bucketed(records: DataFrame, root: str, side: str, buckets: int = BUCKETS) -> None:
    """Write a result that is still in the buckets of its table, without moving it, to a new folder."""
    path = _path(root, side, "buckets")
    conform(records, side).write.bucketBy(buckets, "point_id").sortBy("point_id").option(
        "path", path
    ).saveAsTable(_name(path))
    known = records.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1)
    known.write.parquet(f"{path}_layout")


def open_bucketed(spark: SparkSession, root: str, side: str) -> DataFrame:
    """The bucketed table; a session that did not write it learns of its buckets here."""
    path = _path(root, side, "buckets")
    name = _name(path)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.parquet(f"{path}_layout").first().buckets
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[side].fields)
        spark.sql(
            f"create table {name} ({columns}) using parquet clustered by (point_id) "
            f"sorted by (point_id) into {buckets} buckets location '{path}'"
        )
    return spark.table(name)


# ---- zoned -------------------------------------------------------------------------------------


def zone_columns(side: str) -> list[str]:
    """Columns whose least and greatest value are known for each file."""
    return ["point_id", BUSINESS_ID[side], "gender", AGE_COLUMN[side]]


def write_zoned(
    records: DataFrame, root: str, side: str, by: tuple[str, ...] = ("point_id",), rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Write a table of ``side`` sorted by the columns ``by``, with the span of values of each file.

    A task writes many small files or a large one. Bloom filters are as large as the rows of a file
    need; Parquet otherwise gives each a whole megabyte.
    """
    path = _path(root, side, "zones_by_" + "_".join(by))
    rows = conform(records, side)
    n, cores = rows.count(), records.sparkSession.sparkContext.defaultParallelism
    files = max(1, math.ceil(n / rows_per_file))
    tasks = min(files, max(cores, math.ceil(n / ROWS_PER_FILE)))
    order = [*by, *([] if "point_id" in by else ["point_id"])]
    writer = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write
    for column in ("point_id", BUSINESS_ID[side]):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(rows_per_file))
    writer.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    written = records.sparkSession.read.schema(TABLES[side]).parquet(f"{path}/rows")
    spans = [
        value
        for c in zone_columns(side)
        for value in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))
    ]
    zones = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *spans)
    zones.coalesce(1).write.parquet(f"{path}/zones")


def zones(spark: SparkSession, root: str, side: str, by: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """(file, n, low_..., high_...) of each file of a zoned table."""
    return spark.read.parquet(f"{_path(root, side, 'zones_by_' + '_'.join(by))}/zones")


def _can_hold(column: str, low: Any, high: Any) -> Column:
    """Whether a file may hold a value from ``low`` to ``high``."""
    return (F.col(f"high_{column}") >= F.lit(low)) & (F.col(f"low_{column}") <= F.lit(high))


def _rows_of(spark: SparkSession, side: str, files: DataFrame) -> DataFrame:
    """Rows of the listed files."""
    found = [r.file for r in files.select("file").collect()]
    reader = spark.read.schema(TABLES[side])
    return reader.parquet(*found) if found else spark.createDataFrame([], TABLES[side])


def search_zoned(
    spark: SparkSession, root: str, side: str, filters: dict[str, Any], by: tuple[str, ...] = ("point_id",)
) -> DataFrame:
    """Records that meet the filters of a metadata search, from the files that may hold some."""
    files = zones(spark, root, side, by)
    spans = set(zone_columns(side))
    for key, value in filters.items():
        condition(side, key, value)  # a filter of an unknown kind is an error
        column = AGE_COLUMN[side] if key == "age_range" else key
        if column not in spans or value is None:
            continue
        if key == "age_range":
            files = files.filter(_can_hold(column, *value))
        elif isinstance(value, (list, tuple)):
            files = files.filter(reduce(Column.__or__, [_can_hold(column, v, v) for v in value], F.lit(False)))
        else:
            files = files.filter(_can_hold(column, value, value))
    return filter_records(_rows_of(spark, side, files), side, filters)


def points_zoned(spark: SparkSession, root: str, side: str, ids: list[str] | DataFrame) -> DataFrame:
    """Records by point id, from the files whose span holds one of the ids."""
    wanted = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(i,) for i in ids], "point_id string")
    wanted = wanted.select("point_id").distinct()
    held = F.col("point_id").between(F.col("low_point_id"), F.col("high_point_id"))
    files = F.broadcast(zones(spark, root, side)).join(wanted, held).select("file").distinct()
    return _rows_of(spark, side, files).join(wanted, "point_id", "left_semi")


def page_zoned(
    spark: SparkSession, root: str, side: str, limit: int = 100, offset: str | None = None
) -> DataFrame:
    """``search.list_page`` from the files that hold the page: sorted files share a value at most."""
    files = zones(spark, root, side).select("file", "n", "low_point_id", "high_point_id")
    if offset is not None:
        files = files.filter(F.col("high_point_id") >= offset)
    needed, rows = [], 0
    for r in files.orderBy("low_point_id", "high_point_id").collect():  # a row per file
        if rows > limit:
            break
        needed.append((r.file,))
        # Of the first file, any part may lie before the offset.
        rows += r.n if offset is None or r.low_point_id >= offset else 0
    listed = spark.createDataFrame(needed, "file string")
    return list_page(_rows_of(spark, side, listed), limit, offset)
