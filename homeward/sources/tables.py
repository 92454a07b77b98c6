"""The two person tables as parquet with a fixed schema.

A table is the files that were appended to it and the parts that streams have committed. A part is
written where no reader looks, and counts from the moment that its entry is in the log: a folder
named after stream and batch, with one line that says where the part is, which Spark's output
committer moves into place whole. A batch that dies half-way leaves a part without an entry, and
its repeat writes another one; a batch that was committed is not written again. The name of a stream
lives in its checkpoint, so parts of two streams, or of a stream that has lost its checkpoint, never
replace each other.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeward.schemas import TABLES

# What a stream commits: records of the table, forms that were rejected, matches.
KINDS = ("stored", "rejects", "matches")


def _path(root: str, side: str) -> str:
    return f"{root.rstrip('/')}/{side}_persons"


def _log(root: str, side: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{side}_log/{kind}"


def _lines(spark: SparkSession, folder: str) -> list[str]:
    """Lines of all committed text files below a folder; none if there is no such folder."""
    try:
        found = spark.read.option("recursiveFileLookup", True).text(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return [r.value for r in found.collect()]  # a line per committed batch


def entries(spark: SparkSession, root: str, side: str, kind: str) -> dict[tuple[str, int], dict]:
    """Committed parts by (stream, batch): their path and schema."""
    found = map(json.loads, _lines(spark, _log(root, side, kind)))
    return {(e["stream"], e["batch"]): e for e in found}


def commit_part(
    rows: DataFrame, root: str, side: str, kind: str, stream: str, batch: int
) -> DataFrame:
    """Write ``rows`` as the part of a batch and read it back; a batch that has one keeps it."""
    spark = rows.sparkSession
    known = entries(spark, root, side, kind).get((stream, batch))
    if known is None:
        path = f"{root.rstrip('/')}/{side}_parts/{kind}/{stream}/{batch}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        known = {"stream": stream, "batch": batch, "path": path, "schema": rows.schema.json()}
        line = spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1)
        line.write.mode("overwrite").text(f"{_log(root, side, kind)}/{stream}-{batch}")
    return _read(spark, [known])


def _read(spark: SparkSession, found: list[dict]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(found[0]["schema"]))
    return spark.read.schema(schema).parquet(*[e["path"] for e in found])


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """Name of the stream of a checkpoint folder: made up once, then read from there."""
    folder = f"{checkpoint.rstrip('/')}/stream_name"
    if not _lines(spark, folder):
        line = spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1)
        line.write.mode("overwrite").text(folder)
    return _lines(spark, folder)[0]


def read_table(spark: SparkSession, root: str, side: str) -> DataFrame:
    """The table with all parts that streams have committed."""
    parts = [e["path"] for e in entries(spark, root, side, "stored").values()]
    return spark.read.schema(TABLES[side]).parquet(_path(root, side), *parts)


def read_arrivals(spark: SparkSession, root: str, side: str, kind: str) -> DataFrame:
    """All committed ``rejects`` or ``matches`` of the streams of a side.

    A form that was read by more than one stream is rejected once.
    """
    found = list(entries(spark, root, side, kind).values())
    if not found:
        raise ValueError(f"no stream of {side} has committed {kind}")
    rows = _read(spark, found)
    return rows.dropDuplicates(["form_id"]) if kind == "rejects" else rows


def not_stored(records: DataFrame, root: str, side: str) -> DataFrame:
    """The records whose point id no stream has stored yet.

    Point ids derive from the form's key and its arrival, so only records with an arrival in the
    range of the batch are read, which Parquet's statistics narrow down to few row groups.
    """
    parts = [e["path"] for e in entries(records.sparkSession, root, side, "stored").values()]
    if not parts:
        return records
    low, high = records.agg(F.min("upload_timestamp"), F.max("upload_timestamp")).first()
    if low is None:
        return records
    stored = records.sparkSession.read.schema(TABLES[side]).parquet(*parts)
    known = stored.filter(F.col("upload_timestamp").between(low, high)).select("point_id")
    return records.join(known, "point_id", "left_anti")


def conform(records: DataFrame, side: str) -> DataFrame:
    """Columns of the table in order and type; absent ones are NULL."""
    return records.select(*[
        (F.col(f.name) if f.name in records.columns else F.lit(None))
        .cast(f.dataType)
        .alias(f.name)
        for f in TABLES[side].fields
    ])


def append_rows(records: DataFrame, root: str, side: str) -> None:
    conform(records, side).write.mode("append").parquet(_path(root, side))


def write_table(records: DataFrame, root: str, side: str) -> None:
    """Write a changed table (after a deletion or patches) to a new root."""
    conform(records, side).write.mode("errorifexists").parquet(_path(root, side))


def initialize_tables(spark: SparkSession, root: str) -> None:
    """Create both tables if absent; tables that exist stay as they are."""
    for side, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(_path(root, side))


def reset_tables(spark: SparkSession, root: str) -> None:
    """Empty both tables."""
    for side, schema in TABLES.items():
        for kind in KINDS:  # the log first: what it does not list does not count
            nothing = spark.createDataFrame([], "value string")
            nothing.write.mode("overwrite").text(_log(root, side, kind))
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(_path(root, side))
