"""Image files and pair files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_SCHEMA = "img1 string, img2 string, label int, age_gap int"


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the ``*.JPG`` and ``*.jpg`` files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{JPG,jpg}").load(folder)
    return files.select("path")


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files as (filename, length, content) for the file gate."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.select(name.alias("filename"), "length", "content")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images; an unreadable file is a row of height -1 without data."""
    return spark.read.format("image").option("dropInvalid", False).load(folder)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("img1", "img2", "label", "age_gap").write.option("header", True).csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).option("header", True).csv(path)
