"""Age-labelled image files: parsing, one image per age, statistics, verification pairs.

A file name carries a three-digit person and a two-digit age, so there are at
most 1,000 persons and 100 ages per person however many files there are. Files
are reduced to (person, age) by partial aggregation first; everything that is
collected or paired afterwards is bounded by the name format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# File name layout and target layout.
FILE_NAME = r"^(\d{3})([AB])(\d{2})"
TARGET = "person_%s/age_%02d.jpg"

SEED = 42


def parse_files(files: DataFrame) -> DataFrame:
    """(path) to person_id, version, age, original_name; other names are dropped."""
    name = F.regexp_extract("path", r"[^/]+$", 0)
    stem = F.regexp_replace(name, r"\.JPG|\.jpg", "")
    parts = [F.regexp_extract(stem, FILE_NAME, i) for i in (1, 2, 3)]
    return files.filter(stem.rlike(FILE_NAME)).select(
        parts[0].alias("person_id"),
        parts[1].alias("version"),
        parts[2].cast("int").alias("age"),
        name.alias("original_name"),
        "path",
    )


def image_path(person: Column, age: Column) -> Column:
    return F.format_string(TARGET, person, age)


def files_by_person(files: DataFrame) -> DataFrame:
    """Every file with its ``position`` among the person's files, by age.

    Files of one age are ordered by a hash of the path and the path. They are numbered within
    (person, age, slice of the hash) and shifted by the counts of the earlier slices, of which
    there are at most 256 an age, so a person with a third of all files is no hot group.
    """
    keys = ["person_id", "age", "slice"]
    parsed = parse_files(files).withColumn("slice", F.substring(F.md5("path"), 1, 2))
    before = Window.partitionBy("person_id").orderBy("age", "slice").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = parsed.groupBy(*keys).agg(F.count("*").alias("n"))
    earlier = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    return parsed.join(earlier, keys).select(
        "person_id", "age", "path", (F.col("earlier") + within).alias("position")
    )


def by_person(files: DataFrame) -> DataFrame:
    """One row per person and age: number of files, and the file that is kept (last by path)."""
    return (
        parse_files(files)
        .groupBy("person_id", "age")
        .agg(F.count("*").alias("n_files"), F.max("path").alias("path"))
    )


def manifest(files: DataFrame) -> DataFrame:
    """Source file of every target file of the re-organised data set."""
    return by_person(files).select(
        "path", image_path(F.col("person_id"), F.col("age")).alias("target"), "person_id", "age"
    )


def persons(files: DataFrame) -> DataFrame:
    """person_id and sorted distinct ages; at most 1,000 rows of at most 100 ages."""
    ages = F.sort_array(F.collect_set("age"))
    return parse_files(files).groupBy("person_id").agg(ages.alias("ages"))


def person_stats(files: DataFrame) -> DataFrame:
    ages = F.col("ages")
    return persons(files).select(
        "person_id",
        F.size(ages).alias("n_images"),
        ages,
        F.array_min(ages).alias("min_age"),
        F.array_max(ages).alias("max_age"),
        (F.array_max(ages) - F.array_min(ages)).alias("age_span"),
    )


def overall_stats(files: DataFrame) -> DataFrame:
    return person_stats(files).agg(
        F.count("*").alias("persons"),
        F.sum("n_images").alias("images"),
        F.avg("n_images").alias("avg_images"),
        F.min("age_span").alias("min_span"),
        F.max("age_span").alias("max_span"),
        F.avg("age_span").alias("avg_span"),
    )


def sample_persons(files: DataFrame, n: int = 5) -> DataFrame:
    return person_stats(files).orderBy("person_id").limit(n)


def _older(ages: Column, age: Column, gap: int) -> Column:
    return F.filter(ages, lambda other: (other > age) & (other - age >= gap))


def _pairs_of(people: DataFrame, min_age_gap: int) -> DataFrame:
    younger = people.withColumn("a", F.explode("ages"))
    paired = younger.withColumn("b", F.explode(_older(F.col("ages"), F.col("a"), min_age_gap)))
    return paired.withColumns({
        "img1": image_path(F.col("person_id"), F.col("a")),
        "img2": image_path(F.col("person_id"), F.col("b")),
        "age_gap": F.col("b") - F.col("a"),
    })


def _same_pairs(people: DataFrame, min_age_gap: int) -> DataFrame:
    pairs = _pairs_of(people, min_age_gap)
    return pairs.select("img1", "img2", F.lit(1).alias("label"), "age_gap")


def same_pairs(files: DataFrame, min_age_gap: int = 10) -> DataFrame:
    """All pairs of one person at least ``min_age_gap`` years apart, at most 4,950 per person."""
    return _same_pairs(persons(files), min_age_gap)


def _draw(role: str, seed: int) -> Column:
    """Repeatable 32-bit number of a pair."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(role), "img1", "img2")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def different_pairs(files: DataFrame, min_age_gap: int = 10, seed: int = SEED) -> DataFrame:
    """As many pairs of different persons as there are same-person pairs.

    Every same-person pair draws one pair of two different persons and one image of each, by
    seeded hashes of its own paths. That gives the wanted number without counting first, and the
    same pairs again when a task is repeated. Draws may repeat.
    """
    return _different_pairs(persons(files), min_age_gap, seed)


def _different_pairs(people: DataFrame, min_age_gap: int, seed: int) -> DataFrame:
    everyone = Window.orderBy("person_id")  # at most 1,000 rows
    people = people.withColumns({
        "place": (F.row_number().over(everyone) - 1).cast("bigint"),
        "n_people": F.count("*").over(Window.partitionBy()).cast("bigint"),
    })
    n = F.col("n_people")
    drawn = (
        _pairs_of(people, min_age_gap)
        .filter(n > 1)
        .select(
            F.pmod(_draw("p1", seed), n).alias("p1"),
            F.pmod(
                F.pmod(_draw("p1", seed), n) + 1 + F.pmod(_draw("p2", seed), n - 1), n
            ).alias("p2"),
            _draw("i1", seed).alias("i1"),
            _draw("i2", seed).alias("i2"),
        )
    )

    def pick(i: int) -> DataFrame:
        return F.broadcast(people.select(
            F.col("place").alias(f"p{i}"),
            F.col("person_id").alias(f"person{i}"),
            F.col("ages").alias(f"ages{i}"),
        ))

    def image(i: int) -> Column:
        ages = F.col(f"ages{i}")
        index = F.pmod(F.col(f"i{i}"), F.size(ages).cast("bigint")).cast("int")
        return image_path(F.col(f"person{i}"), F.get(ages, index))

    return drawn.join(pick(1), "p1").join(pick(2), "p2").select(
        image(1).alias("img1"),
        image(2).alias("img2"),
        F.lit(0).alias("label"),
        F.lit(0).alias("age_gap"),
    )


def all_pairs(files: DataFrame, min_age_gap: int = 10, seed: int = SEED) -> DataFrame:
    """Same-person and different-person pairs; the file list is read once."""
    people = persons(files)
    return _same_pairs(people, min_age_gap).unionByName(
        _different_pairs(people, min_age_gap, seed)
    )


def shuffled(pairs: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows in seeded random order."""
    return pairs.orderBy(F.xxhash64("img1", "img2", "label", F.lit(seed)))


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label").agg(F.count("*").alias("pairs"))
