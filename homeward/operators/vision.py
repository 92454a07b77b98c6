"""Faces and images as tables: detections, quality, duplicates, pair verification."""

from __future__ import annotations

from collections import defaultdict
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeward.functions.vectors import NORM_EPSILON
from homeward.operators.skew import HOT_ROWS, hot_keys, lookup_join
from homeward.session import checkpointed

# Thresholds of the gates.
MIN_CONFIDENCE = 0.70
MIN_SHARPNESS = 100.0
BRIGHTNESS = (40, 220)
MIN_CONTRAST = 30
MIN_IMAGE_SIZE = (50, 50)
SAME_PERSON = 0.6


def detections(faces: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Confident faces (x, y, w, h, confidence) with corner box and area; keypoints if given."""
    extra = [c for c in ("keypoints",) if c in faces.columns]
    return faces.filter(F.col("confidence") >= min_confidence).select(
        "image_id",
        "face_id",
        F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("bbox"),
        "confidence",
        (F.col("w") * F.col("h")).alias("area"),
        *extra,
    )


def best_face(found: DataFrame, by: str = "confidence") -> DataFrame:
    """One face per image: the most confident, or with ``by='area'`` the largest.

    A partial maximum, so an image with very many detections is no hot spot.
    """
    if by not in ("confidence", "area"):
        raise ValueError("by must be 'confidence' or 'area'")
    second = "area" if by == "confidence" else "confidence"
    rest = [c for c in found.columns if c not in ("image_id", by, second, "face_id")]
    key = F.struct(by, second, "face_id", *rest)
    return found.groupBy("image_id").agg(F.max(key).alias("_b")).select(
        "image_id", *[F.col("_b")[c].alias(c) for c in found.columns if c != "image_id"]
    )


def quality_gate(metrics: DataFrame, min_sharpness: float = MIN_SHARPNESS) -> DataFrame:
    """Add is_sharp, is_bright_enough, is_contrasted and is_good_quality."""
    return metrics.withColumns({
        "is_sharp": F.col("sharpness") >= min_sharpness,
        "is_bright_enough": F.col("brightness").between(*BRIGHTNESS),
        "is_contrasted": F.col("contrast") >= MIN_CONTRAST,
    }).withColumn(
        "is_good_quality",
        F.col("is_sharp") & F.col("is_bright_enough") & F.col("is_contrasted"),
    )


def image_valid(images: DataFrame, min_size: tuple[int, int] = MIN_IMAGE_SIZE) -> DataFrame:
    """Add is_valid: three channels and at least the given width and height."""
    ok = (
        (F.col("channels") == 3)
        & (F.col("width") >= min_size[0])
        & (F.col("height") >= min_size[1])
    )
    return images.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def average_hash(pixels: Column) -> Column:
    """Hexadecimal hash of a gray thumbnail: one bit per pixel, set where it exceeds the mean."""

    def bits(gray: Column, total: Column) -> Column:
        return F.transform(
            gray, lambda p: F.when(p * F.size(gray) > total, "1").otherwise("0")
        )

    def hashed(gray: Column) -> Column:
        total = F.aggregate(gray, F.lit(0).cast("bigint"), lambda s, p: s + p)
        return _with(total, lambda t: F.lower(F.conv(F.array_join(bits(gray, t), ""), 2, 16)))

    return _with(pixels, hashed)


def duplicate_groups(images: DataFrame) -> DataFrame:
    """Hashes that occur more than once: copies, and the image that stands for the group."""
    return (
        images.groupBy("hash")
        .agg(F.count("*").alias("n_copies"), F.min("image_id").alias("first_image"))
        .filter(F.col("n_copies") > 1)
    )


def duplicate_members(images: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every image of a duplicate group with the group's size and first image.

    ``images`` is read three times; pass a stored table. Hashes with very many copies are salted.
    """
    hot = hot_keys(images, "hash", hot_rows)
    return lookup_join(images, duplicate_groups(images), "hash", spread="image_id", hot=hot)


HASH_BITS = 64
# Different hashes of one band value that are compared in one piece.
BAND_BLOCK = 2_048


def near_duplicates(
    images: DataFrame, radius: int, block: int = BAND_BLOCK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every image with ``n_near``, the others whose hash differs in at most ``radius`` bits.

    ``first_near`` is the least of them and itself. Images (image_id, hash) of equal hash are one
    value with a count. Of ``radius + 1`` bands of bits, two values within the radius agree in at
    least one; they are compared in the first of those. A band value that very many hashes share is
    cut into blocks, and every pair of blocks is a key of its own, so it is no hot key; pairs only
    enter counts. Exact. ``images`` is read more than once; pass a stored table. An image without a
    hash has none near it.
    """
    if not 0 <= radius < HASH_BITS:
        raise ValueError(f"radius must be between 0 and {HASH_BITS - 1}")
    values = checkpointed(
        images.filter(F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(F.count("*").alias("n"), F.min("image_id").alias("least"))
        .withColumn("bits", F.conv("hash", 16, -10).cast("bigint"))
    )
    cuts = [HASH_BITS * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << (high - low)) - 1 for low, high in zip(cuts, cuts[1:])]

    def band(bits: Column, i: int) -> Column:
        shifted = F.shiftrightunsigned(bits, cuts[i])
        return shifted if masks[i].bit_length() == HASH_BITS else shifted.bitwiseAND(masks[i])

    banded = values.select(
        "bits", "n", "least",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("band"), band(F.col("bits"), i).alias("value")) for i in range(radius + 1)
        ])).alias("at"),
    ).select("bits", "n", "least", "at.*")
    blocks = banded.groupBy("band", "value").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = banded.join(blocks, ["band", "value"]).withColumn(
        "own", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    )
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    keys = ["band", "value", "row", "column"]
    left = placed.withColumn("row", F.col("own")).withColumn("column", each)
    right = placed.withColumn("column", F.col("own")).withColumn("row", each)
    right = right.select(*keys, F.col("bits").alias("other"), F.col("n").alias("n_other"), F.col("least").alias("least_other"))
    differ = F.col("bits").bitwiseXOR(F.col("other"))
    # The first band in which the two agree: the bits of every earlier one differ.
    earlier = [F.when(F.col("band") > i, band(differ, i) != 0).otherwise(True) for i in range(radius)]
    meets = F.lit(True)
    for e in earlier:
        meets = meets & e
    near = (
        left.join(right, keys)
        .filter((F.col("bits") != F.col("other")) & (F.bit_count(differ) <= radius) & meets)
        .groupBy("bits")
        .agg(F.sum("n_other").alias("others"), F.min("least_other").alias("least_other"))
    )
    counted = values.join(near, "bits", "left").select(
        "hash",
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"),
        F.least("least", "least_other").alias("first_near"),
    )
    hot = hot_keys(images, "hash", hot_rows)
    joined = lookup_join(images, counted, "hash", spread="image_id", hot=hot, how="left")
    return joined.withColumns({
        "n_near": F.coalesce("n_near", F.lit(0)).cast("long"),
        "first_near": F.coalesce("first_near", "image_id"),
    })


_COMPARED = T.StructType([
    T.StructField("cosine", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
])


@F.arrow_udf(_COMPARED)
def _compare(left: pa.Array, right: pa.Array) -> pa.Array:
    """Null where either vector is null or their lengths differ."""
    lengths = [v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for v in (left, right)]
    usable = (lengths[0] == lengths[1]) & (lengths[0] > 0)
    cosine, distance = np.full(len(left), np.nan), np.full(len(left), np.nan)
    for size in np.unique(lengths[0][usable]).tolist():
        rows = np.flatnonzero(usable & (lengths[0] == size))

        def matrix(vectors):
            flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            return flat.astype(np.float64).reshape(len(rows), size)

        a, b = matrix(left), matrix(right)
        norm = [np.sqrt((m * m).sum(axis=1)) + NORM_EPSILON for m in (a, b)]
        cosine[rows] = (a * b).sum(axis=1) / (norm[0] * norm[1])
        distance[rows] = np.sqrt(((a - b) ** 2).sum(axis=1))
    return pa.StructArray.from_arrays(
        [pa.array(cosine, mask=~usable), pa.array(distance, mask=~usable)], ["cosine", "distance"]
    )


# Outcomes of looking up the vectors of a listed pair.
COMPARED = "compared"
NO_VECTOR = ("no vector for img1", "no vector for img2", "no vectors")
OTHER_LENGTH = "vectors differ in length"


# Pairs whose vectors one task looks up, and tasks per core where there are fewer pairs.
PART_PAIRS = 1_000_000
TASKS_PER_CORE = 3
# Images are hashed into this many buckets; the blocks of a grid are runs of buckets.
BUCKETS = 64
MOST_BLOCKS = 32


def with_vectors(
    pairs: DataFrame,
    vectors: DataFrame,
    pair_id: str,
    names: tuple[str, str] = ("left", "right"),
    hot_rows: int = HOT_ROWS,
    part_pairs: int = PART_PAIRS,
) -> DataFrame:
    """Every listed pair (img1, img2) with the vectors of both images and a ``status``.

    An image without a stored vector, or with an empty one, leaves its vector NULL. Only a pair of
    status ``compared`` has two vectors of one length. Pairs move once, to the cell of a grid of
    both images' blocks, and vectors to every cell of their block. Where that would copy more
    vectors than there are pairs, the sides are joined one after the other instead. Either way an
    image may be in very many pairs.
    """
    usable = vectors.filter(F.size("embedding") > 0)
    grid = _Grid(pairs, pair_id, part_pairs)
    if grid.copies * usable.count() <= grid.n_pairs:
        joined = grid.with_vectors(usable, names)
    else:
        joined = pairs
        for key, name in zip(("img1", "img2"), names):
            side = usable.select(F.col("image_id").alias(key), F.col("embedding").alias(name))
            hot = hot_keys(pairs.select("img1", "img2"), key, hot_rows)
            joined = lookup_join(joined, side, key, spread=pair_id, hot=hot, how="left")
    first, second = (F.col(n).isNull() for n in names)
    status = (
        F.when(first & second, NO_VECTOR[2])
        .when(first, NO_VECTOR[0])
        .when(second, NO_VECTOR[1])
        .when(F.size(names[0]) != F.size(names[1]), OTHER_LENGTH)
        .otherwise(COMPARED)
    )
    return joined.withColumn("status", status)


class _Grid:
    """Pairs dealt to parts by the blocks of both images; a cell with many pairs is many parts.

    Pairs are counted by the buckets of both images, so the driver gets at most ``BUCKETS`` squared
    numbers.
    """

    def __init__(self, pairs: DataFrame, pair_id: str, part_pairs: int):
        self.pairs, self.pair_id = pairs, pair_id
        # A pair that names no image finds no vector in any bucket.
        row, column = self.buckets = [
            F.when(F.col(k).isNull(), self._bucket(F.col(pair_id))).otherwise(self._bucket(F.col(k)))
            for k in ("img1", "img2")
        ]
        counts = pairs.groupBy(row.alias("row"), column.alias("column")).count().collect()
        self.n_pairs = sum(n for _, _, n in counts)
        tasks = TASKS_PER_CORE * pairs.sparkSession.sparkContext.defaultParallelism
        self.blocks = min(ceil(sqrt(max(tasks, self.n_pairs / part_pairs))), MOST_BLOCKS)
        cells: dict[tuple[int, int], int] = defaultdict(int)
        for r, c, n in counts:
            cells[r * self.blocks // BUCKETS, c * self.blocks // BUCKETS] += n
        # Cells differ a little without any hot image; what has more than twice the mean is cut.
        most = 2 * ceil(self.n_pairs / self.blocks**2)
        self.parts: dict[tuple[int, int], range] = {}
        self.n_parts = 0
        for cell, n in sorted(cells.items()):
            self.parts[cell] = range(self.n_parts, self.n_parts + ceil(n / most))
            self.n_parts = self.parts[cell].stop
        # Vectors on the move, as a multiple of the stored ones.
        self.copies = 2 * self.n_parts / self.blocks

    @staticmethod
    def _bucket(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(BUCKETS))

    def _block(self, bucket: Column) -> Column:
        return F.floor(bucket * self.blocks / BUCKETS).cast("int")

    def _part_of_pair(self) -> Column:
        parts = [
            self.parts.get((r, c), range(1)) for r in range(self.blocks) for c in range(self.blocks)
        ]
        row, column = map(self._block, self.buckets)
        first, salts = (
            F.element_at(F.lit(of), row * self.blocks + column + 1)
            for of in ([p.start for p in parts], [len(p) for p in parts])
        )
        # Another hash than the bucket's, which may be one of the pair's id as well.
        salt = F.pmod(F.xxhash64(F.lit("salt"), self.pair_id), salts)
        return (first + salt).cast("int")

    def _parts_of_block(self, axis: int) -> Column:
        """Each block's parts, as a list of lists."""
        parts = [
            [part for cell, some in self.parts.items() if cell[axis] == block for part in some]
            for block in range(self.blocks)
        ]
        return F.array(*[F.array(*map(F.lit, some)).cast("array<int>") for some in parts])

    def with_vectors(self, vectors: DataFrame, names: tuple[str, str]) -> DataFrame:
        """All pairs with the vectors of both images, looked up within each part."""
        sides = list(enumerate(zip(("img1", "img2"), names)))
        rows = self.pairs.withColumns({"_part": self._part_of_pair(), "_side": F.lit(-1)})
        for axis, (key, name) in sides:
            image = F.col("image_id").cast(self.pairs.schema[key].dataType)
            parts = F.element_at(self._parts_of_block(axis), self._block(self._bucket(image)) + 1)
            side = vectors.filter(image.isNotNull()).select(
                image.alias(key),
                F.col("embedding").alias(name),
                F.explode(parts).alias("_part"),
                F.lit(axis).alias("_side"),
            )
            rows = rows.unionByName(side, allowMissingColumns=True)
        # One exchange: the windows sort within the parts.
        rows = rows.repartitionById(max(1, self.n_parts), F.col("_part"))
        for axis, (key, name) in sides:
            stored = F.collect_list(name).over(Window.partitionBy("_part", key))
            rows = rows.withColumn(name, stored).filter(F.col("_side") != axis)
        for name in names:
            rows = rows.withColumn(name, F.explode_outer(name))
        return rows.select(*self.pairs.columns, *names)


def verify_pairs(
    pairs: DataFrame,
    vectors: DataFrame,
    pair_id: str,
    threshold: float = SAME_PERSON,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Cosine, distance and verdict of listed pairs; NULL, with a ``status``, if not comparable."""
    both = with_vectors(pairs, vectors, pair_id, ("_v1", "_v2"), hot_rows)
    compared = both.withColumn("_c", _compare("_v1", "_v2"))
    return compared.withColumns({
        "cosine_similarity": F.col("_c.cosine"),
        "euclidean_distance": F.col("_c.distance"),
        "threshold": F.lit(threshold),
        "is_match": F.col("_c.cosine") >= threshold,
    }).drop("_c", "_v1", "_v2")
