"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.session import run_dir

# Words of a text: runs of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
# Text worked on at a time inside a task; arrays of eight bytes a character stay small.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def filtered_after(df: DataFrame, condition: str) -> DataFrame:
    """Rows where boolean column ``condition`` holds, tested after the columns are computed.

    A plain filter is pushed below the projections and repeats their expressions once per use,
    which multiplies with nested ones. It is not pushed past a column that is not deterministic.
    """
    (place,) = fresh(df, "place")
    numbered = df.withColumn(place, F.monotonically_increasing_id())
    return numbered.filter(F.col(condition) & (F.col(place) >= 0)).drop(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_DRAW_BITS = 62


def drawn(share: Column | float, seed: int, *keys: str) -> Column:
    """Whether a row falls into a share of all, by 62 bits of a seeded hash of its ``keys``.

    A share of one draws every row; shares of one in 1e18 still draw some.
    """
    share = F.lit(share) if isinstance(share, float) else share
    limit = (F.least(share, F.lit(1.0)) * F.lit(float(1 << _DRAW_BITS))).cast("long")
    return F.xxhash64(F.lit(seed), *keys).bitwiseAND((1 << _DRAW_BITS) - 1) < limit


# Kinds, labels or languages that a stratified sample is drawn of; the list of them is broadcast.
MAX_GROUPS = 4096


def stratified(df: DataFrame, group: str, bound: int, seed: int, *keys: str) -> DataFrame:
    """About ``bound`` rows of each value of ``group``, all rows of values that have fewer.

    Rows are drawn by a seeded hash of ``keys``; rows without a value are not drawn. More than
    ``MAX_GROUPS`` values are an error.
    """
    share, value = fresh(df, "share", "value")
    counts = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias(value)).count()
    found = [(r[0], bound / r[1]) for r in counts.limit(MAX_GROUPS + 1).collect()]
    if len(found) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} different values of {group}")
    kind = df.schema[group].dataType.simpleString()
    shares = df.sparkSession.createDataFrame(found, f"{value} {kind}, {share} double")
    return (
        df.join(F.broadcast(shares), F.col(group) == F.col(value))
        .filter(drawn(F.col(share), seed, *keys))
        .drop(share, value)
    )


REPEATS = 1_000
# Keys of repeated rows are sent to all tasks up to this many; more are joined by a shuffle.
SHIPPED_KEYS = 1_000_000


def repeats_merged(docs: DataFrame, n: str) -> DataFrame:
    """Add ``n``: one, or how many rows one stands for where very many are equal.

    Rows that agree in id and checksum of the text are counted; where they are more than ``REPEATS``, equal
    ones are merged before any shuffle of whole rows, so that no key holds more than a few rows. Rows
    with columns that cannot be compared (maps) are left as they are.
    """
    one = F.lit(1).cast("long")
    if any("map<" in t or "variant" in t for _, t in docs.dtypes):
        return docs.withColumn(n, one)
    crc = F.coalesce(F.crc32("text"), F.lit(0))
    key, check = fresh(docs, "key", "check")
    often = stored(
        docs.groupBy(F.col("doc_id").alias(key), crc.alias(check))
        .agg(F.count("*").alias(n))
        .filter(F.col(n) > REPEATS)
        .select(key, check),
        "repeated",
    )
    n_often = often.count()
    if not n_often:
        return docs.withColumn(n, one)
    if n_often <= SHIPPED_KEYS:
        often = F.broadcast(often)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (crc == F.col(check))
    merged = docs.join(often, same, "left_semi").groupBy(*docs.columns).agg(F.count("*").alias(n))
    return docs.join(often, same, "left_anti").withColumn(n, one).unionByName(merged)


# ---- arrays inside tasks ----------------------------------------------------------------------


def text_slices(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes of text."""
    values = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(values):
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(values))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (plus the end)."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    starts[cuts] = inside[cuts]  # a text's first word starts there whatever stands before
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:] - 1
    tails = tails[tails >= 0]
    last[tails] = inside[tails]
    begins, ends = np.flatnonzero(starts), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def span_hashes(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0
) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``; equal runs have equal hashes wherever they stand.

    Differences of prefix sums of a polynomial, moved to position zero by the inverse power.
    """
    base = _BASES[seed]
    values = values.astype(np.uint64) + np.uint64(1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=prefix[1:])
    moved = _powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]
    lengths = (ends - starts).astype(np.uint64)
    return mixed((prefix[ends] - prefix[starts]) * moved + lengths)


def windows(first_word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of each window of ``k`` words within one text, and the text it is from."""
    counts = np.maximum(np.diff(first_word) - (k - 1), 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - before[owner] + first_word[:-1][owner], owner


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of ``n`` bytes from each place, and which of them count.

    A blank inside a run, or a text's end, makes it void; at its ends a blank marks a word's edge.
    """
    size = len(data)
    codes = np.zeros(size, np.uint64)
    valid = np.ones(size, bool)
    for i in range(n):
        codes[: size - i] |= data[i:].astype(np.uint64) << np.uint64(8 * i)
        if 0 < i < n - 1:
            valid[: size - i] &= data[i:] != 32
    for i in range(1, n):
        ends = offsets[1:] - i
        valid[ends[ends >= 0]] = False
    return codes | np.uint64(n << 56), valid


def sums_by_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``cuts``."""
    running = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=running[1:])
    return running[cuts[1:]] - running[cuts[:-1]]
