"""Connected components of an edge table, and work on groups of rows inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import stored


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014), which take a number of
    rounds in the order of the logarithm of the longest path. Each step is an aggregate and a
    join, and its result is a table in the shared folder, so a hub is no group of one task and
    a lost executor costs one step. An empty edge table gives an empty result.
    """
    current = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-edges",
    )
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("root"))
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("root").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        large = stored(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("root"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("root").alias("v"))
            .unionByName(least.withColumnRenamed("root", "v"))
            .filter("u <> v")
            .distinct()
        )
        current = stored(small, f"{name}-small")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def by_group(
    work: Callable[[list, int, int], dict | None], key: str, columns: list[str], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over rows sorted by ``key``: ``work(arrays, start, end)``.

    Arrays are numpy for numbers and Arrow arrays otherwise. Groups are small by construction;
    rows of one that goes on in the next batch are kept until it comes.
    """

    def emit(found: list[dict]) -> pa.RecordBatch:
        merged = [np.concatenate([f[n] for f in found]) for n in schema.names]
        return pa.RecordBatch.from_arrays(
            [pa.array(m).cast(t) for m, t in zip(merged, schema.types)], names=schema.names
        )

    def groups(batch: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        arrays = []
        for name in columns:
            column = batch.column(name)
            plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
            arrays.append(column.to_numpy(zero_copy_only=False) if plain else column)
        found, size = [], 0
        for a, b in zip(cuts, cuts[1:]):
            got = work(arrays, a, b)
            if got is not None:
                found.append(got)
                size += len(next(iter(got.values())))
                if size > 20_000:
                    yield emit(found)
                    found, size = [], 0
        if found:
            yield emit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            # Few rows at a time: a batch of long sets would be held with its copies.
            for first in range(0, batch.num_rows, 2_000):
                part = batch.slice(first, 2_000)
                if rest is not None and rest.num_rows:
                    joined = pa.Table.from_batches([rest, part]).combine_chunks()
                    part = joined.to_batches(max_chunksize=joined.num_rows)[0]
                keys = part.column(key).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
                yield from groups(part, cuts)
                rest = part.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from groups(rest, [0, rest.num_rows])

    return run


def in_blocks(members: DataFrame, group: str, node: str, size: str, limit: int) -> DataFrame:
    """Rows with ``block_key``, ``block`` and ``pair`` so that any two rows of a group meet once.

    Groups of up to ``limit`` rows are one block. Larger ones are cut into blocks by a hash of the
    node, and every pair of blocks is a unit of work of about ``limit`` rows: rows are repeated
    once per block of their group, pairs of rows are never written.
    """
    blocks = F.when(F.col(size) <= limit, F.lit(1)).otherwise(
        F.ceil(F.col(size) / (limit / 2))
    ).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), node), blocks).cast("int")
    return (
        members.withColumn("blocks", blocks)
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .withColumn("block_key", F.xxhash64(group, "low", "high"))
        .withColumn("cross", (F.col("low") != F.col("high")).cast("int"))
        .drop("blocks", "other", "low", "high")
    )


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least index each row is connected to."""
    root = np.arange(len(linked))
    for i in range(len(linked)):
        near = np.flatnonzero(linked[i])
        if len(near):
            roots = np.unique(np.append(root[near], root[i]))
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return root
