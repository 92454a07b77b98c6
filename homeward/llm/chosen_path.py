"""Jaccard join of word shingles by chosen paths.

Texts with equal shingle sets are one node. Each run of the join starts with all nodes in one
set and splits it by a sampled shared token, the least shingle under one of ``HASHES`` random
orders, which two sets share with a probability equal to their similarity. Parts that are still
large are split again on tokens sampled for the path so far, two at a time, down to
``MAX_DEPTH``. Small parts are compared all with all; parts that stay large, because their sets
are all alike, are compared in pairs of blocks. Runs are repeated until a pair at the threshold
is missed with a probability below ``1 - RECALL``.

Inside a part, sets are compared by their ``HASHES`` minima, and a part gives back a spanning
forest of what looks similar rather than its pairs. The components of that are small supersets
of the answer; within each, shingle sets are compared exactly, again in pairs of blocks, and
links are counted, not listed. So a group of thousands of near copies costs comparisons but
neither rows nor memory by the square of its size.

A shingle is five consecutive words; a text of one to four words has one shingle of all of them.
Null and blank texts have none: no links, a class of their own. Rows with equal shingle sets are
linked with each other. Rows with a null id have a null class and no links and count for no other
row. Ids are expected to name a text: of rows that share an id, ``one_of_each`` keeps one. Shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homeward.llm.common import fresh, mixed, span_hashes, stored, text_slices, windows, word_spans
from homeward.llm.graph import by_group, components, forest, in_blocks

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99999
HASHES = 128
# How far an estimate of HASHES minima may lie below the threshold: a pair at 0.8 fails it with
# 1.4e-6, which with the runs' own misses (at most 3.0e-6) stays below 1 - RECALL.
MARGIN = 0.18
# Nodes compared all with all by their minima, and by their shingle sets.
LEAF = 2048
LIMIT = 512
MAX_DEPTH = 3
_SLICE = 1 << 20
_ORDERS = np.random.default_rng(4).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    counts = np.diff(first)
    at, owner = windows(first, k)
    grams = span_hashes(hashes, at, at + k)
    cuts = np.searchsorted(owner, np.arange(len(counts) + 1)).tolist()
    sets = [np.unique(grams[a:b]) for a, b in zip(cuts, cuts[1:])]
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        sets[i] = span_hashes(hashes, first[i : i + 1], first[i + 1 : i + 2])
    return sets


def _identity(shingles: np.ndarray) -> int:
    whole = span_hashes(shingles, np.array([0]), np.array([len(shingles)]))
    return int(whole.view(np.int64)[0])


def _minima(shingles: np.ndarray) -> bytes:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = mixed(shingles[a : a + 4096])
        np.minimum(least, (part[None, :] * _ORDERS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, node, minima) of the rows with an id; node is null without a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                sets = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([
                    batch.slice(start, end - start).column("doc_id"),
                    pa.array([_identity(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([_minima(s) if len(s) else None for s in sets], pa.binary()),
                ], names=["doc_id", "node", "minima"])

    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(run, "doc_id long, node long, minima binary")


def _chosen(paths: np.ndarray, number: int) -> np.ndarray:
    """The ``number`` orders sampled for each path."""
    draws = mixed(paths[:, None] + np.arange(1, HASHES + 1, dtype=np.uint64)[None, :] * _STEP)
    return np.argpartition(draws, number - 1, axis=1)[:, :number]


def _child(paths: np.ndarray, orders: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(paths * _STEP + orders.astype(np.uint64) * np.uint64(1 << 32) + tokens)


def runs_needed(similarity: float, recall: float, depth: int) -> int:
    """Runs until a pair of this similarity shares a part at ``depth`` with probability ``recall``."""
    reach = 1.0
    for _ in range(depth - 1):
        reach = 1 - (1 - similarity * reach) ** 2
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity * reach))


def _split(nodes: DataFrame, number: int) -> DataFrame:
    """Children (path, node) of rows (path, node, minima), ``number`` for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2_000):
                batch = whole.slice(first, 2_000)
                minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), "<u4").reshape(-1, HASHES)
                paths = batch.column("path").to_numpy().view(np.uint64)
                orders = _chosen(paths, number)
                tokens = np.take_along_axis(minima, orders, 1).astype(np.uint64)
                children = _child(paths[:, None], orders, tokens)
                yield pa.RecordBatch.from_arrays([
                    pa.array(children.ravel().view(np.int64)),
                    pa.array(np.repeat(batch.column("node").to_numpy(), number)),
                ], names=["path", "node"])

    return nodes.mapInArrow(run, "path long, node long")


def _sized(parts: DataFrame) -> DataFrame:
    """Rows of parts that hold more than one node, with their number."""
    busy = parts.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    return parts.join(busy, "path")


def _leaves(members: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of what looks similar within each leaf."""
    least = math.ceil(threshold * HASHES)

    def work(arrays, start, end):
        node, minima = arrays
        if end - start < 2:
            return None
        rows = np.frombuffer(b"".join(minima.slice(start, end - start).to_pylist()), "<u4").reshape(-1, HASHES)
        linked = np.empty((len(rows), len(rows)), bool)
        for i in range(len(rows)):
            linked[i] = (rows == rows[i]).sum(1) >= least
        root = forest(linked)
        far = np.flatnonzero(root != np.arange(len(rows)))
        nodes = node[start:end]
        return {"a": nodes[far], "b": nodes[root[far]]} if len(far) else None

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    sorted_rows = members.repartition("block_key").sortWithinPartitions("block_key")
    return sorted_rows.select("block_key", "node", "minima").mapInArrow(
        by_group(work, "block_key", ["node", "minima"], schema), "a long, b long"
    )


def candidates(signatures: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Edges (a, b) whose components hold every similar pair with probability ``recall``."""
    number = runs_needed(similarity, recall, 1)
    deep = runs_needed(similarity, recall, MAX_DEPTH)
    orders = _chosen(np.zeros(1, np.uint64), max(number, deep))[0].tolist()
    roots = F.explode(F.sequence(F.lit(1), F.lit(len(orders))))
    # A run's first split has one token; later ones have two, so that few runs are enough.
    at = F.array(*[F.lit(4 * o + 1) for o in orders])
    token = F.substring("minima", F.get(at, F.col("run") - 1), F.lit(4))
    parts = signatures.select("node", "minima", roots.alias("run")).select(
        F.xxhash64("run", token).alias("path"), "node"
    )
    edges = None
    for depth in range(1, MAX_DEPTH + 1):
        members = stored(_sized(parts).join(signatures, "node"), f"paths-{depth}")
        last = depth == MAX_DEPTH
        small = members if last else members.filter(F.col("n") <= LEAF)
        found = _leaves(in_blocks(small, "path", "node", "n", LEAF), similarity - MARGIN)
        found = stored(found.distinct(), f"leaves-{depth}")
        edges = found if edges is None else edges.unionByName(found)
        large = members.filter(F.col("n") > LEAF)
        if last or large.isEmpty():
            break
        parts = _split(large, 2)
    return edges


def _verified(docs: DataFrame, members: DataFrame, k: int, similarity: float) -> DataFrame:
    """(node, root, links): links of a node within a unit of work and the root it hangs on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                sets = shingle_sets(data, offsets, k)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in ("node", "root", "copies", "n")],
                    pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                ], names=["node", "root", "copies", "n", "shingles"])

    def work(arrays, start, end):
        node, copies, block, cross, packed = arrays
        order = np.argsort(node[start:end], kind="stable")
        size = end - start
        if size < 2:
            return None
        sets = [np.frombuffer(packed[start + i].as_buffer(), "<u8") for i in order.tolist()]
        node, copies, block = node[start:end][order], copies[start:end][order], block[start:end][order]
        lengths = np.array([len(s) for s in sets], np.float64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(size), [len(s) for s in sets])
        by = np.argsort(values, kind="stable")
        values, owner = values[by], owner[by]
        new = np.append(True, values[1:] != values[:-1])
        run = np.cumsum(new) - 1
        shared = np.bincount(run)[run] > 1  # shingles of one member alone are in no intersection
        owner, run = owner[shared], np.cumsum(new[shared]) - 1
        common = np.zeros((size, size), np.float32)
        width = 2048
        cuts = np.searchsorted(run, np.arange(0, (run[-1] if len(run) else 0) + width + 1, width))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                matrix = np.zeros((size, min(width, int(run[b - 1]) - i * width + 1)), np.float32)
                matrix[owner[a:b], run[a:b] - i * width] = 1
                common += matrix @ matrix.T
        union = lengths[:, None] + lengths[None, :] - common
        linked = common / union >= similarity
        np.fill_diagonal(linked, False)
        if cross[start]:
            linked &= block[:, None] != block[None, :]
        links = linked @ copies
        root = forest(linked)
        touched = np.flatnonzero((links > 0) | (root != np.arange(size)))
        if not len(touched):
            return None
        return {"node": node[touched], "root": node[root[touched]], "links": links[touched]}

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = (
        members.join(texts, "doc_id")
        .mapInArrow(read, "node long, root long, copies long, n long, shingles binary")
        .dropDuplicates(["node"])  # rows repeated with their id
    )
    units = in_blocks(sets, "root", "node", "n", LIMIT)
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    columns = ["node", "copies", "block", "cross", "shingles"]
    return (
        units.select("block_key", *columns)
        .repartition("block_key")
        .sortWithinPartitions("block_key")
        .mapInArrow(by_group(work, "block_key", columns, schema), "node long, root long, links long")
    )


def classes(
    docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: least id of its class, other rows it is linked to."""
    rows = stored(signed(docs, k), "shingles")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    nodes = stored(nodes, "nodes")
    signatures = rows.join(nodes.select("node", "doc_id"), ["node", "doc_id"]).select("node", "minima")
    signatures = stored(signatures.dropDuplicates(["node"]), "signatures")
    likely = stored(components(candidates(signatures, similarity, recall), "likely"), "likely")
    sizes = likely.groupBy("root").agg(F.count("*").alias("n"))
    members = likely.join(sizes, "root").join(nodes.withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
    found = stored(
        _verified(docs, members.select("doc_id", "node", "root", "copies", "n"), k, similarity),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    real = stored(
        components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes"),
        "classes",
    )
    least = (
        real.join(nodes, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    )
    described = (
        nodes.join(real.join(least, "root").select("node", "class_id"), "node", "left")
        .join(links, "node", "left")
        .select(
            "node",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    kind = docs.schema["doc_id"].dataType
    answer = rows.select("doc_id", "node").join(described, "node", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        F.coalesce("class_id", "doc_id").cast(kind).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    nameless = docs.filter("doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return answer.unionByName(nameless)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, the one with the least id; rows without an id all stay."""
    first, chosen = fresh(docs, "first", "chosen")
    keep = (
        classes(docs, **options).filter("doc_id = class_id").select(F.col("doc_id").alias(chosen)).distinct()
    )
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.monotonically_increasing_id())
    named = (
        docs.join(keep, F.col("doc_id") == F.col(chosen))
        .withColumn(first, F.row_number().over(order))
        .filter(F.col(first) == 1)
        .select(*docs.columns)
    )
    return named.unionByName(docs.filter("doc_id is null"))
