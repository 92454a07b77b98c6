"""Near-duplicate embeddings by NN-descent.

A neighbour graph is started from random hyperplanes: vectors of one label that fall on the same
side of all planes of a table are compared, many of them in pairs of blocks of bounded size, and
each keeps its best few.
Then it is refined: the neighbours of a node, forward and backward, are compared with each other
in the node's place (Dong et al., 2011), until outside dense groups hardly any entry is new, and
none at the threshold. A list all of whose entries
reach the threshold is saturated and may lack others: it is refined again at twice the length,
and again, up to ``LONGEST``. Besides the lists, every comparison gives a spanning forest of all its
pairs at the threshold, so none that was seen is lost to a full list. These edges are joined to
components, and within a component all vectors are compared in pairs of blocks and their links
counted. So nothing is cut off in a dense group and no list of pairs is written.

The result is audited: vectors drawn by a seeded hash are compared with all others, ``AUDIT`` at first
and twice as many again until ``LINKED`` of them have links, all vectors are drawn, or ``AUDIT_MOST``.
As long as less than ``RECALL`` of a vector's links lie within its component, on average over
those with few links or those with many, another set of tables is added. The recall and the number of
linked vectors that it rests on are columns of the result; the recall is null if that is none.

Only vectors of equal label and length are compared, by cosine in double precision. A vector that
is null, zero, or has null or non-finite components, or a null label, links with nothing: it has
no links and is its own component. Equal vectors of a label are one node and linked with each
other. Rows with a null id have null for component and kept, no links, and count for no other row.
Repeated rows are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homeward.llm.common import drawn, stored
from homeward.llm.graph import by_group, components, forest, in_blocks

SIMILARITY = 0.98
LIST = 8
LONGEST = 32
TABLES = 5
BUCKET = 64
PLANES = 30
PART = 512
BLOCK = 1024
SETTLED = 0.002
AUDIT, AUDIT_MOST, LINKED = 256, 1 << 16, 64
RECALL = 0.99
# Links this close to the threshold are not audited: rounding alone decides whether they are there.
ROUNDING = 1e-9

_EDGE = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("sim", pa.float64()), ("joined", pa.bool_())])
_EDGES = "x long, y long, sim double, joined boolean"


def _matrix(vectors: pa.Array, start: int, end: int) -> np.ndarray:
    flat = vectors.slice(start, end - start).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(end - start, -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))


def _nearest(node: np.ndarray, sim: np.ndarray, k: int, similarity: float) -> dict:
    """The best ``k`` others of each row, and ``joined`` a spanning forest of all at the threshold."""
    np.fill_diagonal(sim, -np.inf)
    sim[node[:, None] == node[None, :]] = -np.inf
    linked = sim >= similarity
    near = np.flatnonzero(linked.any(axis=1) | linked.any(axis=0))
    linked = linked[np.ix_(near, near)]
    root = forest(linked | linked.T)
    far = np.flatnonzero(root != np.arange(len(near)))
    k = min(k, len(node) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(sim, best, 1).ravel()
    kept = np.isfinite(score)
    return {
        "x": np.append(np.repeat(node, k)[kept], node[near[far]]),
        "y": np.append(node[best.ravel()][kept], node[near[root[far]]]),
        "sim": np.append(score[kept], np.ones(len(far))),
        "joined": np.repeat([False, True], [kept.sum(), len(far)]),
    }


def _compare(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges of the best ``k``, and of the forest, within each group (key, node, vector)."""

    def work(arrays, start, end):
        node, vectors = arrays
        if end - start < 2:
            return None
        x = _matrix(vectors, start, end)
        return _nearest(node[start:end], cosines(x, x), k, similarity)

    return (
        rows.select("key", "node", "vector")
        .repartition("key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(by_group(work, "key", ["node", "vector"], _EDGE), _EDGES)
    )


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each node, and every edge of the forests."""
    order = Window.partitionBy("x").orderBy("joined", F.col("sim").desc(), "y")
    return (
        edges.groupBy("x", "y", "joined")
        .agg(F.max("sim").alias("sim"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("joined") | (F.col("rank") <= k))
        .select("x", "y", "sim", "joined")
    )


def _kept(edges: DataFrame, joined: list[DataFrame]) -> DataFrame:
    """The lists of a stored result of ``_best``; its forest edges are added to ``joined``."""
    found = stored(edges, "neighbours")
    joined.append(found.filter("joined").select("x", "y"))
    return found.filter("not joined")


def _start(nodes: DataFrame, sizes: DataFrame, first_table: int, similarity: float) -> DataFrame:
    """Best neighbours within hyperplane buckets; large ones are compared in pairs of blocks.

    The number of planes follows from the number of vectors in the space (space, of).
    """
    planes_of = F.ceil(F.log2(F.col("of") / BUCKET)).cast("long")
    bits = sizes.select("space", F.greatest(F.lit(0), F.least(F.lit(PLANES), planes_of)).alias("bits"))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            node = batch.column("node").to_numpy()
            space = batch.column("space").to_numpy()
            bits = batch.column("bits").to_numpy()
            vectors = batch.column("vector")
            lengths = vectors.value_lengths().to_numpy()
            for width in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == width)
                x = _matrix(vectors.take(pa.array(rows)), 0, len(rows))
                x /= np.abs(x).max(axis=1, keepdims=True)
                for t in range(first_table, first_table + TABLES):
                    if (width, t) not in planes:
                        planes[width, t] = np.random.default_rng([width, t]).normal(size=(PLANES, width)).T
                    most = int(bits[rows].max())
                    sides = (x @ planes[width, t][:, :most] > 0) @ (1 << np.arange(most, dtype=np.int64))
                    sides &= (1 << bits[rows]) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t)), pa.array(space[rows]),
                         pa.array(sides.astype(np.int64)), pa.array(node[rows])],
                        names=["t", "space", "code", "node"],
                    )

    placed = nodes.join(bits, "space").select("node", "space", "bits", "vector").mapInArrow(
        buckets, "t long, space long, code long, node long"
    ).select(F.xxhash64("t", "space", "code").alias("bucket"), "node")
    busy = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    parts = in_blocks(placed.join(busy, "bucket"), "bucket", "node", "n", PART).select(
        F.col("block_key").alias("key"), "node"
    )
    return _compare(parts.join(nodes.select("node", "vector"), "node"), LIST, similarity)


def _refine(lists: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Compare the neighbours of each node with each other; the best ``k`` of old and new."""
    backward = (
        lists.withColumn(
            "rank",
            F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("x", "y"))),
        )
        .filter(F.col("rank") <= k)
        .select(F.col("y").alias("key"), F.col("x").alias("node"))
    )
    around = (
        lists.select(F.col("x").alias("key"), F.col("y").alias("node"))
        .unionByName(backward)
        .unionByName(lists.select(F.col("x").alias("key"), F.col("x").alias("node")))
        .distinct()
    )
    found = _compare(around.join(nodes.select("node", "vector"), "node"), k, similarity)
    return _best(found.unionByName(lists), k)


def _settled(better: DataFrame, lists: DataFrame, k: int, similarity: float) -> bool:
    """Whether hardly any entry, and none at the threshold, is new in the lists that are not saturated.

    Those of dense groups hold most entries at the threshold and would hide what others still gain.
    """
    near = F.col("sim") >= similarity
    reached = F.sum(near.cast("int")).over(Window.partitionBy("x"))
    before = lists.select("x", "y", F.lit(True).alias("known"))
    new = F.col("known").isNull()
    n, changed, gained = (
        better.withColumn("reached", reached)
        .filter(F.col("reached") < k)
        .join(before, ["x", "y"], "left")
        .agg(F.count("*"), F.count_if(new), F.count_if(new & near))
        .first()
    )
    return gained == 0 and changed <= SETTLED * n


def _descend(
    nodes: DataFrame, start: DataFrame, similarity: float, joined: list[DataFrame]
) -> DataFrame:
    """The refined neighbour graph; forests of all edges at the threshold go to ``joined``."""
    lists = _kept(_best(start, LIST), joined)
    done = False
    while not done:  # lists only get better, so they settle
        better = _kept(_refine(lists, nodes, LIST, similarity), joined)
        done = _settled(better, lists, LIST, similarity)
        lists = better
    k = LIST
    while k < LONGEST:
        full = (
            lists.filter(F.col("sim") >= similarity)
            .groupBy("x")
            .agg(F.count("*").alias("reached"))
            .filter(F.col("reached") >= k)
            .select("x")
        )
        saturated = stored(lists.join(full, "x", "left_semi"), "saturated")
        if saturated.isEmpty():
            break
        k *= 2
        longer = _refine(saturated, nodes, k, similarity)
        lists = _kept(lists.join(full, "x", "left_anti").unionByName(longer), joined)
    return lists


def _counted(members: DataFrame, similarity: float) -> DataFrame:
    """(node, root, links) within units of work of the components' rows."""

    def work(arrays, start, end):
        node, copies, block, cross, vectors = arrays
        if end - start < 2:
            return None
        node, copies, block = node[start:end], copies[start:end], block[start:end]
        x = _matrix(vectors, start, end)
        linked = cosines(x, x) >= similarity
        linked |= linked.T
        np.fill_diagonal(linked, False)
        if cross[start]:
            linked &= block[:, None] != block[None, :]
        links = linked @ copies
        root = forest(linked)
        touched = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        if not len(touched):
            return None
        return {"node": node[touched], "root": node[root[touched]], "links": links[touched]}

    columns = ["node", "copies", "block", "cross", "vector"]
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    return (
        in_blocks(members, "root", "node", "n", BLOCK)
        .select("block_key", *columns)
        .repartition("block_key")
        .sortWithinPartitions("block_key", "node")
        .mapInArrow(by_group(work, "block_key", columns, schema), "node long, root long, links long")
    )


def audited(nodes: DataFrame, roots: DataFrame, n: int, similarity: float) -> tuple[float | None, int]:
    """Recall of a sample of vectors, whose links are found by comparing it with all vectors.

    Of each sampled vector with links, the part of them that lies within its component; the mean of
    those with few links or of those with many, whichever is less. Null if none has links. Also the
    number of vectors with links.
    """
    rooted = nodes.join(roots, "node", "left").select(
        "node", "space", "vector", F.coalesce("root", "node").alias("root")
    )
    few, many = [0, 0.0], [0, 0.0]
    low, high = 0.0, AUDIT / max(1, n)
    while True:
        for links, count, total in _links_of(rooted, low, high, similarity):
            kept = few if links else many
            kept[0] += count
            kept[1] += total
        linked = few[0] + many[0]
        if linked >= LINKED or high >= min(1.0, AUDIT_MOST / max(1, n)):
            break
        low, high = high, 2 * high
    means = [total / count for count, total in (few, many) if count]
    return min(means, default=None), linked


def _links_of(rooted: DataFrame, low: float, high: float, similarity: float) -> list[tuple[bool, int, float]]:
    """(whether their links are few, vectors with links, sum of their recalls) of a range of the draw."""
    drawn_before = drawn(low, 31, "node") if low else F.lit(False)
    sample = rooted.filter(drawn(high, 31, "node") & ~drawn_before).collect()  # AUDIT_MOST at most, in about
    if not sample:
        return []
    by_space = {}
    for r in sample:
        by_space.setdefault(r.space, []).append(r)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {
            s: (np.array([r.vector for r in rows], np.float64), np.array([r.root for r in rows]),
                np.array([r.node for r in rows]))
            for s, rows in by_space.items()
        }
        for batch in batches:
            space, node, root = (batch.column(c).to_numpy() for c in ("space", "node", "root"))
            found = []
            for s in np.unique(space).tolist():
                if s not in known:
                    continue
                rows = np.flatnonzero(space == s)
                x = _matrix(batch.column("vector").take(pa.array(rows)), 0, len(rows))
                vectors, roots_known, nodes_known = known[s]
                linked = cosines(vectors, x) >= similarity + ROUNDING
                linked &= nodes_known[:, None] != node[rows][None, :]
                within = linked & (roots_known[:, None] == root[rows][None, :])
                found.append((nodes_known, linked.sum(1), within.sum(1)))
            if found:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "there", "within"])

    sums = (
        rooted.mapInArrow(look, "node long, there long, within long")
        .groupBy("node")
        .agg(F.sum("there").alias("there"), F.sum("within").alias("within"))
        .filter("there > 0")
        .groupBy((F.col("there") <= LIST).alias("few"))
        .agg(F.count("*"), F.sum(F.col("within") / F.col("there")))
        .collect()  # two rows at most
    )
    return [tuple(r) for r in sums]


def near_duplicates(
    vectors: DataFrame,
    similarity: float = SIMILARITY,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept, audit_recall, audit_linked) of every row."""
    kind = vectors.schema[id_column].dataType
    vector = F.col(vector_column)
    sound = (
        F.col(label_column).isNotNull()
        & (F.size(vector) > 0)
        & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(vector, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(label_column, vector_column)).alias("node"),
        F.xxhash64(F.lit(1), label_column, F.size(vector)).alias("space"),
        vector.alias("vector"),
    )
    nodes = stored(
        rows.filter("id is not null and node is not null")
        .groupBy("node", "space", "vector")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .dropDuplicates(["node"]),
        "vectors",
    )
    n = nodes.count()
    sizes = stored(nodes.groupBy("space").agg(F.count("*").alias("of")), "spaces")
    start, recall, joined, tables = None, None, [], 0
    while tables == 0 or (recall is not None and recall < RECALL):
        more = _start(nodes, sizes, tables * TABLES, similarity)
        start = more if start is None else lists.unionByName(more)
        lists = _descend(nodes, start, similarity, joined)
        near = lists.filter(F.col("sim") >= similarity).select("x", "y")
        edges = reduce(DataFrame.unionByName, joined, near)
        likely = stored(components(edges.toDF("a", "b"), "near"), "near")
        recall, linked = audited(nodes, likely, n, similarity)
        tables += 1
    sizes = likely.groupBy("root").agg(F.count("*").alias("n"))
    members = likely.join(sizes, "root").join(nodes.select("node", "vector", "copies"), "node")
    found = stored(_counted(members, similarity), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    real = stored(
        components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "groups"), "groups"
    )
    least = real.join(nodes, "node").groupBy("root").agg(F.min("id").alias("least"))
    described = (
        nodes.join(real.join(least, "root").select("node", "least"), "node", "left")
        .join(links, "node", "left")
        .select(
            "node",
            F.coalesce("least", "id").alias("least"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    named = F.col("id").isNotNull()
    component = F.when(named, F.coalesce("least", "id"))
    return rows.select("id", "node").join(described, "node", "left").select(
        F.col("id").cast(kind).alias(id_column),
        F.when(named, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        (F.col("id") == component).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
        F.lit(linked).cast("long").alias("audit_linked"),
    )
