"""Filter interaction audit: what each filter removes in every order, from decision diagrams.

Every document gets a mask of the filters it fails. Per part, documents are counted by mask, and a
decision diagram is built over the masks: one level per filter, an edge for documents that fail it
and one for those that pass it, and at every node the number of documents below it. Equal nodes of a
level are one node. On the path of passing edges from the root, the count behind the failing
edge of a level is what that filter removes at its step, and the count behind the passing edge is what
is kept. Two neighbouring filters are exchanged by rewriting the two levels between unchanged nodes
above and below; changing neighbours all the way (Steinhaus, Johnson, Trotter) visits all orders.

Documents are reduced before they are brought together: a row of a few numbers per document, then
rows counted by text, part and label, combined before each shuffle. A text that a third of all
documents share is therefore one row per task, and a part's diagram sees at most one row per mask.

A null text counts as empty: no words, it fails only the filter of short texts (and of repeated
ones). Rows without an id are never copies and never make others copies, as nothing is smaller than
null; rows repeated with one id are counted each, and are no copies of each other. Labels of a
document listed repeatedly count if one of them says so. A null part is the empty string. An empty
table has no parts and gives no rows. Columns that are not used may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import sums_by_text, text_slices

# Letter of each filter, by the bit of the mask.
FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = b"#$%&*|"
_COPY = 1 << FILTERS.index("E")


# ---- masks -------------------------------------------------------------------------------------


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, same): the filters that a text fails by itself, and a digest of the text."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch):
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
                split = [t.split() for t in texts]
                words = np.array([len(w) for w in split], np.int64)
                distinct = np.array([len(set(w)) for w in split], np.int64)
                upper = sums_by_text((data >= 65) & (data <= 90), offsets)
                points = sums_by_text((data & 0xC0) != 0x80, offsets)
                fails = [
                    words < MIN_WORDS,
                    100 * distinct < MIN_DISTINCT_PERCENT * words,
                    100 * upper > MAX_UPPER_PERCENT * points,
                    sums_by_text(symbol[data], offsets) > 0,
                ]
                mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("part"), pa.array(mask, pa.int32()),
                    pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                ], names=["doc_id", "part", "mask", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return docs.select("doc_id", lang, "text").mapInArrow(
        run, f"doc_id {kind}, part string, mask int, same binary"
    )


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, at most 32 rows a part."""
    flags = (
        labels.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    no = F.lit(False)
    group = ["same", "part", "mask", "good", "toxic"]
    rows = text_masks(docs).join(flags, "doc_id", "left").withColumns({
        "good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no),
    })
    # Rows by id first, so that of each text the number of rows with its smallest id is known.
    by_text = (
        rows.groupBy(*group, "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy(*group)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("unnamed"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"),
        )
    )
    smallest = by_text.groupBy("same").agg(F.min("low.doc_id").alias("smallest"))
    first = F.coalesce("unnamed", F.lit(0)) + F.when(
        F.col("low.doc_id") == F.col("smallest"), F.col("low.n")
    ).otherwise(F.lit(0))
    split = by_text.join(smallest, "same").select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), first.alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(_COPY)).alias("mask"), (F.col("n") - first).alias("n")),
        )).alias("cell"),
    ).select("part", "good", "toxic", "cell.*").filter("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


# ---- diagrams ----------------------------------------------------------------------------------


class Diagram:
    """Decision diagram of the counts by mask; level ``i`` decides filter ``order[i]``.

    A node of a level is (failing child, passing child), children being places in the next level;
    behind the last level stand the distinct counts. ``weights`` are the counts below each node.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], k: int):
        self.order = list(range(k))
        width = len(next(iter(counts.values()), (0,)))
        zero = (0,) * width
        ends: dict[tuple, int] = {}
        below = [ends.setdefault(counts.get(m, zero), len(ends)) for m in range(1 << k)]
        self.weights: list[list[tuple]] = [list(ends)]
        self.nodes: list[list[tuple[int, int]]] = []
        for level in range(k - 1, -1, -1):
            # Masks of the filters up to this one; its own bit is the highest.
            table: dict[tuple[int, int], int] = {}
            half = 1 << level
            below = [
                table.setdefault((below[m + half], below[m]), len(table)) for m in range(half)
            ]
            self._put(0, list(table))
        self.root = below[0]

    def _put(self, level: int, nodes: list[tuple[int, int]]) -> None:
        children = self.weights[level]
        self.nodes.insert(level, nodes)
        self.weights.insert(
            level, [tuple(x + y for x, y in zip(children[f], children[p])) for f, p in nodes]
        )

    def exchange(self, level: int) -> None:
        """Let the filters of ``level`` and of the level below it change places.

        The nodes of the upper level stay the same functions with the same counts, so nothing
        above changes; the lower level is built anew from what the upper one needs.
        """
        lower, table = self.nodes[level + 1], {}

        def node(fail: int, passed: int) -> int:
            return table.setdefault((fail, passed), len(table))

        upper = [
            (node(lower[f][0], lower[p][0]), node(lower[f][1], lower[p][1]))
            for f, p in self.nodes[level]
        ]
        self.nodes[level] = upper
        del self.nodes[level + 1], self.weights[level + 1]
        self._put(level + 1, list(table))
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def passing_path(self) -> Iterator[tuple[int, tuple, tuple]]:
        """(filter, removed, kept) of each step: counts behind the failing and the passing edge."""
        at = self.root
        for level, (nodes, below) in enumerate(zip(self.nodes, self.weights[1:])):
            fail, at = nodes[at]
            yield self.order[level], below[fail], below[at]


def neighbour_changes(k: int) -> Iterator[int]:
    """Places to exchange with the next one, so that all orders of ``k`` are met once."""
    if k < 2:
        return
    down = True
    # The highest element walks through each order of the others, to and fro.
    for change in [*neighbour_changes(k - 1), None]:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        if change is not None:
            yield change + 1 if down else change
        down = not down


def audit_part(part: str, counts: dict[int, tuple[int, int, int]], letters: str = FILTERS) -> list[dict]:
    """All orders and steps of one part, from (documents, good, toxic) by mask."""
    k = len(letters)
    diagram = Diagram(counts, k)
    found, removed_at = [], {}
    changes = neighbour_changes(k)
    while True:
        order = "".join(letters[i] for i in diagram.order)
        for step, (i, gone, kept) in enumerate(diagram.passing_path(), 1):
            found.append((order, step, i, gone, kept[0]))
            removed_at.setdefault((i, step), []).append(gone[0])
        change = next(changes, None)
        if change is None:
            break
        diagram.exchange(change)
    # First of all, a filter removes all that fail it; last of all, what fails nothing else.
    failing = {i: removed_at[i, 1][0] for i in range(k)}
    alone = {i: removed_at[i, k][0] for i in range(k)}
    total = {i: sum(sum(removed_at[i, s]) for s in range(1, k + 1)) for i in range(k)}
    return [
        {
            "part": part, "filter_order": order, "step": step, "kept": kept, "removed": gone[0],
            "redundant": failing[i] - gone[0], "unique_fails": alone[i], "good_lost": gone[1],
            "toxic_lost": gone[2], "shapley": total[i],
        }
        for order, step, i, gone, kept in found
    ]


_ROW = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def audit(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``mask_counts`` (or the like).

    Bit ``i`` of a mask belongs to letter ``i``. Orders are the factorial of the number of filters.
    """
    if math.factorial(len(letters)) > 50_000:
        raise ValueError("too many filters to list all their orders")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cells = {
            int(m): (int(n), int(g), int(t))
            for m, n, g, t in zip(group["mask"], group["n"], group["good"], group["toxic"])
        }
        return pd.DataFrame(audit_part(group["part"].iloc[0], cells, letters))

    return counts.groupBy("part").applyInPandas(run, _ROW)
