"""Removal of word sequences that stand in an earlier document, found with a count-min prefilter.

A window is ``n`` consecutive words of one document. Its key is the least hash among its runs of
``GRAM`` words, so equal windows have equal keys and neighbouring windows mostly share theirs.

Pass one: every task sketches the keys of its windows (once per stretch of windows with the same
key), the sketches of all tasks are added up cell by cell, and cells with two or more are marked.
A count-min sketch never underestimates, so a window that stands twice has marked cells in every
row of the sketch. Pass two computes exact hashes only for windows with marked cells. Within a
task all but the lowest document of a window are decided at once, so a window that is in a third
of all documents reaches the exact grouping as one document per task; there the smallest
document id of each window is found. Pass three takes the covered words out.

The sketch has ``CELLS_PER_KEY`` cells for each expected key, twice, whatever the size of the corpus, so
the share of unrepeated windows that pass it stays the same. Up to ``SHIPPED_CELLS`` (64 MB in all,
about 8 GB of text) the marked cells go to every task as one bit each. Larger sketches stay where
they are merged: their marked cells are rows, spread by hash, and the stretches' cells are joined to
them, with one row per stretch instead of one per window; a cell that very many stretches share is a
hot key of a plain semi join, which adaptive execution splits.

Windows of one and the same document, or of rows with the same id, do not remove each other. Ids
are expected to name a text: rows repeated with id and text are treated alike. Null ids neither
remove nor lose words; null texts have no words. Windows are compared by two 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homeward.llm.common import fresh, mixed, span_hashes, stored, text_slices, windows, word_spans

N = 50
GRAM = 10
DEPTH = 2
CELLS_PER_KEY = 8
SHIPPED_CELLS = 1 << 28
CHUNK = 1 << 20
_SLICE = 1 << 20
_FLUSH = 1_000_000
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _keys(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, text, key) of all windows of the texts."""
    starts, owner = windows(first, n)
    if not len(starts):
        return starts, owner, np.zeros(0, np.uint64)
    places = np.arange(len(hashes) - GRAM + 1)
    grams = span_hashes(hashes, places, places + GRAM)
    return starts, owner, _sliding_min(grams, n - GRAM + 1)[starts]


def _stretches(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where a text's windows change their key."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))


def _cells(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(keys ^ _SALTS[row]) & np.uint64(cells - 1)).astype(np.int64)


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def sketch(docs: DataFrame, n: int, cells: int) -> np.ndarray:
    """Bits of the cells that two or more keys share, one row of bits per row of the sketch."""
    chunk = min(CHUNK, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, limit=_SLICE):
                _, owner, keys = _keys(*_hashed(data, offsets), n)
                found.append(keys[_stretches(owner, keys)])
        keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
        for row in range(DEPTH):
            at, counts = np.unique(_cells(keys, row, cells), return_counts=True)
            counts = np.minimum(counts, 2).astype(np.uint8)
            cuts = np.searchsorted(at, np.arange(0, cells + 1, chunk))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[i], cuts[i + 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row], pa.int32()), pa.array([i], pa.int32()),
                    pa.array([(at[a:b] - i * chunk).astype("<i4").tobytes()], pa.binary()),
                    pa.array([counts[a:b].tobytes()], pa.binary()),
                ], names=["row", "chunk", "cells", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add up sorted parts one after the other; holds one chunk however many tasks there are."""

        def marked(place: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
            bits = np.packbits(total >= 2, bitorder="little").tobytes()
            columns = [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([bits])], names=["row", "chunk", "bits"])

        place, total = None, np.zeros(chunk, np.uint8)
        for batch in batches:
            keys = zip(batch.column("row").to_pylist(), batch.column("chunk").to_pylist())
            for key, at, counts in zip(keys, batch.column("cells"), batch.column("counts")):
                if key != place:
                    if place is not None:
                        yield marked(place, total)
                    place, total = key, np.zeros(chunk, np.uint8)
                at = np.frombuffer(at.as_buffer(), "<i4")
                # Two is as good as more.
                total[at] = np.minimum(total[at] + np.frombuffer(counts.as_buffer(), np.uint8), 2)
        if place is not None:
            yield marked(place, total)

    merged = (
        docs.select("text")
        .mapInArrow(count, "row int, chunk int, cells binary, counts binary")
        .repartition("row", "chunk")
        .sortWithinPartitions("row", "chunk")
        .mapInArrow(merge, "row int, chunk int, bits binary")
        .collect()  # the marked cells: at most two bits for each of SHIPPED_CELLS
    )
    marked = np.zeros((DEPTH, cells // 8 if cells >= 8 else 1), np.uint8)
    for part in merged:
        bits = np.frombuffer(part.bits, np.uint8)
        marked[part.row, part.chunk * len(bits) : (part.chunk + 1) * len(bits)] = bits
    return marked


def _likely_apart(known: DataFrame, n: int, cells: int) -> DataFrame:
    """(doc_id, likely): stretches whose cells are marked, by joins with a sketch that stays apart."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                _, owner, keys = _keys(*_hashed(data, offsets), n)
                begins = _stretches(owner, keys)
                ids = batch.column("doc_id").slice(start, end - start).to_numpy()
                number = np.arange(len(begins)) - np.searchsorted(owner[begins], owner[begins])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner[begins]]), pa.array(number.astype(np.int64)),
                     *[pa.array(_cells(keys[begins], row, cells)) for row in range(DEPTH)]],
                    names=["doc_id", "stretch", *[f"cell{row}" for row in range(DEPTH)]],
                )

    schema = "doc_id long, stretch long, " + ", ".join(f"cell{row} long" for row in range(DEPTH))
    found = stored(known.mapInArrow(stretches, schema), "repeats-stretches")
    likely = found
    for row in range(DEPTH):
        # One row per task for a cell that is everywhere: counted before the exchange.
        marked = found.groupBy(f"cell{row}").count().filter("count > 1").select(f"cell{row}")
        likely = likely.join(marked, f"cell{row}", "left_semi")
    return likely.groupBy("doc_id").agg(F.collect_set("stretch").alias("likely"))


def _settle(text_ids: np.ndarray, places: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]):
    """Split windows into open ones (of the lowest text of each hash) and runs already decided."""
    order = np.lexsort((text_ids, hashes[1], hashes[0]))
    text_ids, places, a, b = text_ids[order], places[order], hashes[0][order], hashes[1][order]
    head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    lowest = text_ids[head][np.cumsum(head) - 1]
    lost = text_ids > lowest
    again = np.lexsort((places[lost], text_ids[lost]))
    ids, at = text_ids[lost][again], places[lost][again]
    begins = np.flatnonzero(
        np.append(True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + 1))
    ) if len(ids) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(begins, len(ids)))
    return (a[~lost], b[~lost], text_ids[~lost], places[~lost]), (ids[begins], at[begins], lengths)


def repeats(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, runs): runs of windows (place, number) that start in an earlier document, too."""
    known = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Words are some six bytes long; a key lasts for about half of the grams in a window.
    expected = max(1, size // 6 * 2 // (n - GRAM + 2))
    cells = 1 << max(10, math.ceil(math.log2(expected * CELLS_PER_KEY)))
    if cells <= SHIPPED_CELLS:
        marked = known.sparkSession.sparkContext.broadcast(sketch(known, n, cells))
    else:
        marked = None
        known = known.join(_likely_apart(known, n, cells), "doc_id")

    def estimated(batch: pa.RecordBatch, owner: np.ndarray, keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether each stretch may stand twice."""
        if marked is None:
            owners = owner[begins]
            number = np.arange(len(begins)) - np.searchsorted(owners, owners)
            listed = batch.column("likely")
            counts = np.bincount(owners, minlength=batch.num_rows)
            ends = np.cumsum(counts)
            likely = np.zeros(len(begins), bool)
            for i in np.flatnonzero(counts).tolist():
                own = slice(int(ends[i] - counts[i]), int(ends[i]))
                likely[own] = np.isin(number[own], listed[i].values.to_numpy())
            return likely
        likely, bits = np.ones(len(begins), bool), marked.value
        for row in range(DEPTH):
            at = _cells(keys[begins], row, cells)
            likely &= (bits[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return likely

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                hashes, first = _hashed(data, offsets)
                places, owner, keys = _keys(hashes, first, n)
                begins = _stretches(owner, keys)
                likely = estimated(batch.slice(start, end - start), owner, keys, begins)
                likely = np.repeat(likely, np.diff(np.append(begins, len(keys))))
                places, owner = places[likely], owner[likely]
                ids = batch.column("doc_id").slice(start, end - start).to_numpy()
                exact = [span_hashes(hashes, places, places + n, seed=s).view(np.int64) for s in (1, 2)]
                waiting.append((ids[owner], places - first[:-1][owner], *exact))
                held += len(places)
                if held >= _FLUSH:
                    yield from _rows(*map(np.concatenate, zip(*waiting)))
                    waiting, held = [], 0
        if held:
            yield from _rows(*map(np.concatenate, zip(*waiting)))

    found = known.mapInArrow(
        candidates, "hash long, more long, doc_id long, place int, number int, decided boolean"
    )
    earliest = F.min(F.when(~F.col("decided"), F.col("doc_id"))).over(Window.partitionBy("hash", "more"))
    return (
        found.withColumn("earliest", earliest)
        .filter(F.col("decided") | (F.col("earliest") < F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("place", "number")).alias("runs"))
    )


def _rows(
    ids: np.ndarray, places: np.ndarray, hashes: np.ndarray, more: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Open windows by hash; decided runs under a hash of their own, which spreads them."""
    (open_hash, open_more, open_id, open_at), (done_id, done_at, number) = _settle(ids, places, (hashes, more))
    own = mixed(done_id.astype(np.uint64) * np.uint64(1 << 20) + done_at.astype(np.uint64))
    columns = [
        np.concatenate([open_hash, own.view(np.int64)]),
        np.concatenate([open_more, np.zeros(len(done_id), np.int64)]),
        np.concatenate([open_id, done_id]),
        np.concatenate([open_at, done_at]).astype(np.int32),
        np.concatenate([np.ones(len(open_id), np.int64), number]).astype(np.int32),
        np.concatenate([np.zeros(len(open_id), bool), np.ones(len(done_id), bool)]),
    ]
    names = ["hash", "more", "doc_id", "place", "number", "decided"]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
    for first in range(0, whole.num_rows, 20_000):
        yield whole.slice(first, 20_000)


def without_repeats(docs: DataFrame, n: int = N, out: str = "kept") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one blank."""
    (runs,) = fresh(docs, "runs")
    found = repeats(docs, n).withColumnRenamed("runs", runs)
    joined = docs.select("doc_id", "text").join(found, "doc_id", "left").select(
        "doc_id", "text", F.col(f"{runs}.place").alias("place"), F.col(f"{runs}.number").alias("number")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                counts, removed, kept = [], [], []
                texts = batch.column("text").cast(pa.large_binary())
                for text, place, number in zip(texts, batch.column("place"), batch.column("number")):
                    # The blanks that split bytes are those of the words' definition.
                    found = text.as_py().split() if text.is_valid else []
                    counts.append(len(found))
                    if place.is_valid:
                        at = place.values.to_numpy(zero_copy_only=False)
                        change = np.zeros(len(found) + 1, np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + number.values.to_numpy(zero_copy_only=False) + n - 1, -1)
                        covered = np.cumsum(change)[:-1] > 0
                        removed.append(int(covered.sum()))
                        found = [found[i] for i in np.flatnonzero(~covered).tolist()]
                    else:
                        removed.append(0)
                    kept.append(b" ".join(found))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ], names=["doc_id", "n_words", "n_removed", out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, {out} string")
