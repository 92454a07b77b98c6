"""Quality classifier: vectors of hashed words and character n-grams, averaged per document.

Every word and every run of three or four bytes within a word (with its edge) is hashed to a
row of an embedding table; pairs of neighbouring words have two rows of their own, for equal
and for different ones. A document is the average of its rows, a softmax layer on top gives
the probability of each label. Embeddings and layer are learned together by stochastic gradient
descent in numpy, from about ``TRAIN_DOCS`` documents of each label at most, drawn by a seeded hash.
A sample document goes to the driver as counts of hashed features, never more than the table
has rows, so its size is bounded too; documents to score stay in their tasks.

Because the layer is linear, the layer's output of an average is the average of its outputs,
so scoring looks up one number per feature. Texts are scored whole. Null and empty texts have no
features and get the score of the layer's bias. With labels of one kind only, or none, every
score is that kind's share (one half without labels). A document labelled repeatedly counts
once, with its lowest label; null ids and null labels are not learned from. Of rows with one id the
least text is learned from; all are scored. Columns beside id and text may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import (
    byte_grams, mixed, span_hashes, stratified, sums_by_text, text_slices, word_spans,
)

TRAIN_DOCS = 1_500
WORD_ROWS = CHAR_ROWS = 1 << 15
# Two rows for neighbouring words that differ, or are the same.
SAME_WORD = WORD_ROWS + CHAR_ROWS
ROWS = SAME_WORD + 2
GRAMS = (3, 4)
DIM = 16
EPOCHS = 12
RATE = 30.0
_SLICE = 512 << 10


class Model(NamedTuple):
    """Difference of the two classes' logits: per feature row, and the bias."""

    rows: np.ndarray
    bias: float


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature rows, which count, cuts between texts) for words and for each length of runs."""
    starts, ends, first = word_spans(data, offsets)
    hashed = span_hashes(data, starts, ends)
    yield (hashed % np.uint64(WORD_ROWS)).astype(np.int64), np.ones(len(hashed), bool), first
    again = np.append(False, hashed[1:] == hashed[:-1]) if len(hashed) else np.zeros(0, bool)
    follows = np.ones(len(hashed), bool)
    follows[first[:-1][first[:-1] < len(hashed)]] = False  # a text's first word follows none
    yield SAME_WORD + again.astype(np.int64), follows, first
    blanked = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
    for n in GRAMS:
        codes, valid = byte_grams(blanked, offsets, n)
        rows = (mixed(codes) % np.uint64(CHAR_ROWS)).astype(np.int64) + WORD_ROWS
        yield rows, valid, offsets


def _sample(docs: DataFrame, labels: DataFrame) -> list:
    """Feature counts and label of each training document."""
    schema = "doc_id long, label int, rows binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                keys = []
                for rows, valid, cuts in _features(data, offsets):
                    owner = np.repeat(np.arange(end - start), np.diff(cuts))
                    keys.append((owner * ROWS + rows)[valid])
                keys, counts = np.unique(np.concatenate(keys), return_counts=True)
                cuts = np.searchsorted(keys, np.arange(end - start + 1) * ROWS)
                rows = (keys % ROWS).astype("<i4")
                counts = counts.astype("<i4")
                part = batch.slice(start, end - start)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("label"),
                    pa.array([rows[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
                ], names=["doc_id", "label", "rows", "counts"])

    # At most about TRAIN_DOCS ids of each label, and one row of each of them.
    picked = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = picked.mapInArrow(run, schema).collect()
    return sorted(found, key=lambda r: (r.doc_id, r.label, r.rows))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 1) -> Model:
    """Learn from ``labels`` (doc_id, label 0 or 1)."""
    clean = (
        labels.filter("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
    )
    sample = _sample(docs, stratified(clean, "label", train_docs, 13, "doc_id"))
    rng = np.random.default_rng(seed)
    target = np.array([r.label for r in sample])
    if len(set(target.tolist())) < 2:
        good = target.mean() if len(target) else 0.5
        odds = np.log((good * len(target) + 1e-9) / ((1 - good) * len(target) + 1e-9)) if len(target) else 0.0
        return Model(np.zeros(ROWS, np.float32), float(np.clip(odds, -20, 20)))
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.log(np.bincount(target, minlength=2) / len(target))
    features = []
    for r in sample:
        counts = np.frombuffer(r.counts, "<i4").astype(np.float64)
        features.append((np.frombuffer(r.rows, "<i4"), counts / max(counts.sum(), 1)))
    done, steps = 0, EPOCHS * len(sample)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sample)):
            rate = RATE * (1 - done / steps)
            done += 1
            rows, share = features[i]
            hidden = share @ embedding[rows]
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[target[i]] -= 1
            back = layer @ error
            layer -= 0.1 * rate * np.outer(hidden, error)
            bias -= 0.01 * rate * error
            embedding[rows] -= rate * share[:, None] * back
    return Model(
        (embedding @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability of label 1 for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                sums, counts = np.zeros(end - start), np.zeros(end - start)
                for rows, valid, cuts in _features(data, offsets):
                    sums += sums_by_text(np.where(valid, model.rows[rows], 0).astype(np.float64), cuts)
                    counts += sums_by_text(valid, cuts)
                logit = sums / np.maximum(counts, 1) + model.bias
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(start, end - start).column("doc_id"), pa.array(1 / (1 + np.exp(-logit)))],
                    names=["doc_id", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    )


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; folds for held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
