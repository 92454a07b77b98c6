"""Language identification with bit-sliced Bloom filters of byte n-grams.

Each language has a Bloom filter of the n-grams typical of it. The filters of up to 64 languages
lie side by side, one bit of a word each, so one look-up per hash function and a bitwise AND give
the mask of all languages that contain an n-gram. The set bits of a document's masks are counted
per language, the count that false positives alone would give is taken off, and the language
with the largest corrected share of n-grams wins (ties: the first by name).

Learned from about ``TRAIN_DOCS`` documents of each language at most, drawn by a seeded hash, so that a
rare language is learned at any size of the table: an n-gram is typical of a language if it makes up ``MIN_SHARE`` of its n-grams (hence 1 / ``MIN_SHARE`` n-grams a
language at most, the bound of what is collected) and ``RELATIVE`` of its share in the language
where it is most frequent. Texts are read whole: runs of two to four bytes of letters, ASCII in
lower case, with word edges. A null text, or one without a letter, is ``und`` with score zero, and
so is every text if there is nothing to learn from. Repeated rows are learned from and judged like
others; columns beside the three that are read may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homeward.llm.common import byte_grams, mixed, stored, stratified, sums_by_text, text_slices

TRAIN_DOCS = 5_000
GRAMS = (2, 3, 4)
MIN_SHARE = 1e-5
RELATIVE = 0.2
CELLS = 1 << 20
HASHES = 3
UNKNOWN = "und"
_SLICE = 512 << 10


class Filters(NamedTuple):
    names: list[str]
    cells: np.ndarray  # (languages / 64, cells) words of 64 bits
    false_rate: np.ndarray  # per language


def _letters(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, bytes of other characters as they are, the rest blank."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table[data]


def _places(codes: np.ndarray) -> Iterator[np.ndarray]:
    hashed = mixed(codes)
    for i in range(HASHES):
        yield ((hashed >> np.uint64(20 * i)) & np.uint64(CELLS - 1)).astype(np.int64)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from (doc_id, text, lang); rows with null in any of them are left out."""
    known = docs.filter("doc_id is not null and text is not null and lang is not null")
    sample = stratified(known.select("doc_id", "text", "lang"), "lang", train_docs, 7, "doc_id").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                data = _letters(data)
                names = batch.slice(start, end - start).column("lang").to_pylist()
                found = defaultdict(list)
                for n in GRAMS:
                    codes, valid = byte_grams(data, offsets, n)
                    for name, a, b in zip(names, offsets, offsets[1:]):
                        found[name].append(codes[a:b][valid[a:b]])
                for name, codes in found.items():
                    codes, counts = np.unique(np.concatenate(codes).view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                        names=["lang", "gram", "n"],
                    )

    counted = stored(
        sample.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n")),
        "language-grams",
    )
    totals = {r.lang: r.total for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    names = sorted(totals)
    if not names:
        return Filters([], np.zeros((0, 1), np.uint64), np.zeros(0))
    share = F.lit(None).cast("double")
    for name, total in totals.items():
        share = F.when(F.col("lang") == name, F.col("n") / F.lit(float(total))).otherwise(share)
    most = F.max("share").over(Window.partitionBy("gram"))
    typical = (
        counted.withColumn("share", share)
        .filter(F.col("share") >= MIN_SHARE)
        .withColumn("most", most)
        .filter(F.col("share") >= RELATIVE * F.col("most"))
        .select("lang", "gram")
        .toArrow()
    )
    index = {name: i for i, name in enumerate(names)}
    cells = np.zeros(((len(names) + 63) // 64, CELLS), np.uint64)
    false_rate = np.zeros(len(names))
    langs, grams = typical.column("lang").combine_chunks(), typical.column("gram").to_numpy()
    for name in names:
        own = grams[pc.equal(langs, name).to_numpy(zero_copy_only=False)].view(np.uint64)
        word, bit = divmod(index[name], 64)
        for at in _places(own):
            np.bitwise_or.at(cells[word], at, np.uint64(1) << np.uint64(bit))
        filled = np.count_nonzero(cells[word] & (np.uint64(1) << np.uint64(bit))) / CELLS
        false_rate[index[name]] = filled**HASHES
    return Filters(names, cells, false_rate)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; the score is the winner's part of all shares."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cells, false_rate = shared.value
        for batch in batches:
            for start, end, data, offsets in text_slices(batch, limit=_SLICE):
                data = _letters(data)
                hits, n_grams = np.zeros((len(names), end - start)), np.zeros(end - start)
                for n in GRAMS:
                    codes, valid = byte_grams(data, offsets, n)
                    cuts = np.append(0, np.cumsum(valid))[offsets]
                    n_grams += np.diff(cuts)
                    at = list(_places(codes[valid]))
                    for word in range(len(cells)):
                        mask = cells[word][at[0]]
                        for places in at[1:]:
                            mask &= cells[word][places]
                        for bit in range(min(64, len(names) - 64 * word)):
                            set_bits = (mask >> np.uint64(bit)).astype(np.uint8) & 1
                            hits[64 * word + bit] += sums_by_text(set_bits, cuts)
                rows = batch.slice(start, end - start)
                rate = false_rate[:, None]
                share = np.maximum((hits / np.maximum(n_grams, 1) - rate) / (1 - rate), 0)
                wordy = rows.column("wordy").to_numpy(zero_copy_only=False).astype(bool)
                if names:
                    best = share.argmax(0)
                    score = share.max(0) / np.maximum(share.sum(0), 1e-12)
                    found = np.where(wordy, np.array(names, object)[best], UNKNOWN)
                    score = np.where(wordy, score, 0.0)
                else:
                    found, score = np.full(end - start, UNKNOWN, object), np.zeros(end - start)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(found.tolist(), pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"],
                )

    wordy = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", wordy.alias("wordy")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    )
