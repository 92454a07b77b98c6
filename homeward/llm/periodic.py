"""Periodic runs of words, found online by sparse diagonals, and texts with their repeats taken out.

A run is a stretch of words with smallest period ``q`` and a length of at least ``min_length`` and
``min_exponent`` periods that no neighbouring word extends. On the diagonal of lag ``q``, a word matches
when the word ``q`` places before it is the same; a run is a stretch of matches on its diagonal.

The words are gone through in order. The latest earlier occurrence of what starts at a word
lengthens the match of that lag's diagonal by one or opens it; a diagonal that a word does not
lengthen has ended, and emits its run at once if it is long enough. What is looked up is not the
single word but the ``g`` words that start at it, for ``g`` in powers of two, each scale having the
lags from ``g / 2`` (excluded; the first scale from nothing) to ``g``:

* Within a run of period ``q <= g < 2 q`` the ``g`` words at a place contain a whole period. They
  cannot stand less than ``q`` places earlier in the run, as a period is no power of a shorter
  word, so their latest earlier occurrence has lag ``q`` at every place of the run from its second
  period on. The diagonals are therefore complete, and lags that are multiples of ``q`` or not the
  smallest period are never opened.
* Most runs of eight words stand once in a text. Only places whose words stand again go to the next
  scale, so a text takes about as much time as it has words, times the logarithm at worst.

Groups of words are compared by two 64-bit hashes, and each run is checked against the words before
it is emitted. Texts are searched whole; a text with null or no words has no runs. Rows are judged
one by one, so repeated rows give equal results, ids may be null, and an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from homeward.llm.common import fresh, mixed, span_hashes, text_slices, windows, word_spans

MIN_LENGTH = 24
MIN_EXPONENT = 3
_SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _again(lanes: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at``: those whose words stand twice or more, and the lag to the latest earlier one.

    The lag is zero where there is no earlier one. Both come in order of places.
    """
    quick = np.argsort(lanes[0][at])
    ordered = lanes[0][at][quick]
    same = ordered[1:] == ordered[:-1]
    at = at[quick[np.append(same, False) | np.append(False, same)]] if len(at) else at
    order = np.lexsort((at, lanes[1][at], lanes[0][at]))
    at = at[order]
    a, b = lanes[0][at], lanes[1][at]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    lag = np.zeros(len(at), np.int64)
    lag[1:][same] = np.diff(at)[same]
    shared = np.append(same, False) | np.append(False, same) if len(at) else np.zeros(0, bool)
    at, lag = at[shared], lag[shared]
    order = np.argsort(at)
    return at[order], lag[order]


def _occurrences(
    hashes: tuple[np.ndarray, np.ndarray], first: np.ndarray, least: int, exponent: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each scale ``g``: (g, places, lags), lags of the scale's range only."""
    n, longest = len(hashes[0]), int(np.diff(first).max(initial=0))
    g = 1
    while 4 * g <= least:  # a run holds g words and a lag of up to g before them
        g *= 2
    at, owner = windows(first, g)
    lanes = (np.zeros(n, np.uint64), np.zeros(n, np.uint64))
    for lane, (words, out) in enumerate(zip(hashes, lanes)):
        # Equal words of different texts are kept apart.
        out[at] = mixed(span_hashes(words, at, at + g, seed=lane) + owner.astype(np.uint64) * _ODD)
    end = np.zeros(n, np.int64)
    end[at] = first[1:][owner]
    low = 0
    while len(at) and (low + 1) * exponent <= longest:
        at, lag = _again(lanes, at)
        near = (lag > low) & (lag <= g)
        yield g, at[near], lag[near]
        alive = np.zeros(n + 1, bool)
        alive[at] = True
        fits = at + 2 * g <= end[at]
        at = at[fits][alive[at[fits] + g]]
        for lane in lanes:
            lane[at] = mixed(lane[at] * _ODD + mixed(lane[at + g] + np.uint64(g)))
        low, g = g, 2 * g


def _diagonals(
    found: list[tuple[int, np.ndarray, np.ndarray]], least: int, exponent: int
) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the stretches on the diagonals, places in order."""
    place = np.concatenate([p for _, p, _ in found])
    lags = np.concatenate([l for _, _, l in found])
    scale = np.concatenate([np.full(len(p), g) for g, p, _ in found])
    order = np.argsort(place, kind="stable")
    active: dict[int, tuple[int, int]] = {}  # lag: first place of its match, scale
    last = None
    lengthened: dict[int, tuple[int, int]] = {}

    def ended(until: int) -> Iterator[tuple[int, int, int]]:
        """Diagonals with their last match at place ``until`` that are not lengthened there."""
        for lag, (begin, g) in active.items():
            if lag not in lengthened:
                length = lag + until - begin + g
                if length >= max(least, exponent * lag):
                    yield begin - lag, length, lag

    for at, lag, g in zip(place[order].tolist(), lags[order].tolist(), scale[order].tolist()):
        if at != last:
            if last is not None:
                yield from ended(last - 1)
                active = lengthened
                lengthened = {}
                if at != last + 1:
                    yield from ended(last)
                    active = {}
            last = at
        lengthened[lag] = active.get(lag, (at, g))
    if last is not None:
        yield from ended(last - 1)
        active, lengthened = lengthened, {}
        yield from ended(last)


def find_runs(
    data: np.ndarray, offsets: np.ndarray, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT
) -> list[list[tuple[int, int, int]]]:
    """Runs (start word, length, period) of each text of the slice, by start, then period."""
    starts, ends, first = word_spans(data, offsets)
    hashes = (span_hashes(data, starts, ends), span_hashes(data, starts, ends, seed=1))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in offsets[1:]]
    found = [f for f in _occurrences(hashes, first, least, exponent) if len(f[1])]
    if found:
        for start, length, period in _diagonals(found, least, exponent):
            text = int(np.searchsorted(first, start, "right")) - 1
            whole = slice(start + period, start + length), slice(start, start + length - period)
            if all((h[whole[0]] == h[whole[1]]).all() for h in hashes):
                runs[text].append((start - int(first[text]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, without those that a run has after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = compress(words, (np.cumsum(change)[:-1] == 0).tolist())
    return b" ".join(words)


def periodic(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, out: str = "periodic"
) -> DataFrame:
    """Add struct (n_words, runs, collapsed) as the last column, to every row.

    It is named ``out``, with underscores in front if ``docs`` has such a column in any case.
    ``min_exponent`` is at least three; ``min_length`` at least four.
    """
    if min_exponent < 3 or min_length < 4:
        raise ValueError("a run has at least three periods and four words")
    (out,) = fresh(docs, out)
    runs_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("runs", runs_type),
        T.StructField("collapsed", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, limit=_SLICE):
                found = find_runs(data, offsets, min_length, min_exponent)
                raw, cuts = data.tobytes(), offsets.tolist()
                # The blanks that split bytes are those of the words' definition.
                words = [raw[i:j].split() for i, j in zip(cuts, cuts[1:])]
                struct = pa.StructArray.from_arrays(
                    [
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in found], RUNS),
                        pa.array([collapsed(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string()),
                    ],
                    names=["n_words", "runs", "collapsed"],
                )
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, added)]))
