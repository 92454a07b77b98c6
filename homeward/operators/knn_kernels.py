"""Matrix arithmetic that the nearest-neighbour join runs inside its tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores are rounded to this many decimals before they are compared.
SCORE_DIGITS = 9

# A cell is kept when its best possible cosine is this close below the cut; covers the
# rounding of scores and of angles.
SLACK = 1e-6


# Pairs scored in double precision at a time, and pairs returned at a time.
_EXACT_ROWS = 16_384
_OUTPUT_ROWS = 20_000

# Elements of a matrix of rows and cells at a time.
_MATRIX = 1 << 20


def _array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Row-normalised float64 matrix of a list column; zero vectors stay zero."""
    vectors = _array(vectors)
    if not len(vectors):
        return np.empty((0, 1))
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(len(vectors), -1)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(length == 0, 1.0, length)[:, None]


def id_order(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Position of every id in ascending id order; equal ids share one."""
    return pc.rank(_array(ids), tiebreaker="dense").to_numpy()


class Side(NamedTuple):
    """One side of the join, prepared once per task: rows, unit vectors, id order."""

    table: pa.Table
    unit: np.ndarray
    rough: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Side:
        unit = unit_rows(table["vector"])
        return cls(table, unit, unit.astype(np.float32), id_order(table["id"]))


def first_of_group(group: np.ndarray, ranked: np.ndarray, k: int) -> np.ndarray:
    """First k of every group of an order ``ranked`` that keeps groups together."""
    if not len(ranked):
        return ranked
    by_group = group[ranked]
    position = np.arange(len(ranked))
    starts = np.r_[True, by_group[1:] != by_group[:-1]]
    first = np.maximum.accumulate(np.where(starts, position, 0))
    return ranked[position - first < k]


def best_of_group(
    group: np.ndarray, score: np.ndarray, order: np.ndarray, k: int
) -> np.ndarray:
    """Indices of the k best entries of every group: highest score, then lowest order."""
    return first_of_group(group, np.lexsort((order, -score, group)), k)


def without_spare_copies(side: Side, k: int) -> Side:
    """Keep the k lowest ids of every group of identical vectors; no more of them can be used.

    Copies score the same against every query, so beyond k of them ids decide.
    """
    if len(side.unit) <= k:
        return side
    # Cheap test first: identical vectors have identical hashes.
    bits = np.ascontiguousarray(side.unit).view(np.uint64)
    odd = np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(2_654_435_762) + np.uint64(1)
    if np.unique((bits * odd).sum(axis=1), return_counts=True)[1].max() <= k:
        return side
    whole_rows = np.ascontiguousarray(side.unit).view(
        np.dtype((np.void, side.unit.dtype.itemsize * side.unit.shape[1]))
    )
    _, group, size = np.unique(whole_rows.ravel(), return_inverse=True, return_counts=True)
    if size.max() <= k:
        return side
    keep = np.sort(best_of_group(group, np.zeros(len(group)), side.order, k))
    return Side(
        side.table.take(pa.array(keep)), side.unit[keep], side.rough[keep], side.order[keep]
    )


def exact_scores(queries: np.ndarray, base: np.ndarray, q: np.ndarray, b: np.ndarray):
    """Rounded cosines of listed pairs, a bounded number at a time."""
    scores = np.empty(len(q))
    for start in range(0, len(q), _EXACT_ROWS):
        part = slice(start, start + _EXACT_ROWS)
        scores[part] = np.einsum("ij,ij->i", queries[q[part]], base[b[part]])
    return np.round(scores, SCORE_DIGITS)


def _tile_pairs(
    queries: Side, base: Side, rows: slice, part: slice, k: int, low: np.ndarray, allowed
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one tile that can be among the k best: (row in tile, base row, exact score).

    A single-precision product picks them, allowing for its rounding; double precision scores
    them. ``low`` is the score each query has to reach.
    """
    rough = queries.rough[rows] @ base.rough[part].T
    margin = np.float32(queries.unit.shape[1] * 1.2e-7 + 1e-6)
    if allowed is not None:
        rough[~allowed(rows, part)] = -np.inf
    cut = low.astype(np.float32) - margin
    passing = rough >= cut[:, None]
    width = rough.shape[1]
    crowded = np.flatnonzero(np.count_nonzero(passing, axis=1) > k)
    if len(crowded):
        some = rough[crowded]
        kth = np.partition(some, width - k, axis=1)[:, width - k] - 2 * margin
        passing[crowded] = some >= np.maximum(cut[crowded], kth)[:, None]
    q, b = np.divmod(np.flatnonzero(passing), width)
    score = exact_scores(queries.unit[rows], base.unit[part], q, b)
    enough = score >= low[q]
    return q[enough], b[enough] + part.start, score[enough]


def top_pairs(
    queries: Side,
    base: Side,
    k: int,
    threshold: float,
    tile: tuple[int, int],
    allowed: Callable[[slice, slice], np.ndarray] | None = None,
    floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, score) of each query's k best base rows at or above the threshold.

    Works through tiles of (query rows, base rows) that fit a processor cache; the k-th best
    score so far is what the next tile has to reach. ``floor`` are such scores to begin with.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for start in range(0, len(queries.unit), tile[0]):
        rows = slice(start, start + tile[0])
        low = np.full(len(queries.unit[rows]), threshold) if floor is None else floor[rows].copy()
        q, b, score = found[0]
        for first in range(0, len(base.unit), tile[1]):
            part = slice(first, first + tile[1])
            new = _tile_pairs(queries, base, rows, part, k, low, allowed)
            if not len(new[0]):
                continue
            q, b, score = np.r_[q, new[0]], np.r_[b, new[1]], np.r_[score, new[2]]
            keep = best_of_group(q, score, base.order[b], k)
            q, b, score = q[keep], b[keep], score[keep]
            raise_to_kth(low, q, score, k)
        found.append((q + start, b, score))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def raise_to_kth(low: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """Set ``low`` of every query that has k pairs (grouped, best first) to its last score."""
    full = np.flatnonzero(np.bincount(query, minlength=len(low)) >= k)
    low[full] = score[np.searchsorted(query, full, side="right") - 1]


def wanted_mask(queries: pa.Table, base: pa.Table) -> Callable[[slice, slice], np.ndarray]:
    """Per-query prefilter: equal gender where one is wanted, inclusive age range where given."""

    def numbers(rows: pa.Array, name: str) -> np.ndarray:
        return rows.field(name).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)

    wanted, traits = _array(queries["wanted"]), _array(base["traits"])
    genders = pa.concat_arrays([wanted.field("want_gender"), traits.field("gender")])
    codes = genders.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    want, gender = codes[: len(wanted)], codes[len(wanted) :]
    low, high = numbers(wanted, "want_age_low"), numbers(wanted, "want_age_high")
    age = numbers(traits, "age")

    def mask(rows: slice, part: slice) -> np.ndarray:
        w, lo, hi = want[rows, None], low[rows, None], high[rows, None]
        g, a = gender[part], age[part]
        return ((w == -1) | (w == g)) & (np.isnan(lo) | ((a >= lo) & (a <= hi)))

    return mask


def pair_table(
    queries: pa.Table, base: pa.Table, q: np.ndarray, b: np.ndarray, score: np.ndarray
) -> pa.Table:
    q, b = pa.array(q), pa.array(b)
    return pa.table({
        "query_id": queries["id"].take(q),
        "candidate_id": base["id"].take(b),
        "face_similarity": pa.array(score),
        "query": queries["row"].take(q),
        "candidate": base["row"].take(b),
    })


class Search(NamedTuple):
    """What is looked for, and how."""

    k: int
    threshold: float
    tile: tuple[int, int]
    prefilter: bool

    def base_side(self, table: pa.Table) -> Side:
        side = Side.of(table)
        return side if self.prefilter else without_spare_copies(side, self.k)

    def best(self, queries: Side, base: Side, floor: np.ndarray | None = None):
        """(query row, base row, score) of the best pairs, grouped by query, best first."""
        allowed = wanted_mask(queries.table, base.table) if self.prefilter else None
        return top_pairs(queries, base, self.k, self.threshold, self.tile, allowed, floor)

    def batches(self, queries: pa.Table, base: Side) -> Iterator[pa.RecordBatch]:
        """Best pairs of a batch of queries, a bounded number of rows at a time."""
        rows = max(1, _OUTPUT_ROWS // self.k)
        for start in range(0, len(queries), rows):
            some = Side.of(queries.slice(start, rows))
            pairs = pair_table(some.table, base.table, *self.best(some, base))
            yield from pairs.combine_chunks().to_batches()


def as_side(table: pa.Table, row: str) -> pa.Table:
    """Rename the column of carried values to the name both sides use."""
    return table.rename_columns(["row" if c == row else c for c in table.column_names])


def check_order(is_base: pa.ChunkedArray, n_queries: int) -> None:
    """Raise unless ``n_queries`` query rows open the batch and only base rows follow."""
    flags = is_base.to_numpy()
    if flags[:n_queries].any() or not flags[n_queries:].all():
        raise ValueError("query rows must precede the base rows of their block pair")


def leading_queries(
    batches: Iterator[pa.RecordBatch],
) -> tuple[pa.Table | None, pa.Table | None]:
    """Read the query rows that open a block pair, and the base rows of the last batch read.

    Either is None when there are none, and then nothing can match.
    """
    queries = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        n = len(table) - pc.sum(table["is_base"]).as_py()
        check_order(table["is_base"], n)
        if n:
            queries.append(as_side(table.slice(0, n), "query"))
        if n < len(table):
            mine = pa.concat_tables(queries).combine_chunks() if queries else None
            return mine, as_side(table.slice(n), "candidate")
    return (pa.concat_tables(queries) if queries else None), None


def gathered(tables: Iterable[pa.Table], rows: int) -> Iterator[pa.Table]:
    """The same rows in fewer, larger tables of about ``rows`` rows."""
    held: list[pa.Table] = []
    for table in tables:
        held.append(table)
        if sum(map(len, held)) >= rows:
            yield pa.concat_tables(held).combine_chunks()
            held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


class RunningBest:
    """The k best base rows per query over a stream of base batches.

    Holds index and score of the current pairs and, once each, the base rows they refer to.
    """

    def __init__(self, queries: pa.Table, search: Search):
        self.queries, self.search = Side.of(queries), search
        self.floor = np.full(len(self.queries.unit), search.threshold)
        if "floor" in queries.column_names:  # what an earlier pass has found already
            known = _array(queries["floor"]).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            self.floor = np.maximum(self.floor, known)
        self.query, self.row = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score = np.empty(0)
        self.rows: pa.Table | None = None

    def add(self, batch: pa.Table) -> None:
        base = self.search.base_side(batch)
        self.take(base, *self.search.best(self.queries, base, self.floor))

    def take(self, base: Side, q: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        """Add pairs of the queries and of rows of ``base``."""
        if not len(q):
            return
        used, position = np.unique(b, return_inverse=True)
        new = base.table.select(["id", "row"]).take(pa.array(used))
        known = 0 if self.rows is None else len(self.rows)
        self.rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        self.query = np.r_[self.query, q]
        self.row = np.r_[self.row, known + position]
        self.score = np.r_[self.score, score]
        self._cut()

    def _cut(self) -> None:
        ranked = np.lexsort((-self.score, self.query))
        q, s = self.query[ranked], self.score[ranked]
        same = (q[1:] == q[:-1]) & (s[1:] == s[:-1])
        if same.any():  # only now do ids matter
            tied = ranked[np.r_[False, same] | np.r_[same, False]]
            order = np.zeros(len(q), np.int64)
            order[tied] = id_order(self.rows["id"].take(pa.array(self.row[tied])))
            ranked = np.lexsort((order, -self.score, self.query))
        keep = first_of_group(self.query, ranked, self.search.k)
        self.query, self.row, self.score = self.query[keep], self.row[keep], self.score[keep]
        raise_to_kth(self.floor, self.query, self.score, self.search.k)
        if len(self.rows) > 2 * len(self.row) + 10_000 or self.rows["id"].num_chunks > 100:
            used, self.row = np.unique(self.row, return_inverse=True)
            self.rows = self.rows.take(pa.array(used)).combine_chunks()

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.query), _OUTPUT_ROWS):
            part = slice(start, start + _OUTPUT_ROWS)
            pairs = pair_table(
                self.queries.table, self.rows, self.query[part], self.row[part], self.score[part]
            )
            yield from pairs.combine_chunks().to_batches()


class BestOfBoth:
    """The best pairs of held rows and of rows that stream past them, from one product per tile.

    The best of a streamed row are complete, as far as the held rows go, once it has passed; those
    of the held rows once the stream ends. The held rows are queries and the others base rows, or
    the other way round where ``swapped``.
    """

    def __init__(self, held: pa.Table, search: Search, swapped: bool = False):
        self.best, self.search, self.swapped = RunningBest(held, search), search, swapped

    def _flat(self, pairs: pa.Table, of_held: bool) -> Iterator[pa.RecordBatch]:
        """Pairs as (held, streamed) or exchanged; ``reverse`` if they are a base row's best."""
        if self.swapped:
            names = ["candidate_id", "query_id", "face_similarity", "candidate", "query"]
            pairs = pairs.rename_columns(names).select(
                ["query_id", "candidate_id", "face_similarity", "query", "candidate"]
            )
        reverse = pa.array(np.full(len(pairs), of_held == self.swapped))
        yield from pairs.append_column("reverse", reverse).combine_chunks().to_batches()

    def add(self, batch: pa.Table) -> Iterator[pa.RecordBatch]:
        held, stream, k = self.best.queries, Side.of(batch), self.search.k
        of_stream = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        low = self.best.floor.copy()
        for first in range(0, len(stream.unit), self.search.tile[1]):
            part = slice(first, first + self.search.tile[1])
            column_low = np.full(len(stream.unit[part]), self.search.threshold)
            b, q, score = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for start in range(0, len(held.unit), self.search.tile[0]):
                rows = slice(start, start + self.search.tile[0])
                new = _tile_pairs_of_both(held, stream, rows, part, k, low[rows], column_low)
                if not len(new[0]):
                    continue
                for_rows = new[2] >= low[rows][new[0]]
                keep = best_of_group(new[0][for_rows], new[2][for_rows], stream.order[new[1][for_rows]], k)
                chosen = tuple(x[for_rows][keep] for x in new)
                found.append((chosen[0] + start, chosen[1], chosen[2]))
                b, q, score = (
                    np.r_[b, new[1] - first], np.r_[q, new[0] + start], np.r_[score, new[2]],
                )
                keep = best_of_group(b, score, held.order[q], k)
                b, q, score = b[keep], q[keep], score[keep]
                raise_to_kth(column_low, b, score, k)
            of_stream.append((b + first, q, score))
        self.best.take(stream, *(np.concatenate(x) for x in zip(*found)))
        b, q, score = (np.concatenate(x) for x in zip(*of_stream))
        for start in range(0, len(b), _OUTPUT_ROWS):
            some = slice(start, start + _OUTPUT_ROWS)
            pairs = pair_table(held.table, stream.table, q[some], b[some], score[some])
            yield from self._flat(pairs, of_held=False)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for batch in self.best.batches():
            yield from self._flat(pa.Table.from_batches([batch]), of_held=True)


def _tile_pairs_of_both(
    queries: Side, base: Side, rows: slice, part: slice, k: int, row_low: np.ndarray, column_low: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one tile that can be among the k best of their row or of their column."""
    rough = queries.rough[rows] @ base.rough[part].T
    margin = np.float32(queries.unit.shape[1] * 1.2e-7 + 1e-6)

    def passing(scores: np.ndarray, low: np.ndarray) -> np.ndarray:
        cut = low.astype(np.float32) - margin
        found = scores >= cut[:, None]
        width = scores.shape[1]
        crowded = np.flatnonzero(np.count_nonzero(found, axis=1) > k)
        if len(crowded):
            some = scores[crowded]
            kth = np.partition(some, width - k, axis=1)[:, width - k] - 2 * margin
            found[crowded] = some >= np.maximum(cut[crowded], kth)[:, None]
        return found

    q, b = np.nonzero(passing(rough, row_low) | passing(rough.T, column_low).T)
    score = exact_scores(queries.unit[rows], base.unit[part], q, b)
    enough = score >= np.minimum(row_low[q], column_low[b])
    return q[enough], b[enough] + part.start, score[enough]


def cell_lists(chosen: Iterable[np.ndarray]) -> pa.Array:
    """The cells of each row of boolean matrices, which follow each other, as lists."""
    sizes, cells = [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
    for some in chosen:
        sizes.append(some.sum(axis=1))
        cells.append(np.nonzero(some)[1].astype(np.int32))
    offsets = np.cumsum(np.concatenate(sizes))
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(np.concatenate(cells), pa.int32())
    )


def some_rows(rows: int, cells: int) -> Iterator[slice]:
    """Slices of rows whose matrix with all cells is of bounded size."""
    step = max(1, _MATRIX // max(1, cells))
    return (slice(start, start + step) for start in range(0, rows, step))


def nearest_of(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every vector, and the angle to it."""
    cell, angle = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for rows in some_rows(len(vectors), len(pivots)):
        angles = angles_to(vectors[rows], pivots)
        cell[rows] = angles.argmin(axis=1)
        angle[rows] = angles[np.arange(len(angles)), cell[rows]]
    return cell, angle


def without_listed(chosen: np.ndarray, lists: pa.Array) -> np.ndarray:
    """A boolean (row, cell) matrix without the cells that are listed for each row."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    chosen[row, lists.flatten().to_numpy(zero_copy_only=False)] = False
    return chosen


def nearest_cells(angles: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Boolean (query, cell) matrix of the nearest cells that together hold ``k`` rows."""
    filled = np.where(rows > 0, angles, np.inf)
    order = np.argsort(filled, axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    chosen = np.zeros(angles.shape, bool)
    np.put_along_axis(chosen, order, before < k, axis=1)
    return chosen & (rows > 0)


def angles_to(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def reachable_cells(
    angles: np.ndarray,
    rows: np.ndarray,
    nearest: np.ndarray,
    farthest: np.ndarray,
    threshold: float | np.ndarray,
    k: int | None,
) -> np.ndarray:
    """Boolean (query, cell) matrix of the cells that may hold one of a query's k best rows.

    ``threshold`` is one for all queries or one for each.

    ``rows``, ``nearest`` and ``farthest`` describe the cells: number of base rows, smallest and
    largest angle between a row and the pivot. For a query at angle ``a`` from the pivot every
    row of the cell lies between ``max(a - farthest, nearest - a, 0)`` and ``a + farthest``.
    Taking cells in the order of the upper bound until they hold k rows bounds the angle of the
    k-th neighbour. ``k=None`` leaves only the threshold.
    """
    lower = np.maximum(0.0, np.maximum(angles - farthest, nearest - angles))
    cut = np.broadcast_to(np.asarray(threshold, float), len(angles)).copy()
    if k is not None and rows.sum() >= k:
        upper = np.minimum(angles + farthest, np.pi)
        order = np.argsort(upper, axis=1)
        enough = np.argmax(np.cumsum(rows[order], axis=1) >= k, axis=1)
        each = np.arange(len(angles))
        cut = np.maximum(cut, np.cos(upper[each, order[each, enough]]))
    return (rows > 0) & (np.cos(lower) >= cut[:, None] - SLACK)
