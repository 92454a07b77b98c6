"""Exact nearest-neighbour join: for each query row the ``k`` base rows of highest cosine.

Three physical strategies give the same rows:

``broadcast_base``
    The base side is small (its size is checked). It is shipped to the workers
    and each query batch is scored against it in one matrix product. No shuffle.
``broadcast_queries``
    The query side is small. The base table is scanned where it lies; each task
    keeps its own top k per query, so only ``queries x k`` ids and scores per
    task are shuffled, and cut in stages of ``merge_fan_in`` tasks each.
``blocked``
    Neither side is small. Base rows are put into the cell of their nearest
    pivot. A query first meets the nearest cells that hold k rows. The k-th score
    found there and the triangle inequality on angles rule out most of the other
    cells (compare the Voronoi-partitioned kNN join of Lu et al., PVLDB 2012);
    it meets the rest in a second pass. Cells are cut into blocks of bounded
    size, so a cell that holds a third of all rows becomes many tasks. A task keeps
    one query block in memory and streams one base block past it.

``knn_both`` finds the neighbours of either side in the other, from one matrix product where a task
can hold the best of all rows of a side. An index that is kept beside a table is searched in the same way (``knn_index``).

Scores are cosines rounded to nine decimals, ties go to the smaller id. Rounding
makes the order independent of how a matrix product was blocked. Ids must be
unique on either side. Both sides are read more than once, so pass stored tables
rather than results that are expensive to compute.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeward.config import KnnConfig
from homeward.operators import knn_kernels as kernels
from homeward.session import checkpointed

_KEYS = ["cell", "base_block", "query_block"]

# What a result of a query weighs on its way to the final cut.
_RESULT_BYTES = 64
_TASKS_PER_CORE = 3
_FEWEST_ROWS = 256
# Blocks of a side up to which their size may be given: every row of the other is copied to each.
_MOST_BLOCKS = 64


class Cells(NamedTuple):
    """Cells of base rows: unit pivots, number of rows, least and largest angle of a row to its pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @property
    def number(self) -> int:
        return len(self.pivots)


class Routed(NamedTuple):
    """One row per query and cell, the number of queries of each cell, and of all that have one."""

    rows: DataFrame
    asked: dict[int, int]
    queries: int


# Base rows with their cell, or a function from cells to the rows of those.
Placed = DataFrame | Callable[[list[int]], DataFrame]


def in_cells(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the ``cell`` of the nearest pivot and the ``angle`` to it."""

    @F.arrow_udf("struct<cell:int,angle:double>")
    def nearest_pivot(vectors: pa.Array) -> pa.Array:
        cell, angle = kernels.nearest_of(kernels.unit_rows(vectors), pivots)
        return pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(angle)], ["cell", "angle"]
        )

    # Declared nondeterministic so that inferred filters do not evaluate it a second time.
    placed = base.withColumn("_place", nearest_pivot.asNondeterministic()("vector"))
    return placed.select(
        "*", F.col("_place.cell").alias("cell"), F.col("_place.angle").alias("angle")
    ).drop("_place")


def cell_sums(placed: DataFrame) -> DataFrame:
    """(cell, n, lo, hi) of the cells that hold rows."""
    return placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")
    )


def cells_of(placed: DataFrame, pivots: np.ndarray, sums: DataFrame | None = None) -> Cells:
    """The cells of ``placed`` rows, or of sums that are known already."""
    cells = Cells(
        pivots, np.zeros(len(pivots)), np.full(len(pivots), np.pi), np.zeros(len(pivots))
    )
    for c in (cell_sums(placed) if sums is None else sums).collect():  # one row per pivot
        cells.rows[c.cell], cells.near[c.cell], cells.far[c.cell] = c.n, c.lo, c.hi
    return cells


class Prefilter(NamedTuple):
    """Per-query restriction of the base side, given as columns of the two sides."""

    want_gender: Column
    want_age_low: Column
    want_age_high: Column
    base_gender: Column
    base_age: Column


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    threshold: float,
    dim: int,
    query_id: str = "point_id",
    base_id: str = "point_id",
    vector: str = "embedding",
    query_columns: list[str] | None = None,
    base_columns: list[str] | None = None,
    prefilter: Prefilter | None = None,
    config: KnnConfig = KnnConfig(),
) -> DataFrame:
    """Candidates (query_id, candidate_id, face_similarity, query, candidate).

    ``query`` and ``candidate`` are structs of the id and the listed columns. A small base side
    carries them through the join; otherwise only ids and vectors are exchanged and the columns
    are joined to the ``k`` survivors of each query.
    Rows whose vector is NULL or not of length ``dim`` take no part.
    """
    wanted = traits = None
    if prefilter is not None:
        wanted = F.struct(
            prefilter.want_gender.alias("want_gender"),
            prefilter.want_age_low.alias("want_age_low"),
            prefilter.want_age_high.alias("want_age_high"),
        )
        traits = F.struct(
            prefilter.base_gender.alias("gender"), prefilter.base_age.alias("age")
        )
    left = _side(queries, query_id, vector, query_columns or [], dim, "wanted", wanted)
    right = _side(base, base_id, vector, base_columns or [], dim, "traits", traits)
    job = _Job(left, right, (queries, base), k, threshold, dim, prefilter is not None, config)
    return job.plan()


def knn_both(
    left: DataFrame,
    right: DataFrame,
    k: int,
    threshold: float,
    dim: int,
    config: KnnConfig = KnnConfig(),
    id_column: str = "point_id",
    vector: str = "embedding",
) -> DataFrame:
    """Candidates of both sides in one go: (reverse, query_id, candidate_id, face_similarity).

    Rows with ``reverse`` are the candidates of the right side's rows among the left side's. Where a
    task can hold the best of all right rows, every score is computed once, and the best are kept by
    row and by column. Larger sides are searched once in each direction.
    """
    sides = [_side(df, id_column, vector, [], dim, "", None) for df in (left, right)]
    return _Job(*sides, (left, right), k, threshold, dim, False, config).both()


def _only_id(side: DataFrame) -> DataFrame:
    """The side with ``row`` cut down to the id."""
    return side.withColumn("row", F.struct(F.col("id")))


def _side(df, id_col, vector, columns, dim, extra_name, extra) -> DataFrame:
    picked = [
        F.col(id_col).cast("string").alias("id"),
        F.col(vector).alias("vector"),
        F.struct(*[F.col(c) for c in dict.fromkeys([id_col, *columns])]).alias("row"),
    ]
    if extra is not None:
        picked.append(extra.alias(extra_name))
    return df.filter(F.size(vector) == dim).select(*picked)


class _Job(NamedTuple):
    queries: DataFrame
    base: DataFrame
    counted: tuple[DataFrame, DataFrame]  # the sides as given, cheaper to count
    k: int
    threshold: float
    dim: int
    prefiltered: bool
    config: KnnConfig

    def plan(self) -> DataFrame:
        n_queries, n_base = self._counts()
        if self._ships_base(n_base):
            return self.broadcast_base(self.base.toArrow(), n_queries)
        return self._with_rows(self._slim()._unshipped(n_queries, n_base, self._is_narrow(self.queries)))

    def _small(self) -> int:
        """Most rows of vectors that are shipped to every worker."""
        return max(1, self.config.broadcast_bytes // (8 * self.dim))

    def _few(self) -> int:
        """Most rows that a task holds with the best k of each."""
        return max(1, min(self._small(), self.config.task_results // self.k))

    def _ships_base(self, n_base: int) -> bool:
        fits = self.config.strategy in ("auto", "broadcast_base") and n_base <= self._small()
        return fits and self._is_narrow(self.base)

    def _unshipped(self, n_queries: int, n_base: int, narrow: bool = True) -> DataFrame:
        """Pairs of a base side that is not shipped whole."""
        if self.config.strategy in ("auto", "broadcast_queries") and n_queries <= self._few() and narrow:
            return self.broadcast_queries(self.queries.toArrow())
        return self.blocked(n_base)

    def _slim(self) -> _Job:
        return self._replace(queries=_only_id(self.queries), base=_only_id(self.base))

    def _with_rows(self, pairs: DataFrame) -> DataFrame:
        """Put the carried columns of both sides in place of the ids.

        Ids are unique on either side. A base row that is near to very many queries is a hot key
        of a plain join, which adaptive execution splits.
        """
        for key, name, side in (
            ("query_id", "query", self.queries), ("candidate_id", "candidate", self.base)
        ):
            rows = side.select(F.col("id").alias(key), F.col("row").alias(name))
            pairs = pairs.drop(name).join(rows, key)
        return pairs.select("query_id", "candidate_id", "face_similarity", "query", "candidate")

    def _counts(self) -> tuple[int, int]:
        """Rows of both sides in one job that reads no vectors."""
        counted = self.counted[0].select(F.lit(0).alias("side")).unionByName(
            self.counted[1].select(F.lit(1).alias("side"))
        )
        found = {r["side"]: r["count"] for r in counted.groupBy("side").count().collect()}
        return found.get(0, 0), found.get(1, 0)

    def _is_narrow(self, side: DataFrame) -> bool:
        """Whether the carried columns of a side of few rows fit the limit, measured as text."""
        carried = F.sum(F.length(F.col("row").cast("string")))
        return (side.agg(carried).first()[0] or 0) <= self.config.broadcast_bytes

    def _schema(self) -> T.StructType:
        return T.StructType([
            T.StructField("query_id", T.StringType()),
            T.StructField("candidate_id", T.StringType()),
            T.StructField("face_similarity", T.DoubleType()),
            T.StructField("query", self.queries.schema["row"].dataType),
            T.StructField("candidate", self.base.schema["row"].dataType),
        ])

    def _search(self) -> kernels.Search:
        return kernels.Search(self.k, self.threshold, self.config.tile, self.prefiltered)

    def _stream_rows(self) -> int:
        """Base rows scored between two updates of the running result."""
        return max(1, self.config.stream_bytes // (8 * self.dim))

    # Small base side

    def broadcast_base(self, table: pa.Table, n_queries: int) -> DataFrame:
        context = self.base.sparkSession.sparkContext
        shipped = context.broadcast(table)
        search = self._search()
        queries = self.queries
        if n_queries <= self.config.spread_below:
            # Few rows come in few partitions, but each makes up to k rows.
            queries = queries.repartition(context.defaultParallelism, "id")

        def each_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = search.base_side(shipped.value)
            for batch in batches:
                yield from search.batches(pa.Table.from_batches([batch]), base)

        return queries.mapInArrow(each_partition, self._schema())

    # Small query side

    def broadcast_queries(self, table: pa.Table) -> DataFrame:
        shipped = self.base.sparkSession.sparkContext.broadcast(table)
        search, stream_rows = self._search(), self._stream_rows()

        def each_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = kernels.RunningBest(shipped.value, search)
            tables = (pa.Table.from_batches([batch]) for batch in batches)
            for table in kernels.gathered(tables, stream_rows):
                best.add(table)
            yield from best.batches()

        pairs = self.base.mapInArrow(each_partition, self._schema())
        # One query has up to k rows from every base partition: merge a few of them at a time.
        numbers = self.base.select(F.spark_partition_id().alias("part"))
        parts = 1 + (numbers.agg(F.max("part")).first()[0] or 0)
        merged = pairs.withColumn("_part", F.spark_partition_id())
        while parts > self.config.merge_fan_in:
            parts = math.ceil(parts / self.config.merge_fan_in)
            merged = merged.withColumn("_part", F.floor(F.col("_part") / self.config.merge_fan_in))
            merged = self._final_cut(merged, "_part")
        return self._final_cut(merged.drop("_part"))

    def _final_cut(self, pairs: DataFrame, *within: str) -> DataFrame:
        best_first = Window.partitionBy("query_id", *within).orderBy(
            F.desc("face_similarity"), F.asc("candidate_id")
        )
        ranked = pairs.withColumn("_rank", F.row_number().over(best_first))
        return ranked.filter(F.col("_rank") <= self.k).drop("_rank")

    # Two large sides

    def _pivots(self, n_base: int) -> np.ndarray:
        """Unit vectors of a bounded, repeatable pick of base rows: those of lowest id hash."""
        wanted = math.ceil(n_base / self.config.rows_per_pivot)
        wanted = max(1, min(self.config.max_pivots, wanted))
        picked = self.base.select("vector", F.xxhash64("id").alias("h")).orderBy("h", "vector")
        return kernels.unit_rows(picked.limit(wanted).select("vector").toArrow()["vector"])

    def _grid(self, n_queries: float, n_base: float) -> tuple[int, int]:
        """Rows per query block and per base block.

        A task holds one query block and streams a base block past it. Every base row is copied once
        per query block, and every query once per base block, each time with up to k results, so of
        all grids that keep the cores busy and fit the memory of a task the one that moves the
        fewest bytes is taken.
        """
        own = self.config.block_rows
        if own is not None and max(n_queries, n_base) <= _MOST_BLOCKS * own:
            return own, own
        vector, results = 4 * self.dim, _RESULT_BYTES * self.k
        most_queries = max(1, self.config.block_bytes // (2 * vector + results))
        most_base = max(1, self.config.task_bytes // vector)
        tasks = _TASKS_PER_CORE * self.base.sparkSession.sparkContext.defaultParallelism
        least_q = max(1, math.ceil(n_queries / most_queries))
        least_b = max(1, math.ceil(n_base / most_base))
        # No block of less than a few hundred rows is worth a task.
        most_q = max(least_q, math.ceil(n_queries / _FEWEST_ROWS))
        most_b = max(least_b, math.ceil(n_base / _FEWEST_ROWS))

        def moved(grid: tuple[int, int]) -> float:
            q, b = grid
            return n_base * q * vector + n_queries * b * (vector + results)

        grids = []
        b = least_b
        while b <= most_b:
            grids.append((min(most_q, max(least_q, math.ceil(tasks / b))), b))
            b = max(b + 1, int(b * 1.2))
        q, b = min(grids, key=moved)
        return max(1, math.ceil(n_queries / q)), max(1, math.ceil(n_base / b))

    def blocked(self, n_base: int) -> DataFrame:
        spark = self.base.sparkSession
        pivots = self._pivots(n_base)
        if not len(pivots):
            return spark.createDataFrame([], self._schema())
        # Written once: the cells are counted first and joined afterwards.
        placed = checkpointed(in_cells(self.base, pivots))
        return self.search(placed, cells_of(placed, pivots))

    def search(self, placed: Placed, cells: Cells) -> DataFrame:
        """The k best of every query among ``placed`` base rows, in two passes where that helps.

        The first pass scores each query in the nearest cells that hold k rows. The k-th score that
        it finds is what a row of another cell has to reach, which keeps most cells out of reach.
        """
        if cells.number <= 2:
            routed = self._routed(self.queries, cells, None)
            if self._prunes(routed, cells):
                return self._final_cut(self._within(routed, placed, cells))
            return self._final_cut(self._everywhere(self.queries, placed, cells))
        k = self.k

        @F.arrow_udf("array<int>")
        def nearest_cells(vectors: pa.Array) -> pa.Array:
            unit = kernels.unit_rows(vectors)
            return kernels.cell_lists(
                kernels.nearest_cells(kernels.angles_to(unit[some], cells.pivots), cells.rows, k)
                for some in kernels.some_rows(len(unit), cells.number)
            )

        nearest_cells = nearest_cells.asNondeterministic()
        queries = checkpointed(self.queries.withColumn("first", nearest_cells("vector")))
        asked = queries.withColumn("cell", F.explode("first")).drop("first")
        counts = {c["cell"]: c["count"] for c in asked.groupBy("cell").count().collect()}  # a row per cell
        near = checkpointed(self._within(Routed(asked, counts, sum(counts.values())), placed, cells))
        floors = (
            near.groupBy(F.col("query_id").alias("id"))
            .agg(F.sort_array(F.collect_list("face_similarity"), asc=False).alias("best"))
            .select("id", F.get("best", F.lit(k - 1)).alias("floor"))
        )  # a few times k scores a query
        # Written once: cells in reach are counted first and gone through afterwards.
        known = checkpointed(
            queries.join(floors, "id", "left").withColumn(
                "floor", F.coalesce("floor", F.lit(float(self.threshold)))
            )
        )
        routed = self._routed(known, cells, "first")
        if self._prunes(routed, cells):
            return self._final_cut(near.unionByName(self._within(routed, placed, cells)))
        return self._final_cut(self._everywhere(known.drop("first"), placed, cells))

    def _prunes(self, routed: Routed, cells: Cells) -> bool:
        """Whether going by cells moves fewer bytes than comparing everything in one grid of blocks."""
        asked, n_queries = routed.asked, routed.queries
        if not asked:
            return True
        rows = cells.rows
        vector = 4 * self.dim
        with_results = vector + _RESULT_BYTES * self.k

        def moved(query_rows: int, base_rows: int, cells_asked: dict) -> float:
            return sum(
                n_base * math.ceil(n / query_rows) * vector + n * math.ceil(n_base / base_rows) * with_results
                for n, n_base in cells_asked.values()
            )

        by_cell = self._grid(sum(asked.values()), sum(rows[c] for c in asked))
        in_one = self._grid(n_queries, rows.sum())
        return moved(*by_cell, {c: (n, rows[c]) for c, n in asked.items()}) <= moved(
            *in_one, {0: (n_queries, rows.sum())}
        )

    def _everywhere(self, queries: DataFrame, placed: Placed, cells: Cells) -> DataFrame:
        """All queries against all base rows, as one cell."""
        one, n = F.lit(0).cast("int"), queries.count()
        whole = Cells(cells.pivots[:1], np.array([cells.rows.sum()]), np.zeros(1), np.full(1, np.pi))
        if callable(placed):
            placed = placed(np.flatnonzero(cells.rows).tolist())
        routed = Routed(queries.withColumn("cell", one), {0: n} if n else {}, n)
        return self._within(routed, placed.withColumn("cell", one), whole)

    def _routed(self, queries: DataFrame, cells: Cells, done: str | None) -> Routed:
        """The cells in reach of each query, but for those listed in ``done``.

        A query may reach every cell. So a task lists the cells of some queries at a time, and they
        are counted before any list is made.
        """
        threshold, bound_k = self.threshold, None if self.prefiltered else self.k
        floors = "floor" in queries.columns

        def reach(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            unit = kernels.unit_rows(batch["vector"])
            cut = batch["floor"].to_numpy(zero_copy_only=False) if floors else None
            for some in kernels.some_rows(len(unit), cells.number):
                angles = kernels.angles_to(unit[some], cells.pivots)
                found = kernels.reachable_cells(
                    angles, cells.rows, cells.near, cells.far, threshold if cut is None else cut[some], bound_k
                )
                if done is not None:
                    found = kernels.without_listed(found, batch[done].slice(some.start, len(angles)))
                yield found

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Queries of each cell; under -1 those that have any."""
            n, routed = np.zeros(cells.number, np.int64), 0
            for batch in batches:
                for found in reach(batch):
                    n += found.sum(axis=0)
                    routed += int(found.any(axis=1).sum())
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[-1, used], pa.int32()), pa.array(np.r_[routed, n[used]])], ["cell", "n"]
            )

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                start = 0
                for found in reach(batch):
                    some = batch.slice(start, len(found))
                    columns = [c for name, c in zip(some.schema.names, some.columns) if name != done]
                    names = [name for name in some.schema.names if name != done]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, kernels.cell_lists([found])], [*names, "cells"]
                    )
                    start += len(found)

        used = ["vector", *(["floor"] if floors else []), *([done] if done else [])]
        sums = queries.select(*used).mapInArrow(counted, "cell int, n bigint").groupBy("cell")
        asked = {c["cell"]: c["n"] for c in sums.agg(F.sum("n").alias("n")).collect()}  # a row per cell
        n = asked.pop(-1, 0)
        kept = queries.drop(done) if done else queries
        schema = T.StructType([*kept.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
        rows = queries.mapInArrow(listed, schema).withColumn("cell", F.explode("cells")).drop("cells")
        return Routed(rows, asked, n)

    def _blocks(self, routed: Routed, cells: Cells) -> tuple[DataFrame, int, list[int]] | None:
        """(cell, base_blocks, query_blocks) of the cells asked for, the number of tasks, the cells."""
        spark, asked = self.base.sparkSession, routed.asked
        if not asked:
            return None
        rows = cells.rows
        query_rows, base_rows = self._grid(sum(asked.values()), sum(rows[c] for c in asked))
        plan = [
            (cell, math.ceil(rows[cell] / base_rows), math.ceil(n / query_rows))
            for cell, n in asked.items()
        ]
        # Enough tasks that none has to read much more than task_bytes of replicated vectors.
        copied = sum(rows[cell] * q + asked[cell] * b for cell, b, q in plan)
        tasks = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            math.ceil(copied * 4 * self.dim / self.config.task_bytes),
        )
        blocks = spark.createDataFrame(plan, "cell int, base_blocks int, query_blocks int")
        return blocks, tasks, sorted(asked)

    def _within(
        self, routed: Routed, placed: Placed, cells: Cells, both: bool = False
    ) -> DataFrame:
        """The best pairs of routed queries and base rows of the same cell, not yet cut to k in all.

        ``both`` adds the best queries of every base row, told apart by ``reverse``.
        """
        schema = self._schema()
        if both:
            schema = T.StructType([*schema.fields, T.StructField("reverse", T.BooleanType())])
        made = self._blocks(routed, cells)
        if made is None:
            return self.base.sparkSession.createDataFrame([], schema)
        blocks, tasks = F.broadcast(made[0]), made[1]
        if callable(placed):
            placed = placed(made[2])

        def share(count: str) -> Column:
            return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

        def copies(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        left = (
            routed.rows.join(blocks, "cell")
            .withColumn("query_block", share("query_blocks"))
            .withColumn("base_block", copies("base_blocks"))
            .withColumnRenamed("row", "query")
        )
        right = (
            placed.drop("angle")
            .join(blocks, "cell")
            .withColumn("base_block", share("base_blocks"))
            .withColumn("query_block", copies("query_blocks"))
            .withColumnRenamed("row", "candidate")
        )
        rows = left.withColumn("is_base", F.lit(False)).unionByName(
            right.withColumn("is_base", F.lit(True)), allowMissingColumns=True
        )
        search, stream_rows = self._search(), self._stream_rows()

        def block_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The queries of the block come first, then base rows stream past them."""
            mine, first = kernels.leading_queries(batches)
            if mine is None or first is None:
                return
            best = kernels.BestOfBoth(mine, search) if both else kernels.RunningBest(mine, search)

            def base_rows_only() -> Iterator[pa.Table]:
                for batch in batches:
                    table = pa.Table.from_batches([batch])
                    kernels.check_order(table["is_base"], 0)
                    yield kernels.as_side(table, "candidate")

            rest = base_rows_only()
            for table in kernels.gathered(itertools.chain([first], rest), stream_rows):
                yield from best.add(table) or ()
            yield from best.batches()

        return (
            rows.drop("base_blocks", "query_blocks")
            .repartition(tasks, *_KEYS)
            .sortWithinPartitions(*_KEYS, "is_base")
            .groupBy(*_KEYS)
            .applyInArrow(block_pair, schema)
        )

    # Both directions at once

    def both(self) -> DataFrame:
        """Ids and scores of the best pairs of either side, told apart by ``reverse``."""
        slim = self._slim()
        n_queries, n_base = self._counts()
        if self.config.strategy in ("auto", "broadcast_base") and n_base <= self._few():
            pairs = slim._both_shipped(slim.base.toArrow(), n_queries)
        else:
            # No task can hold the best of all base rows: a search for each direction.
            back = slim._replace(queries=slim.base, base=slim.queries, counted=self.counted[::-1])
            return slim._searched(n_queries, n_base, False).unionByName(back._searched(n_base, n_queries, True))
        first = Window.partitionBy("reverse", "query_id").orderBy(
            F.desc("face_similarity"), F.asc("candidate_id")
        )
        return (
            pairs.select(
                "reverse", "face_similarity",
                F.when(F.col("reverse"), F.col("candidate_id")).otherwise(F.col("query_id")).alias("query_id"),
                F.when(F.col("reverse"), F.col("query_id")).otherwise(F.col("candidate_id")).alias("candidate_id"),
            )
            .withColumn("_rank", F.row_number().over(first))
            .filter(F.col("_rank") <= self.k)
            .drop("_rank")
        )

    def _searched(self, n_queries: int, n_base: int, reverse: bool) -> DataFrame:
        if self._ships_base(n_base):
            pairs = self.broadcast_base(self.base.toArrow(), n_queries)
        else:
            pairs = self._unshipped(n_queries, n_base)
        return pairs.select(F.lit(reverse).alias("reverse"), "face_similarity", "query_id", "candidate_id")

    def _both_shipped(self, table: pa.Table, n_queries: int) -> DataFrame:
        """The base side is small: it goes to every task, which keeps the best of its rows, too."""
        context = self.base.sparkSession.sparkContext
        shipped, search, stream_rows = context.broadcast(table), self._search(), self._stream_rows()
        queries = self.queries
        if n_queries <= self.config.spread_below:
            queries = queries.repartition(context.defaultParallelism, "id")

        def each_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The shipped side is held, the scanned one streams past it: their roles are exchanged.
            best = kernels.BestOfBoth(shipped.value, search, swapped=True)
            tables = (pa.Table.from_batches([batch]) for batch in batches)
            for some in kernels.gathered(tables, stream_rows):
                yield from best.add(some)
            yield from best.batches()

        schema = T.StructType([*self._schema().fields, T.StructField("reverse", T.BooleanType())])
        return queries.mapInArrow(each_partition, schema)
