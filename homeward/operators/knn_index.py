"""A neighbour index that is kept beside a table: rows laid out by cell, written once, extended by batch.

Layout below the folder of an index::

    pivots/             the pivots of the cells, in two levels: a cell belongs to its group
    parts/<part>/group=<g>/   rows with their cell, sorted by cell within a group
    sums/<part>/        (cell, n, lo, hi): rows of the part's cells and the angles they lie between

Pivots are picked when the index is made: rows of lowest id hash, as many as the table needs for
``rows_per_cell``. A row goes to the group of its nearest group pivot, and there to the cell of the
nearest pivot; two small products place a row among thousands of cells. A part counts once its sums
are written, which come last, so a batch that dies half-way leaves nothing that is read, and a part
that is there already is not written again.

A search sends its queries to the cells that may hold a neighbour (``knn``) and reads nothing but
those: groups are folders, and within the files of a group, statistics of the sorted cells leave out
row groups. It is exact. An index may be extended beyond the size that its pivots were made for;
cells then only grow.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.config import KnnConfig
from homeward.operators import knn_kernels as kernels
from homeward.operators.knn import Cells, _Job, _side, cell_sums, cells_of

ROWS_PER_CELL = 10_000
MAX_CELLS = 1 << 14


class Index(NamedTuple):
    """An opened index: its cells, the group of each, and its rows."""

    path: str
    cells: Cells
    group: np.ndarray
    rows: DataFrame
    id_column: str
    vector: str
    dim: int


def build_index(
    table: DataFrame,
    path: str,
    dim: int,
    id_column: str = "point_id",
    vector: str = "embedding",
    rows_per_cell: int = ROWS_PER_CELL,
) -> None:
    """Pick the pivots of a new index at ``path`` and write ``table`` as its first part.

    Rows whose vector is NULL or not of length ``dim`` are left out.
    """
    pick_pivots(table, path, dim, id_column, vector, rows_per_cell)
    extend_index(table, path, "first")


def pick_pivots(
    table: DataFrame,
    path: str,
    dim: int,
    id_column: str = "point_id",
    vector: str = "embedding",
    rows_per_cell: int = ROWS_PER_CELL,
) -> None:
    """Make an index without rows, its cells taken from vectors like those that will come."""
    spark = table.sparkSession
    usable = table.filter(F.size(vector) == dim)
    wanted = max(1, min(MAX_CELLS, math.ceil(usable.count() / rows_per_cell)))
    picked = (
        usable.select(F.col(vector).alias("vector"), F.xxhash64(id_column).alias("h"))
        .orderBy("h", "vector")
        .limit(wanted)
    )
    unit = kernels.unit_rows(picked.select("vector").toArrow()["vector"])  # at most MAX_CELLS
    groups = max(1, math.isqrt(len(unit)))
    group = kernels.angles_to(unit, unit[:groups]).argmin(axis=1) if len(unit) else np.zeros(0, int)
    rows = [
        (cell, int(g), cell < groups, dim, id_column, vector, [float(x) for x in v])
        for cell, (g, v) in enumerate(zip(group, unit))
    ]
    schema = "cell int, group int, leads boolean, dim int, id_column string, vector_column string, pivot array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/pivots")


def _pivots(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, int, str, str] | None:
    """(unit pivots, group of each, dim, id column, vector column); none of an empty index."""
    rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()  # at most MAX_CELLS
    if not rows:
        return None
    unit = np.array([r.pivot for r in rows])
    return unit, np.array([r.group for r in rows]), rows[0].dim, rows[0].id_column, rows[0].vector_column


def _sums(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/sums")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """The parts of an index that count."""
    sums = _sums(spark, path)
    return [] if sums is None else sorted(r.part for r in sums.select("part").distinct().collect())


def extend_index(batch: DataFrame, path: str, part: str | None = None) -> None:
    """Add the rows of a batch; nothing happens if the index has the ``part`` already."""
    spark = batch.sparkSession
    part = part or uuid.uuid4().hex
    known = _pivots(spark, path)
    if known is None or part in parts_of(spark, path):
        return
    unit, group, dim, _, vector = known
    members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
    leaders = unit[: len(members)]

    @F.arrow_udf("struct<group:int,cell:int,angle:double>")
    def place(vectors: pa.Array) -> pa.Array:
        rows = kernels.unit_rows(vectors)
        own, _ = kernels.nearest_of(rows, leaders)
        cell, angle = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for g in np.unique(own):
            mine = np.flatnonzero(own == g)
            nearest, angle[mine] = kernels.nearest_of(rows[mine], unit[members[g]])
            cell[mine] = members[g][nearest]
        columns = [pa.array(own, pa.int32()), pa.array(cell, pa.int32()), pa.array(angle)]
        return pa.StructArray.from_arrays(columns, ["group", "cell", "angle"])

    placed = (
        batch.filter(F.size(vector) == dim)
        .withColumn("_place", place.asNondeterministic()(F.col(vector)))
        .select("*", "_place.*")
        .drop("_place")
    )
    folder = f"{path}/parts/{part}-{uuid.uuid4().hex}"
    # Ranges of group and cell: a group with a third of all rows is several tasks and files.
    ordered = placed.repartitionByRange(F.col("group"), F.col("cell"), F.xxhash64(known[3])).sortWithinPartitions(
        "group", "cell"
    )
    ordered.write.partitionBy("group").parquet(folder)
    written = spark.read.schema(ordered.schema).parquet(folder)
    sums = cell_sums(written).withColumns({"part": F.lit(part), "folder": F.lit(folder)})
    sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/{part}")


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The index at ``path`` with all parts that count; none if it has no rows."""
    known, sums = _pivots(spark, path), _sums(spark, path)
    if known is None or sums is None:
        return None
    unit, group, dim, id_column, vector = known
    folders = [r.folder for r in sums.select("folder").distinct().collect()]  # one per part
    if not folders:
        return None
    whole = sums.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    frames = [spark.read.parquet(f) for f in folders]
    schema = frames[0].schema
    rows = frames[0]
    for folder in folders[1:]:
        rows = rows.unionByName(spark.read.schema(schema).parquet(folder), allowMissingColumns=True)
    return Index(path, cells_of(rows, unit, whole), group, rows, id_column, vector, dim)


def knn_indexed(
    queries: DataFrame,
    index: Index,
    k: int,
    threshold: float,
    query_id: str = "point_id",
    vector: str = "embedding",
    query_columns: list[str] | None = None,
    base_columns: list[str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    config: KnnConfig = KnnConfig(),
) -> DataFrame:
    """What ``knn_join`` gives for the indexed table, from the cells in reach of the queries alone.

    ``prepare`` adds columns to indexed rows before ``base_columns`` are taken from them.
    """
    base = index.rows if prepare is None else prepare(index.rows)
    sides = (
        _side(queries, query_id, vector, query_columns or [], index.dim, "", None),
        _side(base, index.id_column, index.vector, base_columns or [], index.dim, "", None),
    )

    def rows_of(asked: list[int]) -> DataFrame:
        """Indexed rows of some cells; groups are folders, cells are sorted within them."""
        groups = sorted({int(index.group[c]) for c in asked})
        within = F.col("group").isin(groups) & F.col("cell").isin([int(c) for c in asked])
        some = index.rows.filter(within)
        some = some if prepare is None else prepare(some)
        side = _side(some.withColumn("_cell", F.col("cell")), index.id_column, index.vector,
                     [*(base_columns or []), "_cell"], index.dim, "", None)
        return side.withColumn("cell", F.col("row._cell")).withColumn(
            "row", F.col("row").dropFields("_cell")
        )

    return _Job(*sides, (queries, base), k, threshold, index.dim, False, config).search(
        rows_of, index.cells
    )
