import numpy as np
import pytest
from pyspark.sql import functions as F

from homeward.config import KnnConfig
from homeward.operators import knn_index
from homeward.operators.knn_index import build_index, extend_index, knn_indexed, open_index

from test_knn import SCHEMA, brute_force, people


def tight(seed, n, dim=12, groups=30):
    """Vectors in well separated groups."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(7).normal(size=(groups, dim))
    vectors = centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))
    return [(f"{seed}-{i}", [float(x) for x in np.float32(v)], "x", i) for i, v in enumerate(vectors)]


def found(pairs):
    return {(r.query_id, r.candidate_id, round(r.face_similarity, 6)) for r in pairs.collect()}


@pytest.mark.parametrize("rows_per_cell", [3, 40, 10_000])
@pytest.mark.parametrize("threshold", [0.45, -1.0])
def test_an_index_in_batches_equals_brute_force(spark, tmp_path, rows_per_cell, threshold):
    base, queries, path = people(2, 150, 8, copies=30), people(1, 60, 8, copies=9), str(tmp_path / "index")
    table = spark.createDataFrame(base, SCHEMA)
    batches = [table.filter(f"age % 3 = {i}") for i in range(3)]
    build_index(batches[0], path, 8, rows_per_cell=rows_per_cell)
    for i in (1, 2, 2):  # the last batch comes twice
        extend_index(batches[i], path, f"batch-{i}")
    assert knn_index.parts_of(spark, path) == ["batch-1", "batch-2", "first"]
    index = open_index(spark, path)
    q = spark.createDataFrame(queries, SCHEMA)
    for config in (KnnConfig(), KnnConfig(block_rows=16)):
        got = knn_indexed(q, index, 5, threshold, config=config)
        assert found(got) == brute_force(queries, base, 5, threshold)


def test_only_cells_in_reach_are_read(spark, tmp_path):
    base, path = tight(2, 3_000), str(tmp_path / "index")
    queries = [r for r in tight(1, 400) if r[3] < 5]
    build_index(spark.createDataFrame(base, SCHEMA).repartition(4), path, 12, rows_per_cell=60)
    index = open_index(spark, path)
    asked = []
    original = knn_index._Job._within

    def within(self, routed, placed, cells, both=False):
        def rows(some):
            asked.append(len(some))
            return placed(some)

        return original(self, routed, rows if callable(placed) else placed, cells, both)

    monkey = pytest.MonkeyPatch()
    monkey.setattr(knn_index._Job, "_within", within)
    try:
        got = knn_indexed(spark.createDataFrame(queries, SCHEMA), index, 5, 0.3)
        assert found(got) == brute_force(queries, base, 5, 0.3)
    finally:
        monkey.undo()
    assert max(asked) <= 0.5 * index.cells.number
    read = knn_indexed(spark.createDataFrame(queries, SCHEMA), index, 5, 0.3)
    assert read.count() == 25


def test_a_batch_that_dies_half_way_does_not_count(spark, tmp_path, monkeypatch):
    base, path = people(2, 80, 8), str(tmp_path / "index")
    table = spark.createDataFrame(base, SCHEMA)
    build_index(table.filter("age % 2 = 0"), path, 8, rows_per_cell=10)

    def dies(written):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(knn_index, "cell_sums", dies)
    with pytest.raises(RuntimeError):
        extend_index(table.filter("age % 2 = 1"), path, "odd")
    monkeypatch.undo()
    half = [r for r in base if r[3] % 2 == 0]
    queries = people(1, 20, 8)
    q = spark.createDataFrame(queries, SCHEMA)
    assert found(knn_indexed(q, open_index(spark, path), 5, 0.2)) == brute_force(queries, half, 5, 0.2)
    extend_index(table.filter("age % 2 = 1"), path, "odd")
    assert found(knn_indexed(q, open_index(spark, path), 5, 0.2)) == brute_force(queries, base, 5, 0.2)


def test_carried_and_prepared_columns_and_odd_rows(spark, tmp_path):
    base, path = people(2, 50, 8), str(tmp_path / "index")
    odd = [("short", [1.0], None, 1), ("none", None, None, 2)]
    build_index(spark.createDataFrame(base + odd, SCHEMA), path, 8, rows_per_cell=10)
    q = spark.createDataFrame(base[:10] + odd, SCHEMA)
    out = knn_indexed(
        q, open_index(spark, path), 1, 0.9, query_columns=["age"], base_columns=["gender", "older"],
        prepare=lambda df: df.withColumn("older", F.col("age") + 1),
    ).collect()
    assert len(out) == 10
    for r in out:
        assert r.candidate.point_id == r.candidate_id and r.candidate.older == r.query.age + 1
    empty = str(tmp_path / "empty")
    build_index(spark.createDataFrame([], SCHEMA), empty, 8)
    assert open_index(spark, empty) is None
