import numpy as np
import pytest
from pyspark.sql import functions as F

from homeward.config import KnnConfig
from homeward.operators import knn, knn_kernels
from homeward.operators.knn import Prefilter, knn_both, knn_join

SCHEMA = "point_id string, embedding array<float>, gender string, age int"
STRATEGIES = {
    "broadcast_base": KnnConfig(strategy="broadcast_base"),
    "broadcast_queries": KnnConfig(strategy="broadcast_queries"),
    "blocked": KnnConfig(strategy="blocked", rows_per_pivot=20, block_rows=16),
    "one_cell_streamed": KnnConfig(strategy="blocked", stream_bytes=1),
    "base_in_small_tiles": KnnConfig(strategy="broadcast_base", tile=(7, 11)),
    "queries_in_small_tiles": KnnConfig(strategy="broadcast_queries", tile=(7, 11)),
    "blocked_small_tiles": KnnConfig(
        strategy="blocked", rows_per_pivot=7, block_rows=5, tile=(3, 2)
    ),
}


def people(seed, n, dim, copies=0):
    """Clustered vectors; ``copies`` of them are identical, one is zero."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(6, dim))
    vectors = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    vectors[:copies] = centres[0]
    vectors[-1] = 0.0
    genders = ["male", "female", None]
    return [
        (f"{seed}-{i}", [float(x) for x in np.float32(v)], genders[i % 3], int(i * 7 % 90))
        for i, v in enumerate(vectors)
    ]


def brute_force(queries, base, k, threshold, allowed=lambda q, b: True):
    def unit(rows):
        m = np.array([r[1] for r in rows], float)
        n = np.sqrt((m * m).sum(axis=1))
        return m / np.where(n == 0, 1, n)[:, None]

    scores = np.round(unit(queries) @ unit(base).T, 9)
    result = set()
    for i, q in enumerate(queries):
        ranked = sorted(
            (-scores[i, j], b[0])
            for j, b in enumerate(base)
            if scores[i, j] >= threshold and allowed(q, b)
        )
        result |= {(q[0], c, round(-s, 6)) for s, c in ranked[:k]}
    return result


def run(spark, queries, base, k, threshold, dim, config, prefilter=None):
    q = spark.createDataFrame(queries, SCHEMA).repartition(3)
    b = spark.createDataFrame(base, SCHEMA).repartition(4)
    if prefilter:
        q = q.withColumns({"want": F.col("gender"), "lo": F.col("age") - 10})
        q = q.withColumn("hi", F.when(F.col("age") % 2 == 0, F.col("age") + 10))
        q = q.withColumn("lo", F.when(F.col("hi").isNotNull(), F.col("lo")))
        prefilter = Prefilter(F.col("want"), F.col("lo"), F.col("hi"), F.col("gender"), F.col("age"))
    out = knn_join(q, b, k, threshold, dim, prefilter=prefilter, config=config)
    return {(r[0], r[1], round(r[2], 6)) for r in out.collect()}


@pytest.mark.parametrize("name", STRATEGIES)
@pytest.mark.parametrize("threshold", [0.45, -1.0])
def test_strategies_equal_brute_force(spark, name, threshold):
    queries, base = people(1, 60, 8), people(2, 150, 8)
    want = brute_force(queries, base, 5, threshold)
    assert run(spark, queries, base, 5, threshold, 8, STRATEGIES[name]) == want


@pytest.mark.parametrize("name", STRATEGIES)
def test_a_third_of_the_rows_are_copies(spark, name):
    queries, base = people(1, 45, 6, copies=15), people(2, 120, 6, copies=40)
    want = brute_force(queries, base, 7, 0.45)
    assert run(spark, queries, base, 7, 0.45, 6, STRATEGIES[name]) == want


@pytest.mark.parametrize("name", STRATEGIES)
def test_prefilter_equals_brute_force(spark, name):
    queries, base = people(1, 40, 6), people(2, 110, 6)

    def allowed(q, b):
        if q[2] is not None and q[2] != b[2]:
            return False
        return q[3] % 2 == 1 or q[3] - 10 <= b[3] <= q[3] + 10

    want = brute_force(queries, base, 4, 0.2, allowed)
    assert run(spark, queries, base, 4, 0.2, 6, STRATEGIES[name], prefilter=True) == want


@pytest.mark.parametrize("name", STRATEGIES)
def test_many_small_batches(spark, name):
    """A block's queries and base rows arrive in several batches, some of them mixed."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    queries, base = people(1, 50, 6, copies=11), people(2, 130, 6, copies=17)
    spark.conf.set(setting, "4")
    try:
        got = run(spark, queries, base, 6, 0.3, 6, STRATEGIES[name])
    finally:
        spark.conf.set(setting, before)
    assert got == brute_force(queries, base, 6, 0.3)


@pytest.mark.parametrize("name", STRATEGIES)
def test_empty_sides(spark, name):
    rows = people(1, 10, 6)
    assert run(spark, rows, [], 3, 0.0, 6, STRATEGIES[name]) == set()
    assert run(spark, [], rows, 3, 0.0, 6, STRATEGIES[name]) == set()


def test_unusable_vectors_take_no_part(spark):
    rows = people(1, 10, 6)
    odd = [("short", [1.0, 2.0], None, 1), ("none", None, None, 1)]
    got = run(spark, rows + odd, rows + odd, 20, -1.0, 6, KnnConfig())
    assert not {"short", "none"} & {p for pair in got for p in pair[:2]}


def test_auto_never_ships_a_side_above_the_limit(spark):
    tiny = KnnConfig(broadcast_bytes=4096, block_rows=16, rows_per_pivot=30)
    queries, base = people(1, 80, 8), people(2, 90, 8)
    q, b = [spark.createDataFrame(r, SCHEMA) for r in (queries, base)]
    plan = knn_join(q, b, 5, 0.45, 8, config=tiny)
    text = plan._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in text
    got = {(r[0], r[1], round(r[2], 6)) for r in plan.collect()}
    assert got == brute_force(queries, base, 5, 0.45)


def test_wide_rows_are_not_shipped(spark):
    config = KnnConfig(broadcast_bytes=20_000)
    q, b = [spark.createDataFrame(people(s, 30, 8), SCHEMA) for s in (1, 2)]
    wide = b.withColumn("gender", F.repeat(F.lit("x"), 2000))
    plans = [
        knn_join(q, side, 5, 0.45, 8, base_columns=["gender"], config=config)
        for side in (b, wide)
    ]
    shipped = ["MapInArrow" in p._jdf.queryExecution().toString() for p in plans]
    scanned = ["WindowGroupLimit" in p._jdf.queryExecution().toString() for p in plans]
    assert shipped == [True, True] and scanned == [False, True]
    rows = [sorted((r[0], r[1]) for r in p.collect()) for p in plans]
    assert rows[0] == rows[1]


def test_carried_columns(spark):
    rows = people(1, 10, 6)
    q = spark.createDataFrame(rows, SCHEMA)
    out = knn_join(q, q, 1, 0.9, 6, query_columns=["age"], base_columns=["gender"])
    for r in out.collect():
        assert r.query.point_id == r.query_id and r.candidate.point_id == r.candidate_id
        assert r.query.age is not None and "gender" in r.candidate.asDict()


def test_block_pairs_refuse_a_wrong_order():
    import pyarrow as pa

    from homeward.operators import knn_kernels as kernels

    def batch(flags):
        columns = {"id": [str(i) for i in range(len(flags))], "is_base": flags}
        columns |= {"query": [None] * len(flags), "candidate": [None] * len(flags)}
        return pa.RecordBatch.from_pydict(columns)

    assert len(kernels.leading_queries(iter([batch([False, False, True])]))[0]) == 2
    with pytest.raises(ValueError, match="precede"):
        kernels.leading_queries(iter([batch([True, False])]))
    with pytest.raises(ValueError, match="precede"):
        kernels.leading_queries(iter([batch([False]), batch([True, False])]))


@pytest.mark.parametrize("prunes", [True, False])
@pytest.mark.parametrize("name", ["blocked", "blocked_small_tiles"])
def test_by_cells_and_in_one_grid_are_the_same(spark, monkeypatch, name, prunes):
    monkeypatch.setattr(knn._Job, "_prunes", lambda *_: prunes)
    queries, base = people(1, 60, 8, copies=9), people(2, 150, 8, copies=30)
    for threshold in (0.45, -1.0):
        want = brute_force(queries, base, 5, threshold)
        assert run(spark, queries, base, 5, threshold, 8, STRATEGIES[name]) == want


def test_scores_found_first_keep_cells_out_of_reach():
    """In two passes a query meets fewer cells than the bound on distances alone allows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    base = centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pivots = base[:60]
    angles = knn_kernels.angles_to(base, pivots)
    cell = angles.argmin(axis=1)
    rows = np.bincount(cell, minlength=60).astype(float)
    own = angles[np.arange(4000), cell]
    near = np.array([own[cell == c].min(initial=np.pi) for c in range(60)])
    far = np.array([own[cell == c].max(initial=0) for c in range(60)])
    queries, k = base[100:200], 10
    at = knn_kernels.angles_to(queries, pivots)
    scores = np.round(queries @ base.T, 9)
    first = knn_kernels.nearest_cells(at, rows, k)
    assert (rows[None, :] * first).sum(axis=1).min() >= k
    floors = np.array([np.sort(s[f[cell]])[-k] for s, f in zip(scores, first)])
    one = knn_kernels.reachable_cells(at, rows, near, far, 0.1, k)
    two = knn_kernels.reachable_cells(at, rows, near, far, floors, k) | first
    assert two.sum() < 0.7 * one.sum()
    for s, reach in zip(scores, two):  # and none of the best is out of reach
        best = np.argsort(-s, kind="stable")[:k]
        assert reach[cell[best]].all()


BOTH = {n: c for n, c in STRATEGIES.items() if "queries" not in n}


@pytest.mark.parametrize("name", BOTH)
@pytest.mark.parametrize("copies", [0, 20])
def test_both_directions_from_one_product(spark, monkeypatch, name, copies):
    left, right = people(1, 60, 8, copies), people(2, 110, 8, 2 * copies)
    for k, threshold in ((5, 0.45), (3, -1.0)):
        frames = [spark.createDataFrame(r, SCHEMA).repartition(3) for r in (left, right)]
        rows = knn_both(*frames, k, threshold, 8, config=BOTH[name]).collect()
        got = {d: {(r.query_id, r.candidate_id, round(r.face_similarity, 6)) for r in rows if r.reverse == d}
               for d in (False, True)}
        assert got == {False: brute_force(left, right, k, threshold), True: brute_force(right, left, k, threshold)}
        assert len(rows) == sum(map(len, got.values()))


def test_both_directions_score_a_pair_once(monkeypatch):
    import pyarrow as pa

    def side(seed, n):
        rows = people(seed, n, 6)
        ids = pa.array([r[0] for r in rows])
        return pa.table({"id": ids, "vector": pa.array([r[1] for r in rows]), "row": ids})

    seen = []
    original = knn_kernels._tile_pairs_of_both
    monkeypatch.setattr(
        knn_kernels, "_tile_pairs_of_both",
        lambda q, b, rows, part, *rest: (seen.append(len(q.unit[rows]) * len(b.unit[part])), original(q, b, rows, part, *rest))[1],
    )
    best = knn_kernels.BestOfBoth(side(1, 50), knn_kernels.Search(3, 0.2, (16, 8), False))
    batches = [b for seed in (2, 3) for b in best.add(side(seed, 30))] + list(best.batches())
    assert sum(seen) == 50 * 60
    assert {b.column("reverse")[0].as_py() for b in batches} == {True, False}


def test_grid_moves_the_fewest_bytes_that_keep_cores_busy(spark):
    base = spark.createDataFrame(people(1, 4, 6), SCHEMA)
    job = knn._Job(base, base, (base, base), 50, 0.45, 512, False, KnnConfig())
    sizes = {}
    for n in (20_000, 100_000, 10_000_000, 1_000_000_000):
        query_rows, base_rows = job._grid(n, n)
        q, b = -(-n // query_rows), -(-n // base_rows)
        assert q * b >= knn._TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        sizes[n] = (n * q * 2048 + n * b * (2048 + 50 * 64)) / (2 * n)
        # What a task holds stays within its limits.
        assert query_rows * (2 * 2048 + 50 * 64) <= KnnConfig().block_bytes + 8192
        assert base_rows * 2048 <= KnnConfig().task_bytes + 2048
    assert sizes[100_000] <= 1.1 * sizes[20_000]


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 64])
def test_both_directions_of_more_rows_than_a_task_holds(spark, broadcast_bytes):
    """No task keeps the best of all base rows: a search for each direction."""
    config = KnnConfig(task_results=50, broadcast_bytes=broadcast_bytes, rows_per_pivot=20)
    left, right = people(1, 60, 8, 9), people(2, 110, 8, 20)
    frames = [spark.createDataFrame(r, SCHEMA) for r in (left, right)]
    pairs = knn_both(*frames, 5, 0.45, 8, config=config)
    rows = pairs.collect()
    got = {d: {(r.query_id, r.candidate_id, round(r.face_similarity, 6)) for r in rows if r.reverse == d}
           for d in (False, True)}
    assert got == {False: brute_force(left, right, 5, 0.45), True: brute_force(right, left, 5, 0.45)}
    job = knn._Job(*[knn._side(f, "point_id", "embedding", [], 8, "", None) for f in frames],
                   frames, 5, 0.45, 8, False, config)
    assert job._few() < 110 and len(rows) == sum(map(len, got.values()))


def test_angles_to_many_cells_are_held_for_few_rows():
    import tracemalloc

    rng = np.random.default_rng(3)
    vectors, pivots = rng.normal(size=(3000, 4)), rng.normal(size=(8000, 4))
    tracemalloc.start()
    cell, angle = knn_kernels.nearest_of(vectors, pivots)
    lists = knn_kernels.cell_lists(
        knn_kernels.angles_to(vectors[some], pivots) < 0.01 for some in knn_kernels.some_rows(3000, 8000)
    )
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # one matrix of all angles has 192 MB
    whole = knn_kernels.angles_to(vectors, pivots)
    assert (cell == whole.argmin(axis=1)).all() and np.allclose(angle, whole.min(axis=1))
    assert lists.to_pylist() == [np.flatnonzero(row < 0.01).tolist() for row in whole]
    left = knn_kernels.without_listed(np.ones((3, 4), bool), lists.from_pandas([[1], None, [0, 3]]))
    assert left.tolist() == [[True, False, True, True], [True] * 4, [False, True, True, False]]


def test_given_blocks_are_copied_a_bounded_number_of_times(spark):
    base = spark.createDataFrame(people(1, 4, 6), SCHEMA)
    job = knn._Job(base, base, (base, base), 10, 0.1, 64, False, KnnConfig(block_rows=64))
    assert job._grid(4000, 1000) == (64, 64)
    for n in (50_000, 300_000, 1_000_000):
        query_rows, base_rows = job._grid(n, n)
        assert -(-n // query_rows) <= knn._MOST_BLOCKS and -(-n // base_rows) <= knn._MOST_BLOCKS
