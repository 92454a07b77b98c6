import numpy as np
import pytest
from pyspark.sql import types as T

from homeward.llm import nn_descent

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("node", "space", "n_links", "kept", "id")],
])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcde") for i, v, label in rows], SCHEMA)


def brute(rows, similarity=0.98):
    """(links, component) of rows with an id, in order."""
    rows = [r for r in rows if r[0] is not None]

    def sound(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    found = {}
    near = [[] for _ in rows]
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la == lb and sound(a, la) and sound(b, lb) and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity:
                    near[i].append(j)
    for i, (vec_id, _, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            new = [j for j in near[queue.pop()] if j not in seen]
            seen.update(new)
            queue += new
        found.setdefault(vec_id, []).append((len(near[i]), min(rows[j][0] for j in seen)))
    return found


def check(spark, rows):
    got = {}
    for r in nn_descent.near_duplicates(frame(spark, rows)).collect():
        if r.vec_id is None:
            assert r.n_links == 0 and r.component_id is None and r.kept is None
            continue
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
        assert r.kept == (r.vec_id == r.component_id)
    want = brute(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def f32(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def test_clusters_pairs_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f32(rng.normal(size=16)), i % 3) for i in range(150)]
    for label, size, spread in ((0, 60, 0.02), (1, 25, 0.05), (2, 2, 0.01)):
        center = rng.normal(size=16)
        for _ in range(size):
            rows.append((len(rows), f32(center + spread * rng.normal(size=16)), label))
    rows += [(len(rows) + k, rows[5][1], rows[5][2]) for k in range(40)]  # exact copies
    rows.append((len(rows), rows[5][1], (rows[5][2] + 1) % 3))  # the same in another label
    rows.append((len(rows), [2 * x for x in rows[7][1]], rows[7][2]))  # the same direction
    check(spark, rows)


def test_odd_vectors(spark):
    good = [1.0, 2.0, 3.0]
    rows = [
        (1, good, 0), (1, good, 0), (2, good, 0), (3, good, None), (4, None, 0), (5, [], 0),
        (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [float("nan"), 2.0, 3.0], 0),
        (9, [float("inf"), 2.0, 3.0], 0), (None, good, 0), (10, [1.0, 2.0], 0), (11, [1.0, 2.0], 0),
        (12, [1e-30, 2e-30, 3e-30], 0), (13, [1e30, 2e30, 3e30], 0),
    ]
    check(spark, rows)


def test_empty(spark):
    assert nn_descent.near_duplicates(frame(spark, [])).count() == 0


def test_saturated_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(3)
    center = rng.normal(size=8)
    rows = [(i, f32(center + 0.03 * rng.normal(size=8)), 0) for i in range(150)]
    check(spark, rows)


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "PART", 16)
    monkeypatch.setattr(nn_descent, "LIST", 2)
    monkeypatch.setattr(nn_descent, "LONGEST", 2)
    rng = np.random.default_rng(5)
    center = rng.normal(size=8)
    rows = [(i, f32(center + 0.01 * rng.normal(size=8)), 0) for i in range(150)]
    check(spark, rows)


def test_close_groups_are_joined_though_their_lists_are_full(spark):
    rng = np.random.default_rng(6)
    rows = []
    for size in (40, 12):
        a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        for center in (a, 0.985 * a + np.sqrt(1 - 0.985**2) * b):
            for _ in range(size):
                rows.append((len(rows), f32(center + 0.0005 * rng.normal(size=16)), size))
    check(spark, rows)


def test_planes_follow_from_the_label_itself(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BUCKET", 2)
    monkeypatch.setattr(nn_descent, "TABLES", 1)
    monkeypatch.setattr(nn_descent, "RECALL", 0.0)  # one set of tables
    rng = np.random.default_rng(7)
    rows = [(i, f32(v), 0) for i, v in enumerate(rng.normal(size=(4096, 16)))]
    for label in range(1, 41):  # small labels with one pair at 0.985 each
        a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        for v in (a, 0.985 * a + np.sqrt(1 - 0.985**2) * b):
            rows.append((len(rows), f32(v), label))
    got = nn_descent.near_duplicates(frame(spark, rows)).filter("vec_id >= 4096")
    assert [r.n_links for r in got.collect()] == [1] * 80


def test_query(run, spark, sf_dir):
    got = run("op1_nn_descent", "vec_id")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    assert {r.vec_id: got[r.vec_id].n_links for r in rows} == {
        r.vec_id: n for r, n in zip(rows, linked.sum(1).tolist())
    }


def test_audit_finds_what_components_miss(spark):
    rows = [(i, [1.0, 0.01 * i], 0) for i in range(10)]
    nodes = frame(spark, rows).selectExpr(
        "vec_id as node", "cast(0 as bigint) as space", "embedding as vector"
    )
    none = spark.createDataFrame([], "node long, root long")
    all_one = nodes.selectExpr("node", "cast(0 as bigint) as root")
    assert nn_descent.audited(nodes, none, 10, 0.98) == (0.0, 10)
    assert nn_descent.audited(nodes, all_one, 10, 0.98) == (pytest.approx(1.0), 10)
    assert nn_descent.audited(nodes.limit(1), none, 1, 0.98) == (None, 0)


def test_audit_draws_until_it_sees_linked_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(3_010, 24)))]
    for i in range(10):  # ten linked pairs among three thousand others
        rows[300 * i] = (300 * i, rows[300 * i + 7][1], 0)
    nodes = frame(spark, rows).selectExpr(
        "vec_id as node", "cast(0 as bigint) as space", "embedding as vector"
    )
    none = spark.createDataFrame([], "node long, root long")
    assert nn_descent.audited(nodes, none, 3_010, 0.98) == (0.0, 20)


def test_audit_counts_each_vector_not_each_link(spark):
    rows = [(i, [1.0, 0.001 * i], 0) for i in range(60)]
    rows += [(60 + i, [0.01 * i, 1.0], 0) for i in range(2)]
    nodes = frame(spark, rows).selectExpr(
        "vec_id as node", "cast(0 as bigint) as space", "embedding as vector"
    )
    group = nodes.filter("node < 60").selectExpr("node", "cast(0 as bigint) as root")
    assert nn_descent.audited(nodes, group, 62, 0.98) == (0.0, 62)


def test_descent_goes_on_for_few_new_pairs_beside_a_dense_group(spark):
    dense = [(x, y, 0.999) for x in range(1000) for y in range(x + 1, x + 9)]
    columns = "x long, y long, sim double"
    lists = spark.createDataFrame([*dense, (5000, 5001, 0.5)], columns)
    better = spark.createDataFrame([*dense, (5000, 5002, 0.99)], columns)
    assert not nn_descent._settled(better, lists, 8, 0.98)
    assert nn_descent._settled(better, better, 8, 0.98)
    moved = spark.createDataFrame([(x, y + 100, s) for x, y, s in dense], columns)
    assert nn_descent._settled(moved, lists, 8, 0.98)  # saturated lists are completed otherwise
