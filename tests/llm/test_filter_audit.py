import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from homeward.llm import filter_audit


def steps(cells, letters="ABCDE"):
    """All orders by filtering one after the other."""
    want, total = {}, Counter()
    bit = {c: 1 << i for i, c in enumerate(letters)}
    for order in itertools.permutations(letters):
        left = dict(cells)
        for step, c in enumerate(order, 1):
            gone = {m: v for m, v in left.items() if m & bit[c]}
            left = {m: v for m, v in left.items() if not m & bit[c]}
            removed = sum(v[0] for v in gone.values())
            failing = sum(v[0] for m, v in cells.items() if m & bit[c])
            total[c] += removed
            want["".join(order), step] = (
                sum(v[0] for v in left.values()), removed, failing - removed,
                cells.get(bit[c], (0,))[0], sum(v[1] for v in gone.values()), sum(v[2] for v in gone.values()),
            )
    return {k: (*v, total[k[0][k[1] - 1]]) for k, v in want.items()}


def listed(rows):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}


def test_all_orders_of_random_masks():
    rng = random.Random(4)
    for letters in ("A", "AB", "ABC", "ABCDE"):
        for _ in range(15):
            masks = rng.sample(range(1 << len(letters)), rng.randint(1, 1 << len(letters)))
            cells = {m: (rng.choice([0, 1, 1, 7]), rng.randint(0, 2), rng.randint(0, 1)) for m in masks}
            assert listed(filter_audit.audit_part("p", cells, letters)) == steps(cells, letters)


def test_neighbour_changes_visit_every_order_once():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for at in filter_audit.neighbour_changes(k):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(k)


def test_equal_nodes_are_shared():
    # The last two filters fail together whatever the first three say.
    cells = {m + t: (5, 0, 0) for m in range(8) for t in (0, 24)}
    diagram = filter_audit.Diagram(cells, 5)
    # Level 0 decides filter 0 and so on; counts are equal below, so each level holds few nodes.
    assert [len(nodes) for nodes in diagram.nodes] == [1, 1, 1, 1, 2]
    for at in filter_audit.neighbour_changes(5):
        diagram.exchange(at)
        assert all(len(nodes) <= 8 for nodes in diagram.nodes)
        assert diagram.weights[0][diagram.root] == (80, 0, 0)


def masks(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    cells = defaultdict(Counter)
    for i, text, lang in rows:
        text = text or ""
        words = text.encode().split()
        mask = (
            (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
            + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
            + 8 * any(c in "#$%&*|" for c in text) + 16 * (i is not None and i > least[text])
        )
        known = i is not None
        cells[lang or "", mask].update(n=1, good=int(known and i in good), toxic=int(known and i in toxic))
    return {k: (c["n"], c["good"], c["toxic"]) for k, c in cells.items()}


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_mask_counts_of_edge_rows(spark, edge, empty, labels):
    more = [(30 + i, t, "en") for i, t in enumerate(["SHOUT " * 120, "a|b " * 3, "w " * 200, "w " * 200, "é" * 9 + "Q"])]
    rows = edge.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "a long, b string, c string"))
    want = masks([tuple(r) for r in rows.collect()], [tuple(r) for r in labels.collect()])
    got = {(r.part, r["mask"]): (r.n, r.good, r.toxic) for r in filter_audit.mask_counts(rows, labels).collect()}
    assert got == want
    # Other columns do not matter, also where they have the names of the results.
    clashing = edge.withColumnsRenamed({"size": "Mask", "node": "part", "hash": "Same", "ids": "good"})
    again = filter_audit.mask_counts(clashing, labels).agg({"n": "sum"}).first()[0]
    assert again == edge.count()
    assert filter_audit.audit(filter_audit.mask_counts(empty, labels)).count() == 0


def test_a_text_that_a_third_of_all_rows_share(spark, labels):
    rows = spark.range(9_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text", "'x' as lang")
    counts = {r["mask"]: r.n for r in filter_audit.mask_counts(rows, labels).collect()}
    assert counts == {1: 6_001, 17: 2_999}


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGHI")
