import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from homeward.llm import chosen_path, graph


def shingles(text, k=5):
    words = (text or "").encode().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[p : p + k]) for p in range(len(words) - k + 1)}


def brute(rows):
    """Sorted (id, class, links) of all rows by comparing all sets that share a shingle."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    where = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            where[x].append(n)
    root, links = list(range(len(rows))), Counter()

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for n, s in enumerate(sets):
        for m, common in Counter(m for x in s for m in where[x] if m > n).items():
            if common / (len(s) + len(sets[m]) - common) >= 0.8:
                links[n] += 1
                links[m] += 1
                root[find(m)] = find(n)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    found = [(i, None if i is None else least[find(n)], links[n]) for n, (i, _) in enumerate(rows)]
    return sorted(found, key=str)


def compare(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in chosen_path.classes(docs).collect()), key=str)
    want = brute(rows)
    assert got == want
    return want


def near_copies(rng, words, n, edits):
    for _ in range(n):
        copy = list(words)
        for p in rng.integers(0, len(words), edits):
            copy[p] = f"e{rng.integers(0, 10**9)}"
        yield " ".join(copy)


def test_query(run, texts):
    got = run("op9_chosen_path")
    want = brute(list(texts.items()))
    assert sorted(((i, r.class_id, r.n_links) for i, r in got.items()), key=str) == want


def test_edge_rows(edge, empty):
    compare(edge)
    assert chosen_path.classes(empty).count() == 0


def test_groups_around_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for edits in (1, 2, 3, 4, 6):
        words = [f"v{i}" for i in rng.integers(0, 10**6, 150)]
        rows += list(near_copies(rng, words, 25, edits))
    rows += [" ".join(f"u{i}" for i in rng.integers(0, 10**6, 60)) for _ in range(200)]
    want = compare(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert any(n > 10 for _, _, n in want)


def test_deep_paths_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LIMIT", 16)
    monkeypatch.setattr(chosen_path, "LEAF", 24)
    rng = np.random.default_rng(12)
    words = [f"v{i}" for i in range(120)]
    rows = list(near_copies(rng, words, 90, 1)) + [" ".join(words)] * 30
    want = compare(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert max(n for _, _, n in want) > 100


def test_one_of_each(edge, empty):
    kept = chosen_path.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 8, 10, None, None], key=str)
    assert chosen_path.one_of_each(empty).count() == 0


def test_runs_reach_the_recall():
    for depth in (1, 2, 3):
        runs = chosen_path.runs_needed(0.8, 0.9999, depth)
        reach = 1.0
        for _ in range(depth - 1):
            reach = 1 - (1 - 0.8 * reach) ** 2
        assert (1 - 0.8 * reach) ** runs <= 1e-4 < (1 - 0.8 * reach) ** (runs - 1)


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)],  # a path
    [(0, i) for i in range(1, 60)],  # a star
    [(9, 3), (3, 9), (4, 4), (7, 8), (8, 2), (2, 7), (-5, 9)],
    [],
])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    want = {x: find(x) for x in list(root)}
    assert {r.node: r.root for r in graph.components(frame, "test").collect()} == want


def test_runs_and_margin_together_keep_the_promise():
    p, n = chosen_path.SIMILARITY, chosen_path.HASHES
    least = math.ceil((p - chosen_path.MARGIN) * n)
    unlike = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least))
    for depth in range(1, chosen_path.MAX_DEPTH + 1):
        reach = 1.0
        for _ in range(depth - 1):
            reach = 1 - (1 - p * reach) ** 2
        apart = (1 - p * reach) ** chosen_path.runs_needed(p, chosen_path.RECALL, depth)
        assert apart + unlike < 1 - chosen_path.RECALL
