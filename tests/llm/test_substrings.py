import hashlib
from collections import defaultdict

import numpy as np
import pytest

from homeward.llm import substrings


def brute(rows, n):
    """(id, words, removed, kept) of each row, by direct comparison of windows."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None and text is not None:
            words = text.encode().split()
            for p in range(len(words) - n + 1):
                key = tuple(words[p : p + n])
                first[key] = min(first.get(key, doc_id), doc_id)
    found = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for p in range(len(words) - n + 1):
            if doc_id is not None and first[tuple(words[p : p + n])] < doc_id:
                covered[p : p + n] = [True] * n
        kept = b" ".join(w for w, c in zip(words, covered) if not c).decode()
        found.append((doc_id, len(words), sum(covered), kept))
    return found


def compare(docs, n=50):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n)
    got = [tuple(r) for r in substrings.without_repeats(docs, n).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    return want


def test_query(run, texts):
    got = run("op3_count_min_repeats")
    for doc_id, n, removed, kept in brute(list(texts.items()), 50):
        r = got[doc_id]
        assert (r.n_words, r.n_removed) == (n, removed)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_edge_rows_and_columns(edge, empty):
    want = compare(edge)
    assert any(r[2] for r in want)
    assert substrings.without_repeats(empty).count() == 0


def test_shared_passages_overlaps_and_loops(spark):
    rng = np.random.default_rng(6)
    word = lambda k: [f"v{i}" for i in rng.integers(0, 500, k)]
    passage, other = word(70), word(55)
    rows = [(i, " ".join(word(int(rng.integers(0, 90))) + passage + word(20))) for i in range(60)]
    rows += [(100 + i, "\n".join(other + passage[:50] + other)) for i in range(5)]
    rows += [(200, "loop loop " * 200), (201, "loop " * 60), (202, " ".join(passage[:49])), (203, " ".join(passage[1:51]))]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_small_flushes_and_other_lengths(spark, documents, monkeypatch):
    monkeypatch.setattr(substrings, "_FLUSH", 100)
    monkeypatch.setattr(substrings, "_SLICE", 5_000)
    compare(documents.repartition(3), 20)


@pytest.mark.parametrize("n", [50, 20])
def test_a_sketch_that_stays_apart_finds_the_same(documents, monkeypatch, n):
    monkeypatch.setattr(substrings, "SHIPPED_CELLS", 64)
    compare(documents.repartition(3), n)


def test_few_unrepeated_windows_pass_a_sketch_that_stays_apart(spark):
    """The share that passes does not grow with the keys, however few cells could be shipped."""
    for size in (2_000, 40_000):
        docs = spark.range(size // 100).selectExpr(
            "id as doc_id", "array_join(transform(sequence(1, 400), x -> concat('w', id * 1000 + x)), ' ') as text"
        )
        n = 50
        keys = size // 100 * 400 // 20
        cells = 1 << (keys * substrings.CELLS_PER_KEY - 1).bit_length()
        likely = substrings._likely_apart(docs, n, cells)
        passing = likely.selectExpr("sum(size(likely))").first()[0] or 0
        assert passing <= 0.05 * keys


def test_windows_that_agree_in_one_hash_are_told_apart():
    ids, places = np.array([1, 2, 3]), np.array([0, 0, 0])
    same, more = np.array([7, 7, 7]), np.array([1, 2, 1])
    (_, _, open_ids, _), (lost_ids, _, _) = substrings._settle(ids, places, (same, more))
    assert sorted(open_ids.tolist()) == [1, 2] and lost_ids.tolist() == [3]


def test_sketch_never_underestimates(documents):
    n, cells = 50, 1 << 12
    marked = substrings.sketch(documents, n, cells)
    seen = defaultdict(set)
    for r in documents.select("doc_id", "text").collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        hashes, first = substrings._hashed(data, np.array([0, len(data)]))
        for key in substrings._keys(hashes, first, n)[2].tolist():
            seen[key].add(r.doc_id)
    twice = np.array([k for k, ids in seen.items() if len(ids) > 1], np.uint64)
    assert len(twice)
    for row in range(substrings.DEPTH):
        at = substrings._cells(twice, row, cells)
        assert ((marked[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1).all()
