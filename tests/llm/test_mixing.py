import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from homeward.llm import mixing


def level_targets(sizes):
    """Targets by raising the level until nobody new is capped; sources in order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float((1, 2, 3)[i % 3]) for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def check(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = level_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    return want, taken


def flat(docs):
    mixed = mixing.mix(docs, "dealt")
    return mixed.select("doc_id", "source", "dealt.*").collect()


def test_query(run, documents, texts):
    got = run("op2_budget_mix")
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i].size == len(text.encode().split())
    want, taken = check(flat(documents))
    for s in want:
        assert abs(taken[s] - want[s]) <= max(1, 0.005 * want[s])
    again = run("op2_budget_mix")
    assert got == again


def test_edge_rows_and_columns(edge, empty):
    rows = flat(edge)
    assert len(rows) == edge.count()
    check(rows)
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in mixing.mix(edge, "dealt").select("doc_id", "dealt.copies").collect():
        want[r.doc_id] += r.copies
    assert copies == +want
    assert mixing.mixed_documents(empty).count() == 0
    assert flat(empty) == []


def test_all_sources_capped_share_the_rest(spark):
    rows = [(i, "w " * 10, "big") for i in range(50)] + [(100, "w " * 5, "a"), (101, "w", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, taken = check(flat(docs))
    assert want["a"] == 15 and want["c"] == 3 and sum(want.values()) == pytest.approx(506)
    assert abs(taken["big"] - want["big"]) <= 10


def test_fit_is_best_below_the_budget():
    rng = np.random.default_rng(2)
    for _ in range(100):
        lengths = np.unique(rng.integers(1, 30, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        every = itertools.product(*[range(c + 1) for c in counts])
        reach = [int(np.dot(x, lengths)) for x in every]
        assert int((take * lengths).sum()) == max(s for s in reach if s <= budget)


def test_few_long_lengths_come_close_to_a_large_budget():
    lengths = np.array([3, 50_000, 70_001])
    take = mixing.fit_budget(lengths, np.array([5, 40, 40]), 1_000_000)
    assert 0 <= 1_000_000 - int((take * lengths).sum()) < 70_001


@pytest.mark.parametrize("part", [0.1, 0.37, 0.6, 0.93])
def test_every_stretch_of_lengths_gives_its_share(part):
    """Real lengths, hardly two documents alike: the budget is met, and not by the longest."""
    rng = np.random.default_rng(4)
    lengths, counts = np.unique(rng.lognormal(5.5, 1.2, 4_000).astype(np.int64) + 1, return_counts=True)
    total = int((lengths * counts).sum())
    budget = int(part * total)
    take = mixing.fit_budget(lengths, counts, budget, 5)
    assert (take >= 0).all() and (take <= counts).all()
    assert int((take * lengths).sum()) == budget
    for stretch in np.array_split(np.arange(len(lengths)), 8):
        words = (lengths * counts)[stretch].sum()
        off = (lengths * take)[stretch].sum() - part * words
        # A document at either end of the stretch, and what programming adds to it.
        assert abs(off) <= 4 * lengths[stretch].max() + 0.02 * words
    again = mixing.fit_budget(lengths, counts, budget, 5)
    assert (take == again).all()


def test_very_many_equal_rows_are_ranked_as_one(spark):
    rows = spark.range(5_000).selectExpr("cast(null as long) as doc_id", "'w w w' as text", "'a' as source")
    rows = rows.unionByName(
        spark.range(3_000).selectExpr("id as doc_id", "concat('x ', id, ' y z ', id % 7) as text", "'b' as source")
    )
    found = flat(rows)
    assert len(found) == 8_000
    want, taken = check(found)
    for s in want:
        assert abs(taken[s] - want[s]) <= 5
    copies = Counter(r.copies for r in found if r.doc_id is None)
    assert sum(copies.values()) == 5_000 and max(copies) - min(copies) <= 1


def test_a_column_with_the_name_of_the_result(edge):
    clashing = edge.withColumnsRenamed({"mix": "Mix", "size": "no_source"})
    mixed = mixing.mix(clashing)
    assert mixed.columns == [*clashing.columns, "_mix"]
    assert {r.Mix for r in mixed.collect()} == {"x"}
    assert mixing.mixed_documents(clashing).columns == clashing.columns
