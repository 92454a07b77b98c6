import random

import numpy as np
import pytest

from homeward.llm import periodic


def brute(words, least=24, exponent=3):
    """Every stretch with a period by comparing all lags; the ones inside a smaller period's go."""
    stretches = []
    for q in range(1, len(words) // exponent + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                stretches.append((i - q, j - i + q, q))
            i = max(j, i + 1)
    inside = lambda s, t: t[2] < s[2] and t[0] <= s[0] and s[0] + s[1] <= t[0] + t[1]
    found = [s for s in stretches if not any(inside(s, t) for t in stretches)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def cut(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts, **limits):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return periodic.find_runs(data, np.cumsum([0, *[len(t.encode()) for t in texts]]), **limits)


@pytest.mark.parametrize("limits", [{}, {"least": 4}, {"least": 9, "exponent": 4}])
def test_runs_of_random_blocks(limits):
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words, letters = [], "abcdefgh"[: rng.randint(1, 7)]
            for _ in range(rng.randint(0, 6)):
                words += [rng.choice(letters) for _ in range(rng.randint(1, 12))] * rng.randint(1, 8)
                words += ["odd"] * (rng.random() < 0.3)
            texts.append(" ".join(words))
        assert found(texts, **limits) == [brute(t.split(), **limits) for t in texts]


def test_long_periods_and_one_word_over_and_over():
    block = [f"w{i}" for i in range(700)]
    words = [*block[:50], *block, *block, *block, *block[:300]]
    assert found([" ".join(words)]) == [[(50, 2400, 700)]]
    # Two hundred thousand equal words: pairs of occurrences would be 2e10.
    assert found(["a " * 200_000 + "b"]) == [[(0, 200_000, 1)]]


def test_rows_and_columns(spark, edge, empty):
    rows = edge.union(spark.createDataFrame(
        [(20, "x " * 30 + "y " * 30, *[None] * 14), (21, "one two three " * 9 + "é ü " * 20, *[None] * 14)],
        edge.schema,
    ))
    got = periodic.periodic(rows)
    assert got.columns == [*edge.columns, "periodic"]
    kept = got.collect()
    assert len(kept) == rows.count()
    for r in kept:
        words = (r.text or "").encode().split()
        want = brute(words) if len(words) < 5_000 else []
        assert [tuple(x) for x in r.periodic.runs] == want
        assert r.periodic.n_words == len(words)
        assert r.periodic.collapsed == cut([w.decode() for w in words], want)
    assert periodic.periodic(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic(edge, min_exponent=2)


def test_clashing_output_name(edge):
    clashing = edge.withColumnRenamed("size", "Periodic")
    got = periodic.periodic(clashing)
    assert got.columns == [*clashing.columns, "_periodic"]
    assert {r.Periodic for r in got.collect()} == {"x"}
