import math
import random
import re
from collections import Counter

import xxhash

from homeward.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    covered = {j + k for j, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def hash64(*parts):
    """Spark's xxhash64 of strings or longs: the hash of one is the seed of the next."""
    seed = 42
    for part in parts:
        data = part.encode() if isinstance(part, str) else part.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def grams(text, bits):
    hashes = [hash64(w) for w in WORD.findall(text or "")]
    every = hashes + [hash64(a, b) for a, b in zip(hashes, hashes[1:])]
    return [h & ((1 << bits) - 1) for h in every]


def steps(texts, trusted, prior=quality_rules.PRIOR):
    """(bits, step of each bucket) by counting n-grams one by one."""
    total = sum(max(0, 2 * len(WORD.findall(texts.get(i) or "")) - 1) for i in trusted)
    bits = quality_rules.LEAST_BITS
    while bits < quality_rules.MOST_BITS and total >= quality_rules.PER_BUCKET << (bits + 1):
        bits += 1
    by_doc = {i: grams(t, bits) for i, t in texts.items()}
    raw = Counter(g for found in by_doc.values() for g in found)
    target = Counter(g for i in trusted for g in by_doc.get(i, ()))
    raw_total, target_total, weight = sum(raw.values()), sum(target.values()), prior * (1 << bits)
    share = {g: (target[g] + weight * (raw[g] / raw_total)) / (target_total + weight) for g in raw}
    return bits, by_doc, {g: round(math.log(share[g] / (raw[g] / raw_total)) * quality_rules.STEPS) for g in raw}


def test_query_equals_brute_force(run, spark, sf_dir, texts):
    got = run("op4_ngram_ratio")
    assert set(got) == set(texts)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = {r.doc_id for r in quality_rules.trusted_ids(labels).collect()}
    assert trusted == {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    _, by_doc, step = steps(texts, trusted)
    kept = 0
    for i, text in texts.items():
        r = got[i]
        want = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        score = sum(step[g] for g in by_doc[i]) / quality_rules.STEPS / max(1, len(by_doc[i]))
        assert abs(r.score - score) < 1e-9
        assert r.kept == (not want[5] and r.score >= quality_rules.THRESHOLD)
        kept += r.kept
    assert 0 < kept < len(texts)


def test_buckets_grow_with_the_target(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PER_BUCKET", 1)
    monkeypatch.setattr(quality_rules, "LEAST_BITS", 4)
    monkeypatch.setattr(quality_rules, "MOST_BITS", 10)
    seen = []
    for n in (2, 20, 200, 2_000):
        texts = {i: f"word{i} other{i % 7} third{i % 11}" for i in range(n)}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        trusted = spark.createDataFrame([(i,) for i in range(0, n, 2)], "doc_id long")
        ratios = quality_rules.log_ratios(docs, trusted)
        bits, _, step = steps(texts, set(range(0, n, 2)))
        assert ratios.bits == bits
        found = [int(x) for x in ratios.steps.split(",")]
        assert len(found) == 1 << bits
        assert all(abs(found[g] - s) <= 1 for g, s in step.items())  # a half may round either way
        assert all(s == 0 for g, s in enumerate(found) if g not in step)
        seen.append(bits)
    assert seen == sorted(seen) and seen[0] == 4 and seen[-1] == 10


def test_many_trusted_ids_are_joined_by_a_shuffle(edge, spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    want = quality_rules.log_ratios(edge, quality_rules.trusted_ids(labels))
    monkeypatch.setattr(quality_rules, "SHIPPED_IDS", 1)
    assert quality_rules.log_ratios(edge, quality_rules.trusted_ids(labels)) == want


def test_clean_documents_stay_and_symbol_junk_goes(run, spark, sf_dir):
    got = run("op4_ngram_ratio")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    clean = [got[r.doc_id] for r in labels if r.quality == 1 and r.doc_id in got]
    assert all(r.kept or r.base_failed for r in clean)
    junk = [got[r.doc_id] for r in labels if r.quality == 0 and r.doc_id in got]
    assert sum(not r.kept for r in junk) >= 0.8 * len(junk)


def test_edge_rows_and_columns(edge, empty, spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (None, 1, 0), (99, 1, 0), (3, None, None)],
        "doc_id long, quality int, toxic int",
    )
    judged = quality_rules.judge(edge, labels, out="verdict")
    assert judged.columns == [*edge.columns, "verdict"]
    for r in judged.collect():
        v = r.verdict
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == base(r.text)
        if not v.n_words:
            assert v.score == 0 and not v.kept
    kept = quality_rules.keep_good(edge, labels)
    assert kept.columns == edge.columns and 1 in {r.doc_id for r in kept.collect()}
    assert quality_rules.keep_good(empty, labels).count() == 0


def test_a_column_with_the_name_of_the_result(edge, spark):
    clashing = edge.withColumnsRenamed({"size": "Quality", "node": "hs", "hash": "TS"})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality_rules.judge(clashing, labels)
    assert judged.columns == [*clashing.columns, "_quality"]
    assert {(r.Quality, r.TS) for r in judged.collect()} == {("x", "x")}
    assert quality_rules.keep_good(clashing, labels).columns == clashing.columns


def test_repeated_windows_in_long_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 90))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t"]) for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(docs, labels).collect():
        v = r.quality
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == base(r.text)


def test_without_trusted_documents_only_base_rules_decide(edge, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(edge, labels).collect():
        assert r.quality.score == 0 and r.quality.kept == (not r.quality.base_failed)
