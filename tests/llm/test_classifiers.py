import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from homeward.llm import language, quality_model
from homeward.llm.common import drawn, stratified
from homeward.llm.queries import op5_subword_classifier, op10_language_filters

SF = "/root/testdata/sf0.01"


def held(doc_id, n, rest):
    return zlib.crc32(str(doc_id).encode()) % n == rest


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in op5_subword_classifier(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all(r.predicted == int(r.score >= 0.7) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held(r.doc_id, 4, 2)]
    right = [rows[r.doc_id].predicted == r.quality for r in labels if r.doc_id in rows]
    assert np.mean(right) >= 0.95
    again = {r.doc_id: r.score for r in op5_subword_classifier(spark, SF).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in op10_language_filters(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == held(i, 5, 0) and 0 <= r.score <= 1 for i, r in rows.items())
    right = [rows[r.doc_id].lang_pred == r.lang for r in docs if held(r.doc_id, 5, 0)]
    assert np.mean(right) >= 0.97


def test_scores_equal_the_average_of_features(spark, edge):
    rng = np.random.default_rng(0)
    model = quality_model.Model(rng.normal(size=quality_model.ROWS).astype(np.float32), 0.3)
    got = quality_model.score(edge, model).collect()
    texts = edge.select("text").collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        data = np.frombuffer((t.text or "").encode(), np.uint8)
        found = [rows[valid] for rows, valid, _ in quality_model._features(data, np.array([0, len(data)]))]
        values = model.rows[np.concatenate(found)].astype(np.float64)
        logit = values.mean() + 0.3 if len(values) else 0.3
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_quality_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (3, 0), (4, 0), (None, 1), (7, None), (99, 1), (5, 7)],
        "doc_id long, label int",
    )
    model = quality_model.train(edge, labels)
    scores = [r.score for r in quality_model.score(edge, model).collect()]
    assert len(scores) == edge.count() and all(0 <= s <= 1 for s in scores)
    assert quality_model.score(empty, quality_model.train(empty, labels)).count() == 0
    none = quality_model.train(edge, labels.limit(0))
    assert {r.score for r in quality_model.score(edge, none).collect()} == {0.5}
    good = quality_model.train(edge, labels.filter("doc_id = 2"))
    assert min(r.score for r in quality_model.score(edge, good).collect()) > 0.99


def test_language_edge_cases(spark, edge, empty):
    filters = language.learn(edge)
    rows = language.predict(edge, filters).collect()
    texts = [r.text for r in edge.select("text").collect()]
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in filters.names
    nothing = language.learn(empty)
    assert nothing.names == []
    assert {r.lang_pred for r in language.predict(edge, nothing).collect()} == {"und"}
    assert language.predict(empty, filters).count() == 0


def test_filters_hold_every_inserted_gram_and_many_languages(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} " * 20, f"l{i:03d}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs)
    assert len(filters.names) == 70 and len(filters.cells) == 2
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, filters).collect()}
    assert got == {i: name for i, _, name in rows}


def grams(text):
    """Runs of two to four letter bytes, one word at a time, with the blank at either edge."""
    blanked = bytes(
        c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()
    )
    for n in language.GRAMS:
        for i in range(len(blanked) - n + 1):
            run = blanked[i : i + n]
            if 32 not in run[1:-1]:
                yield run


def test_corrected_popcounts_equal_a_plain_count(spark, sf_dir, edge):
    """Grams looked up one by one in sets of the inserted ones, false positives included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = language.learn(docs)
    counts = {name: Counter() for name in filters.names}
    for r in docs.collect():
        counts[r.lang].update(grams(r.text))
    totals = {name: sum(c.values()) for name, c in counts.items()}
    typical = {}
    for name, c in counts.items():
        share = {g: n / totals[name] for g, n in c.items()}
        most = lambda g: max(counts[o][g] / totals[o] for o in counts)
        typical[name] = {
            g for g, s in share.items() if s >= language.MIN_SHARE and s >= language.RELATIVE * most(g)
        }

    def places(gram):
        code = np.array([int.from_bytes(gram, "little") | len(gram) << 56], np.uint64)
        return tuple(int(p[0]) for p in language._places(code))

    cells = {name: {c for g in found for c in places(g)} for name, found in typical.items()}
    rate = {name: (len(c) / language.CELLS) ** language.HASHES for name, c in cells.items()}
    for word, name in enumerate(filters.names):
        bits = filters.cells[word // 64] >> np.uint64(word % 64) & np.uint64(1)
        assert set(np.flatnonzero(bits).tolist()) == cells[name]
    some = docs.filter("length(text) < 3000").limit(60).unionByName(
        edge.filter("text is null or length(text) < 3000").select("doc_id", "text", "lang")
    ).collect()
    known = {}
    frame = spark.createDataFrame(some, "doc_id long, text string, lang string").coalesce(1)
    for r, got in zip(frame.collect(), language.predict(frame, filters).collect()):
        runs = list(grams(r.text))
        share = {}
        for name in filters.names:
            hits = sum(all(c in cells[name] for c in known.setdefault(g, places(g))) for g in runs)
            share[name] = max(0.0, (hits / max(1, len(runs)) - rate[name]) / (1 - rate[name]))
        if not any(c.isalpha() for c in r.text or ""):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        best = max(filters.names, key=lambda n: share[n])
        assert got.lang_pred == best
        assert got.score == pytest.approx(share[best] / max(sum(share.values()), 1e-12))


def test_rare_languages_and_labels_are_learned_at_any_size(spark, monkeypatch):
    rows = [(i, f"common words of language number one {i}", "big") for i in range(3_000)]
    rows += [(10_000 + i, "zyx wvu tsr qpo", "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs, train_docs=50)
    assert filters.names == ["big", "rare"]
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, filters).collect()}
    assert got[10_001] == "rare" and got[5] == "big"
    labels = docs.selectExpr("doc_id", "cast(lang = 'rare' as int) as label")
    model = quality_model.train(docs.select("doc_id", "text"), labels, train_docs=50)
    scores = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    assert min(scores[10_000 + i] for i in range(3)) > max(scores[i] for i in range(200))
    # Rows repeated with one id reach the driver once.
    many = docs.filter("doc_id = 10000").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    clean = labels.filter("doc_id = 10000").selectExpr("doc_id", "label")
    assert len(quality_model._sample(many, clean)) == 1


def test_shares_of_a_trillion_rows_still_draw(spark):
    """The draw has 62 bits: with one in 1e12 drawn, the share drawn of a hash is right, not zero."""
    ids = spark.range(200_000)
    for share in (1.0, 0.25, 1e-3):
        n = ids.filter(drawn(share, 3, "id")).count()
        assert abs(n - share * 200_000) <= 5 * (share * 200_000) ** 0.5
    limit = ids.limit(1).select((F.least(F.lit(5_000 / 1e12), F.lit(1.0)) * F.lit(float(1 << 62))).cast("long"))
    assert limit.first()[0] == pytest.approx(5_000 / 1e12 * (1 << 62), rel=1e-9)
    sample = stratified(ids.selectExpr("id", "if(id < 10, 'rare', 'common') as kind"), "kind", 100, 5, "id")
    found = {r.kind: r["count"] for r in sample.groupBy("kind").count().collect()}
    assert found["rare"] == 10 and 50 <= found["common"] <= 160
