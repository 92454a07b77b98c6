import hashlib
from collections import Counter

import numpy as np
import tiktoken
import public_tokenizers

import corpus_pipeline
from homeward.llm import bpe, mixing, secrets
from homeward.llm.queries import QUERIES, ranks_path

from test_chosen_path import brute as classes  # noqa: I001
from test_mixing import level_targets


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], sf_dir).cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert results[-1].columns == columns
    first, good, single, cleaned, mixed, coded = (r.collect() for r in results)

    verdict = {r.doc_id: r.kept for r in QUERIES["op4_ngram_ratio"](spark, sf_dir).collect()}
    assert {r.doc_id for r in good} == {i for i, kept in verdict.items() if kept}
    assert {r.doc_id: r.text for r in good} == {r.doc_id: r.text for r in first if verdict[r.doc_id]}

    want = {i for i, c, _ in classes([(r.doc_id, r.text) for r in good]) if i == c}
    assert sorted(r.doc_id for r in single) == sorted(want)

    spans = {r.doc_id: r.s.spans for r in secrets.scan(results[2], "s").collect()}
    assert {r.doc_id for r in cleaned} == want
    for r in cleaned:
        before = next(b for b in single if b.doc_id == r.doc_id)
        text, at = "", 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                text += before.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.text == text + before.text[at:]
        assert r.n_chars == len(r.text)

    sizes = Counter()
    for r in cleaned:
        sizes[r.source] += len(r.text.encode().split())
    aims = level_targets(dict(sizes))
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.encode().split())
    for s, aim in aims.items():
        # Some sources have a handful of documents left.
        assert abs(taken[s] - aim) <= max(2, 0.05 * aim) or sizes[s] < 2_000, s
    assert max(Counter(r.doc_id for r in mixed).values()) <= mixing.MAX_ROUNDS

    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(ranks_path()))},
    )
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    expected = Counter((r.doc_id, digest(library.encode_ordinary(r.text))) for r in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in coded) == expected


def test_edge_rows_pass_all_stages(spark, edge, empty, sf_dir):
    for start in (edge, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == start.columns, name
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert (start is edge) == bool(rows)


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and set(QUERIES) <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
