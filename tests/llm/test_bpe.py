import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from homeward.llm import bpe
from homeward.llm.queries import ranks_path

RANKS = ranks_path()
VOCABULARY = bpe.read_ranks(RANKS)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={t: i for i, t in enumerate(VOCABULARY)}, special_tokens={},
)


def encoded(texts):
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data]))
    found = bpe._encode_slice(bpe.Scanner(), bpe.Encoder(VOCABULARY), b"".join(data), offsets)
    return [ids.tolist() for ids in found]


def test_random_texts_equal_the_library():
    rng = random.Random(3)
    letters = "abrevlstmd'''  \n\t!?.1234é漢  ß٣Ⅷ\U0001f600\x85　 S"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", "  ", "'s", "x" * 3000, "ab" * 2000 + " ", "\n\n", " 's 're''ll'", "a" * 100_000]
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_contractions_and_blanks():
    texts = ["it's we're they've I'm he'll he'd don't", " 's", "!'s", "\n's", "a  b", "a \n b ", "'sabc"]
    assert encoded(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_scan_equals_steps():
    scanner = bpe.Scanner()
    rng = np.random.default_rng(5)
    symbols = np.append(bpe.END, rng.integers(0, 9, 3000)).astype(np.uint8)
    state, want = bpe.AT_START, []
    for i, symbol in enumerate(symbols.tolist()):
        if bpe._starts_token(state, symbol):
            want.append(i)
        state = bpe._step(state, symbol)
    assert scanner.boundaries(symbols).tolist() == want


def test_query(run, texts):
    got = run("op7_byte_bpe")
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = LIBRARY.encode_ordinary(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edge_rows_and_columns(edge, empty):
    coded = bpe.decode(bpe.encode(edge, RANKS), RANKS)
    assert set(c.lower() for c in edge.columns) <= set(c.lower() for c in coded.columns)
    rows = coded.collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode()
        ids, offsets = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.offsets, "<u4")
        at = 0
        for i, o in list(zip(ids.tolist(), offsets.tolist()))[:50]:
            assert o == at
            at += len(VOCABULARY[i])
    assert bpe.decode(bpe.encode(empty, RANKS), RANKS).count() == 0


def test_null_ids_decode_to_null(edge):
    coded = bpe.encode(edge, RANKS).withColumn("ids", F.lit(None).cast("binary"))
    assert {r.decoded for r in bpe.decode(coded, RANKS).collect()} == {None}
