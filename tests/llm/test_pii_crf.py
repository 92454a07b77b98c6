import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from homeward.llm import pii_crf
from homeward.llm.pii_crf import CARD, EMAIL, IP, PHONE

EMAILS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IPS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARDS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONES = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(digits):
    doubled = [2 * int(d) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), EMAIL, m.end()) for m in EMAILS.finditer(text)]
    found += [(m.start(), IP, m.end()) for m in IPS.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [
        (m.start(), CARD, m.end()) for m in CARDS.finditer(text) if 12 <= len(digits(m)) <= 19 and passes(digits(m))
    ]
    found += [(m.start(), PHONE, m.end()) for m in PHONES.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def listed(spans):
    return ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def card(rng, n=16):
    head = "".join(rng.choice("123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if passes(head + d))


def test_query(run, texts):
    got = run("op13_skip_chain_crf")
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans, r = base(text), got[i]
        kinds = [k for _, k, _ in spans]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        every = [s.split(":") for s in r.spans.split(",") if s]
        found = [(int(a), pii_crf.KINDS.index(k), int(b)) for k, a, b in every]
        assert found == sorted(found) and [s for s in found if s[1] < 4] == spans
        for a, k, b in found:
            assert k < 4 or not any(x < b and a < y for x, _, y in spans)
            assert any(c.isdigit() or c == "@" for c in text[a:b])
        if not re.search("[0-9@]", text or ""):
            assert found == []


TRICKY = [
    "a@b.c@d.e x@y z@1.2 .%+-@a-b.c-d.e. @x.y é@a.b漢c.d@e.f",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.0.1 1.2.3 1..2.3.4 9.9.9.9.",
    "4111111111111111 4111-1111 1111-1111 41111111111111 5 0 00 1- 2 4111  1111",
    "+1 (555) 555-1234 +1+2 345 6789 0 ++49.30.1234567-- +1 234 567 8901 2345 678 +5 x",
    "", None, "\n", "@", "1", "a" * 300 + "@b.c", "٣٣٣٣ ² x²@a.b 1²3",
]


def test_tricky_texts():
    for text in TRICKY:
        assert pii_crf.base_spans(text or "")[0] == base(text), text
    rng = random.Random(5)
    for _ in range(3_000):
        text = "".join(rng.choice("1125@a.+- ()%é\n") for _ in range(rng.randint(0, 40)))
        assert pii_crf.base_spans(text)[0] == base(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1 ", "1.", "+", "a@", "+1", "@", ".a", "1-("])
def test_long_texts_take_time_in_proportion(piece):
    text = piece * (400_000 // len(piece))
    pii_crf.base_spans(text)
    found = pii_crf.graph(text)
    assert found is None or len(found.words) <= 400_000


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    words = ["see", "the", "call", "from", "now", "end.", "of", "und"]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(30)]
        number = "".join(rng.choice("0123456789") for _ in range(16))
        while passes(number):
            number = number[:-1] + str((int(number[-1]) + 1) % 10)
        for value in rng.sample([
            card(rng), f"{rng.choice(words)}.{i}@mail{i % 9}.example.com", f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
            ".".join(str(rng.randint(0, 255)) for _ in range(4)), number, "Version 2.0,", str(rng.randint(0, 99)),
        ], 3):
            text.insert(rng.randint(0, 10) * 3, value)
            if i % 2:
                text += [rng.choice(words), value]
        rows.append((i, " ".join(text)))
    return pii_crf.train(spark.createDataFrame(rows, "doc_id long, text string"))


def added(text, model):
    spans = pii_crf.base_spans(text)[0]
    found = pii_crf.graph(text)
    return [(text[a:b], k - 4) for a, k, b in pii_crf._entities(text, found, pii_crf.marginals([found], model), spans)]


def test_numbers_side_by_side_are_found(model):
    rng = random.Random(7)
    a, b = card(rng), card(rng)
    assert base(f"see {a} {b} end") == []
    assert added(f"see {a} {b} end", model) == [(a, CARD), (b, CARD)]
    phone = "+1 (217) 555-1234"
    assert added(f"call {phone} {a} now", model) == [(phone, PHONE), (a, CARD)]
    assert added("see Version 2.0, of 12 and 1234567890123456 now", model) == []


def test_a_distant_equal_word_decides(model):
    """A word that says nothing itself takes the label of its sure copy, through the skip edge only."""
    rng = random.Random(8)
    a = card(rng)
    found = pii_crf.graph(f"see {a} from " + "the end of " * 200 + f"call {a}, now")
    assert found.same == [(0, 1)]
    alone = found._replace(same=[])
    # Without any feature of its own, the second mention is undecided.
    unknown = found.features.copy()
    unknown[1] = 0
    p = pii_crf.marginals([found._replace(features=unknown)], model)
    q = pii_crf.marginals([alone._replace(features=unknown)], model)
    kind = 1 + 2 * CARD
    assert p[0, kind] > 0.9
    assert p[1, kind] > q[1, kind] + 0.2


def exact(found, model):
    """Marginals by listing all labellings."""
    n = len(found.words)
    unary = model.words[found.features].sum(1)
    scores = {}
    for labels in itertools.product(range(pii_crf.LABELS), repeat=n):
        s = sum(unary[i, y] for i, y in enumerate(labels))
        for i in range(n):
            s += model.chain[labels[i - 1], labels[i]] if found.after[i] else 0
        s += sum(model.same[labels[a], labels[b]] for a, b in found.same)
        s += sum(model.alike[labels[a], labels[b]] for a, b in found.alike)
        scores[labels] = s
    top = max(scores.values())
    p = np.zeros((n, pii_crf.LABELS))
    for labels, s in scores.items():
        for i, y in enumerate(labels):
            p[i, y] += np.exp(s - top)
    return p / p.sum(1, keepdims=True)


def test_messages_give_exact_marginals_without_loops_and_close_ones_with(model):
    rng = np.random.default_rng(9)
    noisy = pii_crf.Model(rng.normal(0, 0.5, model.words.shape), *(rng.normal(0, 0.7, (9, 9)) for _ in range(3)))
    noisy = noisy._replace(same=noisy.same + noisy.same.T, alike=noisy.alike + noisy.alike.T)
    for text in ("1 2 x 3 4", "11 x 11 x 22", "a@b.c x d@b.c x 5 6"):
        found = pii_crf.graph(text)
        got = pii_crf.marginals([found, found], noisy)
        assert np.abs(got[: len(found.words)] - exact(found, noisy)).max() < 0.01
        assert np.allclose(got[: len(found.words)], got[len(found.words) :], atol=0.01)
    loop = pii_crf.graph("1 2 x 1 2")
    assert np.abs(pii_crf.marginals([loop], model) - exact(loop, model)).max() < 0.1


def test_rows_and_columns(spark, edge, empty, model):
    clashing = edge.withColumnRenamed("size", "Private")
    got = pii_crf.find(clashing, model)
    assert got.columns == [*clashing.columns, "_private"]
    rows = got.collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert [tuple(s) for s in r._private.base] == base(r.text)
    assert pii_crf.find(empty, pii_crf.train(empty)).count() == 0
    # Nothing to learn from: base spans only.
    assert pii_crf.train(edge.filter("doc_id = 8")) is None
    docs = spark.createDataFrame([(1, "a@b.c 12"), (1, "a@b.c 12"), (None, "1.2.3.4")], "doc_id long, text string")
    assert [len(r.private.spans) for r in pii_crf.find(docs, None).collect()] == [1, 1, 1]
