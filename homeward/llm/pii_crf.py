"""Personal data: fixed patterns, and a skip-chain conditional random field over each document.

Base kinds are patterns, matched leftmost and without overlap per kind; matches that fail their
rule are dropped whole. The field finds what they lose, such as two numbers side by side that the
patterns read as one. Its nodes are the words with a digit or an at sign; all other words are no
personal data, and what they are is a feature of the nodes beside them. A node has one of nine labels, none or the beginning or
inside of an entity of a kind. Log potentials are learned: of hashed features of the word and its
neighbours, of the labels of neighbouring words, and of the labels of words that are the same
(letter case, punctuation around them and separators of digits aside) or have the same mail domain,
however far apart. A word is joined to the one before it with the same key, so a word that a
document repeats a thousand times costs a thousand edges.

Labels follow from sum-product message passing over each document's graph, with loops, until the
messages settle. An entity is added where every word of it has its kind with a probability of at
least ``THRESHOLD`` and no base span overlaps it.

Learning maximises the pseudo-likelihood with the base matches as labels; words that stand only in
a match dropped for having too many digits are unknown and learned from in no way. The sample is
bounded and stratified: of the documents with a node, about ``TRAIN_DOCS`` for each combination of
marks in them (at sign, dotted digits, plus sign, long number), drawn by a seeded hash, and of each
at most ``TRAIN_WORDS`` consecutive nodes. Without any base match in the sample nothing is added.

Places are code points, ends exclusive. Null texts count as empty. Whole texts are searched in one
go; each step takes time in proportion to the text, whatever it holds. Rows are judged one by one, so
repeated rows agree, ids may be null, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homeward.llm.common import fresh, stratified

# Kinds in the order in which they are listed; the field's come after the patterns'.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *[f"crf_{k}" for k in BASE]]
EMAIL, IP, CARD, PHONE = range(4)

# Fixed patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LABELS = 1 + 2 * len(BASE)  # none, then beginning and inside of each kind
ROWS = 1 << 13
FEATURES = 11
TRAIN_DOCS = 400
TRAIN_WORDS = 300
STEPS = 150
RATE = 0.5
DECAY = 1e-3
ROUNDS = 60
THRESHOLD = 0.5
_BATCH_CHARS = 1 << 20

_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_AROUND = "\"'`.,;:!?*&%$#|<>[]{}"
_UNIT = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CORE = {
    EMAIL: re.compile(r"[A-Za-z0-9](.*[A-Za-z0-9])?", re.S),
    IP: re.compile(r"[0-9](.*[0-9])?", re.S),
    CARD: re.compile(r"[0-9](.*[0-9])?", re.S),
    PHONE: re.compile(r"[+(0-9](.*[0-9])?", re.S),
}


# ---- base patterns -----------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's sum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if i % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign, so that a long run of letters is gone through once."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            last = found.end()
            yield begin, last
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base matches, and (start, end) of those dropped as too long."""
    spans, lost = [(a, EMAIL, b) for a, b in _emails(text)], []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), IP, m.end()))
    for kind, pattern, least, most in ((CARD, _CARD, 12, 19), (PHONE, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if len(digits) > most:
                lost.append((m.start(), m.end()))
            elif len(digits) >= least and (kind == PHONE or luhn(digits)):
                spans.append((m.start(), kind, m.end()))
    return sorted(spans), sorted(lost)


# ---- graphs ------------------------------------------------------------------------------------


class Graph(NamedTuple):
    """Nodes of one text: words, feature rows, the node before if it is the word before, skip edges."""

    words: list[tuple[int, int]]
    features: np.ndarray  # (nodes, FEATURES)
    after: np.ndarray  # whether the previous node is the previous word
    same: list[tuple[int, int]]
    alike: list[tuple[int, int]]


def _words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or an at sign."""
    end, found = 0, _MARK.search(text)
    while found:
        begin = found.start()
        while begin > end and not _SPACE.match(text[begin - 1]):
            begin -= 1
        blank = _SPACE.search(text, found.end())
        end = blank.start() if blank else len(text)
        yield begin, end
        found = _MARK.search(text, end)


def _shape(word: str, sizes: bool) -> str:
    units = []
    for m in _UNIT.finditer(word[:64]):
        unit = m.group()
        if unit[0].isdigit() and unit.isascii():
            units.append(f"9{len(unit)}" if sizes else "9")
        else:
            units.append("a" if unit[0].isalpha() else unit)
    return "".join(units)


def _row(name: str) -> int:
    """A feature's row of weights; row 0 stands for no feature and weighs nothing."""
    return 1 + zlib.crc32(name.encode("utf-8", "replace")) % (ROWS - 1) if name else 0


def _beside(side: str, word: list[str]) -> str:
    """Feature of a neighbouring word; another node's part is for the edge between them to say."""
    if not word or _MARK.search(word[0]):
        return "" if word else side
    return f"{side} {word[0].strip(_AROUND).lower()}"


def _own_features(word: str) -> list[str]:
    core = word.strip(_AROUND)
    digits = _NOT_DIGIT.sub("", core)
    parts = core.split(".")
    octets = len(parts) == 4 and all(
        p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts
    )
    number = len(digits) == len(core.replace("-", "")) and 12 <= len(digits) <= 19
    local, at, domain = core.partition("@")
    mail = bool(local and at and _DOMAIN.fullmatch(domain))
    return [
        "bias", f"shape {_shape(core, True)}", f"form {_shape(core, False)}",
        f"digits {min(len(digits), 24)}", f"octets {octets}", f"mail {mail}",
        f"number {luhn(digits) if number else None}", f"plus {core[:1] == '+'}",
    ]


def graph(text: str) -> Graph | None:
    """The field's graph of a text; none without nodes."""
    words = list(_words(text))
    if not words:
        return None
    rows, after = [], []
    same, alike = [], []
    seen: dict[str, int] = {}
    domains: dict[str, int] = {}
    known: dict[str, list[int]] = {}
    for i, (begin, end) in enumerate(words):
        word = text[begin:end]
        # A word's neighbours are looked for in the next forty characters.
        left = text[max(0, begin - 40) : begin].split()[-1:]
        right = text[end : end + 40].split()[:1]
        gap = text[words[i - 1][1] : begin] if i else "x"
        after.append(bool(i) and len(gap) <= 40 and not gap.strip("\x20\t\n\v\f\r"))
        own = known.get(word)
        if own is None:
            own = [_row(f) for f in _own_features(word)]
            if len(known) < 10_000:
                known[word] = own
        sides = (_beside("left", left), _beside("right", right))
        rows.append([*own, *map(_row, sides), _row(f"line {chr(10) in text[max(0, begin - 1) : begin]}")])
        core = word.strip(_AROUND).casefold()
        digits = _NOT_DIGIT.sub("", core)
        key = digits if len(digits) >= 7 else core
        if key in seen:
            same.append((seen[key], i))
        seen[key] = i
        domain = core.partition("@")[2]
        if domain:
            if domain in domains:
                alike.append((domains[domain], i))
            domains[domain] = i
    return Graph(words, np.array(rows, np.int32), np.array(after, bool), same, alike)


def _labels(found: Graph, spans: list[tuple[int, int, int]], lost: list[tuple[int, int]]) -> np.ndarray:
    """Label of each node from the base matches; -1 where a match was dropped as too long."""
    labels = np.zeros(len(found.words), np.int8)
    starts = np.array([a for a, _ in found.words])
    ends = np.array([b for _, b in found.words])
    for a, b in lost:
        labels[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b)] = -1
    for a, kind, b in spans:
        low, high = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
        labels[low:high] = 2 + 2 * kind
        labels[low : low + 1] = 1 + 2 * kind
    return labels


# ---- learning ----------------------------------------------------------------------------------


class Model(NamedTuple):
    """Log potentials: of features, of neighbouring words, of equal words, of equal domains."""

    words: np.ndarray  # (ROWS, LABELS)
    chain: np.ndarray  # (LABELS, LABELS), left by right
    same: np.ndarray
    alike: np.ndarray


def _pairs(edges: list[tuple[int, int]]) -> np.ndarray:
    return np.array(edges, np.int64).reshape(-1, 2)


def fit(graphs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Model | None:
    """Learn from (features, labels, after, same, alike) of texts by adaptive gradient steps."""
    sizes = np.cumsum([0, *[len(g[0]) for g in graphs]])
    if not sizes[-1]:
        return None
    features = np.concatenate([g[0] for g in graphs])
    labels = np.concatenate([g[1] for g in graphs]).astype(np.int64)
    if not (labels > 0).any():
        return None
    after = np.concatenate([g[2] for g in graphs])
    right = np.flatnonzero(after)
    chain = np.stack([right - 1, right], 1)
    skips = [np.concatenate([g[k] + n for g, n in zip(graphs, sizes)]) for k in (3, 4)]
    known = labels >= 0
    chain, *skips = [e[known[e[:, 0]] & known[e[:, 1]]] for e in (chain, *skips)]
    weight = known / max(1, int(known.sum()))
    model = Model(np.zeros((ROWS, LABELS)), *(np.zeros((LABELS, LABELS)) for _ in range(3)))
    squares = [np.full(w.shape, 1e-8) for w in model]
    hot = np.eye(LABELS)[np.maximum(labels, 0)]
    flat = features.ravel()
    for _ in range(STEPS):
        scores = model.words[features].sum(1)
        np.add.at(scores, chain[:, 1], model.chain[labels[chain[:, 0]]])
        np.add.at(scores, chain[:, 0], model.chain.T[labels[chain[:, 1]]])
        for table, edges in zip((model.same, model.alike), skips):
            both = table + table.T
            np.add.at(scores, edges[:, 1], both[labels[edges[:, 0]]])
            np.add.at(scores, edges[:, 0], both[labels[edges[:, 1]]])
        scores -= scores.max(1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(1, keepdims=True)
        error = (p - hot) * weight[:, None]
        slopes = [DECAY * w / max(1, ROWS) for w in model]
        repeated = np.repeat(error, features.shape[1], 0)
        for y in range(LABELS):
            slopes[0][:, y] += np.bincount(flat, repeated[:, y], ROWS)
        slopes[0][0] = 0
        np.add.at(slopes[1], labels[chain[:, 0]], error[chain[:, 1]])
        np.add.at(slopes[1].T, labels[chain[:, 1]], error[chain[:, 0]])
        for k, edges in zip((2, 3), skips):
            for a, b in ((0, 1), (1, 0)):
                found = np.zeros((LABELS, LABELS))
                np.add.at(found, labels[edges[:, a]], error[edges[:, b]])
                slopes[k] += found + found.T
        for w, square, slope in zip(model, squares, slopes):
            square += slope * slope
            w -= RATE * slope / np.sqrt(square)
    return Model(model.words, model.chain, model.same + model.same.T, model.alike + model.alike.T)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learn from a bounded sample of ``docs`` (doc_id, text)."""
    text = F.col("text")
    marks = [text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"\+[0-9]"), text.rlike(r"[0-9]{9}")]
    marked = docs.select("doc_id", "text").filter(text.rlike("[0-9@]")).withColumn(
        "marks", F.concat_ws("", *[m.cast("string") for m in marks])
    )
    sample = stratified(marked, "marks", train_docs, 19, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("text"):
                one = value.as_py()
                found = graph(one)
                if found is None:
                    continue
                labels = _labels(found, *base_spans(one))
                n = len(labels)
                low = zlib.crc32(one.encode("utf-8", "replace")) % max(1, n - TRAIN_WORDS + 1)
                high = min(n, low + TRAIN_WORDS)
                after = found.after[low:high].copy()
                after[:1] = False
                cut = [
                    (e[((e >= low) & (e < high)).all(1)] - low).astype("<i4")
                    for e in (_pairs(found.same), _pairs(found.alike))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in (
                        found.features[low:high].astype("<i4"), labels[low:high], after, *cut)],
                    names=["features", "labels", "after", "same", "alike"],
                )

    schema = "features binary, labels binary, after binary, same binary, alike binary"
    rows = sample.select("text").mapInArrow(run, schema).collect()  # at most 16 * train_docs, in about
    graphs = [
        (
            np.frombuffer(r.features, "<i4").reshape(-1, FEATURES),
            np.frombuffer(r.labels, np.int8),
            np.frombuffer(r.after, bool),
            np.frombuffer(r.same, "<i4").reshape(-1, 2).astype(np.int64),
            np.frombuffer(r.alike, "<i4").reshape(-1, 2).astype(np.int64),
        )
        for r in sorted(rows)
    ]
    return fit(graphs)


# ---- inference ---------------------------------------------------------------------------------


def marginals(graphs: list[Graph], model: Model) -> np.ndarray:
    """Probability of each label for the nodes of all graphs, by sum-product message passing."""
    sizes = np.cumsum([0, *[len(g.words) for g in graphs]])
    after = np.concatenate([g.after for g in graphs])
    unary = model.words[np.concatenate([g.features for g in graphs])].sum(1)
    right = np.flatnonzero(after)
    parts = [(np.stack([right - 1, right], 1), model.chain)]
    for k, table in ((3, model.same), (4, model.alike)):
        parts.append((np.concatenate([_pairs(g[k]) + n for g, n in zip(graphs, sizes)]), table))
    # Both directions of every edge; the potential of a message goes from its sender's label.
    source = np.concatenate([e[:, side] for e, _ in parts for side in (0, 1)])
    target = np.concatenate([e[:, 1 - side] for e, _ in parts for side in (0, 1)])
    cuts = np.cumsum([0, *[len(e) for e, _ in parts for _ in (0, 1)]])
    back = np.concatenate([
        np.concatenate([np.arange(len(e)) + b, np.arange(len(e)) + a])
        for (e, _), a, b in zip(parts, cuts[::2], cuts[1::2])
    ]).astype(np.int64)
    tables = [np.exp(w - w.max()) for _, t in parts for w in (t, t.T)]
    messages = np.full((len(source), LABELS), -np.log(LABELS))
    order = np.argsort(target, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(target[order]) > 0)) if len(order) else order
    unary -= unary.max(1, keepdims=True)

    def beliefs() -> np.ndarray:
        total = unary.copy()
        if len(order):
            total[target[order][heads]] += np.add.reduceat(messages[order], heads, axis=0)
        return total

    for _ in range(ROUNDS if len(source) else 0):
        cavity = beliefs()[source] - messages[back]
        cavity = np.exp(cavity - cavity.max(1, keepdims=True))
        new = np.empty_like(messages)
        for a, b, table in zip(cuts, cuts[1:], tables):
            new[a:b] = cavity[a:b] @ table
        new = np.log(np.maximum(new / new.sum(1, keepdims=True), 1e-30))
        moved = float(np.abs(np.exp(new) - np.exp(messages)).max())
        messages = np.log(0.5 * np.exp(messages) + 0.5 * np.exp(new))
        if moved < 1e-3:
            break
    total = beliefs()
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _entities(text: str, found: Graph, p: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Entities of the field that no base span overlaps."""
    label = p.argmax(1)
    kind = (label - 1) // 2  # -1 for none
    sure = np.zeros(len(label), bool)
    for k in range(len(BASE)):
        sure |= (kind == k) & (p[:, 1 + 2 * k] + p[:, 2 + 2 * k] >= THRESHOLD)
    added, i, n = [], 0, len(label)
    starts = [a for a, _, _ in spans]
    # Base spans of different kinds may overlap: the furthest end so far decides.
    furthest = np.maximum.accumulate([b for _, _, b in spans]).tolist() if spans else []
    while i < n:
        j = i + 1
        if kind[i] >= 0:
            while j < n and found.after[j] and kind[j] == kind[i] and label[j] == 2 + 2 * kind[i]:
                j += 1
            begin, end = found.words[i][0], found.words[j - 1][1]
            core = _CORE[int(kind[i])].search(text, begin, end)
            if core and sure[i:j].all():
                a, b = core.span()
                before = int(np.searchsorted(starts, b)) - 1
                if before < 0 or furthest[before] <= a:
                    added.append((a, len(BASE) + int(kind[i]), b))
        i = j
    return added


def find(docs: DataFrame, model: Model | None, out: str = "private") -> DataFrame:
    """Add struct (base, spans) as the last column: sorted (start, rank of the kind, end).

    It is named ``out``, with underscores in front if ``docs`` has such a column in any case.
    """
    (out,) = fresh(docs, out)
    fields = ("start", "rank", "end")
    span = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in fields]))
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in fields]))

    def flush(texts: list[str]) -> pa.StructArray:
        base = [base_spans(t)[0] if _MARK.search(t) else [] for t in texts]
        graphs = [(i, g) for i, t in enumerate(texts) if model is not None and (g := graph(t))]
        spans = [list(s) for s in base]
        if graphs:
            p, at = marginals([g for _, g in graphs], model), 0
            for i, g in graphs:
                own = p[at : at + len(g.words)]
                at += len(g.words)
                spans[i] = sorted(base[i] + _entities(texts[i], g, own, base[i]))
        return pa.StructArray.from_arrays(
            [pa.array([[dict(zip(fields, s)) for s in x] for x in found], kind) for found in (base, spans)],
            names=["base", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("") if batch.num_rows else []
            start, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(texts[i].as_py())
                size += len(held[-1])
                if size >= _BATCH_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, flush(held)], names=[*part.schema.names, out]
                    )
                    start, held, size = i + 1, [], 0

    added = T.StructType([T.StructField("base", span), T.StructField("spans", span)])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, added)]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ","
    )
