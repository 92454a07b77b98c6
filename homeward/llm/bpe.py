"""Byte-level BPE: pre-tokenisation by array scans, cached pair merging, decoding.

The pattern of the rank files,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is a small automaton once each character carries what the pattern looks ahead for: whether
white space is followed by white space or the end, and whether an apostrophe is followed by
the rest of a contraction. Every symbol is a function from state to state. Functions are
composed by doubling distances until each composition is constant, which gives the state in
front of every character without walking through the text, and with it the token starts.

Null texts count as empty and have no ids. Texts are whole, however long. Columns of the input
that are called like an added one are replaced.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from homeward.llm.common import text_slices

# Characters of the White_Space property, a fixed value.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
          0x205F, 0x3000]

# Symbols: text end, letter, number, other, apostrophe of a contraction with one or two more
# letters, blank before non-space, other space before non-space, space before space or the end.
END, LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, GAP = range(9)
# States: at a start, in letters, in numbers, in others, after a blank, in a gap, one or two
# letters of a contraction to come, contraction complete.
AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_GAP, ONE_LEFT, TWO_LEFT, DONE = range(9)
_CACHE_ENTRIES = 100_000
_SLICE = 512 << 10


def _step(state: int, symbol: int) -> int:
    if symbol == LETTER:
        return {TWO_LEFT: ONE_LEFT, ONE_LEFT: DONE}.get(state, IN_LETTERS)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS
        return ONE_LEFT if symbol == SHORT else TWO_LEFT
    return {END: AT_START, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: AFTER_BLANK,
            SPACE: AT_START, GAP: IN_GAP}[symbol]


def _starts_token(state: int, symbol: int) -> bool:
    inside = {
        END: range(9),
        LETTER: (IN_LETTERS, AFTER_BLANK, ONE_LEFT, TWO_LEFT),
        NUMBER: (IN_NUMBERS, AFTER_BLANK),
        GAP: (IN_GAP,),
        BLANK: (),
        SPACE: (),
    }.get(symbol, (IN_OTHERS, AFTER_BLANK))
    return state not in inside


class Scanner:
    """Tables of the automaton: composition of its functions, token starts, character classes."""

    def __init__(self):
        functions = [tuple(_step(s, c) for s in range(9)) for c in range(9)]
        known = {f: i for i, f in enumerate(dict.fromkeys(functions))}
        queue = list(known)
        generators = list(known)
        while queue:
            f = queue.pop()
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
        ordered = list(known)
        self.of_symbol = np.array([known[f] for f in functions], np.uint8)
        self.compose = np.zeros((len(ordered), len(ordered)), np.uint8)
        for (i, f), (j, g) in product(enumerate(ordered), repeat=2):
            self.compose[i, j] = known[tuple(g[s] for s in f)]
        self.constant = np.array([len(set(f)) == 1 for f in ordered])
        self.value = np.array([f[0] for f in ordered], np.uint8)
        self.starts = np.array([[_starts_token(s, c) for c in range(9)] for s in range(9)])
        kinds = np.full(0x110000, OTHER, np.uint8)
        for point in range(0x110000):
            kind = unicodedata.category(chr(point))[0]
            if kind == "L":
                kinds[point] = LETTER
            elif kind == "N":
                kinds[point] = NUMBER
        kinds[SPACES] = SPACE
        self.kinds = kinds

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of characters; ``ends`` are the places that separate texts."""
        symbols = self.kinds[points]
        symbols[ends] = END
        following = np.append(symbols[1:], END)
        space = symbols == SPACE
        closed = (following == SPACE) | (following == END)
        symbols[space & closed] = GAP
        symbols[space & ~closed & (points == 32)] = BLANK
        at = np.flatnonzero((points == 39) & (symbols == OTHER) & (following == LETTER))
        one, third = points[at + 1], np.minimum(at + 2, len(points) - 1)
        two = np.where((symbols[third] == LETTER) & (third > at + 1), points[third], 0)
        symbols[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        for pair in ("re", "ve", "ll"):
            symbols[at[(one == ord(pair[0])) & (two == ord(pair[1]))]] = LONG
        return symbols

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        """Places where tokens start. The first symbol must be END."""
        reach = self.of_symbol[symbols]
        distance = 1
        while distance < len(reach) and not self.constant[reach].all():
            reach[distance:] = self.compose[reach[:-distance], reach[distance:]]
            distance *= 2
        before = np.append(np.uint8(AT_START), self.value[reach[:-1]])
        return np.flatnonzero(self.starts[before, symbols])


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file, by rank. The ranks are 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = dict((int(rank), token) for token, rank in (x.split() for x in lines if x.strip()))
    if sorted(pairs) != list(range(len(pairs))):
        raise ValueError("the ranks of the file are not gapless")
    return [base64.b64decode(pairs[i]) for i in range(len(pairs))]


_NEVER = np.iinfo(np.int64).max
_LONG_PIECE = 400


class Encoder:
    """Ids of slices, merged pair by pair in order of rank and remembered.

    New slices of a batch are merged together: in every round each of them does its merge of
    lowest rank, leftmost first, on arrays that hold all of them.
    """

    def __init__(self, vocabulary: list[bytes]):
        self.rank = {token: i for i, token in enumerate(vocabulary)}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.of_byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.size = len(vocabulary)
        keys, to = array("q"), array("q")
        for n, token in enumerate(vocabulary):
            for i in range(1, len(token)):
                if token[:i] in self.rank and token[i:] in self.rank:
                    keys.append(self.rank[token[:i]] * self.size + self.rank[token[i:]])
                    to.append(n)
        order = np.argsort(np.frombuffer(keys, np.int64))
        self.keys = np.append(np.frombuffer(keys, np.int64)[order], _NEVER)
        self.to = np.append(np.frombuffer(to, np.int64)[order], _NEVER)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank, which is the id, of what two neighbours merge into."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], _NEVER)

    def _merge(self, pieces: list[bytes]) -> None:
        tokens = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        ranks = np.full(len(tokens), _NEVER)
        ranks[:-1] = self._pair(tokens[:-1], tokens[1:])
        ranks[:-1][owner[1:] != owner[:-1]] = _NEVER
        while len(tokens):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(begins, len(owner)))
            best = np.minimum.reduceat(ranks, begins)
            done = best == _NEVER
            if done.any():
                whole = np.repeat(done, lengths)
                ids = tokens[whole].tolist()
                stop = 0
                for piece, n in zip(owner[begins[done]].tolist(), lengths[done].tolist()):
                    self.cache[pieces[piece]] = tuple(ids[stop : stop + n])
                    stop += n
                tokens, owner, ranks = tokens[~whole], owner[~whole], ranks[~whole]
                best, lengths = best[~done], lengths[~done]
                if not len(tokens):
                    break
            at = np.flatnonzero(ranks == np.repeat(best, lengths))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            tokens[at] = ranks[at]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, owner, ranks = tokens[keep], owner[keep], ranks[keep]
            at -= np.arange(len(at))
            again = np.concatenate([at, at[at > 0] - 1])
            again = again[again + 1 < len(tokens)]
            same = owner[again] == owner[again + 1]
            ranks[at[at + 1 >= len(tokens)]] = _NEVER
            ranks[again] = np.where(same, self._pair(tokens[again], tokens[again + 1]), _NEVER)

    def _merged_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same with a heap over a linked list, for slices that would take many rounds."""
        from heapq import heapify, heappop, heappush

        rank, n = self.rank, len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank[parts[i] + parts[i + 1]], i, parts[i], parts[i + 1])
                for i in range(n - 1) if parts[i] + parts[i + 1] in rank]
        heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and parts[i] + parts[j] in rank:
                heappush(heap, (rank[parts[i] + parts[j]], i, parts[i], parts[j]))

        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if parts[i] is not left or j >= n or parts[j] is not right:
                continue
            parts[i] = left + right
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(rank[p] for p in parts if p is not None)

    def learn(self, pieces: list[bytes]) -> None:
        """Put all of ``pieces`` into the cache, which is emptied when it is full."""
        if len(self.cache) > _CACHE_ENTRIES:
            self.cache.clear()
        new = []
        for piece in set(pieces).difference(self.cache):
            if piece in self.rank:
                self.cache[piece] = (self.rank[piece],)
            elif len(piece) > _LONG_PIECE:
                self.cache[piece] = self._merged_long([piece[i : i + 1] for i in range(len(piece))])
            else:
                new.append(piece)
        if new:
            self._merge(new)


def _encode_slice(scanner: Scanner, encoder: Encoder, data: bytes, offsets: np.ndarray):
    """Ids of each text of a slice."""
    bounds = offsets.tolist()
    joined = "".join(["\n" + data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at_byte = np.append(0, np.cumsum(width))
    raw = joined.encode()
    # The separators stand one byte before each text, and each text moves by those before it.
    ends = np.searchsorted(at_byte, offsets[:-1] + np.arange(len(offsets) - 1))
    begins = scanner.boundaries(scanner.symbols(points, ends))
    stops = np.append(begins[1:], len(points))
    closing = np.append(ends[1:], len(points))
    owner = np.searchsorted(ends, begins, "right") - 1
    stops = np.minimum(stops, closing[owner])
    pieces = [raw[a:b] for a, b in zip(at_byte[begins].tolist(), at_byte[stops].tolist())]
    encoder.learn(pieces)
    split = np.searchsorted(owner, np.arange(len(offsets))).tolist()
    look_up = encoder.cache.__getitem__
    for a, b in zip(split, split[1:]):
        yield np.fromiter(chain.from_iterable(map(look_up, pieces[a:b])), "<u4")


def _with_columns(batch: pa.RecordBatch, schema: pa.Schema, added: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [added[f.name] if f.name in added else batch.column(f.name) for f in schema], schema=schema
    )


def _added(docs: DataFrame, *names: str) -> T.StructType:
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    return T.StructType([*kept, *[T.StructField(n, T.BinaryType()) for n in names]])


def encode(docs: DataFrame, ranks_path: str, column: str = "text") -> DataFrame:
    """Add ``ids`` and ``offsets``: token ids and the byte in the text at which each starts.

    Both are packed little-endian numbers of 32 bits. ``ranks_path`` is read by the
    caller's process; the vocabulary, 50,256 entries or as many as the file has, goes to the
    tasks with the function.
    """
    vocabulary = read_ranks(ranks_path)
    out = _added(docs, "ids", "offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, encoder = Scanner(), Encoder(vocabulary)
        lengths = np.array([len(t) for t in vocabulary], np.int64)
        schema = None
        for batch in batches:
            for first, end, data, offsets in text_slices(batch, column, _SLICE):
                ids, places = [], []
                for found in _encode_slice(scanner, encoder, data.tobytes(), offsets):
                    stops = np.cumsum(lengths[found])
                    ids.append(found.tobytes())
                    places.append((stops - lengths[found]).astype("<u4").tobytes())
                rows = batch.slice(first, end - first)
                if schema is None:
                    schema = pa.schema([
                        pa.field(f.name, pa.binary() if f.name in ("ids", "offsets")
                                 else batch.schema.field(f.name).type) for f in out
                    ])
                yield _with_columns(rows, schema, {
                    "ids": pa.array(ids, pa.binary()), "offsets": pa.array(places, pa.binary())
                })

    return docs.mapInArrow(run, out)


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded``: the bytes that ``ids`` stand for. Null ids decode to null.

    An offset that does not fit the ids raises an error.
    """
    vocabulary = read_ranks(ranks_path)
    out = _added(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in pieces_of(batches, 500):
            decoded = []
            for ids, offsets in zip(batch.column("ids"), batch.column("offsets")):
                if not ids.is_valid:
                    decoded.append(None)
                    continue
                found = np.frombuffer(ids.as_buffer(), "<u4").tolist()
                text = b"".join(map(vocabulary.__getitem__, found))
                places = np.frombuffer(offsets.as_buffer(), "<u4")
                if len(places) != len(found) or (
                    found and places[-1] + len(vocabulary[found[-1]]) != len(text)
                ):
                    raise ValueError("ids and offsets do not belong together")
                decoded.append(text)
            if schema is None:
                schema = pa.schema([
                    pa.field(f.name, pa.binary() if f.name == "decoded"
                             else batch.schema.field(f.name).type) for f in out
                ])
            yield _with_columns(batch, schema, {"decoded": pa.array(decoded, pa.binary())})

    return encoded.mapInArrow(run, out)
