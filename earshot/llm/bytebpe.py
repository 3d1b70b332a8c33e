"""Byte-level BPE: pieces found by an associative scan of an automaton's transitions, merged with a memory of pieces.

No regular expression runs over a text. Every code point has a class, every class is a function from state to state, and
composing such functions is associative: a scan over blocks of a text, all at once, gives the state at each code point,
and state and class say where a piece begins. The pieces are slices of the text's bytes; each different one is merged once.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import python_batches, unused

# Fixed value: the pattern whose matches the automaton below finds.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points scanned at once, whatever a text's length; pieces that a worker remembers; and the bytes of the longest
#: piece that is remembered and merged along with others of its length.
SCAN, MEMO, SHORT_PIECE = 1 << 20, 300_000, 48

END, SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, ONE, RV, EL, E = range(11)
START, S1, S2, W1, W2, WORD, NUM, MARKS, Q, Q_RV, Q_EL, SHORT = range(12)
NO_RANK = 1 << 40
HERE, BEFORE = 1, 2  #: A piece begins at this code point, at the one before it.


def step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and where pieces are now known to begin.

    S1, S2, W1, W2: in white space of one or more code points that ends in a space or in another one. Of white space, all
    but the last code point is a piece, and a last one that is a space goes with what follows. Q: after a quote that
    begins a piece, so s, t, m, d, re, ve or ll end the piece (SHORT); Q_RV and Q_EL: half of the latter three.
    """
    waiting = BEFORE if state in (Q_RV, Q_EL) else 0
    if kind == END:
        return START, HERE | waiting
    if kind in (SPACE, WHITE):
        run = state in (S1, S2, W1, W2)
        return {(SPACE, False): S1, (SPACE, True): S2, (WHITE, False): W1, (WHITE, True): W2}[kind, run], 0 if run else HERE | waiting
    after = BEFORE if state in (S2, W2) else waiting
    joined = state in (S1, S2)
    if kind == QUOTE:
        if joined or state in (MARKS, Q):
            return MARKS, after
        return Q, HERE | after
    if kind in (NUMBER, OTHER):
        to = NUM if kind == NUMBER else MARKS
        goes_on = joined or state == to or (kind == OTHER and state == Q)
        return to, after | (0 if goes_on else HERE)
    if state == Q and kind in (ONE, RV, EL):
        return {ONE: SHORT, RV: Q_RV, EL: Q_EL}[kind], 0
    if (state, kind) in ((Q_RV, E), (Q_EL, EL)):
        return SHORT, 0
    return WORD, after | (0 if joined or state in (WORD, Q_RV, Q_EL) else HERE)


class _Monoid:
    """All functions that sequences of classes make of the states, numbered, with the number of each composition."""

    def __init__(self):
        kinds, states = range(11), range(12)
        functions = [tuple(step(s, k)[0] for s in states) for k in kinds]
        numbers: dict[tuple, int] = {}
        for f in functions:
            numbers.setdefault(f, len(numbers))
        todo = list(numbers)
        for f in todo:  # grows
            for g in functions:
                fg = tuple(g[s] for s in f)
                if fg not in numbers:
                    numbers[fg] = len(numbers)
                    todo.append(fg)
        self.n = len(todo)
        self.of_class = np.array([numbers[f] for f in functions], np.uint8 if self.n <= 256 else np.uint16)
        self.apply = np.array(todo, np.uint8)
        self.compose = np.array([[numbers[tuple(g[s] for s in f)] for g in todo] for f in todo], self.of_class.dtype).ravel()
        self.begins = np.array([[step(s, k)[1] for k in kinds] for s in states], np.uint8).ravel()


@functools.lru_cache(1)
def _monoid() -> _Monoid:
    return _Monoid()


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: letters, numbers and white space as the tokenizers' own library knows them."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        one = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    for kind, chars in ((SPACE, " "), (QUOTE, "'"), (ONE, "stmd"), (RV, "rv"), (EL, "l"), (E, "e")):
        out[[ord(c) for c in chars]] = kind
    return out


def _states(kinds: np.ndarray, state: int) -> np.ndarray:
    """The state after each of a run of classes, begun in `state`: blocks are composed side by side, then begun in turn."""
    m, n = _monoid(), len(kinds)
    width = max(1, int(n**0.5))
    blocks = -(-n // width)
    padded = np.full(blocks * width, END, np.uint8)
    padded[:n] = kinds
    f = np.ascontiguousarray(m.of_class[padded].reshape(blocks, width).T)
    for j in range(1, width):
        f[j] = m.compose[f[j - 1].astype(np.int32) * m.n + f[j]]
    begun = np.empty(blocks, np.uint8)
    for b, whole in enumerate(f[-1].tolist()):
        begun[b] = state
        state = int(m.apply[whole, state])
    return m.apply[f, begun].T.ravel()[:n]


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each of `codes`, the code points of texts one after the other that end before `ends`."""
    m, table, state = _monoid(), classes(), START
    marks = np.zeros(len(codes) + len(ends), bool)
    kinds = np.insert(table[codes], ends, END)
    for at in range(0, len(kinds), SCAN):
        part = kinds[at : at + SCAN]
        after = _states(part, state)
        before = np.concatenate([[state], after[:-1]])
        known = m.begins[before * np.int32(11) + part]
        marks[at : at + len(part)] |= (known & HERE) > 0
        late = at - 1 + np.flatnonzero(known & BEFORE)
        marks[late] = True
        state = int(after[-1])
    return np.delete(marks, ends + np.arange(len(ends)))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of least rank, the first of equals, is merged until no pair has one. n log n in its length."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []  # of the part that begins at i; 0 once it is gone

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteTokenizer:
    """Ids of a file of ranks, of a batch of texts at once."""

    def __init__(self, path: str):
        import public_tokenizers

        if public_tokenizers.PATTERN != PATTERN:
            raise ValueError("the automaton is made for another pattern")
        with open(path, "rb") as f:
            self._ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table = [b""] * (max(self._ranks.values()) + 1)
        for token, rank in self._ranks.items():
            table[rank] = token
        self._bytes = pa.array(table, pa.binary())
        self._lengths = np.array([len(t) for t in table], np.int64)
        self._memo: dict[bytes, bytes] = {}
        self._single = np.array([self._ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = ((self._ranks.get(t[:k]), self._ranks.get(t[k:]), r) for t, r in self._ranks.items() for k in range(1, len(t)))
        table = np.array([(a << 32 | b, r) for a, b, r in pairs if a is not None and b is not None], np.int64).reshape(-1, 2)
        table = table[np.argsort(table[:, 0])]
        self._pairs, self._pair_ranks = np.append(table[:, 0], -1), np.append(table[:, 1], NO_RANK)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NO_RANK for none."""
        key = left << 32 | right
        at = np.searchsorted(self._pairs[:-1], key)
        return np.where(self._pairs[at] == key, self._pair_ranks[at], NO_RANK)

    def _merged(self, pieces: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of different pieces: those of one length side by side, each round one merge in each of them."""
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self._ranks.get(piece)
            if whole is not None:
                yield i, whole.to_bytes(4, "little")
            elif len(piece) > SHORT_PIECE:
                yield i, array("I", merge(piece, self._ranks)).tobytes()
            else:
                by_length.setdefault(len(piece), []).append(i)
        for n, which in by_length.items():
            ids = self._single[np.frombuffer(b"".join(pieces[i] for i in which), np.uint8).reshape(-1, n)]
            which, ranks = np.array(which), self._rank(ids[:, :-1], ids[:, 1:])
            while len(which):
                width, row = ids.shape[1], np.arange(len(which))
                at = ranks.argmin(1)
                best = ranks[row, at]
                going = best != NO_RANK
                if not going.all():
                    data = ids[~going].astype("<u4").tobytes()
                    yield from ((i, data[4 * width * k : 4 * width * (k + 1)]) for k, i in enumerate(which[~going].tolist()))
                    which, ids, ranks, at, best = (x[going] for x in (which, ids, ranks, at, best))
                    row = np.arange(len(which))
                ids[row, at] = best
                rest = np.arange(width - 1)
                ids = np.take_along_axis(ids, rest + (rest > at[:, None]), 1)
                ranks = np.take_along_axis(ranks, rest[:-1] + (rest[:-1] >= at[:, None]), 1)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
                ranks[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
                ranks[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        out = [self._memo.get(p) for p in pieces]
        new = [i for i, known in enumerate(out) if known is None]
        if len(self._memo) + len(new) > MEMO:
            self._memo.clear()
        for k, ids in self._merged([pieces[i] for i in new]):
            out[new[k]] = ids
            if len(pieces[new[k]]) <= SHORT_PIECE:
                self._memo[pieces[new[k]]] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """For each text its ids, and the byte of the text at which each of them begins; null and empty texts have none."""
        texts = texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int32()))
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(at[0]), int(at[-1] - at[0]))
        at -= at[0]
        codes = np.frombuffer(data.to_pybytes().decode().encode("utf-32-le"), "<u4")
        sizes = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int8)
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        starts = upto[:-1][piece_starts(codes, np.searchsorted(upto, at[1:]))]
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, at[-1]).astype(np.int32)), data])
        numbered = pieces.dictionary_encode()
        made = pa.array(self._ids(numbered.dictionary.to_pylist()), pa.binary()).take(numbered.indices)
        bounds = np.frombuffer(made.buffers()[1], np.int32)[: len(made) + 1] // 4 if len(made) else np.zeros(1, np.int32)
        ids = np.frombuffer(made.buffers()[2], np.int32)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.int32)
        lists = pa.array(bounds[np.searchsorted(starts, at)], pa.int32())
        spans = np.concatenate([[0], np.cumsum(self._lengths[ids])])[:-1]
        per_text = np.diff(lists.to_numpy())
        offsets = spans - np.repeat(at[:-1], per_text)
        return pa.ListArray.from_arrays(lists, pa.array(ids)), pa.ListArray.from_arrays(lists, pa.array(offsets, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes that each list of ids stands for; null for null."""
        tokens = self._bytes.take(ids.flatten())
        at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        lists = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])
        data = memoryview(tokens.buffers()[2] or b"") if len(tokens) else memoryview(b"")
        bounds = at[lists].tolist()
        missing = ids.is_null().to_pylist()
        return pa.array([None if gone else bytes(data[a:b]) for a, b, gone in zip(bounds, bounds[1:], missing)], pa.binary())


@functools.lru_cache(2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row, and n_tokens, ids and offsets of its whole text.

    ids: what the vocabulary's ranks make of each match of its pattern, strings of special tokens being ordinary text.
    offsets: the byte of the text, in UTF-8, at which each token begins, so tokens i to j are the bytes from offsets[i]
    to offsets[j]; token_text gives them. Null and empty texts have no tokens. Rows stay apart, whatever their ids; an
    empty table stays empty. Work is linear in a text but for merging a single piece, n log n in it.
    """
    python_batches(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names)))
    types = dict(slim.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for b in batches:
            ids, offsets = bpe.encode(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], ids.value_lengths().cast(pa.int64()), ids, offsets], [*names, "n_tokens", "ids", "offsets"])

    out = slim.mapInArrow(run, ", ".join([*(f"{n} {types[n]}" for n in names), "n_tokens long", "ids array<int>", "offsets array<int>"]))
    return out.withColumnsRenamed(dict(zip(names, keep)))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns but ids_col, and `decoded`: the bytes that the ids stand for, null for null."""
    python_batches(encoded.sparkSession)
    (name,) = unused(encoded, "decoded")
    order = [c for c in encoded.columns if c != ids_col]
    slim = encoded.select(*order, F.col(ids_col).cast("array<int>").alias(ids_col))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in slim.dtypes if c != ids_col), f"`{name}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], bpe.decode(b.column(len(order)))], [*order, name])

    return slim.mapInArrow(run, schema)


def token_text(text: Column, offsets: Column, first: Column, last: Column) -> Column:
    """The bytes of tokens `first` to `last` (from 0, both included) of a text; fewer if it has fewer, empty if none."""
    data = F.encode(text, "utf-8")
    begin = F.get(offsets, first)
    end = F.coalesce(F.get(offsets, last + 1), F.octet_length(data))
    return F.coalesce(F.substring(data, begin + 1, end - begin), F.encode(F.lit(""), "utf-8"))
