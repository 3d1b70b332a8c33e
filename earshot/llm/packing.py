"""Best-fit packing by bin completion: branch and bound over the histogram of lengths."""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm.common import checkpointed, give_back, python_batches
from earshot.llm.tokens import word_tokenizer

#: Decisions of the search, and twice the number of different lengths more, before the best packing so far is taken; and
#: fillings that are looked at for each of these decisions, on the whole.
NODES, LOOKS = 4_000, 20
#: Decisions on the way to the present one whose fillings are kept; those of earlier ones are made again on the way back.
KEPT = 32
#: Pieces of one length that are numbered in one window, about.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Pattern:
    """`bins` sequences, each with `items`: (length, how many)."""

    items: tuple[tuple[int, int], ...]
    bins: int


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the sum over the capacity, and the bound that long pieces need one each.

    For each k up to half the capacity: pieces over capacity - k share a bin with none of length k or more, pieces over
    half the capacity have one each, and those from k on fill what these leave.
    """
    size = np.zeros(capacity + 1, np.int64)
    for length, n in hist.items():
        size[length] = n
    n_upto, w_upto, half = np.cumsum(size), np.cumsum(size * np.arange(capacity + 1)), capacity // 2
    k = np.arange(1, half + 1)
    alone = n_upto[-1] - n_upto[capacity - k]
    large = n_upto[capacity - k] - n_upto[half]
    room = large * capacity - (w_upto[capacity - k] - w_upto[half])
    more = w_upto[half] - w_upto[k - 1] - room
    each = alone + large + np.maximum(0, -(-more // capacity))
    return max(-(-int(w_upto[-1]) // capacity), int(each.max(initial=0)))


def best_fit(hist: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, with equal bins handled together."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, bins: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_[room].append((items, bins))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - (left % each) * length, ((length, left % each),), 1)
                break
            room = rooms[at]
            items, bins = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // length, left)
            full = min(bins, left // each)
            put(room - each * length, (*items, (length, each)), full)
            if bins > full:
                put(room, items, bins - full)
            left -= full * each
    return [Pattern(items, bins) for room in open_.values() for items, bins in room]


class _Fillings:
    """The undominated multisets of the pieces left that fit into `room`, least waste first, made one at a time.

    reach[i] holds, as the bits of one number, the sums up to `room` that pieces of the i shortest lengths give. So for
    each waste the walk from the longest length down enters no path that does not end in a filling of just that sum.
    """

    def __init__(self, lengths: list[int], counts: list[int], room: int):
        n = bisect_right(lengths, room)
        self.lengths, self.counts, self.room, self.every = lengths[:n], counts[:n], room, (1 << room + 1) - 1
        self.reach = [1]
        for length, have in zip(self.lengths, self.counts):
            sums, have, step = self.reach[-1], min(have, room // length), 1
            while have > 0:  # 1, 2, 4, ... pieces together, and the rest
                step = min(step, have)
                sums |= sums << step * length & self.every
                have, step = have - step, 2 * step
            self.reach.append(sums)

    def upto(self, waste: int, looks: list[int]) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        """(waste, ((length, how many), ...)) of undominated fillings that waste this much at most.

        looks: how many fillings may still be looked at, counted down here.
        """
        for w in range(min(waste, self.room) + 1):
            if self.reach[-1] >> self.room - w & 1:
                for items in self._exact(len(self.lengths), self.room - w):
                    looks[0] -= 1
                    if looks[0] < 0:
                        return
                    if not self.dominated(items, w):
                        yield w, items

    def _exact(self, n: int, total: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not total:
            yield ()
            return
        for i in range(min(n, bisect_right(self.lengths, total)) - 1, -1, -1):
            if not self.reach[i + 1] >> total & 1:
                return  # nor do fewer lengths give it
            length = self.lengths[i]
            for k in range(min(self.counts[i], total // length), 0, -1):
                if self.reach[i] >> total - k * length & 1:
                    for rest in self._exact(i, total - k * length):
                        yield ((length, k), *rest)

    def dominated(self, items: tuple[tuple[int, int], ...], waste: int) -> bool:
        """Whether a piece left out can take the place of some of the pieces, or of none, that are no longer together.

        Then the filling with that piece is as good in any packing, as the pieces go where it was. A piece in the place
        of one as long changes nothing and does not count.
        """
        used = dict(items)
        sums, several = 1, 0  # of any pieces; of two at least
        single = 0
        for length, k in items:
            for _ in range(k):
                several |= (several | single) << length
                single |= 1 << length
                sums |= sums << length
        below, have = (sums << 1, 1) if waste else (0, 0)  # sums and up to `waste` more, at least one
        while have < waste:
            step = min(have, waste - have)
            below, have = below | below << step, have + step
        for length, have in zip(self.lengths, self.counts):
            if have > used.get(length, 0) and (below | several) >> length & 1:
                return True
        return False


def bin_completion(hist: dict[int, int], capacity: int, nodes: int | None = None) -> list[Pattern]:
    """Few sequences of at most `capacity` for hist (length to count): the fewest, or the best found in `nodes` decisions.

    The largest piece left is completed to a bin by each undominated filling in turn, least waste first, the bin made as
    often as its pieces are left, and on the way back once. A branch ends where its waste, or the lower bound of what it
    leaves, forbids fewer bins than the best packing so far has, or where the same pieces were left after as few bins
    before. The first such packing is best-fit decreasing, and now and then a branch is ended by it. The lower bound
    ends the search, so without the limits (`nodes`, None: NODES and twice the number of lengths; LOOKS) it is exact.
    """
    hist = {k: n for k, n in hist.items() if n}
    if not hist:
        return []
    nodes = NODES + 2 * len(hist) if nodes is None else nodes
    total = sum(k * n for k, n in hist.items())
    bound = lower_bound(hist, capacity)
    best = best_fit(hist, capacity)
    bins_of = lambda p: sum(x.bins for x in p)
    fewest = bins_of(best)
    if fewest == bound:
        return best
    left = dict(sorted(hist.items()))
    path: list[Pattern] = []
    seen: dict[int, int] = {}
    wasted, used, made = 0, 0, 0
    looks = [LOOKS * nodes]

    def branches() -> Iterator[Pattern]:
        """Bins of the largest piece left; what may be wasted is asked again after each, as `fewest` falls."""
        lengths = [k for k, n in left.items() if n]
        largest = lengths[-1]
        counts = [left[k] for k in lengths]
        counts[-1] -= 1
        allowed = (fewest - 1) * capacity - total - wasted
        if allowed < 0:
            return
        for w, items in _Fillings(lengths, counts, capacity - largest).upto(allowed, looks):
            mine = dict(items)
            mine[largest] = mine.get(largest, 0) + 1
            whole = tuple(sorted(mine.items(), reverse=True))
            often = min(left[k] // n for k, n in whole)
            for bins in {often: 0, 1: 0}:
                yield Pattern(whole, bins)
            if w > (fewest - 1) * capacity - total - wasted:
                return

    def change(p: Pattern, sign: int) -> None:
        nonlocal wasted, used
        for k, n in p.items:
            left[k] += sign * n * p.bins
        wasted -= sign * (capacity - sum(k * n for k, n in p.items)) * p.bins
        used -= sign * p.bins

    stack: list[list] = [[branches(), 0]]  # the branches of each decision, and how many were tried
    while stack and made < nodes and looks[0] > 0 and fewest > bound:
        if stack[-1][0] is None:
            stack[-1][0] = itertools.islice(branches(), stack[-1][1], None)
        p = next(stack[-1][0], None)
        stack[-1][1] += 1
        if p is None:
            stack.pop()
            if path:
                change(path.pop(), 1)
            continue
        made += 1
        change(p, -1)
        path.append(p)
        rest = {k: n for k, n in left.items() if n}
        if not rest and used < fewest:
            best, fewest = list(path), used
        state = hash(tuple(left.values()))
        if not rest or wasted > (fewest - 1) * capacity - total or seen.get(state, used + 1) <= used or used + lower_bound(rest, capacity) >= fewest:
            change(path.pop(), 1)
            continue
        seen[state] = used
        if made % 64 == 1:
            filled = best_fit(rest, capacity)
            if used + bins_of(filled) < fewest:
                best, fewest = [*path, *filled], used + bins_of(filled)
        stack.append([branches(), 0])
        if len(stack) > KEPT:
            stack[-KEPT - 1][0] = None
    return best


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, bins, offset): the k-th piece of a length has its place there."""
    ranks: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, n in p.items:
            rows.setdefault(length, []).append((ranks[length], sequence, p.bins, offset))
            ranks[length] += n * p.bins
            offset += n * length
        sequence += p.bins
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of each document's ids and then end_id; with_ids adds ids, 32 bit each."""
    python_batches(docs.sparkSession, rows=2000, mb=4)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(slim.dtypes)["doc_id"]
    last = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        for b in batches:
            rows, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, encoded in enumerate(tokenizer.encode(b.column(1))):
                ids = bytes(encoded) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
            columns = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            give_back()

    return slim.mapInArrow(encode, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int, nodes: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset. pieces: doc_id, piece, length (1 to capacity), and more.

    Pieces of one length are interchangeable, so the search sees only how many there are of each length: at most
    `capacity` numbers reach the driver, and its patterns go back as a table that is bounded by the capacity, not by the
    data. The k-th piece of a length then looks its place up. Pieces are numbered within (length, bucket of a hash), and
    buckets by their counts, so that no task holds all pieces of a common length. pieces must give the same rows when
    read again, as a checkpoint does.
    """
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(bin_completion(hist, capacity, nodes))
    buckets = max(16, min(4096, sum(hist.values()) // BUCKET_ROWS))
    named = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    offsets = named.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    offsets = offsets.select("length", "_bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = named.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        for k, at in length.groupby(length.to_numpy()).indices.items():
            t, r = table[int(k)], rank.to_numpy()[at]
            row = t[np.searchsorted(t[:, 0], r, "right") - 1]
            i = r - row[:, 0]
            out[at, 0] = row[:, 1] + i % row[:, 2]
            out[at, 1] = row[:, 3] + i // row[:, 2] * k
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its whole text's ids and id 1; only a longer one than `capacity` is cut, into pieces of `capacity` and
    a last one. Null text counts as empty (id 1 alone). Repeated rows are packed as often as they occur; an empty table
    gives no rows. Other columns of docs are left out, so none can clash. with_ids: also the ids of each piece.
    """
    pieces = checkpointed(cut_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col, with_ids=with_ids))
    return pack_pieces(pieces, capacity)
