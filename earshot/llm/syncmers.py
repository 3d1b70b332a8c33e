"""Document fingerprints of closed syncmers, matched by position."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import python_batches

#: Code points of a k-mer and of the inner substrings of which the minimum decides.
K, S = 16, 6
#: Code points that are worked on together.
CHUNK = 1_000_000
#: Rows of a bucket of neighbouring ids, about, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 10_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def _whole(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big")


def closed_syncmers(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of code points: k-mers whose least s-mer is their first or last.

    Whether a k-mer is one depends on its own code points alone, so equal passages have equal anchors wherever they are.
    """
    if len(points) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(points) - S + 1
        inner = np.zeros(n, np.uint64)
        for i in range(S):
            inner = inner * np.uint64(0x100000001B3) + points[i : i + n]
        inner = _mix(inner)
        least, width, have = inner, K - S + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        m = len(points) - K + 1
        least = np.minimum(least[:m], least[width - have : width - have + m])
        at = np.flatnonzero((inner[:m] == least) | (inner[K - S : K - S + m] == least))
        return at, _mix(inner[at] * _A + inner[at + S] * _B + inner[at + K - S])


def fingerprints(texts: list[str]) -> list[str]:
    """For each text all its anchors in text order, repeated ones too, 8 hexadecimal digits each.

    A text without an anchor (mostly one shorter than K) has a single one, of the whole text; the empty text has "".
    """
    out: list[str] = []
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            out += _some(texts[begin : i + 1])
            begin, size = i + 1, 0
    return out


def _some(texts: list[str]) -> list[str]:
    ends = np.cumsum([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at, h = closed_syncmers(points)
    doc = np.searchsorted(ends, at, "right")
    inside = at + K <= ends[doc] if len(at) else np.zeros(0, bool)
    digits = (h[inside] >> np.uint64(32)).astype(">u4").tobytes().hex()
    bounds = np.searchsorted(doc[inside], np.arange(len(texts) + 1)) * 8
    return [digits[a:b] if b > a else f"{_whole(t):08x}" if t else "" for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist())]


def likeness(a: str, b: str) -> float:
    """Share of the anchors of two texts that match in the same order: 1 for equal fingerprints.

    The first occurrence of an anchor in one text is matched with the first in the other, the second with the second,
    and so on; of these matches the longest chain that goes on in both texts is counted, which is linear in the length
    but for a logarithm. With j matched of n and m anchors the share is 2 j / (n + m), Dice's coefficient.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(t), ">u4").astype(np.uint64) for t in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    same = int(differ[0]) if len(differ) else n  # a common beginning matches as it is
    _, at, to = np.intersect1d(_occurrences(x[same:]), _occurrences(y[same:]), assume_unique=True, return_indices=True)
    chain: list[int] = []
    for i in to[np.argsort(at)].tolist():
        if not chain or i > chain[-1]:
            chain.append(i)
        else:
            chain[bisect_left(chain, i)] = i
    return 2 * (same + len(chain)) / (len(x) + len(y))


def _occurrences(h: np.ndarray) -> np.ndarray:
    """h (below 2^32) with, in the upper half, how often the value was there before."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
    out = np.empty(len(h), np.uint64)
    out[order] = ordered | (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64) << np.uint64(32)
    return out


def fingerprint_column(text: Column) -> Column:
    """Fingerprints of a column of texts; null counts as the empty text."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([t or "" for t in texts]), dtype=object)

    return of(text)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of edited ones, and how alike they are.

    The next document is the one with the next smaller id, after the last the first; rows of equal id follow each other
    by a hash of the text, and null ids come last. The edited text has its last floor(n / 3) code points replaced by as
    many of the next document, or all. Null text counts as empty. A single document is its own next one; an empty table
    gives no rows; other columns of docs are left out, so none can clash.

    Ids are cut into buckets at approximate quantiles, at most MOST_BUCKETS numbers on the driver. The greatest id of a
    bucket is a quantile itself, and its row is also sent, as a mere next one, to the bucket before. So texts are moved
    once, compressed, each bucket is read in order as a stream, and no task needs more than a batch in memory. Rows of
    an id that is several quantiles, and of null ids, are cut further by ranges of the hash of their texts.
    """
    spark = docs.sparkSession
    python_batches(spark, rows=1000, mb=4)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ids = slim.select("doc_id")
    n, nulls = ids.count(), ids.filter("doc_id is null").count()
    if not n:
        nothing = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return spark.createDataFrame([], nothing)
    buckets = max(1, min(MOST_BUCKETS, (n - nulls) // BUCKET_ROWS))
    cuts: list[float] = []
    if n > nulls:
        most = float(ids.agg(F.max("doc_id").alias("m")).first()["m"])
        cuts = [*ids.dropna().approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets), most] if buckets > 1 else [most]
    times = Counter(cuts)
    # Above 2^53 several ids have one double, so a quantile does not name one.
    parts_of: dict = {c: k for c, k in times.items() if k > 1 and abs(c) < 1 << 53}
    if nulls:
        parts_of[None] = max(1, min(MOST_BUCKETS, nulls // BUCKET_ROWS))
    segments = [(c, 0) for c in sorted(times, reverse=True)]  # in the order of reading: (greatest id, part of its rows)
    least: dict = {}
    if parts_of:  # the parts that there are, and the hash that each begins with
        repeated = [int(c) for c in parts_of if c is not None]
        rows, many = slim.filter(F.col("doc_id").isNull() | F.col("doc_id").isin(repeated)), F.lit(parts_of.get(None, 1))
        if repeated:
            table = F.create_map(*(F.lit(x).cast("long") for c in repeated for x in (c, parts_of[c])))
            many = F.when(F.col("doc_id").isNull(), many).otherwise(table[F.col("doc_id")])
        # as in spread: the upper 32 bits of the hash, from 0 on, times the number of parts
        part = F.shiftright((F.shiftright("tie", 32) + F.lit(1 << 31)) * many, 32)
        for r in rows.groupBy(F.col("doc_id").cast("double").alias("c"), part.cast("int").alias("part")).agg(F.min("tie").alias("t")).collect():
            least[r["c"], r["part"]] = r["t"]
        segments = [s for c in [*sorted(times, reverse=True), *[None] * bool(nulls)] for s in (sorted(k for k in least if k[0] == c) if c in parts_of else [(c, 0)])]
    place = {s: i for i, s in enumerate(segments)}
    last_part = {c: i for (c, _), i in place.items()}  # ids below a repeated one follow its last part

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, heads = zstandard.ZstdCompressor(3), np.array(sorted(times))
        of_head = np.array([last_part[c] for c in heads.tolist()], np.int64)
        for b in batches:
            known = np.array(b.column(0).is_valid())
            value, tie = b.column(0).fill_null(0).to_numpy().astype(np.float64), b.column(2).to_numpy()
            bucket, is_head = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
            if len(heads):
                at = np.minimum(np.searchsorted(heads, value, "left"), len(heads) - 1)
                bucket, is_head = of_head[at], known & (heads[at] == value)
            if parts_of:
                for i in np.flatnonzero(~known | is_head).tolist():
                    c = float(value[i]) if known[i] else None
                    if c in parts_of:
                        s = (c, ((int(tie[i]) >> 32) + (1 << 31)) * parts_of[c] >> 32)
                        bucket[i], is_head[i] = place[s], int(tie[i]) == least[s]
            # The first row of a segment is the next one of the segment before; the first segment follows the last.
            before = (bucket - 1) % len(segments)
            text = [pack.compress(t.encode()) for t in b.column(1).to_pylist()]
            rows = np.concatenate([np.arange(len(known)), np.flatnonzero(is_head)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([bucket, before[is_head]]).astype(np.int32)), pa.array(np.arange(len(rows)) >= len(known)), b.column(0).take(take), b.column(2).take(take), pa.array(text, pa.binary()).take(take)],
                ["bucket", "only_next", "doc_id", "tie", "z"],
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, last = zstandard.ZstdDecompressor(), None
        for b in batches:
            texts = [unpack.decompress(z).decode() for z in b.column(4).to_pylist()]
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts, fingerprints(texts)))
            if last is not None:
                rows.insert(0, last)
            last = rows[-1] if rows else last
            done, edited = [], []
            for this, after in zip(rows, rows[1:]):
                if not this[1] and this[0] == after[0]:
                    t = this[3]
                    m = len(t) // 3
                    done.append((this, after))
                    edited.append(t[: len(t) - m] + after[3][:m])
            marks = fingerprints(edited)
            out = {
                "doc_id": pa.array([a[2] for a, _ in done], pa.int64()),
                "n_chars": pa.array([len(a[3]) for a, _ in done], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array([a[4] for a, _ in done], pa.string()),
                "edited_fingerprint": pa.array(marks, pa.string()),
                "near_edited": pa.array([likeness(a[4], m) for (a, _), m in zip(done, marks)], pa.float64()),
                "near_next": pa.array([likeness(a[4], b_[4]) for a, b_ in done], pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(out)

    dealt = slim.mapInArrow(spread, "bucket int, only_next boolean, doc_id long, tie long, z binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "only_next", F.col("doc_id").desc_nulls_last(), "tie")
    return in_order.mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
