"""N-gram Jaccard join by chosen paths: sets split by sampled shared tokens, small buckets compared, runs repeated."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm.common import BROADCAST_ROWS, checkpointed, give_back, python_batches, unused, weighted_join
from earshot.llm.leafjoin import link_leaves, split_large

#: Words of a shingle, least similarity, and the probability with which a pair just as similar is to be met.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Members of a bucket that is not split further; for each round that splits larger ones, its further samples and how
#: many of them each bucket draws. More of both for other similarities and recalls: see pools_for.
SMALL, POOLS = 256, ((10, 4), (8, 3), (8, 3), (8, 3))
#: Pairs for each set, on average, that are compared one by one; more of them are by one matrix of all sets.
FEW = 4
#: Words whose hashes a worker remembers.
CACHE = 170_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def runs_for(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Runs after which a pair of this similarity has shared a sampled token with probability recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity)))


def split_loss(similarity: float, runs: int, pools: tuple[tuple[int, int], ...]) -> float:
    """Probability that a pair just as similar never meets if all its buckets are split in all rounds.

    The pair shares g samples of a round's pool, the same ones in each of its buckets; a bucket draws its own few.
    """
    chances = [[math.comb(n, g) * similarity**g * (1 - similarity) ** (n - g) for g in range(n + 1)] for n, _ in pools]
    total = 0.0
    for shared in itertools.product(*(range(n + 1) for n, _ in pools)):
        weight = math.prod(c[g] for c, g in zip(chances, shared))
        if weight < 1e-9:
            total += weight
            continue
        lost = 0.0  # in one bucket
        for g, (n, few) in reversed([*zip(shared, pools)]):
            lost = sum(math.comb(g, j) * math.comb(n - g, few - j) / math.comb(n, few) * lost**j for j in range(few + 1))
        total += weight * (1 - similarity * (1 - lost)) ** runs
    return total


@functools.cache
def pools_for(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[tuple[int, int], ...]:
    """POOLS, enlarged until splitting leaves the recall."""
    pools = POOLS
    while pools and split_loss(similarity, runs_for(similarity, recall), pools) > max(1 - recall, 1.5 * (1 - similarity) ** runs_for(similarity, recall)):
        pools = tuple((n + 2, few + 1) for n, few in pools)
    return pools


class Shingles:
    """The set of a text's word n-grams as ascending 64-bit hashes; of all its words if there are fewer.

    Words are runs of letters, digits and _, lower case; a text without any goes by what stands between white space.
    The empty set is that of a text of white space only.
    """

    _words = re.compile(r"\w+").findall

    def __init__(self, n: int = WORDS):
        self._n, self._known = n, {}

    def _hash(self, word: str) -> int:
        if len(self._known) >= CACHE:
            self._known.clear()
        h = self._known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        words = self._words(text) or text.split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self._known
        h = np.array([known[w] if w in known else self._hash(w) for w in words], np.uint64)
        n = min(self._n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                out = (out ^ h[i : len(h) - n + 1 + i]) * _A
                out ^= out >> np.uint64(29)
        return np.unique(out)


def samples(tokens: np.ndarray, k: int) -> np.ndarray:
    """For each of k random orders of all tokens the first one in the set: two sets share it with their similarity."""
    out = np.empty(k, np.int64)
    step = max(1, (1 << 14) // len(tokens))
    with np.errstate(over="ignore"):
        order = np.arange(k, dtype=np.uint64)[:, None] * _A + np.uint64(0x2545F4914F6CDD1D)
        for i in range(0, k, step):
            x = tokens ^ order[i : i + step]
            x *= _B
            x ^= x >> np.uint64(32)
            x *= _A
            out[i : i + step] = (x.min(1) >> np.uint64(1)).astype(np.int64)
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two sets have in common."""
    both = np.concatenate((a, b))
    both.sort()
    return np.count_nonzero(both[1:] == both[:-1])


def shared_by_all(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many tokens each set of a has in common with each of b; None: with each of a."""
    sets = a if b is None else a + b
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    which, column = which[several], column[several]
    place = np.cumsum(count > 1) - 1
    column = place[column]
    n_columns = int(place[-1] + 1) if len(place) else 0
    n_a = len(a)
    both = np.zeros((n_a, n_a if b is None else len(b)), np.float64)
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    width = 16_384
    for c in range(0, n_columns, width):
        lo, hi = np.searchsorted(column, (c, c + width))
        m = np.zeros((len(sets), min(width, n_columns - c)), np.float32)
        m[which[lo:hi], column[lo:hi] - c] = 1
        both += m[:n_a] @ (m if b is None else m[n_a:]).T
    if b is None:
        np.fill_diagonal(both, [len(s) for s in a])
    return both


def jaccard_links(similarity: float):
    """Which sets (payloads of ascending 64-bit hashes) have at least this Jaccard similarity, exactly."""

    def enough(both: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        # Integers below 2^53, so that a similarity of just 0.8 counts.
        return both * (1 + similarity) >= similarity * (size_a + size_b) * (1 - 1e-12)

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        same = b is a or a == b
        a = [np.frombuffer(x, "<u8") for x in a]
        b = a if same else [np.frombuffer(x, "<u8") for x in b]
        size_a = np.array([len(s) for s in a], np.float64)
        size_b = size_a if same else np.array([len(s) for s in b], np.float64)
        # Two sets share no more than the smaller one has, so most pairs are told apart by their sizes.
        out = enough(np.minimum(size_a[:, None], size_b[None, :]), size_a[:, None], size_b[None, :])
        at, bt = np.nonzero(np.triu(out, 1) if same else out)
        if len(at) <= FEW * max(len(a), len(b)):
            both = np.array([shared(a[i], b[j]) for i, j in zip(at.tolist(), bt.tolist())], np.float64)
            out[at, bt] = hit = enough(both, size_a[at], size_b[bt])
            if same:
                out[bt, at] = hit
            return out
        return enough(shared_by_all(a, None if same else b), size_a[:, None], size_b[None, :])

    return linked


def texts_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(rep, cnt, text) of the row that each item names by id and hash of its text, once for each copy of that row.

    rows: row, text_hash, text; items: rep, cnt, of (row, text_hash). So no more texts come than there are rows, also if
    one id repeats. An item's count is at least its row's, so that a row that repeats often is not shuffled to one task.
    """
    wanted = checkpointed(items.select(F.xxhash64("of.row", "of.text_hash").alias("source"), "rep", "cnt"))
    there = rows.select(F.xxhash64("row", "text_hash").alias("source"), "text")
    if wanted.count() <= BROADCAST_ROWS:
        return there.join(F.broadcast(wanted), "source").select("rep", "cnt", "text")
    return weighted_join(there, wanted.withColumn("w", F.col("cnt")), "source", "w").select("rep", "cnt", "text")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links) of each row of docs; with_hash adds text_hash, xxhash64 of the text.

    Two texts are linked if their sets of word n-grams have a Jaccard similarity of at least `similarity`; n_links counts
    the other rows that a row is linked to, class_id is the least doc_id that links lead to, its own included. Texts
    with fewer words have one n-gram of them all; null and blank texts link with nothing. Rows of null id link like
    others and count as greater than any id: a class of them alone has a null class_id. Repeated rows are links. An
    empty table stays empty; other columns are left out.

    Equal sets are one item with a count. In each of runs_for() runs a set goes to the bucket of one sampled token;
    two sets share it with their similarity. Buckets of over SMALL sets are split by further samples, each bucket by a few
    drawn for it from the round's pool (pools_for), each set going along with all of them, round by round, so that buckets of a token that many texts share come apart while similar
    sets stay together; copies too alike to come apart are compared in blocks. Within a bucket similarities are exact. Only
    ids, counts and samples are shuffled for that; the sets themselves, once for each bucket with company, are made
    again for the documents that have any. (Items are known by 64 bits of a hash of their set.)
    """
    spark = docs.sparkSession
    python_batches(spark)
    runs = runs_for(similarity, recall)
    pools = pools_for(similarity, recall)
    coordinates = runs + sum(n for n, _ in pools)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("row", F.coalesce("doc_id", "text_hash"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for b in batches:
            keys, sizes, sampled = [], [], []
            for text in b.column(1).to_pylist():
                s = make(text)
                keys.append(int.from_bytes(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                sizes.append(8 * len(s))
                sampled.append(samples(s, coordinates) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sampled, pa.list_(pa.int64()))], ["doc_id", "text_hash", "row", "rep", "bytes", "samples"])
            give_back()

    described = checkpointed(slim.mapInArrow(describe, "doc_id long, text_hash long, row long, rep long, bytes long, samples array<long>"))
    items = checkpointed(described.filter("rep is not null").groupBy("rep").agg(F.min("doc_id").alias("first"), F.min(F.struct("row", "text_hash")).alias("of"), F.count("*").alias("cnt"), F.any_value("bytes").alias("bytes"), F.any_value("samples").alias("samples")))
    first = F.array(*(F.xxhash64(F.lit(r), F.col("samples")[r]) for r in range(runs)))
    paths = items.select(F.explode(F.array_distinct(first)).alias("leaf"), "rep", "bytes")

    def split(large: DataFrame, step: int) -> DataFrame:
        rows = large.join(items.select("rep", "samples"), "rep")
        n, few = pools[step]
        begin = runs + sum(m for m, _ in pools[:step])
        # The bucket's own draw: the few of least hash, so that a pair lost in one bucket is not lost in all of them.
        drawn = F.slice(F.array_sort(F.array(*(F.struct(F.xxhash64("leaf", F.lit(k)).alias("h"), F.lit(k).alias("k"), F.col("samples")[begin + k].alias("x")) for k in range(n)))), 1, few)
        more = F.transform(drawn, lambda d: F.xxhash64("leaf", d["k"], d["x"]))
        return rows.select("leaf", "rep", "bytes", F.explode(F.array_distinct(more)).alias("child"))

    paths = split_large(paths, SMALL, split, len(pools))

    def payloads(reps: DataFrame) -> DataFrame:
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Shingles(words)
            for b in batches:
                payload = [make(t).astype("<u8").tobytes() for t in b.column(2).to_pylist()]
                # a text of another set under the same source, two in 2^64, goes
                right = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) == r for p, r in zip(payload, b.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(payload, pa.binary())], ["rep", "cnt", "payload"]).filter(pa.array(right))
                give_back()

        return texts_of(slim, items.join(reps, "rep", "left_semi")).mapInArrow(sets, "rep long, cnt long, payload binary").dropDuplicates(["rep"])

    found = link_leaves(payloads, paths, jaccard_links(similarity))
    classes = items.select("rep", "first", "cnt").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = classes.groupBy("component").agg(F.min("first").alias("class_id"), F.count("*").alias("w"))
    classed = weighted_join(classes, checkpointed(least), "component", "w")
    of_item = checkpointed(classed.select("rep", F.col("cnt").alias("w"), (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id"))
    columns = ["doc_id", "class_id", "n_links", *["text_hash"] * with_hash]
    linked = weighted_join(described.filter("rep is not null").select("doc_id", "text_hash", "rep"), of_item, "rep", "w").select(*columns)
    alone = described.filter("rep is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")).select(*columns)
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each class: the one of the smallest id; documents without links all stay.

    Repeated rows (equal id and text) are a class, of which one row stays. A null id counts as a large one made of the
    text. Otherwise ids are taken to be unique: two texts of one id that both lead a class are told apart by their hash
    only if the classes differ in id. Texts aren't moved unless over 100,000 rows go or repeat.
    """
    tid, th, n = unused(docs, "tid", "th", "n")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    large = F.shiftrightunsigned(text_hash, 2) + F.lit(1 << 62)
    docs = docs.withColumns({tid: F.coalesce(F.col(id_col).cast("long"), large), th: text_hash})
    joined = checkpointed(jaccard_join(docs.select(tid, text_col), id_col=tid, text_col=text_col, with_hash=True, **how).filter("n_links > 0"))
    lead = joined.filter("doc_id = class_id").groupBy("class_id").agg(F.min("text_hash").alias("lead"), F.count("*").alias("copies"))
    told = weighted_join(joined, lead.join(joined.groupBy("class_id").agg(F.count("*").alias("w")), "class_id"), "class_id", "w")
    leads = (F.col("doc_id") == F.col("class_id")) & (F.col("text_hash") == F.col("lead"))
    gone = checkpointed(told.filter(~leads).select(F.col("doc_id").alias(tid), F.col("text_hash").alias(th)).distinct())
    n_gone = gone.count()
    stays = docs.join(F.broadcast(gone) if n_gone <= 100_000 else gone, [tid, th], "left_anti")
    again = checkpointed(lead.filter("copies > 1").select(F.col("class_id").alias(tid), F.col("lead").alias(th)))
    n_again = again.count()
    if n_again:
        repeated = F.broadcast(again) if n_again <= 100_000 else again
        one = stays.join(repeated, [tid, th], "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(tid, th).orderBy(th))).filter(F.col(n) == 1)
        stays = stays.join(repeated, [tid, th], "left_anti").unionByName(one.drop(n))
    return stays.drop(tid, th)
