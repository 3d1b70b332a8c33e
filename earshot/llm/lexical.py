"""Ranked lexical search: documents scored one after the other from compressed postings, shard by shard, then merged."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm.common import checkpointed, python_batches, small_join

#: Documents, and bytes of text, of a shard; a longer text is a shard of its own.
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
#: Documents whose scores are summed together when the postings of an item are merged; items that are searched together.
WINDOW, ITEMS = 2048, 256

# The bytes that belong to no term, and the same as a pattern of what does.
BREAKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[list(UPPER.encode())] = list(LOWER.encode())
_FOLD[list(BREAKS)] = 0


def terms_of(text: Column) -> Column:
    """The terms of a text, with repeats: runs of anything but ASCII marks, white space and controls; A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), 1)


def terms_of_texts(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, term) of each term of an array of strings."""
    texts = texts.cast(pa.string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]] if len(texts) else np.zeros(0, np.uint8)
    at -= at[0]
    inside = data > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = at[:-1][np.diff(at) > 0]
    starts[firsts] = inside[firsts]  # a term never goes on into the next text
    where = np.flatnonzero(starts)
    upto = np.concatenate([[0], np.cumsum(inside)])  # bytes of terms before each byte
    offsets = np.append(upto[where], upto[-1]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return np.searchsorted(at, where, "right") - 1, terms


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2^63 as bytes of seven bits, the last of each below 128; and how many bytes each takes."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 9):
        size += x >= np.uint64(1 << (7 * k))
    out, ends = np.zeros(int(size.sum()), np.uint8), np.cumsum(size)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[ends[has] - 1 - k] = ((x[has] >> np.uint64(7 * k)) & np.uint64(127)) | np.uint64(128 if k else 0)
    return out, size


def numbers(data: bytes) -> np.ndarray:
    """What varints made bytes of."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    first = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - first).max(initial=-1)) + 1):
        has = ends - first >= k
        out[has] = (out[has] << 7) | (b[first[has] + k] & 127)
    return out


class _Shard:
    """Texts gathered until there are enough for a shard."""

    def __init__(self):
        self.ids, self.of, self.terms, self.counts, self.docs, self.bytes = [], [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        of, terms = terms_of_texts(texts)
        numbered = terms.dictionary_encode()
        n = max(1, len(numbered.dictionary))
        pairs, counts = np.unique(of * n + numbered.indices.to_numpy(), return_counts=True)
        self.ids.append(ids), self.of.append(pairs // n + self.docs), self.counts.append(counts)
        self.terms.append(numbered.dictionary.take(pa.array(pairs % n)))
        self.docs += len(texts)
        self.bytes += texts.nbytes

    def rows(self) -> pa.RecordBatch:
        """A row for each term, by term: df and postings; and one of no term for the documents: their ids and lengths.

        Documents are numbered by id, null ids last. postings: gaps between their numbers and, after all gaps, how often
        the term occurs in each."""
        ids = pa.concat_arrays(self.ids).cast(pa.int64())
        order = np.lexsort([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)])
        place = np.empty(self.docs, np.int64)
        place[order] = np.arange(self.docs)
        of, counts = place[np.concatenate(self.of)], np.concatenate(self.counts)
        lengths = np.bincount(of, counts, self.docs).astype(np.int64)
        numbered = pa.chunked_array(self.terms).combine_chunks().dictionary_encode()
        numbered = numbered.combine_chunks() if isinstance(numbered, pa.ChunkedArray) else numbered
        code = numbered.indices.to_numpy()
        by = np.lexsort([of, code])
        of, counts, code = of[by], counts[by], code[by]
        df = np.bincount(code, minlength=len(numbered.dictionary))
        ends = np.cumsum(df)
        gaps = np.diff(of, prepend=0)
        if len(of):
            gaps[ends - df] = of[ends - df]
        (g, g_size), (c, c_size) = varints(gaps), varints(counts)
        edges = np.concatenate([[0], ends])
        g_at, c_at = (np.concatenate([[0], np.cumsum(s)])[edges].tolist() for s in (g_size, c_size))
        g, c = g.tobytes(), c.tobytes()
        postings = [g[a:b] + c[x:y] for a, b, x, y in zip(g_at, g_at[1:], c_at, c_at[1:])]
        named, _ = varints(lengths)
        key = ids.take(pa.array(order)).drop_null()
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([numbered.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array([*df.tolist(), int((lengths > 0).sum())], pa.int64()), pa.array([*[0] * len(df), int(lengths.sum())], pa.int64()),
             pa.array([*postings, named.tobytes()], pa.binary()), pa.concat_arrays([pa.nulls(len(df), pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key)])],
            ["term", "df", "length", "postings", "ids"],
        )


INDEX = "shard long, term string, df long, length long, postings binary, ids array<long>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of whole texts, checkpointed: (shard, term, df, length, postings, ids), by shard and term.

    Each shard is some documents of one partition, ordered by id, so nothing is shuffled. The row of a null term has the
    shard's ids, their lengths in terms as postings, how many have a term as df, and how many terms they have as length.
    Null and empty texts have no terms; rows of one id are documents of their own; other columns are left out.
    """
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = (TaskContext.get().partitionId() << 32), _Shard()

        def out() -> pa.RecordBatch:
            rows = shard.rows()
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, number), pa.int64()), *rows.columns], ["shard", *rows.schema.names])

        for b in batches:
            for at in range(0, b.num_rows, shard_docs):
                part = b.slice(at, shard_docs)
                if shard.docs and (shard.docs + part.num_rows > shard_docs or shard.bytes + part.column(1).nbytes > shard_bytes):
                    yield out()
                    number, shard = number + 1, _Shard()
                shard.add(part.column(0), part.column(1))
        if shard.docs:
            yield out()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return checkpointed(slim.mapInArrow(run, INDEX))


class _Postings:
    """What a term adds to the score of each document that holds it, by the documents' numbers in the shard."""

    def __init__(self, data: bytes, weight: int, m: np.ndarray):
        x = numbers(data)
        n = len(x) // 2
        tf = x[n:]
        self.docs = np.cumsum(x[:n])
        self.scores = weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs]))


def best_documents(lists: list[_Postings], k: int) -> list[tuple[int, int]]:
    """The k (score, -document) of the highest scores above 0 in lists of postings, of equal scores the first documents.

    A heap has the next document of each list. The least one begins a window of WINDOW documents; the lists that have any
    in it give them, their scores are summed, and the lists go back with what comes next. Only scores that would get in
    reach the heap of results, which never has more than k."""
    queue = [(int(p.docs[0]), i, 0) for i, p in enumerate(lists) if len(p.docs)]
    heapq.heapify(queue)
    best: list[tuple[int, int]] = []
    while queue:
        begin = queue[0][0]
        scores = np.zeros(WINDOW, np.int64)
        while queue and queue[0][0] < begin + WINDOW:
            _, i, at = heapq.heappop(queue)
            docs = lists[i].docs
            to = at + int(np.searchsorted(docs[at : at + WINDOW], begin + WINDOW))
            scores[docs[at:to] - begin] += lists[i].scores[at:to]
            if to < len(docs):
                heapq.heappush(queue, (int(docs[to]), i, to))
        found = np.flatnonzero(scores > (best[0][0] if len(best) == k else 0))
        if len(found) > k:  # of those, the k best are all that can stay
            found = np.sort(found[np.argsort(-scores[found], kind="stable")[:k]])
        for d in found.tolist():
            entry = (int(scores[d]), -(begin + d))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return best


def search(index: DataFrame, queries: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_col, rank, doc_id, score): the k highest-scoring documents of build_index for each row of queries.

    An item's terms count once each. A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), where N documents have a
    term at all and df this one; a document of n terms has m = 100 - 50 + (50 n N) div L, L being the terms of all; its
    score sums w * ((10^9 tf) div (1000 tf + 20 m)). Ranks go from 1 without ties, equal scores by ascending doc_id, null
    ids last; documents with score 0 are no results, so items without terms or matches have no rows. Rows of one item_col
    value are one item; a null one is an item, too. Empty tables give no rows.

    Terms of the items meet the postings by a join (sent to all executors up to BROADCAST_ROWS terms), so only postings
    that are asked for are shuffled, by shard and by block of ITEMS items. A shard's documents are merged by
    best_documents; of the shards' results each task keeps k an item before the last merge.
    """
    spark = index.sparkSession
    item_type = dict(queries.dtypes)[item_col]
    named = F.coalesce(F.concat(F.lit("="), F.col(item_col).cast("string")), F.lit(""))  # a null item is one, too
    asked = queries.select(named.alias("item"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    # A block of items is a hash of them, so that no window numbers all items.
    n_blocks = max(1, -(-queries.select(item_col).distinct().count() // ITEMS))
    asked = checkpointed(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")))
    total = index.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
    n, length = int(total["n"]), int(total["l"])
    names = checkpointed(asked.groupBy("term").agg(F.collect_set("block").alias("blocks")))
    hits = checkpointed(small_join(index.filter("term is not null").select("shard", "term", "df", "postings"), names, ["term"], "inner"))
    weights = hits.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight"))
    members = asked.groupBy("block", "term").agg(F.collect_list("item").alias("items")).join(weights, "term")
    members = checkpointed(members)
    dealt = small_join(hits.select("shard", "term", "postings", F.explode("blocks").alias("block")), members, ["block", "term"], "inner")
    shards = hits.select("shard", F.explode("blocks").alias("block")).distinct()
    docs = index.filter("term is null").select("shard", "postings", "ids").join(shards, "shard")
    none = F.lit(None)
    parts = dealt.select("shard", "block", "postings", "weight", "items", none.cast("array<long>").alias("ids")).unionByName(
        docs.select("shard", "block", "postings", none.cast("long").alias("weight"), none.cast("array<string>").alias("items"), "ids"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        about = rows["ids"].notna()
        ids, lengths = rows["ids"][about].iloc[0], numbers(rows["postings"][about].iloc[0])
        m = 50 + (50 * lengths * n) // length
        of_item: dict = {}
        for data, weight, items in rows[["postings", "weight", "items"]][~about].itertuples(index=False):
            p = _Postings(data, int(weight), m)
            for item in items:
                of_item.setdefault(item, []).append(p)
        found = [(item, int(ids[-d]) if -d < len(ids) else None, s) for item, lists in of_item.items() for s, d in best_documents(lists, k)]
        return pd.DataFrame({"item": [f[0] for f in found], "doc_id": pd.array([f[1] for f in found], "Int64"), "score": pd.array([f[2] for f in found], "int64")})

    found = parts.groupBy("shard", "block").applyInPandas(run, "item string, doc_id long, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select(F.when(F.col("item") != "", F.substring("item", 2, 1 << 30)).cast(item_type).alias(item_col), "rank", "doc_id", "score")
