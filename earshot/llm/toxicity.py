"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import give_back, python_batches, sample_by_hash, unused

#: Rows of labels that the weights are fitted to, about: those with the smallest hashes of the id; and coordinates of
#: all of them together: rows after the one that reaches this number are left out, in the order of the hashes.
TRAIN_ROWS, TRAIN_COORDINATES = 16_000, 1 << 26
#: Words whose hashes a worker remembers: they and their dictionary take some 200 bytes a word. Most words of a large corpus
#: occur once, so it is filled anew now and then, which costs little for those that recur.
WORDS = 170_000


@dataclass(frozen=True)
class Ftrl:
    """bits: log2 of the number of coordinates. alpha, beta: rates; l1, l2: penalties. epochs: passes over the rows."""

    bits: int = 20
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 1.0
    epochs: int = 3
    seed: int = 5


class Features:
    """Coordinates of a text: its words (runs of letters and digits, lower case), pairs of neighbours, pairs with one word
    between, and the words' first letters, which inflected and compound forms of an insult share."""

    _words = re.compile(r"\w+").findall
    _parts = (4, 5, 6)

    def __init__(self, bits: int):
        self._shift = np.uint64(64 - bits)
        self._known: dict[str, int] = {}
        self._table = np.zeros((WORDS, 1 + len(self._parts)), np.uint64)

    def _row(self, word: str) -> int:
        if len(self._known) >= WORDS:
            return -1
        i = self._known[word] = len(self._known)
        of = lambda w: zlib.crc32(w.encode("utf-8", "replace"))
        self._table[i] = [of(word) + 1, *((k << 33) + of(word[:k]) if len(word) >= k else of(word) + 1 for k in self._parts)]
        return i

    def __call__(self, text: str | None) -> np.ndarray:
        """All coordinates, repeats included: a word that occurs twice is in it twice."""
        known, words = self._known, self._words((text or "").lower())
        rows = [known[w] if w in known else self._row(w) for w in words]
        if -1 in rows:  # the table is full
            known.clear()
            if len(set(words)) >= WORDS:
                half = len(words) // 2
                return np.concatenate([self(" ".join(words[:half])), self(" ".join(words[half - 2 :]))])
            rows = [known[w] if w in known else self._row(w) for w in words]
        t = self._table[np.array(rows, np.int64)]
        h = t[:, 0]
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        with np.errstate(over="ignore"):
            mixed = [(t * a).ravel(), (h[:-1] * a + h[1:]) * b, (h[:-2] * a + h[2:]) * c]
        return (np.concatenate(mixed) >> self._shift).astype(np.int32)


@dataclass
class Weights:
    """The coordinates that aren't 0, and the bias."""

    bits: int
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = math.log(0.05)

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.w
        return out


def score_of(coordinates: np.ndarray, dense: np.ndarray, bias: float) -> float:
    on = np.unique(coordinates[dense[coordinates] != 0])
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + float(dense[on].sum(dtype=np.float64))))))


def fit(rows: list[np.ndarray], labels: list[int], p: Ftrl) -> Weights:
    """Per coordinate: z (gradients less what rates took), n (squared gradients); a weight is 0 until |z| exceeds l1."""
    if not rows:
        return Weights(p.bits)
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    ones = sum(labels)
    bias, n_bias = math.log((ones + 0.5) / (len(rows) - ones + 10)), 0.0
    order = np.random.default_rng(p.seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            s = bias + w.sum()
            g = 1 / (1 + math.exp(-max(-50.0, min(50.0, s)))) - labels[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[x] = zi + g - sigma * w
            n[x] = ni + g * g
            n_bias += g * g
            bias -= p.alpha / 4 / (p.beta + math.sqrt(n_bias)) * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return Weights(p.bits, at.astype(np.int32), w[at].astype(np.float32), bias)


def held_out_split(doc_id):
    """Whether crc32 of the id as text leaves 2 modulo 4: such rows never give a label. Null ids count as not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", label_id: str = "doc_id") -> DataFrame:
    """(text columns of docs, _label) for about `rows` labelled documents that aren't held out, by the id's hash.

    Labels without id or value are left out; of several for an id the largest counts. The labels kept are about `rows`,
    which bounds what is broadcast, so the texts of other documents are never moved. All documents of a repeated id
    share its label.
    """
    known = labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().filter(~held_out_split(F.col("_id")))
    known = sample_by_hash(known.withColumn("_h", F.xxhash64("_id")), "_h", rows, known.count())
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    return docs.join(F.broadcast(known), F.col(id_col) == F.col("_id"), "inner").drop("_id")


def train(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Weights:
    """Weights from about `rows` labelled documents; their coordinates are made in parallel and fitted in one task."""
    python_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = labelled_sample(slim, labels, label_col, rows).select(F.xxhash64("doc_id").alias("h"), F.col("_label").alias("y"), "text")

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(params.bits)
        for b in batches:
            x = [np.unique(make(t)).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["h", "y", "x"])
            give_back()

    def in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: list[np.ndarray] = []
        y: list[int] = []
        size = 0
        for b in batches:  # read to the end, kept up to the bounds
            for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if size < TRAIN_COORDINATES and len(x) < 2 * rows:
                    size += len(v) // 4
                    x.append(np.frombuffer(v, "<i4")), y.append(1 if label else 0)
        m = fit(x, y, params)
        yield pa.RecordBatch.from_arrays([pa.array([m.at.astype("<i4").tobytes()], pa.binary()), pa.array([m.w.astype("<f4").tobytes()], pa.binary()), pa.array([m.bias])], ["at", "w", "bias"])

    # Two times `rows` and TRAIN_COORDINATES bound the one task, whatever repeats and however long the texts are.
    made = sample.mapInArrow(coordinates, "h long, y int, x binary")
    row = made.repartition(1).sortWithinPartitions("h", "y", "x").mapInArrow(in_one, "at binary, w binary, bias double").collect()
    if not row:
        return Weights(params.bits)
    return Weights(params.bits, np.frombuffer(row[0]["at"], "<i4"), np.frombuffer(row[0]["w"], "<f4"), row[0]["bias"])


def score(docs: DataFrame, weights: Weights, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold) from the whole text; null counts as empty.

    The weights that aren't 0 go to the executors, at most 2^bits. Columns of docs with these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    python_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, make = sent.value, Features(sent.value.bits)
        dense = m.dense()
        for t in texts:
            yield pd.Series([score_of(make(x), dense, m.bias) for x in t], dtype="float64")
            give_back()

    (s,) = unused(docs, "s")
    out = docs.withColumn(s, of(F.col(text_col)))
    return out.select(*docs.columns, F.col(s).alias("score"), (F.col(s) >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score and predicted.

    Labels come only from documents that aren't held out; without any, every text scores about
    0.05. Empty and null texts score the bias alone. Repeated rows score alike. An empty table stays empty.
    """
    return score(docs, train(docs, labels, params, rows, id_col, text_col), text_col).withColumn("held_out", held_out_split(F.col(id_col)))
