"""A multinomial logistic model over hashed words and word pairs, fitted by whole-table gradient steps.

Weights are integers in units of 1 / UNIT, and so is what a row adds to a gradient. So sums are exact: they are the same
however rows are dealt to tasks, after a task is run again, and in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators.sentences import class_weights

UNIT = 1 << 20
#: Kept from dividing by zero in a step.
LEAST = 1e-12
PROBABILITIES = ("p_low", "p_neutral", "p_high")


def buckets(sentence: Column, features: int) -> Column:
    """The buckets of a sentence's words and pairs of neighbours, with repeats, and the last one, `features`, for the bias."""
    words = F.coalesce(T.words(sentence), F.array().cast("array<string>"))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    hashed = F.transform(F.concat(words, pairs), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(features)).cast("int"))
    return F.array_append(hashed, F.lit(features))


def rates(steps: int, rate: float, warmup: float) -> list[float]:
    """The rate of each step: rising in the first `warmup` of them, then falling, both linearly."""
    warm = max(1, math.ceil(steps * warmup))
    return [rate * (s / warm if s <= warm else (steps - s + 1) / (steps - warm + 1)) for s in range(1, steps + 1)]


def _logits(found: pa.Array, weights: np.ndarray) -> np.ndarray:
    """A row of three for each list of buckets, none of which is empty."""
    ends = np.cumsum(found.value_lengths().to_numpy())
    total = weights[found.flatten().to_numpy()]
    return np.add.reduceat(total, np.concatenate([[0], ends[:-1]])) / float(UNIT) if len(ends) else np.zeros((0, 3))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / (e[:, 0] + e[:, 1] + e[:, 2])[:, None]


@dataclass
class LinearModel:
    """weights: features + 1 rows of three integers, the last row the bias."""

    weights: np.ndarray

    def __call__(self, sentences: DataFrame) -> DataFrame:
        """Adds p_low, p_neutral and p_high to a table with a column sentence; the model goes to each task once."""
        sent = sentences.sparkSession.sparkContext.broadcast(self.weights)

        @F.arrow_udf("array<double>")
        def scores(found: pa.Array) -> pa.Array:
            p = _softmax(_logits(found, sent.value)).ravel()
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) + 1, 3), pa.int32()), pa.array(p))

        scored = sentences.withColumn("_p", scores(buckets(F.col("sentence"), len(self.weights) - 1)))
        return scored.withColumns({p: F.col("_p")[i] for i, p in enumerate(PROBABILITIES)}).drop("_p")

    def table(self, spark: SparkSession) -> DataFrame:
        """(bucket, w_low, w_neutral, w_high)."""
        return spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(self.weights)], "bucket int, w_low long, w_neutral long, w_high long")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> LinearModel:
    rows = spark.read.parquet(path).orderBy("bucket").collect()  # features + 1 rows
    return LinearModel(np.array([r[1:] for r in rows], np.int64))


def fit(training: DataFrame, features: int = 1 << 14, steps: int = 20, rate: float = 0.5, warmup: float = 0.1, decay: float = 0.01) -> LinearModel:
    """The model after `steps` steps over all of training: sentence, weak_label, label (0 to 2, none null).

    Rows weigh as class_weights says. A step takes off rate * (g / root of the sum of g^2 so far + decay * weight), g being
    the mean gradient of the cross entropy. Each is one scan and one aggregation by bucket, summed up in each task first;
    to the driver come features + 1 rows. Without rows all weights are 0.
    """
    spark = training.sparkSession
    each = class_weights(training).select(F.col("label").alias("weak_label"), "weight")
    rows = training.join(F.broadcast(each), "weak_label").select(F.col("label").cast("int").alias("label"), "weight", buckets(F.col("sentence"), features).alias("found")).persist()
    w, seen = np.zeros((features + 1, 3), np.int64), np.zeros((features + 1, 3))
    try:
        n = rows.count()
        for r in rates(steps, rate, warmup) if n else []:
            g = _gradient(rows, w) / float(UNIT * n)
            seen = seen + g * g
            now = w / float(UNIT)
            w = np.floor((now - r * (g / (np.sqrt(seen) + LEAST) + decay * now)) * float(UNIT) + 0.5).astype(np.int64)
    finally:
        rows.unpersist()
    return LinearModel(w)


def _gradient(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """The sum over rows (label, weight, found) of what each adds to each bucket, as integers."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(sent.value.shape, np.int64)
        for b in batches:
            label, weight, found = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            off = _softmax(_logits(found, sent.value)) - (label[:, None] == np.arange(3))
            each = np.floor(weight[:, None] * off * float(UNIT) + 0.5).astype(np.int64)
            np.add.at(sums, found.flatten().to_numpy(), np.repeat(each, found.value_lengths().to_numpy(), 0))
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(sums[at, c]) for c in range(3))], ["bucket", "e0", "e1", "e2"])

    parts = rows.mapInArrow(run, "bucket int, e0 long, e1 long, e2 long")
    out = np.zeros(w.shape)
    for s in parts.groupBy("bucket").agg(*(F.sum(e).alias(e) for e in ("e0", "e1", "e2"))).collect():
        out[s["bucket"]] = s[1:]
    sent.unpersist()
    return out
