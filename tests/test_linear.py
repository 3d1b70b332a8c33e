import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from earshot.operators import linear


def slow_buckets(sentence: str | None, features: int) -> list[int]:
    w = re.findall("[a-z']+", (sentence or "").lower())
    return [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % features for t in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]] + [features]


def slow_fit(rows: list[tuple], features: int, steps: int, rate: float) -> list[list[int]]:
    n = [sum(r[1] == c for r in rows) for c in range(3)]
    w, seen = [[0] * 3 for _ in range(features + 1)], [[0.0] * 3 for _ in range(features + 1)]
    warm = max(1, math.ceil(steps / 10))
    for s in range(1, steps + 1):
        r, g = rate * (s / warm if s <= warm else (steps - s + 1) / (steps - warm + 1)), [[0] * 3 for _ in range(features + 1)]
        for text, label in rows:
            found = slow_buckets(text, features)
            z = [sum(w[b][c] for b in found) / linear.UNIT for c in range(3)]
            e = [math.exp(x - max(z)) for x in z]
            for c in range(3):
                off = math.floor(len(rows) / (3 * n[label]) * (e[c] / sum(e) - (label == c)) * linear.UNIT + 0.5)
                for b in found:
                    g[b][c] += off
        for b in range(features + 1):
            for c in range(3):
                x, now = g[b][c] / (linear.UNIT * len(rows)), w[b][c] / linear.UNIT
                seen[b][c] += x * x
                w[b][c] = math.floor((now - r * (x / (math.sqrt(seen[b][c]) + linear.LEAST) + 0.01 * now)) * linear.UNIT + 0.5)
    return w


ROWS = [("we grow and grow", 2), ("it may fall", 0), ("it's ten", 1), ("", 1), (None, 0), ("we may grow it", 2), ("Ten TEN ten", 1), ("we may grow it", 2)] * 3


def test_steps_by_loops_whatever_the_partitions(spark, tmp_path):
    df = spark.createDataFrame([(t, ("low", "neutral", "high")[c], c) for t, c in ROWS], "sentence string, weak_label string, label int")
    want = slow_fit(ROWS, 16, 7, 0.4)
    models = [linear.fit(df.repartition(k), 16, 7, 0.4) for k in (1, 5)]
    for m in models:
        assert np.abs(m.weights - np.array(want)).max() <= 1  # exp may differ in its last bit
    assert (models[0].weights == models[1].weights).all()
    models[0].save(spark, f"{tmp_path}/m")
    again = linear.load(spark, f"{tmp_path}/m")
    assert (again.weights == models[0].weights).all()
    for r in again(df).collect():
        z = [sum(int(again.weights[b][c]) for b in slow_buckets(r["sentence"], 16)) / linear.UNIT for c in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert all(abs(r[p] - x / sum(e)) < 1e-12 for p, x in zip(linear.PROBABILITIES, e))


def test_no_rows_and_one_class(spark):
    df = spark.createDataFrame([("up", "high", 2)], "sentence string, weak_label string, label int")
    assert not linear.fit(df.limit(0), 8).weights.any()
    assert linear.LinearModel(np.zeros((9, 3), np.int64))(df.limit(0)).count() == 0
    got = linear.fit(df, 8)(df).first()
    assert got["p_high"] > max(got["p_low"], got["p_neutral"])
    assert linear.rates(10, 1.0, 0.2) == [0.5, 1.0, 8 / 9, 7 / 9, 6 / 9, 5 / 9, 4 / 9, 3 / 9, 2 / 9, 1 / 9]
    assert df.select(linear.buckets(F.col("sentence"), 8).alias("b")).first()["b"] == slow_buckets("up", 8)
