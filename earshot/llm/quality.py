"""Quality classifier by co-training: a text view and a metadata view teach each other, calibrated views score all documents."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import give_back, python_batches, sample_by_hash, unused
from earshot.llm.toxicity import held_out_split

#: Labelled rows, and rows without a label, that the classifiers are fitted to, about: those with the smallest hashes.
TRAIN_ROWS, POOL_ROWS = 16_000, 16_000
#: Rounds of co-training; in each a view labels at most this share of the pool, and of each class only rows whose
#: probability of another class is at most this part of that class' share among the labels.
ROUNDS, SHARE, DOUBT = 3, 0.1, 0.25

TEXT_FEATURES = (
    "log_words", "word_chars", "upper", "digit", "space", "mark", "symbol", "bar", "other", "capital_words", "all_capital_words",
    "word_repeats_next", "most_frequent", "distinct", "ends_in_symbol", "lines", "line_chars", "lines_twice", "lines_with_end", "no_letters", "empty",
)
#: Buckets of a text's words by hash.
WORDS = 128
#: Buckets of the metadata's names (language and source), steps of the length (four for each doubling), and buckets of
#: language and step together.
NAMES, STEPS, CROSSED = 32, 64, 128
TEXT_WIDTH, METADATA_WIDTH = len(TEXT_FEATURES) + WORDS, 3 + 2 * NAMES + STEPS + CROSSED

_KIND = np.full(0x250, 8, np.int8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 mark, 5 symbol, 6 bar, 7 line end, 8 other
for _c in range(0x250):
    _s = chr(_c)
    _KIND[_c] = 1 if _s.isupper() else 0 if _s.isalpha() else 2 if _s.isdigit() else 7 if _s == "\n" else 3 if _s.isspace() else 6 if _s == "|" else 4 if _s in ".,;:?'\"-()" else 5


def word_features(texts: list[str | None]) -> np.ndarray:
    """Each text's words by hashed buckets with signs, the root of what a bucket adds up to; of length 1 in all.

    A word's hash is of its length and its first and last eight bytes, with the bit that tells ASCII's cases apart set.
    """
    chunks = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    numbered = chunks.values.dictionary_encode()
    words = numbered.dictionary
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)) | 0x20
    begin, size = ends[:-1], np.diff(ends)
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for at in (begin, np.maximum(begin, ends[1:] - 8)):
            for k in range(8):
                h = (h ^ np.where(k < size, raw[at + k], 0).astype(np.uint64)) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(31)
    of_word = (h % np.uint64(WORDS)).astype(np.int64)
    sign = np.where(size == 0, 0.0, np.where(h >> np.uint64(20) & np.uint64(1), -1.0, 1.0))
    index, n = numbered.indices.to_numpy(), len(texts)
    doc = np.repeat(np.arange(n), np.diff(chunks.offsets.to_numpy()))
    out = np.bincount(doc * WORDS + of_word[index], sign[index], n * WORDS).reshape(n, WORDS)
    out = np.sign(out) * np.sqrt(np.abs(out))
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def shape_features(text: str | None) -> list[float]:
    """TEXT_FEATURES of a whole text: shares of kinds of characters, words and lines. Null counts as empty."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * (len(TEXT_FEATURES) - 1) + [1.0]
    n, w = len(text), len(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KIND[np.minimum(points, 0x24F)], minlength=9) / n
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    capitals = sum(x[0].isupper() for x in counts)
    shouted = sum(x.isupper() and len(x) > 1 for x in counts)
    odd = sum(c for x, c in counts.items() if not x[-1].isalnum() and x[-1] not in ".,;:?'\"-)")
    sure = min(w, 200)  # in a longer text fewer words are new
    return [
        np.log1p(w), (n - w) / w, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[8], capitals / len(counts), shouted / len(counts),
        sum(map(eq, words, words[1:])) / w, max(counts.values()) / w, len(counts) / w * np.sqrt(w / sure), odd / w,
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), float(kinds[0] + kinds[1] < 0.3), 0.0,
    ]


def text_features(texts: list[str | None]) -> np.ndarray:
    """The text view of each text: its shape and its words."""
    if not len(texts):
        return np.zeros((0, TEXT_WIDTH))
    return np.hstack([np.array([shape_features(t) for t in texts]), word_features(texts)])


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Length on record, smooth and by steps, hashed names of language and source, and language with the step.

    What is missing has its own place.
    """
    out = np.zeros(METADATA_WIDTH)
    known = n_chars is not None and n_chars == n_chars
    size = np.log1p(max(0.0, min(n_chars, 1e300))) if known else 0.0
    step = min(STEPS - 2, int(4 * size / np.log(2))) if known else STEPS - 1
    out[:3] = (size, size**2 / 10, 0.0) if known else (0.0, 0.0, 1.0)
    out[3 + zlib.crc32(f"lang {lang}".encode()) % NAMES] = 1.0
    out[3 + NAMES + zlib.crc32(f"source {source}".encode()) % NAMES] = 1.0
    out[3 + 2 * NAMES + step] = 1.0
    out[3 + 2 * NAMES + STEPS + zlib.crc32(f"{lang} {step}".encode()) % CROSSED] = 1.0
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> Logistic:
    """Ridge logistic regression by Newton steps on standardised columns, 4,096 rows at a time."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        square, slope = np.diag(penalty), penalty * w
        for i in range(0, len(x), 4096):
            z = np.hstack([np.clip((x[i : i + 4096] - mean) / scale, -8, 8), np.ones((len(x[i : i + 4096]), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            square += (z * (p * (1 - p))[:, None]).T @ z
            slope += z.T @ (p - y[i : i + 4096])
        step = np.linalg.solve(square, slope)
        size = np.abs(step).max()
        w = w - step * min(1.0, 4 / max(size, 1e-9))
        if size < 1e-6:
            break
    return Logistic(mean, scale, w)


@dataclass
class Model:
    """Both views, the calibration of each (slope and offset of its logit) and the weights of the calibrated logits."""

    views: list[Logistic]
    calibration: list[Logistic]
    combine: Logistic | None
    constant: float = 0.5
    taught: list[tuple[int, ...]] = field(default_factory=list)

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.combine is None:
            return np.full(len(text), self.constant)
        logits = np.column_stack([c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibration, (text, metadata))])
        return 1 / (1 + np.exp(-self.combine.logit(logits)))


def confirmed(p: np.ndarray, wrong: np.ndarray, most: float) -> bool:
    """Whether of rows with a probability p of being wrong of at most `most` no larger part is (with half an error added)."""
    sure = p <= most
    return bool((wrong[sure].sum() + 0.5) / (sure.sum() + 1) <= most)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, share: float = SHARE, doubt: float = DOUBT) -> Model:
    """A model from labelled rows (both views and y) and a pool without labels.

    A fifth of the labelled rows is kept for calibration. In each round each calibrated view labels the rows of the pool
    without a label yet that it is surest of, at most `share` of the pool and in the proportion of y, and of a class only
    rows that are of another one with at most `doubt` times that one's share in y, if the rows kept back confirm it; they
    join the training rows of the other view. So of a view that knows little no wrong labels are taken. Then both are calibrated and combined on the rows
    kept back, where such a view gets no weight. `taught` of the model counts the labels that each view gave a round.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model([], [], None, constant=float(y[0]) if len(y) else 0.5)
    hold = np.arange(len(y)) % 5 == 4
    if y[hold].size == 0 or y[hold].min() == y[hold].max() or y[~hold].min() == y[~hold].max():
        hold = np.ones(len(y), bool)
        fit_on = hold
    else:
        fit_on = ~hold
    xs = [v[fit_on] for v in views]
    ys = [y[fit_on].astype(float)] * 2
    left = np.ones(len(pool[0]), bool)
    positive = y.mean()
    taught: list[tuple[int, ...]] = []

    def now() -> tuple[list[Logistic], list[Logistic]]:
        fitted = [fit_logistic(x, t) for x, t in zip(xs, ys)]
        return fitted, [fit_logistic(m.logit(v[hold])[:, None], y[hold].astype(float), 0.1) for m, v in zip(fitted, views)]

    for _ in range(rounds):
        fitted, calibrated = now()
        given: list[tuple[np.ndarray, np.ndarray]] = []
        for m, c, v, known in zip(fitted, calibrated, pool, views):
            p, p_held = (1 / (1 + np.exp(-c.logit(m.logit(x)[:, None]))) if len(x) else np.zeros(0) for x in (v, known[hold]))
            most = int(share * len(v))
            free = np.flatnonzero(left)
            good = free[np.argsort(-p[free], kind="stable")][: int(most * positive)]
            bad = free[np.argsort(p[free], kind="stable")][: int(most * (1 - positive))]
            # of both classes in the proportion of y, or none
            good = good[1 - p[good] <= doubt * (1 - positive)][: confirmed(1 - p_held, 1 - y[hold], doubt * (1 - positive)) * len(p)]
            bad = bad[p[bad] <= doubt * positive][: confirmed(p_held, y[hold], doubt * positive) * len(p)]
            n = min(len(good) / positive, len(bad) / (1 - positive))
            good, bad = good[: round(n * positive)], bad[: round(n * (1 - positive))]
            given.append((np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])))
        taught.append(tuple(len(rows) for rows, _ in given))
        for v, (rows, labels) in enumerate(given):
            other = 1 - v
            xs[other] = np.vstack([xs[other], pool[other][rows]])
            ys[other] = np.concatenate([ys[other], labels])
            left[rows] = False
    fitted, calibrated = now()
    logits = np.column_stack([c.logit(m.logit(v[hold])[:, None]) for m, c, v in zip(fitted, calibrated, views)])
    return Model(fitted, calibrated, fit_logistic(logits, y[hold].astype(float), 0.1), taught=taught)


def _features(docs: DataFrame, text_col: str, keep: list) -> DataFrame:
    python_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(list(text_features(t.tolist()).astype(np.float32)), dtype=object)
            give_back()

    return docs.select(*keep, of(F.col(text_col)).alias("x"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> Model:
    """Fits both views to about `rows` labelled and `pool_rows` unlabelled documents, chosen by the id's hash.

    Labels of held-out documents (crc32 of the id leaves 2 modulo 4) are never used. All documents of a repeated id share
    its label, the largest one given. One task fits the views, to 1.1 times `rows` and `pool_rows` at most, also where an
    id repeats or is null in a large part of the rows; only the model reaches the driver.
    """
    docs = docs.select(id_col, text_col, lang_col, source_col, chars_col)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().filter(~held_out_split(F.col("_id")))
    known = sample_by_hash(known.withColumn("_h", F.xxhash64("_id")), "_h", rows, known.count())
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    names = [F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(chars_col).cast("double").alias("n_chars")]
    pool_hash = F.xxhash64(F.col(id_col), F.lit("pool"))
    n_docs = docs.count()
    pool = sample_by_hash(docs.withColumn("_h", pool_hash), "_h", pool_rows, n_docs).drop("_h")
    pool = pool.join(F.broadcast(known), F.col(id_col) == F.col("_id"), "left_anti").withColumn("_label", F.lit(None).cast("int"))
    labelled = docs.join(F.broadcast(known), F.col(id_col) == F.col("_id"), "inner").drop("_id")
    keep = [F.xxhash64(id_col).alias("h"), F.col("_label").alias("y"), *names]
    data = _features(labelled, text_col, keep).unionByName(_features(pool, text_col, keep))
    most = (pool_rows + pool_rows // 10, rows + rows // 10)

    def in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, m, y, kept = [], [], [], [0, 0]
        for b in batches:  # read to the end, kept up to the bounds
            columns = b.to_pydict()
            for i, label in enumerate(columns["y"]):
                if kept[label is not None] < most[label is not None]:
                    kept[label is not None] += 1
                    x.append(np.array(columns["x"][i], np.float32))
                    m.append(metadata_features(columns["lang"][i], columns["source"][i], columns["n_chars"][i]).astype(np.float32))
                    y.append(-1 if label is None else label)
        text, metadata, labels_ = np.array(x, np.float32).reshape(len(x), TEXT_WIDTH), np.array(m, np.float32).reshape(len(m), METADATA_WIDTH), np.array(y, np.int64)
        del x, m
        has = labels_ >= 0
        model = co_train((text[has], metadata[has]), labels_[has], (text[~has], metadata[~has]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = data.repartition(1).sortWithinPartitions("h", "n_chars", "source", "lang").mapInArrow(in_one, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else co_train((np.zeros((0, TEXT_WIDTH)),) * 2, np.zeros(0, int), (np.zeros((0, TEXT_WIDTH)),) * 2)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """docs with quality_score (0 to 1, of the whole text) and keep (quality_score >= threshold); columns so named are replaced."""
    docs = docs.drop("quality_score", "keep")
    python_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, lang, source, chars in rows:
            x = text_features(text.tolist())
            m = np.array([metadata_features(a, b, c) for a, b, c in zip(lang, source, chars)], float).reshape(len(text), METADATA_WIDTH)
            yield pd.Series(sent.value.score(x, m))
            give_back()

    (s,) = unused(docs, "s")
    out = docs.withColumn(s, of(F.col(text_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(chars_col).cast("double")))
    return out.select(*docs.columns, F.col(s).alias("quality_score"), (F.col(s) >= threshold).alias("keep"))


def quality(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """docs with quality_score and keep for every row.

    Without labels, or with those of one class only, the score is one number (0.5, or the class) and all documents of
    class 1, or without any label, are kept. Null and empty texts are scored by their metadata and the feature `empty`.
    Null metadata has coordinates of its own. Repeated rows score alike; an empty table stays empty.
    """
    return score(docs, train(docs, labels, **names), **names)
