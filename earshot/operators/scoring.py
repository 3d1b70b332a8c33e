"""Sentence scoring: a scorer interface, the lexicon's scorer and one for models of Python, and how well a scorer does."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.operators.linear import PROBABILITIES
from earshot.operators.ranks import with_before


class Scorer(Protocol):
    """Adds p_low, p_neutral and p_high to a table with a column sentence. A transformer can be put behind it by a pandas UDF."""

    def __call__(self, sentences: DataFrame) -> DataFrame: ...


def predicted(p: list[Column]) -> Column:
    """Label of the largest probability, the first of equal ones."""
    values = F.array(*p)
    return F.element_at(F.array(*map(F.lit, T.LABELS)), F.array_position(values, F.array_max(values)).cast("int"))


def with_confidence(scored: DataFrame, sentiment: Column | None = None) -> DataFrame:
    """Adds confidence (p_high - p_low), pred and sentiment (null unless given)."""
    return scored.withColumns({
        "confidence": F.col("p_high") - F.col("p_low"), "pred": predicted([F.col(c) for c in PROBABILITIES]),
        "sentiment": F.lit(None).cast("double") if sentiment is None else sentiment,
    })


def python_scorer(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> Scorer:
    """A model of Python's behind a pandas UDF: load() gives, once a task, a function from sentences to their rows of
    probabilities. Of each Arrow batch it gets `batch` sentences at a time in the order of their lengths, so that a
    transformer pads little; the order of the rows stays."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            texts = [t or "" for t in s]
            order = np.argsort([len(t) for t in texts], kind="stable")
            out = np.zeros((len(texts), len(PROBABILITIES)))
            for i in range(0, len(texts), batch):
                at = order[i : i + batch]
                out[at] = model([texts[k] for k in at])
            yield pd.Series(list(out))

    def add(sentences: DataFrame) -> DataFrame:
        return sentences.withColumn("_p", run(F.col("sentence"))).withColumns({c: F.col("_p")[i] for i, c in enumerate(PROBABILITIES)}).drop("_p")

    return add


def lexicon_sentiment(lexicon: T.Lexicon = T.Lexicon()) -> Column:
    """A sentiment of a column sentence between -1 and 1 where no model is plugged in: certainty less hedging, over both and one."""
    up, down = T.certainty(F.col("sentence"), lexicon), T.hedging(F.col("sentence"), lexicon)
    return (up - down) / (up + down + 1)


def lexicon_scorer(lexicon: T.Lexicon = T.Lexicon()) -> Scorer:
    """Softmax of (hedging, 0.5, certainty)."""

    def run(sentences: DataFrame) -> DataFrame:
        e = [F.exp(F.least(x, F.lit(50.0))) for x in (T.hedging(F.col("sentence"), lexicon), F.lit(0.5), T.certainty(F.col("sentence"), lexicon))]
        return sentences.withColumns({c: x / (e[0] + e[1] + e[2]) for c, x in zip(PROBABILITIES, e)})

    return run


def confusion(scored: DataFrame, truth: str = "weak_label", pred: str = "pred") -> DataFrame:
    return scored.groupBy(truth, pred).agg(F.count("*").alias("n"))


def classification_report(counts: DataFrame, truth: str = "weak_label", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support) from confusion()."""
    t = counts.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    p = counts.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("called"))
    out = t.join(p, "label", "full").na.fill(0)
    precision, recall = F.coalesce(F.try_divide("hit", "called"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def overall(counts: DataFrame, truth: str = "weak_label", pred: str = "pred") -> DataFrame:
    """One row: n, accuracy, macro_f1 and the majority class's share."""
    report = classification_report(counts, truth, pred).filter("support > 0").agg(F.avg("f1").alias("macro_f1"), (F.max("support") / F.sum("support")).alias("majority_baseline"))
    return counts.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")).crossJoin(report)


def roc_auc(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row (n, auc): the share of pairs that score puts in order, ties half, from counts of each score's values."""
    y = scored.select(F.col(score).alias("_s"), positive.cast("int").alias("_y")).dropna()
    counts = y.groupBy("_s").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    pos, neg = F.sum("_pos"), F.sum("_neg")
    u = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2))
    return with_before(counts, "_s", ["_neg"], []).agg((pos + neg).alias("n"), F.try_divide(u, (pos * neg).cast("double")).alias("auc")).withColumn("n", F.coalesce("n", F.lit(0)))


def context_check(sentences: DataFrame, scorer: Scorer, lexicon: T.Lexicon = T.Lexicon(), token: str = "[MASK]") -> DataFrame:
    """One row (n, auc, neutral_share): low against high sentences scored again with all cues masked."""
    masked = sentences.filter(F.col("weak_label").isin("low", "high")).withColumn("sentence", T.squeeze(T.mask_cues(F.col("sentence"), token, lexicon)))
    scored = with_confidence(scorer(masked)).select("weak_label", "confidence", "pred").cache()  # read for ranks, counts and shares
    neutral = scored.agg(F.avg((F.col("pred") == "neutral").cast("double")).alias("neutral_share"))
    return roc_auc(scored, "confidence", F.col("weak_label") == "high").crossJoin(neutral)


def score_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("calls"), F.avg("conf_prepared").alias("conf_prepared"), F.avg("conf_qna").alias("conf_qna"), F.avg((F.col("gap") < 0).cast("double")).alias("gap_below_zero"))
