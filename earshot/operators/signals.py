"""Scored sentences to calls, and calls to BUY / HOLD / SELL signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_HISTORY, BUY_Z, SELL_Z = 20, 0.5, -0.5
SECTIONS = ("prepared", "qna")
#: Columns of signals in their order.
OUTPUT = (
    "ticker", "company", "call_date", "call_time_et", "signal", "confidence", "confidence_z", "conf_prepared", "conf_qna", "gap", "pct_high", "pct_low", "confidence_change", "sentences", "warmup",
)


def call_features(sentences: DataFrame) -> DataFrame:
    """One row per call with both sections: {conf,pct_low,pct_high,sentiment,n}_{prepared,qna}, gap, sentiment_gap.

    sentences: call_id, ticker, company, call_date, call_time_et, section, confidence, pred, sentiment. Conditional
    aggregates do the pivot in one aggregation. Missing company or time count as "".
    """
    keys = ["call_id", "ticker", F.coalesce("company", F.lit("")).alias("company"), "call_date", F.coalesce("call_time_et", F.lit("")).alias("call_time_et")]
    out = []
    for s in SECTIONS:
        here = F.col("section") == s
        out += [
            F.avg(F.when(here, F.col("confidence"))).alias(f"conf_{s}"),
            F.avg(F.when(here, (F.coalesce(F.col("pred") == "low", F.lit(False))).cast("double"))).alias(f"pct_low_{s}"),
            F.avg(F.when(here, (F.coalesce(F.col("pred") == "high", F.lit(False))).cast("double"))).alias(f"pct_high_{s}"),
            F.avg(F.when(here, F.col("sentiment"))).alias(f"sentiment_{s}"),
            F.count_if(here).alias(f"n_{s}"),
        ]
    calls = sentences.groupBy(*keys).agg(*out).dropna(subset=["conf_prepared", "conf_qna"])
    return calls.withColumns({"gap": F.col("conf_qna") - F.col("conf_prepared"), "sentiment_gap": F.col("sentiment_qna") - F.col("sentiment_prepared")})


def lag_change(df: DataFrame, value: str, name: str, by: str = "ticker", order: tuple[str, ...] = ("call_date",)) -> DataFrame:
    """Adds the difference to the row before of the same ticker; null for the first."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def weighted_confidence(conf: str = "conf", n: str = "n") -> Column:
    """Mean of the sections' confidence weighted by their sentences; null without sentences."""
    total = F.col(f"{n}_prepared") + F.col(f"{n}_qna")
    return F.try_divide(F.col(f"{conf}_prepared") * F.col(f"{n}_prepared") + F.col(f"{conf}_qna") * F.col(f"{n}_qna"), total)


def expanding_z(df: DataFrame, value: str = "confidence", date: str = "call_date", name: str = "confidence_z", min_history: int = MIN_HISTORY) -> DataFrame:
    """Adds the z-score of value against all rows of strictly earlier dates; null below min_history of them or without spread.

    Rows of a day don't see each other. Values are summed by date, so the one global window has a row a date, and the
    running sums are joined back by broadcast. Sums are of differences from the overall mean, which keeps the variance
    exact where the mean is large.
    """
    center = df.agg(F.avg(value).alias("_c"))
    x = F.col(value) - F.col("_c")
    by_date = df.select(date, value).crossJoin(F.broadcast(center)).groupBy(date, "_c").agg(F.count(value).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    before = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    past = by_date.select(date, "_c", *(F.sum(c).over(before).alias(c) for c in ("_n", "_s", "_q")))
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    var = F.when(F.col("_n") > 1, (F.col("_q") - F.col("_n") * mean * mean) / (F.col("_n") - 1))
    z = F.when((F.col("_n") >= min_history) & (var > 1e-18), (x - mean) / F.sqrt(F.greatest(var, F.lit(1e-300))))
    return df.join(F.broadcast(past), date, "left").withColumn(name, z).drop("_c", "_n", "_s", "_q")


def signal_of(z: Column, buy_z: float = BUY_Z, sell_z: float = SELL_Z) -> Column:
    return F.when(z > buy_z, "BUY").when(z < sell_z, "SELL").otherwise("HOLD")


def make_signals(calls: DataFrame, min_history: int = MIN_HISTORY, buy_z: float = BUY_Z, sell_z: float = SELL_Z) -> DataFrame:
    """calls with confidence, confidence_z, signal, warmup and the context columns that no signal depends on."""
    out = expanding_z(calls.withColumn("confidence", weighted_confidence()), min_history=min_history)
    out = out.withColumns({"signal": signal_of(F.col("confidence_z"), buy_z, sell_z), "warmup": F.col("confidence_z").isNull()})
    out = out.withColumns({"gap": F.col("conf_qna") - F.col("conf_prepared"), "sentences": F.col("n_prepared") + F.col("n_qna")})
    for p in ("pct_high", "pct_low"):
        if f"{p}_prepared" in calls.columns:
            out = out.withColumn(p, weighted_confidence(p))
    return lag_change(out, "confidence", "confidence_change", order=("call_date", "call_id") if "call_id" in calls.columns else ("call_date",))


def output_columns(signals: DataFrame) -> DataFrame:
    """OUTPUT in order, null where signals lacks a column."""
    return signals.select(*(F.col(c) if c in signals.columns else F.lit(None).cast("string").alias(c) for c in OUTPUT))


def latest(signals: DataFrame, days: int = 45, most: int = 15) -> DataFrame:
    """Signals other than HOLD of the last `days` days after warm-up: the `most` highest BUY and lowest SELL, by z."""
    live = signals.filter(~F.col("warmup"))
    since = live.agg(F.date_sub(F.max(F.to_date("call_date")), days).alias("since"))
    recent = live.crossJoin(F.broadcast(since)).filter((F.to_date("call_date") >= F.col("since")) & (F.col("signal") != "HOLD")).drop("since")
    buy = recent.filter("signal = 'BUY'").orderBy(F.desc("confidence_z"), "ticker", "call_date").limit(most)
    sell = recent.filter("signal = 'SELL'").orderBy("confidence_z", "ticker", "call_date").limit(most)
    return buy.unionByName(sell)
