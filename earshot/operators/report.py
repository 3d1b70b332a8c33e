"""Data sets of the reports and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.operators.prices import asof_backward


def quarter_index(signals: DataFrame, least: int = 20) -> DataFrame:
    """(quarter, calls, confidence, buy_share, sell_share) for every quarter between the first and the last of `least` calls; null between."""
    q = F.trunc(F.to_date("call_date"), "quarter")
    got = signals.groupBy(q.alias("quarter")).agg(F.count("*").alias("calls"), F.avg("confidence").alias("confidence"), F.avg((F.col("signal") == "BUY").cast("double")).alias("buy_share"), F.avg((F.col("signal") == "SELL").cast("double")).alias("sell_share"))
    got = got.filter(F.col("calls") >= least)
    spine = got.agg(F.min("quarter").alias("a"), F.max("quarter").alias("b")).filter("a is not null").select(F.explode(F.expr("sequence(a, b, interval 3 months)")).alias("quarter"))
    return spine.join(got, "quarter", "left")


def z_histogram(signals: DataFrame, low: float = -4.0, high: float = 4.0, bins: int = 80) -> DataFrame:
    """(signal, bin, n, share of the signal): z clipped to the range in equal bins from 1, the last closed on the right."""
    z = F.greatest(F.least("confidence_z", F.lit(high)), F.lit(low))
    at = F.least(F.width_bucket(z, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    n = signals.filter("confidence_z is not null").groupBy("signal", at.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("signal")))


def chart_tickers(signals: DataFrame, configured: list[str], most: int = 9, least_configured: int = 3, least: int = 6) -> DataFrame:
    """(ticker, calls, pos): configured tickers with a few calls in their order, then others by calls, in all `most`."""
    n = signals.groupBy("ticker").agg(F.count("*").alias("calls"))
    at = F.array_position(F.array(*map(F.lit, configured)), F.col("ticker")) if configured else F.lit(0)
    ranked = n.withColumn("_at", at).filter(((F.col("_at") > 0) & (F.col("calls") >= least_configured)) | ((F.col("_at") == 0) & (F.col("calls") >= least)))
    order = [F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.lit(1 << 30)), F.desc("calls"), F.col("ticker")]
    top = ranked.orderBy(*order).limit(most)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("ticker", "calls", "pos")


def price_panels(signals: DataFrame, prices: DataFrame, tickers: DataFrame) -> DataFrame:
    """Live signals of the chosen tickers with the last close on or before the call."""
    live = signals.filter(~F.col("warmup")).join(F.broadcast(tickers.select("ticker")), "ticker", "left_semi")
    mine = prices.join(F.broadcast(tickers.select("ticker")), "ticker", "left_semi").select("ticker", "date", "close")
    return asof_backward(live, mine, "ticker", "call_date", "date").withColumn("price_at_call", F.col("bar.close")).drop("bar")


def scatter_sample(events: DataFrame, key: list[str], most: int = 6000) -> DataFrame:
    """At most `most` rows, always the same ones: those with the least md5 of the key."""
    h = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key)))
    return events.orderBy(h, *key).limit(most)
