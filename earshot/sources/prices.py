"""The store of price bars: what is there, what has to be fetched, and what is known to be missing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions import text as T
from earshot.operators.prices import to_fetch
from earshot.sources.tables import exists

BARS = "ticker string, date date, open double, close double, volume double"
#: What is known of a ticker: ok, listed_later (its bars begin after the start asked for) or missing (no bars at all).
KNOWN = "ticker string, state string, first date, read timestamp"


def known(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, state, first) as last read."""
    log = spark.read.schema(KNOWN).json(f"{folder}/known")
    latest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("read")))
    return log.withColumn("_n", latest).filter("_n = 1").drop("_n", "read")


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The bars of each ticker's last download."""
    bars = spark.read.parquet(f"{folder}/bars")
    last = bars.groupBy("ticker").agg(F.max("read").alias("read"))
    return bars.join(last, ["ticker", "read"], "left_semi").drop("read")


def update(spark: SparkSession, wanted: DataFrame, start: str, folder: str, download: Callable[[list[str], str], DataFrame], batch: int = 100, tries: int = 3, pause: float = 30.0, sleep=time.sleep, grace_days: int = 10) -> dict[str, int]:
    """Downloads bars of wanted tickers that the folder does not cover yet, batch by batch; counts by state.

    Covered are those whose bars begin within grace_days of start or that are known to be listed later; those known to be
    missing are not asked for again. download(symbols, start) gives (ticker, date, open, close, volume) of symbols, and
    is tried again after a pause, longer each time; a batch that fails every time is left for the next update. Each batch
    is written before the next is asked for. Tickers, not bars, reach the driver.
    """
    if not exists(spark, f"{folder}/known"):
        spark.createDataFrame([], KNOWN).write.json(f"{folder}/known")
        spark.createDataFrame([], f"{BARS}, read timestamp").write.parquet(f"{folder}/bars")
    state = known(spark, folder)
    first = state.filter("state <> 'missing'").select("ticker", F.col("first").alias("date"))
    asked = wanted.select("ticker").distinct().join(state.filter("state = 'missing'"), "ticker", "left_anti")
    asked = asked.join(state.select("ticker", (F.col("state") == "listed_later").alias("listed_later")), "ticker", "left")
    todo = sorted(r["ticker"] for r in to_fetch(first, asked, start, grace_days).collect())
    counts: dict[str, int] = {}
    for i in range(0, len(todo), batch):
        part = spark.createDataFrame([(t,) for t in todo[i : i + batch]], "ticker string").withColumn("symbol", T.symbol(F.col("ticker")))
        symbols = [r["symbol"] for r in part.collect()]
        for k in range(tries):
            try:
                got = download(symbols, start).dropna().withColumnRenamed("ticker", "symbol").join(F.broadcast(part), "symbol").withColumn("read", F.current_timestamp()).persist()
                begin = got.groupBy("ticker").agg(F.min("date").alias("first"))
                late = F.col("first") > F.date_add(F.lit(start).cast("date"), grace_days)
                found = part.select("ticker").join(begin, "ticker", "left").withColumn("state", F.when(F.col("first").isNull(), "missing").when(late, "listed_later").otherwise("ok")).withColumn("read", F.current_timestamp())
                got.select("ticker", "date", "open", "close", "volume", "read").write.mode("append").parquet(f"{folder}/bars")
                states = found.groupBy("state").agg(F.count("*").alias("n")).collect()
                found.select("ticker", "state", "first", "read").write.mode("append").json(f"{folder}/known")
                got.unpersist()
            except Exception as e:  # a source may fail in any way; what it said is told, and the batch tried again
                print(f"prices of {symbols[0]} and {len(symbols) - 1} more: {type(e).__name__}")
                if k < tries - 1:
                    sleep(pause * (k + 1))
                continue
            for r in states:
                counts[r["state"]] = counts.get(r["state"], 0) + r["n"]
            break
        else:
            counts["failed"] = counts.get("failed", 0) + len(symbols)
    return counts
