"""Long price tables and as-of lookups of the days that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PREMARKET_END = "09:30"


def with_bars(prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 20, 60), trailing: int = 20) -> DataFrame:
    """prices (ticker, date, open, close, volume) with bar (from 0), bars, dollar_volume and close_{h}, date_{h}.

    dollar_volume is the mean of close * volume of the `trailing` bars before; close_{h} the close h - 1 bars on. All are
    windows over one partitioning and order, in which bars without a date come last.
    """
    w = Window.partitionBy("ticker").orderBy(F.asc_nulls_last("date"))
    out = {
        "bar": F.row_number().over(w) - 1,
        "bars": F.count("*").over(Window.partitionBy("ticker")),
        "dollar_volume": F.avg(F.col("close") * F.col("volume")).over(w.rowsBetween(-trailing, -1)),
    }
    for h in horizons:
        out[f"close_{h}"] = F.lead("close", h - 1).over(w)
        out[f"date_{h}"] = F.lead("date", h - 1).over(w)
    return prices.withColumns(out)


def is_premarket(time_col: str = "call_time_et"):
    return F.coalesce((F.col(time_col) > "") & (F.col(time_col) < PREMARKET_END), F.lit(False))


def _asof(left: DataFrame, bars: DataFrame, by: str | None, left_date: str, bar_date: str, tag: Column, bar_tag: int, backward: bool) -> DataFrame:
    """left with `bar`, the nearest row of bars in the order of dates and tags, before it or else after it.

    What bar a row gets hangs on its key, day and tag only, so it is looked up once for each of these that occurs: they
    are put in one order with the bars, and each takes the last bar passed (the order is read backwards where the next is
    wanted, as only frames that end at the row run along). So a window has a few rows a day of a key, however many rows
    ask for them; these meet the answers by a join, which splits a frequent key.
    """
    key = F.lit(0) if by is None else F.col(by)
    asked = left.select(key.alias("_k"), F.to_date(left_date).alias("_d"), tag.alias("_tag"), F.struct(*left.columns).alias("_l"))
    points = asked.select("_k", "_d", "_tag").distinct().withColumn("_b", F.lit(None).cast(bars.schema))
    b_ = bars.select(key.alias("_k"), F.to_date(bar_date).alias("_d"), F.lit(bar_tag).alias("_tag"), F.struct(*bars.columns).alias("_b"))
    order = ["_d", "_tag"] if backward else [F.desc("_d"), F.desc("_tag")]
    w = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.unionByName(b_).withColumn("bar", F.last("_b", ignorenulls=True).over(w)).filter(F.col("_tag") != bar_tag)
    found = found.select(F.col("_k").alias("_k2"), F.col("_d").alias("_d2"), F.col("_tag").alias("_tag2"), "bar")
    same = F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_tag") == F.col("_tag2"))
    return asked.join(found, same).select("_l.*", "bar")


def asof_forward(left: DataFrame, bars: DataFrame, by: str, left_date: str, bar_date: str, same_day) -> DataFrame:
    """left with `bar`, the first row of bars (a struct) of its key on or after left_date, or after it unless same_day; null if none."""
    return _asof(left, bars, by, left_date, bar_date, F.when(same_day, 0).otherwise(2), 1, backward=False)


def asof_backward(left: DataFrame, bars: DataFrame, by: str | None, left_date: str, bar_date: str) -> DataFrame:
    """left with `bar`, the last row of bars of its key on or before left_date, null if none; by None: bars are of one series."""
    return _asof(left, bars, by, left_date, bar_date, F.lit(1), 0, backward=True)


def covered(prices: DataFrame, wanted: DataFrame, start: str, grace_days: int = 10) -> DataFrame:
    """Tickers of wanted whose prices begin within grace_days of start, or which are known to be listed later (listed_later)."""
    first = prices.groupBy("ticker").agg(F.min("date").alias("first"))
    known = F.coalesce(F.col("listed_later"), F.lit(False)) if "listed_later" in wanted.columns else F.lit(False)
    return wanted.join(first, "ticker").filter((F.col("first") <= F.date_add(F.lit(start).cast("date"), grace_days)) | known).select("ticker")


def to_fetch(prices: DataFrame, wanted: DataFrame, start: str, grace_days: int = 10) -> DataFrame:
    """Tickers of wanted that aren't covered."""
    return wanted.select("ticker").distinct().join(covered(prices, wanted, start, grace_days), "ticker", "left_anti")
