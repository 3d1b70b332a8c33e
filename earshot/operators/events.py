"""Event study: signals joined to prices, and statistics of their excess returns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.functions.statistics import spearman_p_value, t_p_value
from earshot.operators.prices import asof_forward, is_premarket, with_bars
from earshot.operators.ranks import average_ranks, quantiles, with_before
from earshot.sources.tables import cut

HORIZONS = (1, 5, 20, 60)
FEATURES = ("confidence", "gap", "conf_qna", "conf_prepared")
ORDER = ("BUY", "HOLD", "SELL")


def event_returns(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...] = HORIZONS, min_price: float = 5.0, min_dollar_volume: float = 1e6, min_bars: int = 30, min_before: int = 20) -> DataFrame:
    """One row per tradeable signal: entry, and for each horizon ret_{h}d, excess_{h}d and exit_date_{h}d (null if out of range).

    Entry is at the open of the first bar on the call's day for premarket calls and after it for others. It must be a
    day of the benchmark, the ticker must have min_bars bars and min_before of them before, and price and mean dollar
    volume reach their minima. benchmark: date, open, close of one series. A null ticker is none.
    """
    bars = with_bars(prices.filter(F.col("ticker").isNotNull()), horizons, min_before).filter(F.col("bars") >= min_bars)
    days = with_bars(benchmark.select(F.lit("").alias("ticker"), "date", "open", "close", F.lit(0.0).alias("volume")), horizons)
    days = days.select(F.col("date").alias("entry_date"), F.col("open").alias("_open"), *(F.col(f"close_{h}").alias(f"_close_{h}") for h in horizons))
    found = asof_forward(signals, bars, "ticker", "call_date", "date", is_premarket()).filter("bar is not null")
    found = found.filter((F.col("bar.bar") >= min_before) & (F.col("bar.open") >= min_price) & (F.col("bar.dollar_volume") >= min_dollar_volume))
    found = found.withColumns({"entry_date": F.col("bar.date"), "entry_price": F.col("bar.open"), "dollar_volume": F.col("bar.dollar_volume")}).join(F.broadcast(days), "entry_date")
    out = {}
    for h in horizons:
        both = F.col(f"bar.close_{h}").isNotNull() & F.col(f"_close_{h}").isNotNull()
        out[f"ret_{h}d"] = F.when(both, F.col(f"bar.close_{h}") / F.col("entry_price") - 1)
        out[f"excess_{h}d"] = F.when(both, F.col(f"bar.close_{h}") / F.col("entry_price") - F.col(f"_close_{h}") / F.col("_open"))
        out[f"exit_date_{h}d"] = F.when(both, F.col(f"bar.date_{h}"))
    found = found.withColumns(out).withColumns({"month": F.trunc("entry_date", "month"), "year": F.year("entry_date")})
    keep = [c for c in ("ticker", "company", "call_date", "entry_date", "signal", "entry_price", "dollar_volume", *FEATURES) if c in found.columns]
    return found.select(*keep, *out, "month", "year")


def winsorized(events: DataFrame, column: str, q: float = 0.01) -> DataFrame:
    """Events with a value in column, clipped to its q and 1 - q quantiles (linear between values) over all of them.

    The two quantiles are found at once, as whatever is made of the result would find them again.
    """
    there = events.filter(F.col(column).isNotNull())
    low, high = quantiles(there.select(column), column, [q, 1 - q]).first()
    return there.withColumn(column, F.greatest(F.least(F.col(column), F.lit(high).cast("double")), F.lit(low).cast("double")))


def by_signal(events: DataFrame, column: str) -> DataFrame:
    """(signal, n, mean, median, hit_rate) for BUY, HOLD and SELL; a SELL hits below 0, the others above."""
    spine = events.sparkSession.createDataFrame([(s, i) for i, s in enumerate(ORDER)], "signal string, _o int")
    x = F.col(column)
    hit = F.when(F.col("signal") == "SELL", x < 0).otherwise(x > 0)
    got = events.groupBy("signal").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(hit.cast("double")).alias("hit_rate"))
    middle = quantiles(events.select("signal", column).dropna(), column, [0.5], ["signal"]).withColumnRenamed("q0", "median")
    return F.broadcast(spine).join(got, "signal", "left").join(middle, "signal", "left").select("signal", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", "hit_rate")


def with_quintiles(events: DataFrame, feature: str, order: tuple[str, ...] = ("ticker", "call_date"), least: int = 25, nulls_last: bool = False) -> DataFrame:
    """Adds q_{feature}: 1 to 5 by rank within the quarter of the call, of at least `least` rows; the edges are those of
    equal parts of the ranks' range.

    Rows of equal values are ranked in `order`; rows without a value come before all others, or by nulls_last after them.
    How many rows of the quarter have a smaller value comes from counts of values in ranges; only rows of one quarter and
    one value are numbered in a window.
    """
    x = events.withColumn("_quarter", F.trunc(F.to_date("call_date"), "quarter"))
    counts = x.groupBy("_quarter", F.col(feature).alias("_value")).agg(F.count("*").alias("_n"))
    before = with_before(counts, "_value", ["_n"], ["_quarter"]).select(F.col("_quarter").alias("_q2"), "_value", "_n_before")
    sizes = counts.groupBy(F.col("_quarter").alias("_q3")).agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col("_value").isNull(), F.col("_n")).otherwise(0)).alias("_nulls"))
    tied = F.row_number().over(Window.partitionBy("_quarter", feature).orderBy(*order))
    placed = x.withColumn("_tied", tied).join(before, F.col("_quarter").eqNullSafe(F.col("_q2")) & F.col(feature).eqNullSafe(F.col("_value"))).join(F.broadcast(sizes), F.col("_quarter").eqNullSafe(F.col("_q3")))
    rank = F.col("_n_before") + F.col("_tied")
    if nulls_last:
        rank = rank - F.col("_nulls") + F.when(F.col(feature).isNull(), F.col("_all")).otherwise(0)
    fifth = F.greatest(F.lit(1), F.ceil(F.lit(5) * (rank - 1) / F.greatest(F.col("_all") - 1, F.lit(1)))).cast("int")
    return placed.withColumn(f"q_{feature}", F.when(F.col("_all") >= least, fifth)).select(*events.columns, f"q_{feature}")


def quintile_means(events: DataFrame, column: str, feature: str) -> DataFrame:
    return events.filter(F.col(f"q_{feature}").isNotNull()).groupBy(F.col(f"q_{feature}").alias("quintile")).agg(F.avg(column).alias("mean"), F.count("*").alias("n"))


def monthly_spread(events: DataFrame, column: str, long: Column, short: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, month, spread): mean of the long side less that of the short one, for months with both."""
    m = events.groupBy(*by, "month").agg(F.avg(F.when(long, F.col(column))).alias("l"), F.avg(F.when(short, F.col(column))).alias("s"))
    return m.filter("l is not null and s is not null").select(*by, "month", (F.col("l") - F.col("s")).alias("spread"))


def spread_t(events: DataFrame, column: str, long: Column, short: Column, by: list[str] = [], least: int = 3) -> DataFrame:  # noqa: B006
    """(by, months, spread, t_stat): mean monthly spread and its t; null below `least` months."""
    m = monthly_spread(events, column, long, short, by)
    enough = F.count("*") >= least
    sd = F.stddev_samp("spread")
    return m.groupBy(*by).agg(F.count("*").alias("months"), F.when(enough, F.avg("spread")).alias("spread"), F.when(enough & (sd > 0), F.avg("spread") / (sd / F.sqrt(F.count("*").cast("double")))).alias("t_stat"))


def with_p_value(spreads: DataFrame) -> DataFrame:
    """Adds p_value, two-sided. Its expression is long: many spreads get theirs by one call, not by one each."""
    return spreads.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("months") - 1))


def clustered_spread(events: DataFrame, column: str, long: Column, short: Column, by: list[str] = [], least: int = 3) -> DataFrame:  # noqa: B006
    """(by, months, spread, t_stat, p_value): what spread_t gives, with the p of t."""
    return with_p_value(spread_t(events, column, long, short, by, least))


def rank_ic(events: DataFrame, column: str, features: tuple[str, ...] = FEATURES, least: int = 10) -> DataFrame:
    """(feature, n, spearman, p_value) for features with at least `least` values; all features in one pass over the events."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x"), F.col(column).alias("_y")) for f in features))
    d = events.select(F.inline(pairs)).dropna()

    ranked = d.join(average_ranks(d, "_x", "_rx", ["feature"]), ["feature", "_x"]).join(average_ranks(d, "_y", "_ry", ["feature"]), ["feature", "_y"])
    return ranked.groupBy("feature").agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("spearman")).filter(F.col("n") >= least).withColumn("p_value", spearman_p_value(F.col("spearman"), F.col("n")))


def summarize(events: DataFrame, horizons: tuple[int, ...] = HORIZONS, winsorize: float = 0.01, least: int = 30) -> dict:
    """All statistics as a nested dict for JSON; only aggregates are collected."""
    top = events.agg(F.count("*").alias("events"), F.countDistinct("ticker").alias("tickers"), F.min("entry_date").alias("a"), F.max("entry_date").alias("b")).first()
    out: dict = {"events": top["events"], "tickers": top["tickers"], "first_entry": str(top["a"]), "last_entry": str(top["b"])}
    for f in ("confidence", "gap"):
        events = with_quintiles(events, f)
    events = cut(events)

    rounded = lambda x, k: None if x is None else round(x, k)

    def as_dict(r) -> dict:
        if r["spread"] is None:
            return {"spread": None, "t_stat": None, "p_value": None, "months": r["months"]}
        return {"spread": round(r["spread"], 5), "t_stat": rounded(r["t_stat"], 3), "p_value": rounded(r["p_value"], 4), "months": r["months"]}

    buy, sell = F.col("signal") == "BUY", F.col("signal") == "SELL"
    sides = {"buy_minus_sell": (buy, sell)} | {f"{f}_q5_minus_q1": (F.col(f"q_{f}") == 5, F.col(f"q_{f}") == 1) for f in ("confidence", "gap")}
    for h in horizons:
        c = f"excess_{h}d"
        if events.filter(F.col(c).isNotNull()).count() < least:
            continue
        d = cut(winsorized(events, c, winsorize))
        res: dict = {"by_signal": {r["signal"]: {"n": r["n"], "mean": rounded(r["mean"], 5), "median": rounded(r["median"], 5), "hit_rate": rounded(r["hit_rate"], 4)} for r in by_signal(d, c).collect()}}
        spreads = [spread_t(d, c, *side).select(F.lit(name).alias("of"), "*") for name, side in sides.items()]
        p = {r["of"]: as_dict(r) for r in with_p_value(functools.reduce(DataFrame.unionByName, spreads)).collect()}
        res["buy_minus_sell"] = p["buy_minus_sell"]
        for f in ("confidence", "gap"):
            means = {r["quintile"]: rounded(r["mean"], 5) for r in quintile_means(d, c, f).orderBy("quintile").collect()}
            res[f"quintiles_{f}"] = {"mean_by_quintile": means, "q5_minus_q1": p[f"{f}_q5_minus_q1"]}
        res["rank_ic"] = {r["feature"]: {"spearman": rounded(r["spearman"], 4), "p_value": rounded(r["p_value"], 4)} for r in rank_ic(d, c).collect() if r["spearman"] is not None}
        years = {r["year"]: {"n": r["n"]} for r in d.groupBy("year").agg(F.count("*").alias("n")).orderBy("year").collect()}
        for name in ("buy_minus_sell", "confidence_q5_minus_q1"):
            got = {r["year"]: r["spread"] for r in spread_t(d, c, *sides[name], ["year"]).collect()}
            for y in years:
                years[y][name] = rounded(got.get(y), 5)
        res["by_year"] = years
        out[f"{h}d"] = res
    return out
