"""Long-only lot simulation: BUY adds a lot, SELL closes all, each with a shadow lot of the benchmark.

Tickers share no cash, so the whole state machine is windows by ticker: no Python state and one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.operators.prices import asof_backward

LOT_DOLLARS, MAX_LOTS = 1000.0, 5
TRADE_COLUMNS = (
    "date", "ticker", "action", "reason", "price", "shares", "dollars", "cost", "spy_shares", "spy_dollars", "pnl", "spy_pnl", "days_held", "lots_after",
)


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays from start up to, not including, end; 0 if end isn't later. Arithmetic, no calendar rows."""
    def upto(d: Column) -> Column:  # weekdays since Monday 1970-01-05, before d
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.when(end > start, upto(end) - upto(start)).otherwise(F.lit(0)).cast("int")


def lot_states(events: DataFrame, order: list[str], by: str = "ticker", signal: str = "signal", max_lots: int = MAX_LOTS) -> DataFrame:
    """Adds seg (SELLs before), lots_before, trades (whether it does) and lots_after to each event of a ticker in `order`."""
    w = Window.partitionBy(by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("seg", F.coalesce(F.sum((F.col(signal) == "SELL").cast("int")).over(before), F.lit(0)).cast("int"))
    inside = Window.partitionBy(by, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("lots_before", F.least(F.coalesce(F.sum((F.col(signal) == "BUY").cast("int")).over(inside), F.lit(0)), F.lit(max_lots)).cast("int"))
    trades = F.when(F.col(signal) == "BUY", F.col("lots_before") < max_lots).when(F.col(signal) == "SELL", F.col("lots_before") > 0).otherwise(F.lit(False))
    after = F.when(F.col(signal) == "SELL", F.lit(0)).when((F.col(signal) == "BUY") & trades, F.col("lots_before") + 1).otherwise(F.col("lots_before"))
    return out.withColumns({"trades": trades, "lots_after": after.cast("int")})


def _with_opens(events: DataFrame, benchmark: DataFrame, seq: str) -> DataFrame:
    opens = benchmark.select(F.to_date("date").alias("entry_date"), F.col("open").alias("spy_open")).filter("spy_open is not null")
    return events.select("ticker", F.to_date("entry_date").alias("entry_date"), "signal", "entry_price", F.col(seq).alias("seq")).join(F.broadcast(opens), "entry_date")


def lots(events: DataFrame, prices: DataFrame, benchmark: DataFrame, lot_dollars: float = LOT_DOLLARS, max_lots: int = MAX_LOTS, gap_days: int = 7, seq: str = "seq") -> DataFrame:
    """One row per lot: opened, shares, cost, spy_shares, and closed, close_price, spy_close_price, reason (null while open).

    A lot closes at the SELL that ends its segment, or at the last price of a ticker whose history ends over gap_days
    before the benchmark's. events: ticker, entry_date, signal, entry_price and seq, which orders events of a day.
    """
    order = ["entry_date", "seq"]
    states = lot_states(_with_opens(events, benchmark, seq), order, max_lots=max_lots)
    bought = states.filter("signal = 'BUY' and trades").select(
        "ticker", "seg", F.col("entry_date").alias("opened"), F.col("seq").alias("open_seq"), F.col("entry_price").alias("open_price"), F.col("spy_open").alias("spy_open_price"),
        (F.lit(lot_dollars) / F.col("entry_price")).alias("shares"), F.lit(lot_dollars).alias("cost"), (F.lit(lot_dollars) / F.col("spy_open")).alias("spy_shares"),
    )
    sold = states.filter("signal = 'SELL' and trades").select("ticker", "seg", F.col("entry_date").alias("_d"), F.col("seq").alias("close_seq"), F.col("entry_price").alias("_p"), F.col("spy_open").alias("_s"))
    last_day = benchmark.agg(F.max(F.to_date("date")).alias("_last"))
    ends = prices.groupBy("ticker").agg(F.max_by("close", "date").alias("_end_close"), F.max(F.to_date("date")).alias("_end"))
    ends = ends.crossJoin(F.broadcast(last_day)).filter(F.col("_end") < F.date_sub("_last", gap_days)).drop("_last")
    ends = asof_backward(ends, benchmark.select("date", "close"), None, "_end", "date").withColumn("_end_spy", F.col("bar.close")).drop("bar")
    return (
        bought.join(sold, ["ticker", "seg"], "left").join(ends, "ticker", "left")
        .withColumns({
            "closed": F.coalesce("_d", "_end"), "close_price": F.coalesce("_p", "_end_close"), "spy_close_price": F.coalesce("_s", "_end_spy"),
            "reason": F.when(F.col("_d").isNotNull(), "signal").when(F.col("_end").isNotNull(), "price history ended"),
        }).drop("_d", "_p", "_s", "_end", "_end_close", "_end_spy")
    )


def trade_log(events: DataFrame, prices: DataFrame, benchmark: DataFrame, lot_dollars: float = LOT_DOLLARS, max_lots: int = MAX_LOTS, gap_days: int = 7, seq: str = "seq") -> DataFrame:
    """TRADE_COLUMNS, one row per BUY, per lot closed and per event without a trade; lots_after runs along each ticker.

    Rows of a ticker's day keep the order of events, closings of delisted tickers come last.
    """
    states = lot_states(_with_opens(events, benchmark, seq), ["entry_date", "seq"], max_lots=max_lots)
    all_lots = lots(events, prices, benchmark, lot_dollars, max_lots, gap_days, seq)
    none = F.lit(None).cast("double")
    zero = F.lit(0.0)
    buys = all_lots.select(
        F.col("opened").alias("date"), "ticker", F.lit("BUY").alias("action"), F.lit("signal").alias("reason"), F.col("open_price").alias("price"), "shares", (-F.col("cost")).alias("dollars"), "cost",
        "spy_shares", (-F.col("cost")).alias("spy_dollars"), none.alias("pnl"), none.alias("spy_pnl"), F.lit(None).cast("int").alias("days_held"), F.col("open_seq").alias("_seq"), F.lit(0).cast("long").alias("_lot"),
    )
    proceeds, spy = F.col("shares") * F.col("close_price"), F.col("spy_shares") * F.col("spy_close_price")
    sells = all_lots.filter("closed is not null").select(
        F.col("closed").alias("date"), "ticker", F.lit("SELL").alias("action"), "reason", F.col("close_price").alias("price"), (-F.col("shares")).alias("shares"), proceeds.alias("dollars"), (-F.col("cost")).alias("cost"),
        (-F.col("spy_shares")).alias("spy_shares"), spy.alias("spy_dollars"), (proceeds - F.col("cost")).alias("pnl"), (spy - F.col("cost")).alias("spy_pnl"),
        business_days(F.col("opened"), F.col("closed")).alias("days_held"), F.coalesce("close_seq", F.lit((1 << 63) - 1)).alias("_seq"), F.col("open_seq").alias("_lot"),
    )
    reason = F.when(F.col("signal") == "HOLD", "hold").when(F.col("signal") == "BUY", "at max lots").otherwise("nothing held")
    idle = states.filter(~F.col("trades")).select(
        F.col("entry_date").alias("date"), "ticker", F.when(F.col("signal") == "HOLD", "HOLD").otherwise(F.concat("signal", F.lit(" (no trade)"))).alias("action"), reason.alias("reason"), F.col("entry_price").alias("price"),
        zero.alias("shares"), zero.alias("dollars"), zero.alias("cost"), zero.alias("spy_shares"), zero.alias("spy_dollars"), none.alias("pnl"), none.alias("spy_pnl"), F.lit(None).cast("int").alias("days_held"), F.col("seq").alias("_seq"), F.lit(0).cast("long").alias("_lot"),
    )
    w = Window.partitionBy("ticker").orderBy("date", "_seq", "_lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("action") == "BUY", 1).when(F.col("action") == "SELL", -1).otherwise(0)
    log = buys.unionByName(sells).unionByName(idle)
    return log.withColumn("lots_after", F.sum(step).over(w).cast("int")).select(*TRADE_COLUMNS)


def daily_book(trades: DataFrame, prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per benchmark day from the first trade on: values, cash, profit and returns of both legs.

    What a ticker is worth changes on days of its trades and prices only. These changes are summed up by day, and then
    along the days: no table of days times tickers. Values are kept as decimals of ten places, so that what is sold
    leaves nothing behind, whatever the order of the sums.
    """
    real = trades.filter(F.col("action").isin("BUY", "SELL"))
    all_days = benchmark.select(F.to_date("date").alias("date"), F.col("close").alias("_spy"))
    days = all_days.filter(F.col("date") >= real.agg(F.min("date")).scalar())
    moves = real.select("ticker", "date", F.col("shares").alias("_m"), F.lit(None).cast("double").alias("_c"))
    close = prices.select("ticker", F.to_date("date").alias("date"), F.lit(None).cast("double").alias("_m"), F.col("close").alias("_c"))
    close = close.join(real.select("ticker").distinct(), "ticker", "left_semi")
    points = moves.unionByName(close).join(days.select("date"), "date", "left_semi").groupBy("ticker", "date").agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("_m"), F.max("_c").alias("_c"))
    along = Window.partitionBy("ticker").orderBy("date")
    w = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = points.withColumns({"_sh": F.greatest(F.sum("_m").over(w), F.lit(0.0)), "_cl": F.last("_c", ignorenulls=True).over(w)})
    held = held.withColumns({"_v": F.coalesce(F.col("_sh") * F.col("_cl"), F.lit(0.0)).cast("decimal(28,10)"), "_n": (F.col("_sh") > 1e-9).cast("long")})
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(along), F.lit(0).cast(dict(held.dtypes)[c]))
    changes = held.select("date", step("_v").alias("_v"), step("_n").alias("_n")).groupBy("date").agg(F.sum("_v").alias("_v"), F.sum("_n").alias("_n"))
    by_day = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = days.select("date").join(changes, "date", "left").select(
        "date", F.coalesce(F.sum("_v").over(by_day), F.lit(0)).cast("double").alias("market_value"), F.coalesce(F.sum("_n").over(by_day), F.lit(0)).alias("stocks_held")
    )
    flows = real.groupBy("date").agg(*(F.sum(c).alias(f"_{c}") for c in ("dollars", "spy_dollars", "spy_shares", "cost")), F.sum(F.when(F.col("action") == "BUY", F.col("cost")).otherwise(0.0)).alias("_buys"))
    book = days.join(flows, "date", "left").join(value, "date")
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.sum(F.coalesce(f"_{c}", F.lit(0.0))).over(run)
    book = book.withColumns({"cash": total("dollars"), "spy_value": total("spy_shares") * F.col("_spy"), "spy_cash": total("spy_dollars"), "cost_basis_open": total("cost"), "_buys": F.coalesce("_buys", F.lit(0.0))})
    book = book.withColumns({"pnl": F.col("market_value") + F.col("cash"), "spy_pnl": F.col("spy_value") + F.col("spy_cash")}).withColumn("excess_pnl", F.col("pnl") - F.col("spy_pnl"))
    day = Window.orderBy("date")

    def ret(v: str, p: str) -> Column:
        base = F.coalesce(F.lag(v).over(day), F.lit(0.0)) + F.col("_buys")
        return F.when(base > 0, (F.col(p) - F.coalesce(F.lag(p).over(day), F.lit(0.0))) / F.greatest(base, F.lit(1e-300))).otherwise(0.0)

    book = book.withColumns({"ret": ret("market_value", "pnl"), "spy_ret": ret("spy_value", "spy_pnl")}).withColumn("excess_ret", F.col("ret") - F.col("spy_ret"))
    return book.select("date", "market_value", "cash", "spy_value", "spy_cash", "cost_basis_open", "stocks_held", "pnl", "spy_pnl", "excess_pnl", "ret", "spy_ret", "excess_ret")


def return_stats(book: DataFrame, column: str = "ret", date: str = "date", days_a_year: int = 252) -> DataFrame:
    """One row: annualized_return, annualized_vol, sharpe (null without spread), max_drawdown, total_return."""
    run = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = book.select(date, F.col(column).alias("_r")).withColumn("_g", F.product(1 + F.col("_r")).over(run)).withColumn("_top", F.max("_g").over(run))
    growth, n, sd = F.max_by("_g", date), F.count("*"), F.stddev_samp("_r")
    root = F.sqrt(F.lit(float(days_a_year)))
    return g.agg(
        (F.pow(growth, F.lit(float(days_a_year)) / n) - 1).alias("annualized_return"), (sd * root).alias("annualized_vol"), F.when(sd > 0, F.avg("_r") / sd * root).alias("sharpe"),
        F.min(F.col("_g") / F.col("_top") - 1).alias("max_drawdown"), (growth - 1).alias("total_return"),
    )


def holdings(all_lots: DataFrame, prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Open lots by ticker at the last close, and unrealised profit of both legs; largest value first."""
    close = prices.groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"))
    spy = benchmark.agg(F.max_by("close", "date").alias("_spy"))
    got = all_lots.filter("closed is null").groupBy("ticker").agg(F.count("*").alias("lots"), F.sum("shares").alias("shares"), F.sum("cost").alias("cost_basis"), F.min("opened").alias("first_bought"), F.sum("spy_shares").alias("_sh"))
    got = got.join(close, "ticker").crossJoin(F.broadcast(spy)).withColumn("market_value", F.col("shares") * F.col("last_close"))
    return got.select(
        "ticker", "lots", "shares", "cost_basis", "first_bought", "last_close", "market_value", (F.col("market_value") - F.col("cost_basis")).alias("unrealized_pnl"),
        (F.col("_sh") * F.col("_spy") - F.col("cost_basis")).alias("spy_unrealized_pnl"),
    ).orderBy(F.desc("market_value"), "ticker")


def trade_summary(trades: DataFrame) -> DataFrame:
    """One row of counts, rates and sums of the log."""
    a, closed = F.col("action"), F.col("action") == "SELL"
    rate = lambda c: F.avg(F.when(closed, c.cast("double")))
    return trades.agg(
        F.count_if(a == "BUY").alias("lots_bought"), F.count_if(closed).alias("lots_sold"),
        F.countDistinct(F.when(closed & (F.col("reason") == "signal"), F.struct("ticker", "date"))).alias("sell_exits"),
        F.count_if(a == "BUY (no trade)").alias("skipped_buys_at_cap"), F.count_if(a == "SELL (no trade)").alias("sells_with_nothing_held"),
        rate(F.col("pnl") > 0).alias("closed_lot_win_rate"), rate(F.col("pnl") > F.col("spy_pnl")).alias("closed_lot_beat_spy_rate"),
        F.median(F.when(closed, F.col("days_held"))).alias("median_days_held"), F.coalesce(F.sum(F.when(closed, F.col("pnl"))), F.lit(0.0)).alias("realized_pnl"),
    )


def by_year(trades: DataFrame, book: DataFrame) -> DataFrame:
    """(year, strategy, shadow_spy, excess_pnl in the year, lots_bought)."""
    y = book.groupBy(F.year("date").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("strategy"), (F.product(1 + F.col("spy_ret")) - 1).alias("shadow_spy"), F.max_by("excess_pnl", "date").alias("_end"))
    w = Window.orderBy("year")
    bought = trades.filter("action = 'BUY'").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("lots_bought"))
    y = y.withColumn("excess_pnl", F.col("_end") - F.coalesce(F.lag("_end").over(w), F.lit(0.0))).drop("_end")
    return y.join(bought, "year", "left").withColumn("lots_bought", F.coalesce("lots_bought", F.lit(0)))


def summarize(trades: DataFrame, book: DataFrame, held: DataFrame) -> dict:
    """All of it as a nested dict for JSON; only single rows and one row a year are collected."""
    out = trade_summary(trades).first().asDict()
    end = book.agg(*(F.max_by(c, "date").alias(c) for c in ("pnl", "spy_pnl", "excess_pnl")), F.max("cost_basis_open").alias("m")).first()
    h = held.agg(F.sum("unrealized_pnl").alias("u"), F.count("*").alias("n")).first()
    money = lambda x: None if x is None else round(x, 2)
    out |= {"realized_pnl": money(out["realized_pnl"]), "unrealized_pnl": money(h["u"] or 0.0), "total_pnl": money(end["pnl"]), "shadow_spy_pnl": money(end["spy_pnl"]), "excess_pnl": money(end["excess_pnl"]), "max_capital_deployed": money(end["m"]), "stocks_held_now": h["n"]}
    for name, c in (("strategy", "ret"), ("shadow_spy", "spy_ret"), ("excess", "excess_ret")):
        out[name] = {k: None if v is None else round(v, 3 if k == "sharpe" else 4) for k, v in return_stats(book, c).first().asDict().items()}
    out["by_year"] = {r["year"]: {"strategy": round(r["strategy"], 4), "shadow_spy": round(r["shadow_spy"], 4), "excess_pnl": round(r["excess_pnl"], 2), "lots_bought": r["lots_bought"]} for r in by_year(trades, book).orderBy("year").collect()}
    return out
