"""Prices, events and lots as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import events as E
from earshot.operators import inventory as I
from earshot.operators import prices as P
from earshot.operators import report
from earshot.plans import analogues as A

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(*names: str, digits: int = 6):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def rsql(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def study(spark, d):
    return E.event_returns(A.price_signals(spark, d), A.prices(spark, d), A.benchmark(spark, d), min_dollar_volume=A.MIN_DOLLAR_VOLUME).cache()  # several statistics read it


@query(f"WITH {A.PRICES_SQL} SELECT ticker, date, {rsql('open', 'close', 'volume')} FROM prices")
def price_bars(spark, d):
    return A.prices(spark, d).select("ticker", "date", *r("open", "close", "volume"))


@query(f"WITH {A.BARS_SQL} SELECT ticker, date, bar::INT AS bar, bars, {rsql('dollar_volume')} FROM bars")
def trailing_dollar_volume(spark, d):
    return P.with_bars(A.prices(spark, d)).select("ticker", "date", "bar", "bars", *r("dollar_volume"))


@query(f"WITH {A.BARS_SQL} SELECT ticker, date, {rsql('close_5', 'close_60')}, date_20 FROM bars")
def horizon_returns(spark, d):
    return P.with_bars(A.prices(spark, d)).select("ticker", "date", *r("close_5", "close_60"), "date_20")


@query(f"""WITH {A.PRICES_SQL}, {A.PRICE_SIGNALS_SQL} SELECT call, b.date AS entry_date, round(b.open, 6) AS entry_price FROM (SELECT *, call_date + CASE WHEN call_time_et > '' AND call_time_et < '09:30' THEN 0 ELSE 1 END AS d FROM psignals) s ASOF LEFT JOIN prices b ON s.ticker = b.ticker AND s.d <= b.date""")
def entry_asof_forward(spark, d):
    x = P.asof_forward(A.price_signals(spark, d), A.prices(spark, d), "ticker", "call_date", "date", P.is_premarket())
    return x.select("call", F.col("bar.date").alias("entry_date"), F.round("bar.open", 6).alias("entry_price"))


@query(f"WITH {A.PRICES_SQL}, {A.PRICE_SIGNALS_SQL} SELECT call, round(b.close, 6) AS price_at_call FROM psignals s ASOF LEFT JOIN prices b ON s.ticker = b.ticker AND s.call_date >= b.date")
def asof_backward(spark, d):
    return P.asof_backward(A.price_signals(spark, d), A.prices(spark, d), "ticker", "call_date", "date").select("call", F.round("bar.close", 6).alias("price_at_call"))


def hot_signals(spark, d):
    """price_signals, half of them of one ticker."""
    s = A.price_signals(spark, d)
    return s.withColumn("ticker", F.when(F.col("call") % 2 == 0, F.lit("S7")).otherwise(F.col("ticker"))).withColumn("call_time_et", F.when(F.col("call") % 3 == 0, "08:00").otherwise("17:00"))


HOT_SQL = f"{A.PRICES_SQL}, {A.PRICE_SIGNALS_SQL}, hot AS (SELECT call, CASE WHEN call % 2 = 0 THEN 'S7' ELSE ticker END AS ticker, call_date, call_date + CASE WHEN call % 3 = 0 THEN 0 ELSE 1 END AS least FROM psignals)"


@query(f"""WITH {HOT_SQL} SELECT call, f.date AS entry_date, round(f.open, 6) AS entry_price, round(b.close, 6) AS price_at_call FROM hot h
ASOF LEFT JOIN (SELECT ticker, date, open FROM prices) f ON h.ticker = f.ticker AND h.least <= f.date ASOF LEFT JOIN (SELECT ticker, date, close FROM prices) b ON h.ticker = b.ticker AND h.call_date >= b.date""")
def asof_hot_key(spark, d):
    """Both as-of joins with half of all rows on one key."""
    prices = A.prices(spark, d)
    found = P.asof_forward(hot_signals(spark, d), prices, "ticker", "call_date", "date", P.is_premarket()).withColumnRenamed("bar", "entry")
    return P.asof_backward(found, prices, "ticker", "call_date", "date").select("call", F.col("entry.date").alias("entry_date"), F.round("entry.open", 6).alias("entry_price"), F.round("bar.close", 6).alias("price_at_call"))


@query(f"WITH {A.EVENTS_SQL} SELECT ticker, call_date, entry_date, signal, {rsql('entry_price', 'dollar_volume', 'confidence')}, month, year FROM events_")
def tradeable_filter(spark, d):
    return study(spark, d).select("ticker", "call_date", "entry_date", "signal", *r("entry_price", "dollar_volume", "confidence"), "month", F.col("year").cast("long").alias("year"))


@query(f"WITH {A.EVENTS_SQL} SELECT ticker, call_date, entry_date, signal, {rsql('confidence', 'ret_1d', 'excess_1d', 'ret_5d', 'excess_5d', 'excess_20d', 'excess_60d')}, exit_date_5d FROM events_")
def excess_returns(spark, d):
    return study(spark, d).select("ticker", "call_date", "entry_date", "signal", *r("confidence", "ret_1d", "excess_1d", "ret_5d", "excess_5d", "excess_20d", "excess_60d"), "exit_date_5d")


WINSOR_SQL = f"{A.EVENTS_SQL}, lim AS (SELECT quantile_cont(excess_5d, 0.01) AS lo, quantile_cont(excess_5d, 0.99) AS hi FROM events_), wins AS (SELECT * REPLACE (greatest(least(excess_5d, hi), lo) AS excess_5d) FROM events_, lim WHERE excess_5d IS NOT NULL)"


def clipped(spark, d):
    return E.winsorized(study(spark, d), "excess_5d")


@query(f"WITH {WINSOR_SQL} SELECT signal, count(*) AS n, round(avg(excess_5d), 6) AS mean, round(median(excess_5d), 6) AS median, round(avg((CASE WHEN signal = 'SELL' THEN excess_5d < 0 ELSE excess_5d > 0 END)::INT), 6) AS hit_rate FROM wins GROUP BY 1")
def winsorized_by_signal(spark, d):
    return E.by_signal(clipped(spark, d), "excess_5d").select("signal", "n", *r("mean", "median", "hit_rate"))


QUINT_SQL = "ranked AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('quarter', call_date) ORDER BY confidence, ticker, call_date, entry_date) AS rn, count(*) OVER (PARTITION BY date_trunc('quarter', call_date)) AS cnt FROM events_), q AS (SELECT *, CASE WHEN cnt >= 25 THEN greatest(1, ceil(5 * (rn - 1) / (cnt - 1)))::INT END AS q_confidence FROM ranked)"


def ranked(spark, d):
    return E.with_quintiles(study(spark, d), "confidence", ("ticker", "call_date", "entry_date"), nulls_last=True)


@query(f"WITH {A.EVENTS_SQL}, {QUINT_SQL} SELECT ticker, call_date, entry_date, {rsql('confidence')}, q_confidence FROM q")
def quarter_quintiles(spark, d):
    return ranked(spark, d).select("ticker", "call_date", "entry_date", *r("confidence"), "q_confidence")


@query(f"WITH {A.EVENTS_SQL}, {QUINT_SQL} SELECT q_confidence AS quintile, round(avg(excess_5d), 6) AS mean, count(*) AS n FROM q WHERE q_confidence IS NOT NULL GROUP BY 1")
def quintile_means(spark, d):
    return E.quintile_means(ranked(spark, d), "excess_5d", "confidence").select("quintile", *r("mean"), "n")


SPREAD_SQL = "m AS (SELECT {by} month, avg(excess_5d) FILTER (signal = 'BUY') - avg(excess_5d) FILTER (signal = 'SELL') AS spread FROM wins GROUP BY ALL), k AS (SELECT * FROM m WHERE spread IS NOT NULL)"


#: Two-sided p-values of t(id, t, df) as p(id, p_value): the finite sums for whole degrees of freedom, whose terms a recursion makes.
P_SQL = """q AS (SELECT id, df, atan(abs(t) / sqrt(df)) AS angle, df / (df + t * t) AS c2 FROM t WHERE df > 0),
terms AS (
  SELECT id, df, angle, c2, (2 - df % 2)::BIGINT AS j, CASE WHEN df % 2 = 0 THEN 1 ELSE sqrt(c2) END AS term, CASE WHEN df % 2 = 0 THEN 1 ELSE sqrt(c2) END AS total FROM q
  UNION ALL SELECT id, df, angle, c2, j + 2, term * c2 * (CASE WHEN df % 2 = 0 THEN (j - 1)::DOUBLE / j ELSE (j + 1)::DOUBLE / (j + 2) END), total + term * c2 * (CASE WHEN df % 2 = 0 THEN (j - 1)::DOUBLE / j ELSE (j + 1)::DOUBLE / (j + 2) END)
  FROM terms WHERE j + 2 <= df - 2 * (df % 2) AND term > 1e-18),
p AS (SELECT id, 1 - CASE WHEN df % 2 = 0 THEN sin(any_value(angle)) * max(total) WHEN df = 1 THEN any_value(angle) * 2 / pi() ELSE 2 / pi() * (any_value(angle) + sin(any_value(angle)) * max(total)) END AS p_value FROM terms GROUP BY id, df)"""


@query(f"""WITH RECURSIVE {WINSOR_SQL}, {SPREAD_SQL.format(by='')}, one AS (SELECT count(*) AS months, CASE WHEN count(*) >= 3 THEN avg(spread) END AS spread, CASE WHEN count(*) >= 3 THEN avg(spread) / (stddev_samp(spread) / sqrt(count(*))) END AS t_stat FROM k),
t AS (SELECT 0 AS id, t_stat AS t, months - 1 AS df FROM one WHERE t_stat IS NOT NULL), {P_SQL}
SELECT months, round(spread, 6) AS spread, round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value FROM one LEFT JOIN p ON true""")
def clustered_spread(spark, d):
    return E.clustered_spread(clipped(spark, d), "excess_5d", F.col("signal") == "BUY", F.col("signal") == "SELL").select("months", *r("spread", "t_stat", "p_value"))


@query(f"WITH {WINSOR_SQL}, {SPREAD_SQL.format(by='year,')} SELECT year, count(*) AS months, round(CASE WHEN count(*) >= 3 THEN avg(spread) END, 6) AS spread FROM k GROUP BY 1")
def by_year_spread(spark, d):
    return E.clustered_spread(clipped(spark, d), "excess_5d", F.col("signal") == "BUY", F.col("signal") == "SELL", ["year"]).select(F.col("year").cast("long").alias("year"), "months", *r("spread"))


_IC_SQL = " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, corr(x, y) AS spearman FROM r_{f}" for f in E.FEATURES)


@query("WITH RECURSIVE " + WINSOR_SQL + "," + ",".join(f"r_{f} AS (SELECT rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2 AS x, rank() OVER (ORDER BY excess_5d) + (count(*) OVER (PARTITION BY excess_5d) - 1) / 2 AS y FROM wins)" for f in E.FEATURES) + f""",
ic AS MATERIALIZED ({_IC_SQL}), t AS (SELECT feature AS id, spearman * sqrt((n - 2) / (1 - spearman * spearman)) AS t, n - 2 AS df FROM ic WHERE abs(spearman) < 1), {P_SQL}
SELECT feature, n, round(spearman, 6) AS spearman, round(CASE WHEN abs(spearman) >= 1 THEN 0 ELSE p_value END, 6) AS p_value FROM ic LEFT JOIN p ON feature = id""")
def rank_ic(spark, d):
    return E.rank_ic(clipped(spark, d), "excess_5d").select("feature", "n", *r("spearman", "p_value"))


@query(f"WITH {A.EVENTS_SQL} SELECT count(*) AS events, count(DISTINCT ticker) AS tickers, min(entry_date) AS first_entry, max(entry_date) AS last_entry FROM events_")
def event_counts(spark, d):
    return study(spark, d).agg(F.count("*").alias("events"), F.countDistinct("ticker").alias("tickers"), F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry"))


@query(f"WITH {A.PRICES_SQL}, w AS (SELECT DISTINCT 'S' || (o_custkey % 120) AS ticker, o_custkey % 120 = 119 AS later FROM orders), f AS (SELECT ticker, min(date) AS first FROM prices GROUP BY 1) SELECT ticker FROM w LEFT JOIN f USING (ticker) WHERE NOT coalesce(first <= DATE '1995-01-02' + 10, false)")
def price_coverage(spark, d):
    wanted = A.table(spark, d, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 120).cast("string")).alias("ticker"))
    return P.to_fetch(A.prices(spark, d), wanted, "1995-01-02")


@query(f"""WITH {A.SIGNALS_SQL}, {A.PRICES_SQL}, n AS (SELECT ticker, count(*) AS calls, list_position(['C7', 'C3', 'C11'], ticker) AS listed FROM signals GROUP BY 1),
k AS (SELECT ticker, row_number() OVER (ORDER BY coalesce(listed, 1000000), calls DESC, ticker) AS pos FROM n WHERE (listed IS NOT NULL AND calls >= 3) OR (listed IS NULL AND calls >= 6)),
s AS (SELECT call_id, 'S' || substr(ticker, 2) AS ticker, call_date, signal FROM signals WHERE NOT warmup AND ticker IN (SELECT ticker FROM k WHERE pos <= 9))
SELECT call_id, s.ticker, signal, round(b.close, 6) AS price_at_call FROM s ASOF LEFT JOIN prices b ON s.ticker = b.ticker AND s.call_date >= b.date""")
def price_panels(spark, d):
    from earshot.plans.signal_queries import made

    s, priced = made(spark, d), F.concat(F.lit("S"), F.substring("ticker", 2, 20)).alias("ticker")
    chosen = report.chart_tickers(s, ["C7", "C3", "C11"]).select(priced)
    return report.price_panels(s.withColumn("ticker", priced), A.prices(spark, d), chosen).select("call_id", "ticker", "signal", *r("price_at_call"))


# Lots: bought and sold at events.
def lot_tables(spark, d):
    return A.lot_events(spark, d), A.lot_prices(spark, d), A.lot_benchmark(spark, d)


def log(spark, d):
    return I.trade_log(*lot_tables(spark, d), gap_days=1).cache()  # the book and the summaries read it


def book(spark, d):
    return I.daily_book(log(spark, d), A.lot_prices(spark, d), A.lot_benchmark(spark, d))


@query(f"WITH {A.LOT_EVENTS_SQL} SELECT ticker, seq, signal, seg, lots_before, trades FROM states")
def lot_state(spark, d):
    return I.lot_states(A.lot_events(spark, d), ["entry_date", "seq"]).select("ticker", "seq", "signal", "seg", "lots_before", "trades")


@query(f"WITH {A.LOT_EVENTS_SQL} SELECT ticker, open_seq, opened, closed, reason, {rsql('shares', 'spy_shares', 'close_price', 'spy_close_price')} FROM lots_")
def lot_closeouts(spark, d):
    return I.lots(*lot_tables(spark, d), gap_days=1).select("ticker", "open_seq", "opened", "closed", "reason", *r("shares", "spy_shares", "close_price", "spy_close_price"))


@query("SELECT o_orderkey, len(list_filter(range(0, greatest(date_diff('day', o_orderdate::DATE, DATE '1998-01-01'), 0)), lambda d: isodow(o_orderdate::DATE + d::INT) < 6))::INT AS days FROM orders")
def business_days(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", I.business_days(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date")).alias("days"))


_LOG = ("price", "shares", "dollars", "cost", "spy_shares", "spy_dollars", "pnl", "spy_pnl")


@query(f"WITH {A.LOT_EVENTS_SQL} SELECT date, ticker, action, reason, {rsql(*_LOG)}, days_held, lots_after FROM trades_")
def trade_log(spark, d):
    return log(spark, d).select("date", "ticker", "action", "reason", *r(*_LOG), "days_held", "lots_after")


_BOOK = ("market_value", "cash", "spy_value", "spy_cash", "cost_basis_open", "pnl", "spy_pnl", "excess_pnl")


@query(f"WITH {A.LOT_EVENTS_SQL} SELECT date, {rsql(*_BOOK, digits=4)}, stocks_held FROM book")
def daily_book(spark, d):
    return book(spark, d).select("date", *r(*_BOOK, digits=4), "stocks_held")


@query(f"WITH {A.LOT_EVENTS_SQL} SELECT date, {rsql('ret', 'spy_ret')}, round(ret - spy_ret, 6) AS excess_ret FROM book")
def daily_returns(spark, d):
    return book(spark, d).select("date", *r("ret", "spy_ret", "excess_ret"))


@query(f"""WITH {A.LOT_EVENTS_SQL}, g AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM book), t AS (SELECT *, max(g) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM g)
SELECT round(arg_max(g, date) ** (12.0 / count(*)) - 1, 4) AS annualized_return, round(stddev_samp(ret) * sqrt(12), 6) AS annualized_vol, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) AS sharpe, round(min(g / top - 1), 6) AS max_drawdown, round(arg_max(g, date) - 1, 6) AS total_return FROM t""")
def return_stats(spark, d):
    return I.return_stats(book(spark, d), days_a_year=12).select(*r("annualized_return", digits=4), *r("annualized_vol", "sharpe", "max_drawdown", "total_return"))


@query(f"""WITH {A.LOT_EVENTS_SQL}, lc AS (SELECT ticker, arg_max(close, date) AS last_close FROM lprices GROUP BY 1), s AS (SELECT arg_max(close, date) AS spy FROM lbench)
SELECT ticker, count(*) AS lots, round(sum(shares), 6) AS shares, sum(cost) AS cost_basis, min(opened) AS first_bought, round(any_value(last_close), 6) AS last_close, round(sum(shares) * any_value(last_close), 4) AS market_value,
  round(sum(shares) * any_value(last_close) - sum(cost), 4) AS unrealized_pnl, round(sum(spy_shares) * any_value(spy) - sum(cost), 4) AS spy_unrealized_pnl FROM lots_ JOIN lc USING (ticker), s WHERE closed IS NULL GROUP BY 1""")
def holdings(spark, d):
    e, p, b = lot_tables(spark, d)
    return I.holdings(I.lots(e, p, b, gap_days=1), p, b).select("ticker", "lots", *r("shares"), "cost_basis", "first_bought", *r("last_close"), *r("market_value", "unrealized_pnl", "spy_unrealized_pnl", digits=4))


@query(f"""WITH {A.LOT_EVENTS_SQL}, c AS (SELECT * FROM trades_ WHERE action = 'SELL')
SELECT (SELECT count(*) FROM trades_ WHERE action = 'BUY') AS lots_bought, count(*) AS lots_sold, (SELECT count(*) FROM (SELECT DISTINCT ticker, date FROM c WHERE reason = 'signal')) AS sell_exits,
  (SELECT count(*) FROM trades_ WHERE action = 'BUY (no trade)') AS skipped_buys_at_cap, (SELECT count(*) FROM trades_ WHERE action = 'SELL (no trade)') AS sells_with_nothing_held,
  round(avg((pnl > 0)::INT), 6) AS closed_lot_win_rate, round(avg((pnl > spy_pnl)::INT), 6) AS closed_lot_beat_spy_rate, median(days_held) AS median_days_held, round(sum(pnl), 4) AS realized_pnl FROM c""")
def inventory_summary(spark, d):
    s = I.trade_summary(log(spark, d))
    return s.select("lots_bought", "lots_sold", "sell_exits", "skipped_buys_at_cap", "sells_with_nothing_held", *r("closed_lot_win_rate", "closed_lot_beat_spy_rate"), "median_days_held", *r("realized_pnl", digits=4))


@query(f"""WITH {A.LOT_EVENTS_SQL}, y AS (SELECT year(date) AS year, product(1 + ret) - 1 AS strategy, product(1 + spy_ret) - 1 AS shadow_spy, arg_max(excess_pnl, date) AS end_ FROM book GROUP BY 1)
SELECT year::BIGINT AS year, round(strategy, 6) AS strategy, round(shadow_spy, 6) AS shadow_spy, round(end_ - coalesce(lag(end_) OVER (ORDER BY year), 0), 4) AS excess_pnl, (SELECT count(*) FROM trades_ WHERE action = 'BUY' AND year(date) = y.year) AS lots_bought FROM y""")
def inventory_by_year(spark, d):
    return I.by_year(log(spark, d), book(spark, d)).select(F.col("year").cast("long").alias("year"), *r("strategy", "shadow_spy"), *r("excess_pnl", digits=4), "lots_bought")
