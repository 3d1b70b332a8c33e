"""The engine's tables made from the shared ones, in DataFrames and in SQL.

Shared tables have no transcripts, so orders stand for calls, lineitems for scored sentences and for price bars, events
for a stream of signals, conversations for turns. Words that occur in the invented texts stand for the lexicon's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import Lexicon, whole_words

LEXICON = Lexicon(
    strong=("is", "will", "and"), moderate=("with", "was"), weak=("of", "for"), uncertainty=("to", "that"),
    certainty_phrases=("the th", "on the"), hedge_phrases=("in the", "of a"), soft_phrases=("re an", "a the"), strong_weights={"will": 0.5, "and": 0.5},
)
BOILERPLATE = "licensed under|the of|and the"
CUE, REMARKS, HANDOFF, MONOLOGUE, FIRST = whole_words("the", "der", "les", "que"), 20, 40, 60, whole_words("the", "die", "des")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_discount", "l_returnflag")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("call_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.lit("").alias("company"), F.to_date("o_orderdate").alias("call_date"),
        F.lit("16:30").alias("call_time_et"), F.when(F.col("l_linestatus") == "O", "prepared").otherwise("qna").alias("section"), (F.col("l_discount") * 20 - 1).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "neutral").otherwise("high").alias("pred"), F.lit(None).cast("double").alias("sentiment"),
    )


SCORED_SQL = """
scored AS (
  SELECT o_orderkey AS call_id, 'C' || o_custkey AS ticker, o_orderdate::DATE AS call_date,
         CASE WHEN l_linestatus = 'O' THEN 'prepared' ELSE 'qna' END AS section, l_discount * 20 - 1 AS confidence,
         CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'neutral' ELSE 'high' END AS pred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CALLS_SQL = (
    SCORED_SQL
    + """,
calls AS (
  SELECT * , conf_qna - conf_prepared AS gap,
    (conf_prepared * n_prepared + conf_qna * n_qna) / (n_prepared + n_qna) AS confidence
  FROM (
    SELECT call_id, ticker, call_date,
      avg(confidence) FILTER (section = 'prepared') AS conf_prepared, avg(confidence) FILTER (section = 'qna') AS conf_qna,
      avg((pred = 'low')::INT) FILTER (section = 'prepared') AS pct_low_prepared, avg((pred = 'low')::INT) FILTER (section = 'qna') AS pct_low_qna,
      avg((pred = 'high')::INT) FILTER (section = 'prepared') AS pct_high_prepared, avg((pred = 'high')::INT) FILTER (section = 'qna') AS pct_high_qna,
      count(*) FILTER (section = 'prepared') AS n_prepared, count(*) FILTER (section = 'qna') AS n_qna
    FROM scored GROUP BY ALL)
  WHERE conf_prepared IS NOT NULL AND conf_qna IS NOT NULL)"""
)
SIGNALS_SQL = (
    CALLS_SQL
    + """,
days AS (SELECT call_date, count(*) AS n, sum(confidence) AS s, sum(confidence * confidence) AS q FROM calls GROUP BY 1),
past AS (SELECT call_date, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM days
         WINDOW w AS (ORDER BY call_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
zs AS (SELECT c.*, CASE WHEN p.n >= 20 AND (p.q - p.s * p.s / p.n) / (p.n - 1) > 1e-18
              THEN (c.confidence - p.s / p.n) / sqrt((p.q - p.s * p.s / p.n) / (p.n - 1)) END AS confidence_z
       FROM calls c LEFT JOIN past p USING (call_date)),
signals AS (SELECT *, CASE WHEN confidence_z > 0.5 THEN 'BUY' WHEN confidence_z < -0.5 THEN 'SELL' ELSE 'HOLD' END AS signal, confidence_z IS NULL AS warmup,
              confidence - lag(confidence) OVER (PARTITION BY ticker ORDER BY call_date, call_id) AS confidence_change,
              n_prepared + n_qna AS sentences FROM zs)"""
)

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = F.struct(*(x for c in _KEY for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))  # nulls last
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max_by(price, key).alias("close"), F.sum("l_quantity").alias("volume")
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).groupBy("date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))


PRICES_SQL = f"""
prices AS (
  SELECT 'S' || l_suppkey AS ticker, l_shipdate::DATE AS date,
    first(l_extendedprice / l_quantity ORDER BY {", ".join(_KEY)}) AS open, last(l_extendedprice / l_quantity ORDER BY {", ".join(_KEY)}) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL),
bench AS (SELECT date, avg(open) AS open, avg(close) AS close FROM prices GROUP BY 1)"""


def price_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call"), F.concat(F.lit("S"), (F.col("o_custkey") % 100).cast("string")).alias("ticker"), F.lit("").alias("company"), F.to_date("o_orderdate").alias("call_date"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "08:00").when(F.substring("o_orderpriority", 1, 1) == "2", F.lit(None)).otherwise("16:30").alias("call_time_et"),
        F.when(F.col("o_orderstatus") == "F", "BUY").when(F.col("o_orderstatus") == "O", "SELL").otherwise("HOLD").alias("signal"),
        F.col("o_totalprice").alias("confidence"), (F.col("o_totalprice") % 1000 / 1000).alias("gap"), (F.col("o_totalprice") % 77).alias("conf_qna"), (F.col("o_totalprice") % 13).alias("conf_prepared"),
    )


PRICE_SIGNALS_SQL = """
psignals AS (
  SELECT o_orderkey AS call, 'S' || (o_custkey % 100) AS ticker, o_orderdate::DATE AS call_date,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '08:00' WHEN '2' THEN NULL ELSE '16:30' END AS call_time_et,
    CASE o_orderstatus WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'SELL' ELSE 'HOLD' END AS signal,
    o_totalprice AS confidence, o_totalprice % 1000 / 1000 AS gap, o_totalprice % 77 AS conf_qna, o_totalprice % 13 AS conf_prepared
  FROM orders)"""
BARS_SQL = (
    PRICES_SQL
    + """,
bars AS (
  SELECT *, row_number() OVER w - 1 AS bar, count(*) OVER (PARTITION BY ticker) AS bars,
    avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS dollar_volume,
    close AS close_1, lead(close, 4) OVER w AS close_5, lead(close, 19) OVER w AS close_20, lead(close, 59) OVER w AS close_60,
    date AS date_1, lead(date, 4) OVER w AS date_5, lead(date, 19) OVER w AS date_20, lead(date, 59) OVER w AS date_60
  FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)),
bdays AS (
  SELECT date, open AS b_open, close AS b_1, lead(close, 4) OVER w AS b_5, lead(close, 19) OVER w AS b_20, lead(close, 59) OVER w AS b_60
  FROM bench WINDOW w AS (ORDER BY date))"""
)
EVENTS_SQL = (
    BARS_SQL
    + ","
    + PRICE_SIGNALS_SQL
    + """,
entries AS (
  SELECT s.*, b.date AS entry_date, b.open AS entry_price, b.* EXCLUDE (ticker, date, open)
  FROM (SELECT * FROM psignals WHERE call_time_et > '' AND call_time_et < '09:30') s ASOF JOIN (SELECT * FROM bars WHERE bars >= 30) b ON s.ticker = b.ticker AND s.call_date <= b.date
  UNION ALL
  SELECT s.*, b.date AS entry_date, b.open AS entry_price, b.* EXCLUDE (ticker, date, open)
  FROM (SELECT * FROM psignals WHERE NOT coalesce(call_time_et > '' AND call_time_et < '09:30', false)) s ASOF JOIN (SELECT * FROM bars WHERE bars >= 30) b ON s.ticker = b.ticker AND s.call_date < b.date),
events_ AS (
  SELECT e.*, date_trunc('month', entry_date)::DATE AS month, year(entry_date) AS year,
    CASE WHEN close_1 IS NOT NULL AND b_1 IS NOT NULL THEN close_1 / entry_price - 1 END AS ret_1d, CASE WHEN b_1 IS NOT NULL THEN close_1 / entry_price - b_1 / b_open END AS excess_1d,
    CASE WHEN b_5 IS NOT NULL THEN close_5 / entry_price - 1 END AS ret_5d, CASE WHEN b_5 IS NOT NULL THEN close_5 / entry_price - b_5 / b_open END AS excess_5d,
    CASE WHEN b_20 IS NOT NULL THEN close_20 / entry_price - 1 END AS ret_20d, CASE WHEN b_20 IS NOT NULL THEN close_20 / entry_price - b_20 / b_open END AS excess_20d,
    CASE WHEN b_60 IS NOT NULL THEN close_60 / entry_price - 1 END AS ret_60d, CASE WHEN b_60 IS NOT NULL THEN close_60 / entry_price - b_60 / b_open END AS excess_60d,
    CASE WHEN b_5 IS NOT NULL THEN date_5 END AS exit_date_5d
  FROM entries e JOIN bdays d ON e.entry_date = d.date
  WHERE bar >= 20 AND entry_price >= 5.0 AND dollar_volume >= 1000.0)"""
)
MIN_DOLLAR_VOLUME = 1000.0


def lot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.to_date("ts").alias("entry_date"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "error", "SELL").otherwise("HOLD").alias("signal"), (F.col("value") + 1).alias("entry_price"),
    )


def lot_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lot_events(spark, sf_dir)
    return e.groupBy("ticker", F.col("entry_date").alias("date")).agg(F.min_by("entry_price", "seq").alias("open"), F.max_by("entry_price", "seq").alias("close"), F.lit(1.0).alias("volume"))


def lot_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lot_prices(spark, sf_dir).groupBy("date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))


LOT_EVENTS_SQL = """
levents AS (
  SELECT 'U' || user_id AS ticker, ts::DATE AS entry_date, event_id AS seq, value + 1 AS entry_price,
    CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'HOLD' END AS signal FROM events),
lprices AS (SELECT ticker, entry_date AS date, first(entry_price ORDER BY seq) AS open, last(entry_price ORDER BY seq) AS close FROM levents GROUP BY ALL),
lbench AS (SELECT date, avg(open) AS open, avg(close) AS close FROM lprices GROUP BY 1),
segs AS (
  SELECT e.*, b.open AS spy_open, coalesce(sum((signal = 'SELL')::INT) OVER (PARTITION BY ticker ORDER BY entry_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS seg
  FROM levents e JOIN lbench b ON e.entry_date = b.date),
nb AS (SELECT *, least(coalesce(sum((signal = 'BUY')::INT) OVER (PARTITION BY ticker, seg ORDER BY entry_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5)::INT AS lots_before FROM segs),
states AS (SELECT *, CASE signal WHEN 'BUY' THEN lots_before < 5 WHEN 'SELL' THEN lots_before > 0 ELSE false END AS trades FROM nb),
lends AS (
  SELECT p.ticker, p.date AS end_, p.close AS end_close, b.close AS end_spy
  FROM (SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM lprices GROUP BY 1) p JOIN lbench b USING (date)
  WHERE p.date < (SELECT max(date) FROM lbench) - INTERVAL 1 DAY),
lots_ AS (
  SELECT b.ticker, b.seg, b.entry_date AS opened, b.seq AS open_seq, b.entry_price AS open_price, b.spy_open AS spy_open_price, 1000.0 / b.entry_price AS shares, 1000.0 AS cost, 1000.0 / b.spy_open AS spy_shares,
    s.seq AS close_seq, coalesce(s.entry_date, e.end_) AS closed, coalesce(s.entry_price, e.end_close) AS close_price, coalesce(s.spy_open, e.end_spy) AS spy_close_price,
    CASE WHEN s.seq IS NOT NULL THEN 'signal' WHEN e.end_ IS NOT NULL THEN 'price history ended' END AS reason
  FROM (SELECT * FROM states WHERE signal = 'BUY' AND trades) b
  LEFT JOIN (SELECT * FROM states WHERE signal = 'SELL' AND trades) s ON b.ticker = s.ticker AND b.seg = s.seg
  LEFT JOIN lends e ON b.ticker = e.ticker),
moves AS (
  SELECT opened AS date, ticker, 'BUY' AS action, 'signal' AS reason, open_price AS price, shares, -cost AS dollars, cost, spy_shares, -cost AS spy_dollars, NULL::DOUBLE AS pnl, NULL::DOUBLE AS spy_pnl, NULL::INT AS days_held, open_seq AS k, 0::BIGINT AS lot, 1 AS step FROM lots_
  UNION ALL
  SELECT closed, ticker, 'SELL', reason, close_price, -shares, shares * close_price, -cost, -spy_shares, spy_shares * spy_close_price, shares * close_price - cost, spy_shares * spy_close_price - cost,
    len(list_filter(range(0, date_diff('day', opened, closed)), lambda d: isodow(opened + d::INT) < 6))::INT, coalesce(close_seq, 9223372036854775807), open_seq, -1 FROM lots_ WHERE closed IS NOT NULL
  UNION ALL
  SELECT entry_date, ticker, CASE signal WHEN 'HOLD' THEN 'HOLD' ELSE signal || ' (no trade)' END, CASE signal WHEN 'HOLD' THEN 'hold' WHEN 'BUY' THEN 'at max lots' ELSE 'nothing held' END, entry_price, 0.0, 0.0, 0.0, 0.0, 0.0, NULL, NULL, NULL, seq, 0, 0 FROM states WHERE NOT trades),
trades_ AS (SELECT *, (sum(step) OVER (PARTITION BY ticker ORDER BY date, k, lot ROWS UNBOUNDED PRECEDING))::INT AS lots_after FROM moves),
real_ AS (SELECT * FROM trades_ WHERE action IN ('BUY', 'SELL')),
days_ AS (SELECT date, close AS spy FROM lbench WHERE date >= (SELECT min(date) FROM real_)),
spine AS (SELECT d.date, t.ticker FROM days_ d CROSS JOIN (SELECT DISTINCT ticker FROM real_) t),
held AS (
  SELECT s.date, s.ticker, greatest(sum(coalesce(m.m, 0)) OVER w, 0) AS sh, last_value(p.close IGNORE NULLS) OVER w AS cl
  FROM spine s LEFT JOIN (SELECT ticker, date, sum(shares) AS m FROM real_ GROUP BY ALL) m USING (ticker, date) LEFT JOIN lprices p USING (ticker, date)
  WINDOW w AS (PARTITION BY s.ticker ORDER BY s.date ROWS UNBOUNDED PRECEDING)),
value_ AS (SELECT date, coalesce(sum(sh * cl), 0) AS market_value, count(*) FILTER (sh > 1e-9) AS stocks_held FROM held GROUP BY 1),
flows AS (SELECT date, sum(dollars) AS dollars, sum(spy_dollars) AS spy_dollars, sum(spy_shares) AS spy_shares, sum(cost) AS cost, sum(CASE WHEN action = 'BUY' THEN cost ELSE 0 END) AS buys FROM real_ GROUP BY 1),
b1 AS (
  SELECT d.date, v.market_value, v.stocks_held, coalesce(f.buys, 0) AS buys, sum(coalesce(f.dollars, 0)) OVER w AS cash, sum(coalesce(f.spy_shares, 0)) OVER w * d.spy AS spy_value,
    sum(coalesce(f.spy_dollars, 0)) OVER w AS spy_cash, sum(coalesce(f.cost, 0)) OVER w AS cost_basis_open
  FROM days_ d JOIN value_ v USING (date) LEFT JOIN flows f USING (date) WINDOW w AS (ORDER BY d.date ROWS UNBOUNDED PRECEDING)),
b2 AS (SELECT *, market_value + cash AS pnl, spy_value + spy_cash AS spy_pnl FROM b1),
book AS (
  SELECT *, pnl - spy_pnl AS excess_pnl,
    CASE WHEN coalesce(lag(market_value) OVER w, 0) + buys > 0 THEN (pnl - coalesce(lag(pnl) OVER w, 0)) / (coalesce(lag(market_value) OVER w, 0) + buys) ELSE 0 END AS ret,
    CASE WHEN coalesce(lag(spy_value) OVER w, 0) + buys > 0 THEN (spy_pnl - coalesce(lag(spy_pnl) OVER w, 0)) / (coalesce(lag(spy_value) OVER w, 0) + buys) ELSE 0 END AS spy_ret
  FROM b2 WINDOW w AS (ORDER BY date))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "Analyst").when(F.col("role") == "system", "Operator").otherwise("Chief Executive Officer")
    speaker = F.when(F.col("role") == "user", F.concat(F.lit("Pat Q. User"), (F.col("turn") % 3).cast("string"))).when(F.col("role") == "system", "Operator").otherwise("Jo Exec")
    return c.select(F.col("conv_id").alias("call"), F.col("turn").cast("int").alias("turn"), speaker.alias("speaker"), kind.alias("role"), "text")


TURNS_SQL = r"""
turns AS (
  SELECT conv_id AS call, turn::INT AS turn, CASE role WHEN 'user' THEN 'Pat Q. User' || (turn % 3) WHEN 'system' THEN 'Operator' ELSE 'Jo Exec' END AS speaker,
    CASE role WHEN 'user' THEN 'Analyst' WHEN 'system' THEN 'Operator' ELSE 'Chief Executive Officer' END AS role, text,
    len(regexp_extract_all(text, '\S+')) AS w,
    CASE role WHEN 'system' THEN 'operator' WHEN 'user' THEN 'analyst' ELSE 'executive' END AS kind
  FROM conversations)"""
