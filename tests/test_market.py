import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from earshot.operators import events as E
from earshot.operators import inventory as I
from earshot.operators import prices as P
from earshot.operators import ranks as R
from earshot.operators import report, signals

DAY = datetime.date


def calls(spark, rows):
    return spark.createDataFrame([(t, DAY(2026, 1, d), p, q, 10, 30) for t, d, p, q in rows], "ticker string, call_date date, conf_prepared double, conf_qna double, n_prepared long, n_qna long")


def test_z_by_search(spark):
    """Each value against the mean and spread of all of strictly earlier days, once there are enough."""
    import statistics

    rng = random.Random(31)
    rows = [(DAY(2025, 3, 1) + datetime.timedelta(rng.randrange(25)), rng.choice([0.5, -0.25, rng.random()])) for _ in range(70)]
    got = signals.expanding_z(spark.createDataFrame(rows, "call_date date, confidence double"), min_history=8).collect()
    assert len(got) == 70
    for r in got:
        past = [x for d, x in rows if d < r["call_date"]]
        want = (r["confidence"] - statistics.mean(past)) / statistics.stdev(past) if len(past) >= 8 else None
        assert r["confidence_z"] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))


def test_z_of_large_means(spark):
    rng = random.Random(1)
    x = [1e9 + rng.random() for _ in range(60)]
    df = spark.createDataFrame([(DAY(2026, 1, 1) + datetime.timedelta(i), v) for i, v in enumerate(x)], "call_date date, confidence double")
    got = {r["call_date"]: r["confidence_z"] for r in signals.expanding_z(df, min_history=20).collect()}
    past = x[:50]
    m = sum(past) / 50
    sd = (sum((v - m) ** 2 for v in past) / 49) ** 0.5
    assert got[DAY(2026, 1, 1) + datetime.timedelta(50)] == pytest.approx((x[50] - m) / sd, rel=1e-3)


def test_signals_by_search(spark):
    """Signals follow the z of the weighted confidence alone, whatever the gap; changes are by ticker."""
    rng = random.Random(32)
    rows = [(t, d, rng.uniform(-1, 1), rng.uniform(-1, 1)) for t in ("KST", "RVN") for d in sorted(rng.sample(range(1, 29), 20))]
    weighted = {(t, d): (10 * p + 30 * q) / 40 for t, d, p, q in rows}
    for r in signals.make_signals(calls(spark, rows), min_history=5, buy_z=0.8, sell_z=-0.3).collect():
        t, d = r["ticker"], r["call_date"].day
        assert r["confidence"] == pytest.approx(weighted[t, d]) and r["warmup"] == (r["confidence_z"] is None)
        z = r["confidence_z"]
        assert r["signal"] == ("HOLD" if z is None or -0.3 < z < 0.8 else "BUY" if z > 0 else "SELL")
        before = [weighted[x] for x in sorted(weighted) if x[0] == t and x[1] < d][-1:]
        assert r["confidence_change"] == (pytest.approx(weighted[t, d] - before[0]) if before else None)
    assert signals.output_columns(signals.make_signals(calls(spark, rows))).columns == list(signals.OUTPUT)


def test_call_features_need_both_sections(spark):
    rows = [("a", "T", None, "prepared", 0.5, "high"), ("a", "T", None, "prepared", 0.1, "low"), ("a", "T", None, "qna", -0.2, "low"), ("b", "T", "C", "qna", 1.0, "high")]
    df = spark.createDataFrame(rows, "call_id string, ticker string, company string, section string, confidence double, pred string").withColumns({"call_date": F.lit("d"), "call_time_et": F.lit(None).cast("string"), "sentiment": F.lit(None).cast("double")})
    got = signals.call_features(df).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["company"], r["call_time_et"], r["n_prepared"], r["n_qna"], r["pct_high_prepared"], r["pct_low_qna"], r["sentiment_gap"]) == ("", "", 2, 1, 0.5, 1.0, None)
    assert r["conf_prepared"] == pytest.approx(0.3) and r["gap"] == pytest.approx(-0.5)


def business(n: int, start=DAY(2024, 1, 1)) -> list[DAY]:
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += datetime.timedelta(1)
    return out


def history(spark, n=80, drift=0.0, price=100.0, volume=1e6, ticker="T"):
    rows = [(ticker, d, price * (1 + drift) ** i, price * (1 + drift) ** i, volume) for i, d in enumerate(business(n))]
    return spark.createDataFrame(rows, "ticker string, date date, open double, close double, volume double")


def sig(spark, day, time, signal="BUY"):
    return spark.createDataFrame([("T", "", day, time, signal, 1.0, 0.0, 0.5, 0.5)], "ticker string, company string, call_date date, call_time_et string, signal string, confidence double, gap double, conf_qna double, conf_prepared double")


@pytest.mark.parametrize("day, time, entry", [((2024, 1, 18), "09:29", (2024, 1, 18)), ((2024, 1, 18), "09:30", (2024, 1, 19)), ((2024, 1, 19), None, (2024, 1, 22)), ((2024, 1, 21), "06:00", (2024, 1, 22)), ((2024, 1, 20), "", (2024, 1, 22)), ((2023, 6, 1), "20:00", (2024, 1, 1))])
def test_entry_day(spark, day, time, entry):
    got = P.asof_forward(sig(spark, DAY(*day), time), history(spark), "ticker", "call_date", "date", P.is_premarket()).first()
    assert got["bar"]["date"] == DAY(*entry)


def test_asof_by_search(spark):
    rng = random.Random(6)
    day = lambda: DAY(2024, 1, 1) + datetime.timedelta(rng.randrange(60))
    bars = sorted({(rng.choice("abc"), day()) for _ in range(50)})
    left = [(i, rng.choice("abcd"), day(), rng.random() < 0.5) for i in range(200)]
    b = spark.createDataFrame(bars, "k string, date date")
    df = spark.createDataFrame(left, "i int, k string, d date, same boolean")
    forward = {r["i"]: r["bar"] and r["bar"]["date"] for r in P.asof_forward(df, b, "k", "d", "date", F.col("same")).collect()}
    back = {r["i"]: r["bar"] and r["bar"]["date"] for r in P.asof_backward(df, b, "k", "d", "date").collect()}
    for i, k, d, same in left:
        mine = [x for y, x in bars if y == k]
        assert forward[i] == min((x for x in mine if x > d or x == d and same), default=None)
        assert back[i] == max((x for x in mine if x <= d), default=None)


def test_excess_return(spark):
    bench = history(spark, ticker="B", drift=-0.002).drop("ticker")
    got = E.event_returns(sig(spark, DAY(2024, 2, 8), "07:15"), history(spark, drift=0.003), bench).first()
    assert got["entry_date"] == DAY(2024, 2, 8) and got["excess_60d"] is None
    for h in (1, 5, 20):
        assert got[f"ret_{h}d"] == pytest.approx(1.003 ** (h - 1) - 1) and got[f"excess_{h}d"] == pytest.approx(1.003 ** (h - 1) - 0.998 ** (h - 1))
    at = lambda day, bars: E.event_returns(sig(spark, day, "07:15"), bars, bench).count()
    assert [at(DAY(2024, 2, 8), x) for x in (history(spark, price=4.9), history(spark, volume=9e3), history(spark, n=29))] == [0, 0, 0]
    assert (at(DAY(2024, 1, 26), history(spark)), at(DAY(2024, 1, 29), history(spark))) == (0, 1)  # 19 and 20 bars before


def test_spread_by_months(spark):
    import statistics

    rng = random.Random(33)
    rows = [(DAY(2023, rng.randint(1, 9), 1), rng.gauss(0, 1), rng.choice("LSN")) for _ in range(80)]
    rows = [r for r in rows if not (r[0].month == 4 and r[2] == "S")]  # a month without a short side
    df = spark.createDataFrame(rows, "month date, x double, side string")
    got = E.clustered_spread(df, "x", F.col("side") == "L", F.col("side") == "S").first()
    of = lambda m, side: [x for d, x, s in rows if d.month == m and s == side]
    spreads = [statistics.mean(of(m, "L")) - statistics.mean(of(m, "S")) for m in range(1, 10) if of(m, "L") and of(m, "S")]
    assert got["months"] == len(spreads) and got["spread"] == pytest.approx(statistics.mean(spreads))
    assert got["t_stat"] == pytest.approx(statistics.mean(spreads) / (statistics.stdev(spreads) / len(spreads) ** 0.5))
    two = E.clustered_spread(df.filter("month < '2023-03-01'"), "x", F.col("side") == "L", F.col("side") == "S").first()
    assert (two["months"], two["spread"], two["t_stat"]) == (2, None, None)


def test_ranks_and_quantiles_by_sorting(spark):
    import numpy as np

    rng = random.Random(34)
    rows = [(g, rng.choice([rng.random(), 0.5, -1.0, float(rng.randrange(9))])) for g in ("a", "b", "c") for _ in range({"a": 700, "b": 1, "c": 42}[g])]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    for r in R.quantiles(df, "x", shares, ["g"]).collect():
        assert [r[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile([x for g, x in rows if g == r["g"]], shares).tolist())
    whole = R.quantiles(df, "x", shares).first()
    assert [whole[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile([x for _, x in rows], shares).tolist())
    for r in R.average_ranks(df, "x", "rank", ["g"]).collect():
        mine = [x for g, x in rows if g == r["g"]]
        assert r["rank"] == sum(x < r["x"] for x in mine) + (sum(x == r["x"] for x in mine) + 1) / 2
    assert R.quantiles(df.limit(0), "x", [0.5]).first()["q0"] is None


@pytest.mark.parametrize("n", [24, 25, 26, 33, 101])
def test_quintiles(spark, n):
    import pandas as pd

    df = spark.createDataFrame([("T", DAY(2024, q, 1), float(g + 100 * q), g) for q in (1, 4) for g in range(n)], "ticker string, call_date date, gap double, i int")
    got = [r["q_gap"] for r in E.with_quintiles(df, "gap").orderBy("gap").collect()]
    if n < 25:
        assert set(got) == {None}
    else:
        assert got == 2 * (pd.qcut(pd.Series(range(n)).rank(method="first"), 5, labels=False) + 1).tolist()


def test_rank_ic_and_summary(spark):
    import pandas as pd

    rng = random.Random(2)
    rows = [("T", DAY(2024, 1 + i % 9, 1 + i % 28), DAY(2024, 1 + i % 9, 1), 2024, rng.choice(E.ORDER), float(rng.randrange(6)), rng.random(), 1.0 * i, float(rng.randrange(4)), rng.gauss(0, 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "ticker string, call_date date, month date, year int, signal string, confidence double, gap double, conf_qna double, conf_prepared double, excess_5d double").withColumns({"entry_date": F.col("call_date"), "excess_1d": F.lit(None).cast("double")})
    pdf = pd.DataFrame(rows).iloc[:, [5, 6, 7, 8, 9]].rank()
    got = {r["feature"]: (r["n"], r["spearman"]) for r in E.rank_ic(df, "excess_5d").collect()}
    for k, f in enumerate(E.FEATURES):
        assert got[f] == (240, pytest.approx(pdf.iloc[:, k].corr(pdf.iloc[:, 4])))
    s = E.summarize(df, (1, 5))
    assert "1d" not in s and s["events"] == 240 and set(s["5d"]) == {"by_signal", "buy_minus_sell", "quintiles_confidence", "quintiles_gap", "rank_ic", "by_year"}
    assert s["5d"]["buy_minus_sell"]["months"] == 9 and 0 <= s["5d"]["buy_minus_sell"]["p_value"] <= 1 and s["5d"]["by_year"][2024]["n"] == 240


def fold(events: list[tuple], cap: int = 5):
    """The lots of each ticker, one event after another."""
    held, out = defaultdict(int), []
    for t, _, seq, s in sorted(events, key=lambda e: (e[1], e[2])):
        before = held[t]
        trades = s == "BUY" and before < cap or s == "SELL" and before > 0
        held[t] = before + 1 if s == "BUY" and trades else 0 if s == "SELL" else before
        out.append((t, seq, before, trades, held[t]))
    return sorted(out)


def test_lot_states_by_fold(spark):
    rng = random.Random(8)
    ev = [(f"T{rng.randrange(40)}", DAY(2024, 1, 1 + rng.randrange(28)), i, rng.choices(["BUY", "SELL", "HOLD"], [6, 1, 2])[0]) for i in range(1200)]
    df = spark.createDataFrame(ev, "ticker string, d date, seq int, signal string")
    got = sorted((r["ticker"], r["seq"], r["lots_before"], r["trades"], r["lots_after"]) for r in I.lot_states(df, ["d", "seq"]).collect())
    assert got == fold(ev)


def lot_case(spark, signals_, n=80, drift=0.01, bench_drift=None, prices_n=None):
    ev = spark.createDataFrame([(t, d, i, s, 100.0 * (1 + drift) ** business(n).index(d)) for i, (t, d, s) in enumerate(signals_)], "ticker string, entry_date date, seq int, signal string, entry_price double")
    prices = None
    for t in sorted({t for t, _, _ in signals_}):
        h = history(spark, prices_n or n, drift, ticker=t)
        prices = h if prices is None else prices.unionByName(h)
    bench = history(spark, n, drift if bench_drift is None else bench_drift, ticker="B").drop("ticker")
    return ev, prices, bench


def test_sell_closes_all_lots(spark):
    days = business(60)
    args = lot_case(spark, [("T", days[3], "BUY"), ("T", days[10], "BUY"), ("T", days[12], "BUY"), ("T", days[31], "SELL")], n=60, drift=-0.004, bench_drift=0.0)
    log = I.trade_log(*args).orderBy("date", F.desc("lots_after")).collect()
    assert [(r["action"], r["lots_after"], r["days_held"]) for r in log] == [("BUY", 1, None), ("BUY", 2, None), ("BUY", 3, None), ("SELL", 2, 28), ("SELL", 1, 21), ("SELL", 0, 19)]
    assert [r["pnl"] for r in log[3:]] == [pytest.approx(1000 * (0.996**k - 1)) for k in (28, 21, 19)] and all(r["spy_pnl"] == pytest.approx(0) for r in log[3:])
    assert I.lots(*args).filter("closed is null").count() == 0


def test_nothing_held_and_cap(spark):
    days = business(40)
    log = I.trade_log(*lot_case(spark, [("T", days[2], "HOLD"), ("T", days[7], "SELL"), ("U", days[9], "SELL")])).orderBy("date").collect()
    assert [(r["action"], r["reason"], r["shares"]) for r in log] == [("HOLD", "hold", 0.0), ("SELL (no trade)", "nothing held", 0.0), ("SELL (no trade)", "nothing held", 0.0)]
    args = lot_case(spark, [("T", d, "BUY") for d in days[5:13]])
    log = I.trade_log(*args).orderBy("date").collect()
    assert [r["action"] for r in log] == ["BUY"] * 5 + ["BUY (no trade)"] * 3 and I.holdings(I.lots(*args), *args[1:]).first()["lots"] == 5


def test_history_that_ends(spark):
    args = lot_case(spark, [("T", DAY(2024, 2, 1), "BUY")], prices_n=40)
    last = I.trade_log(*args).orderBy(F.desc("date")).first()
    assert (last["action"], last["reason"], last["date"]) == ("SELL", "price history ended", business(40)[-1])


def test_book_reconciles(spark):
    days = business(60)
    flow = [("A", days[21], "BUY"), ("B", days[22], "BUY"), ("A", days[30], "BUY"), ("A", days[41], "SELL"), ("B", days[45], "BUY"), ("A", days[50], "BUY")]
    ev, prices, bench = lot_case(spark, flow, bench_drift=0.004)
    log, lots = I.trade_log(ev, prices, bench).cache(), I.lots(ev, prices, bench)
    book = I.daily_book(log, prices, bench).cache()
    held = I.holdings(lots, prices, bench)
    last = book.orderBy(F.desc("date")).first()
    done = log.agg(F.sum("pnl").alias("p"), F.sum("spy_pnl").alias("s")).first()
    rest = held.agg(F.sum("unrealized_pnl").alias("p"), F.sum("spy_unrealized_pnl").alias("s")).first()
    assert last["pnl"] == pytest.approx(done["p"] + rest["p"]) and last["spy_pnl"] == pytest.approx(done["s"] + rest["s"])
    s = I.summarize(log, book, held)
    assert s["lots_bought"] == 5 and s["lots_sold"] == 2 and s["sell_exits"] == 1 and s["max_capital_deployed"] == 3000.0 and s["total_pnl"] == round(last["pnl"], 2) and set(s["by_year"]) == {2024}
    same = I.daily_book(I.trade_log(*lot_case(spark, flow)), *lot_case(spark, flow)[1:])
    assert same.filter("abs(excess_pnl) > 1e-6").count() == 0


def test_book_by_loops_without_days_times_tickers(spark):
    """Prices that begin late, have gaps or none at all; lots sold whole, on days of the benchmark only."""
    rng, days = random.Random(12), business(50)
    trades, prices = [], []
    for t in "ABCD":
        held = 0.0
        for d in sorted(rng.sample(days[3:], 8)):
            sell = held > 0 and rng.random() < 0.5
            trades.append((d, t, "SELL" if sell else "BUY", -held if sell else 7.3, 1.0))
            held = 0.0 if sell else held + 7.3
        prices += [(t, d, rng.uniform(1, 9)) for d in days if t != "D" and rng.random() < 0.6]
    trades.append((days[0] - datetime.timedelta(2), "A", "HOLD", 5.0, 1.0))
    log = spark.createDataFrame(trades, "date date, ticker string, action string, shares double, x double").selectExpr("*", "-x AS dollars", "-x AS spy_dollars", "x AS spy_shares", "x AS cost")
    bench = spark.createDataFrame([(d, 10.0, 10.0) for d in days], "date date, open double, close double")
    book = I.daily_book(log, spark.createDataFrame(prices, "ticker string, date date, close double"), bench)
    plan = book._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    first = min(d for d, _, a, _, _ in trades if a != "HOLD")
    got = {r["date"]: (r["market_value"], r["stocks_held"]) for r in book.collect()}
    assert sorted(got) == [d for d in days if d >= first]
    for day in got:
        value = n = 0
        for t in "ABCD":
            sh = max(0.0, sum(s for d, k, a, s, _ in trades if k == t and a != "HOLD" and d <= day))
            cl = [c for k, d, c in sorted(prices) if k == t and first <= d <= day]
            value, n = value + (sh * cl[-1] if cl else 0), n + (sh > 1e-9)
        assert got[day] == (pytest.approx(value, abs=1e-6), n)


def test_quintiles_of_equal_values_go_by_order(spark):
    rng = random.Random(2)
    rows = [(f"T{rng.randrange(99)}", DAY(2024, rng.choice([1, 5]), 1 + i % 28), rng.choice([0.0, 0.0, 1.5, None, rng.random()]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "ticker string, call_date date, gap double, i int")
    got = {r["i"]: r["q_gap"] for r in E.with_quintiles(df, "gap", ("ticker", "call_date", "i")).collect()}
    for half in (1, 5):
        mine = sorted((r for r in rows if r[1].month == half), key=lambda r: (r[2] is not None, r[2] or 0.0, r[0], r[1], r[3]))
        assert [got[r[3]] for r in mine] == [max(1, -(-5 * k // (len(mine) - 1))) for k in range(len(mine))]
    assert len(got) == 400 and E.with_quintiles(df.limit(0), "gap").count() == 0


def test_asof_of_a_hot_key_numbers_days_not_rows(spark):
    """5,000 rows of one key on 20 days: the window has one row a day and bar, and every row gets its bar."""
    left = spark.range(5000).selectExpr("'H' AS k", "date_add(date'2024-01-01', cast(id % 20 AS int)) AS d", "id AS i")
    bars = spark.range(5).selectExpr("'H' AS k", "date_add(date'2024-01-03', cast(id * 4 AS int)) AS date", "id AS n")
    for r in P.asof_backward(left, bars, "k", "d", "date").collect():
        day = r["i"] % 20
        assert (r["bar"] and r["bar"]["n"]) == (None if day < 2 else min(4, (day - 2) // 4))
    odd = spark.createDataFrame([("H", None, 1), (None, DAY(2024, 1, 9), 2)], "k string, d date, i int")
    assert {r["i"]: r["bar"] for r in P.asof_forward(odd.filter("i = 2"), bars, "k", "d", "date", F.lit(True)).collect()} == {2: None}
    assert P.asof_backward(odd, bars, "k", "d", "date").count() == 2


def test_business_days(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(DAY(2020, 1, 1) + datetime.timedelta(rng.randrange(2000)), DAY(2020, 1, 1) + datetime.timedelta(rng.randrange(2000))) for _ in range(300)] + [(DAY(2024, 1, 1), DAY(2024, 1, 1))]
    for r in spark.createDataFrame(rows, "a date, b date").withColumn("n", I.business_days(F.col("a"), F.col("b"))).collect():
        assert r["n"] == max(0, int(np.busday_count(r["a"], r["b"])))


def test_reports(spark):
    rows = [(f"T{i % 4}", DAY(2024, 1, 1) + datetime.timedelta(3 * i), ["BUY", "SELL", "HOLD"][i % 3], 0.01 * i, (i - 60) / 12, i < 10) for i in range(120)]
    df = spark.createDataFrame(rows, "ticker string, call_date date, signal string, confidence double, confidence_z double, warmup boolean")
    got = signals.latest(df, 45, 3).collect()
    assert [r["signal"] for r in got] == ["BUY"] * 3 + ["SELL"] * 3 and got[0]["confidence_z"] == max(r["confidence_z"] for r in got if r["signal"] == "BUY")
    h = report.z_histogram(df).groupBy("signal").agg(F.sum("share").alias("s"), F.max("bin").alias("b"), F.min("bin").alias("a")).collect()
    assert all(r["s"] == pytest.approx(1) and r["b"] == 80 and r["a"] == 1 for r in h)
    assert [r["ticker"] for r in report.chart_tickers(df, ["T2", "none"], most=3).orderBy("pos").collect()] == ["T2", "T0", "T1"]
    q = report.quarter_index(df, 25).orderBy("quarter").collect()
    assert len(q) == 4 and q[0]["calls"] == 31


def test_price_coverage(spark):
    wanted = spark.createDataFrame([("T", False), ("NEW", True), ("GONE", False)], "ticker string, listed_later boolean")
    late = history(spark, 30, ticker="NEW").withColumn("date", F.date_add("date", 60))
    prices = history(spark).unionByName(late)
    assert [r[0] for r in P.to_fetch(prices, wanted, "2024-01-01").collect()] == ["GONE"]
    assert {r[0] for r in P.to_fetch(prices, wanted.drop("listed_later"), "2024-01-01").collect()} == {"GONE", "NEW"}


def test_ranges_are_the_same_each_time_they_are_made(spark):
    n = 120_000
    counts = spark.range(0, n, 1, 3).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"), F.lit("g").alias("g"), F.lit(1).alias("w"))
    mixed = counts.mapInPandas(lambda parts: (x.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 32)) for x in parts), counts.schema)  # as rows come from other machines: in another order each time
    kept = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    try:
        assert R.bounds(mixed, "v", ["g"]).first() == R.bounds(mixed.repartition(5), "v", ["g"]).first()
        assert R.with_before(mixed, "v", ["w"], ["g"]).filter("w_before <> v").count() == 0
        assert R.with_before(mixed.drop("g"), "v", ["w"], []).filter("w_before <> v").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_ranges_of_a_group_without_values(spark):
    counts = spark.createDataFrame([("a", None, 2), ("b", None, 3), ("b", 1.0, 4), ("b", 2.0, 5)], "g string, v double, w int")
    assert {(r["g"], r["v"]): r["w_before"] for r in R.with_before(counts, "v", ["w"], ["g"]).collect()} == {("a", None): 0, ("b", None): 0, ("b", 1.0): 3, ("b", 2.0): 7}


def test_quintile_means_of_rows_in_another_order_each_time(spark):
    n = 300_000
    rows = spark.range(0, n, 1, 2).select(F.lit("T").alias("ticker"), F.lit("2024-02-01").alias("call_date"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("x"))
    mixed = rows.mapInPandas(lambda parts: (x.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 32)) for x in parts), rows.schema)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for k, v in zip(kept, ("false", str(n), "1")):
        spark.conf.set(k, v)
    try:
        got = {r["quintile"]: (r["n"], r["mean"]) for r in E.quintile_means(E.with_quintiles(mixed, "x"), "x", "x").collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    fifths = {}
    for i in range(n):
        fifths.setdefault(max(1, -(-5 * i // (n - 1))), []).append(i)
    assert got == {q: (len(v), pytest.approx(sum(v) / len(v))) for q, v in fifths.items()}
