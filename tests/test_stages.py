import datetime
import gzip
import hashlib
import json
import random

from earshot import config
from earshot.plans import stages
from earshot.sources import crawl

GOOD = ["We are confident in our growth this year and delivered.", "Margins will definitely expand again in the coming quarter.", "We remain on track for our targets in every region."]
BAD = ["It may be unclear how demand could develop from here.", "Perhaps volumes might soften and that is hard to predict.", "We are cautious as the risk of delays could increase."]
PLAIN = ["Revenue was ten billion dollars in the last quarter.", "Cost of sales came to four billion dollars in total.", "The tax rate was eighteen percent for the period."]


def page(day: datetime.date, prepared: list[str], answers: list[str]) -> str:
    """Two speak first, the second in two turns of which one runs over several paragraphs; a guest's name is in bold only."""
    half = len(prepared) // 2
    said = lambda who, role, texts: f"<p><strong>{who}</strong> -- <em>{role}</em></p>" + "".join(f"<p>{t}</p>" for t in texts)
    body = "".join([
        f"<h1>Works update</h1><p>The call was held on {day:%b} {day.day}, {day.year} at 6:05 a.m.</p>", "<h2>Prepared Remarks</h2>", said("Operator", "", ["Good day to you all."]),
        said("Ragna Holt", "Head of Works", [" ".join(prepared[:half])]), said("Ivar Lie", "Treasurer", prepared[half:]), "<h2>Questions and answers</h2>",
        "<p><strong>Sol Aune</strong> -- Analyst</p><p>What do you expect?</p>", said("Ivar Lie", "Treasurer", answers[:1]), said("Ragna Holt", "Head of Works", answers[1:]), "<h2>Call participants</h2><p>Ragna Holt</p>",
    ])
    return f"<html><body><header>Wire</header><div class='main article-body'>{body}</div></body></html>"


def test_from_pages_to_evaluation(spark, tmp_path):
    rng = random.Random(4)
    data, records, seq = tmp_path / "data", [], 0
    tickers = ["AAA", "BBB", "CCC", "DDD"]
    for t in tickers:
        for k in range(14):
            day = datetime.date(2022, 1, 10) + datetime.timedelta(60 * k + rng.randrange(5))
            pool = rng.choice([GOOD + PLAIN, BAD + PLAIN, GOOD + BAD])
            text = lambda: [f"{rng.choice(pool)}" for _ in range(6)]
            url = f"https://example.com/{t}/{k}"
            h = hashlib.sha1(url.encode()).hexdigest()
            f = data / "raw" / "pages" / h[:2] / f"{h}.html.gz"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(gzip.compress(page(day, text(), text()).encode()))
            seq += 1
            records.append((seq, url, str(day), "ok", t, f"{t} Inc", "", "Q1 2022", f"pages/{h[:2]}/{h}.html.gz"))
    records.append((seq + 1, "https://example.com/none", "2022-01-01", "missing", None, None, None, None, None))
    df = spark.createDataFrame(records, "seq long, url string, published string, status string, ticker string, company string, title string, fiscal_quarter string, file string")
    crawl.append_index(df, str(data / "raw" / "index"))
    days = [d for d in (datetime.date(2021, 10, 1) + datetime.timedelta(i) for i in range(1200)) if d.weekday() < 5]
    price = {t: 50.0 for t in [*tickers, "SPY"]}
    rows = []
    for d in days:
        for t in price:
            price[t] *= 1 + rng.gauss(0.0004, 0.01)
            rows.append((t, d, price[t], price[t] * (1 + rng.gauss(0, 0.003)), 1e6))
    spark.createDataFrame(rows, "ticker string, date date, open double, close double, volume double").write.parquet(str(tmp_path / "prices"))
    settings = {"data": str(data), "results": str(tmp_path / "results"), "prices": str(tmp_path / "prices"), "parse": {"min_section_words": 20}, "train": {"features": 1024}, "signals": {"min_history": 8}}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    cfg = config.load(str(tmp_path / "c.json"))

    parsed = stages.parse(spark, cfg).first()
    assert (parsed["pages"], parsed["calls"], parsed["tickers"], parsed["both_share"]) == (56, 56, 4, 1.0)
    counts = {r["label"]: r["sentences"] for r in stages.label(spark, cfg).collect()}
    assert {"low", "high", "neutral"} <= set(counts) and sum(counts.values()) > 400
    metrics = stages.train(spark, cfg)
    assert metrics["test"]["accuracy"] > 0.95 and metrics["val"]["n"] > 0
    assert stages.score(spark, cfg).first()["calls"] == 56
    made = {r["signal"]: r["n"] for r in stages.make_signals(spark, cfg).collect()}
    assert sum(made.values()) == 56 and made["BUY"] > 3 and made["SELL"] > 3
    out = stages.backtest(spark, cfg)
    assert out["events"]["events"] > 30 and "5d" in out["events"] and out["inventory"]["lots_bought"] > 0
    assert json.loads((tmp_path / "results" / "evaluation.json").read_text())["inventory"]["total_pnl"] == out["inventory"]["total_pnl"]


def test_sitemap_cache(spark):
    wanted = crawl.months(spark, "2024-01", "2024-04")
    cached = spark.createDataFrame([(datetime.date(2024, 1, 1),), (datetime.date(2024, 4, 1),)], "month date")
    got = [r["month"] for r in crawl.sitemaps_to_fetch(wanted, cached, datetime.date(2024, 4, 9)).orderBy("month").collect()]
    assert got == [datetime.date(2024, 2, 1), datetime.date(2024, 3, 1), datetime.date(2024, 4, 1)]


def test_config():
    assert config.load().signals.min_history == 20 and config.load().backtest.horizons == (1, 5, 20, 60)
