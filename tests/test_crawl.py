import datetime
import io
import urllib.error

import pytest
from pyspark.sql import functions as F

from earshot import config
from earshot.operators.scoring import python_scorer
from earshot.plans import stages
from earshot.sources import crawl, prices


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def opener(codes):
    def open_(url, timeout):
        code = codes.pop(0)
        if code == 200:
            return io.BytesIO(b"body")
        raise urllib.error.HTTPError(url, code, "", {}, None) if code else OSError()

    return open_


@pytest.mark.parametrize("codes, want, paused", [([200], "ok", 0), ([410], "missing", 0), ([0, 200], "ok", 5), ([500, 0, 200], "ok", 15), ([502] * 4, "error", 75), ([429, 200], "ok", 30), ([403, 503, 404], "missing", 90)])
def test_fetch(codes, want, paused):
    clock = Clock()
    status, body = crawl.fetch("u", crawl.Limiter(1.0, clock=clock, sleep=clock.sleep), open_=opener(list(codes)), sleep=clock.sleep)
    assert (status, body) == (want, b"body" if want == "ok" else None) and clock.now - 1000 == pytest.approx(paused, abs=3)


def test_a_throttled_worker_holds_all(tmp_path):
    clock = Clock()
    one, two = (crawl.Limiter(2.0, str(tmp_path / "p"), clock, clock.sleep) for _ in range(2))
    for _ in range(3):
        one.wait()
    assert clock.now == 1004
    crawl.fetch("u", one, open_=opener([429, 404]), sleep=lambda s: None)
    began = clock.now
    two.penalize(0.0)
    two.wait()
    assert clock.now >= 1034 and clock.now >= began
    (tmp_path / "p" / "torn.until").write_text("")
    two.wait()


SITE = {"https://s.org/2024/01": "<loc>https://s.org/t/2024/01/05/a</loc> <loc>https://s.org/t/2024/01/09/b</loc>", "https://s.org/2024/02": "<loc>https://s.org/t/2024/02/01/c</loc><loc>https://s.org/t/2024/02/02/d</loc><loc>https://s.org/t/2024/02/02/e</loc>"}
PAGES = {"a": "KST", "b": "RVN", "c": "KST", "d": None}


def test_crawl_resumes_filters_and_stores_each_batch(spark, tmp_path):
    cfg = config.load()
    cfg.data, cfg.scrape.start_month, cfg.scrape.batch, cfg.scrape.tickers = str(tmp_path), "2024-01", 2, ["kst"]
    cfg.scrape.sitemap_url, cfg.scrape.url_pattern = "https://s.org/{year}/{month:02d}", r"https://s\.org/t/(\d{4})/(\d{2})/(\d{2})/[^<\s]+"
    asked: list[list[str]] = []
    stop_at = [3]

    def fetched(urls):
        asked.append(urls)
        if len(asked) == stop_at[0]:
            raise KeyboardInterrupt
        rows = []
        for u in urls:
            name = u.rsplit("/", 1)[1]
            if u in SITE:
                rows.append((u, "ok", SITE[u].encode()))
            elif name == "e":
                rows.append((u, "error", None))
            else:
                head = f"<meta name=primary_tickers content='{PAGES[name]}'>" if PAGES[name] else ""
                rows.append((u, "ok", f"{head}<div class='{'article-body' if PAGES[name] else 'x'}'>{name}</div>".encode()))
        return spark.createDataFrame(rows, "url string, status string, body binary")

    today = datetime.date(2024, 2, 20)
    with pytest.raises(KeyboardInterrupt):
        stages.scrape(spark, cfg, today, fetched)
    assert [[u.rsplit("/", 1)[1] for u in x] for x in asked] == [["01", "02"], ["d", "e"], ["c", "b"]]
    stop_at[0] = 0
    counts = {r["status"]: r["n"] for r in stages.scrape(spark, cfg, today, fetched).collect()}
    assert counts == {"ok": 2, "skipped": 1, "error": 1}  # d is missing, and final; e is asked for again
    log = f"{tmp_path}/raw/fetched"
    index = {r["url"][-1]: (r["status"], r["ticker"]) for r in crawl.latest_records(crawl.read_batches(spark, log)).collect()}
    assert index == {"a": ("ok", "KST"), "c": ("ok", "KST"), "d": ("missing", ""), "e": ("error", "")}
    assert [len(x) for x in asked[3:]] == [1, 2, 2] and asked[3] == ["https://s.org/2024/02"]
    bodies = lambda: sorted(r["url"][-1] for r in crawl.read_batches(spark, log).filter("body is not null").collect())
    assert bodies() == ["a", "c"]
    # A run that stopped while it wrote: files of a batch without Spark's mark. It is neither read nor kept.
    last = crawl.committed_batches(spark, log)[-1]
    crawl.read_batches(spark, log).limit(1).drop("batch").write.parquet(f"{log}/batch={last + 1}")
    (tmp_path / "raw" / "fetched" / f"batch={last + 1}" / "_SUCCESS").unlink()
    assert crawl.committed_batches(spark, log)[-1] == last and bodies() == ["a", "c"]
    cfg.scrape.tickers = []
    assert {r["status"]: r["n"] for r in stages.scrape(spark, cfg, today, fetched).collect()} == {"ok": 1, "error": 1}  # b and e
    assert bodies() == ["a", "b", "c"] and crawl.committed_batches(spark, log)[-1] == last + 1
    seen = [r["seq"] for r in crawl.read_batches(spark, log).collect()]
    assert len(set(seen)) == len(seen)
    parsed = stages.parse(spark, cfg).first()
    assert (parsed["pages"], parsed["calls"]) == (3, 0)  # all are read, none is a call


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    """A record and its page are one row: a batch that breaks off has neither, and the next run asks for it again."""
    schema, path = "seq long, url string, published string, status string, ticker string, company string, title string, fiscal_quarter string, file string, error string, body binary", f"{tmp_path}/f"
    rows = [(i, f"u{i}", "2024-01-01", ("ok", "missing", "error", "skipped")[i % 4], "T", None, None, None, f"f{i}", None, b"x") for i in range(8)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    with pytest.raises(Exception, match="stopped"):
        crawl.write_batch(df.withColumn("error", F.when(F.col("seq") == 5, F.raise_error(F.lit("stopped"))).otherwise(F.col("error"))), path, 0)
    assert crawl.committed_batches(spark, path) == [] and crawl.read_batches(spark, path).count() == 0
    crawl.write_batch(df, path, 0)
    got = crawl.read_batches(spark, path).collect()
    assert sorted((r["url"], r["status"], r["body"] is not None, r["batch"]) for r in got) == [(f"u{i}", r[3], r[3] == "ok", 0) for i, r in enumerate(rows) if r[3] != "skipped"]


def test_price_store(spark, tmp_path):
    asked: list[list[str]] = []
    fails = [2]

    def download(symbols, start):
        asked.append(symbols)
        if "BRK-B" in symbols and fails[0]:
            fails[0] -= 1
            raise TimeoutError
        first = {"A": "2020-01-03", "BRK-B": "2020-01-02", "NEW": "2021-06-01"}
        rows = [(s, datetime.date.fromisoformat(first[s]), 1.0, 2.0, 3.0) for s in symbols if s in first] + [(s, datetime.date(2022, 1, 1), None, 1.0, 1.0) for s in symbols]
        return spark.createDataFrame(rows, prices.BARS)

    wanted = spark.createDataFrame([(t,) for t in ("A", "BRK.B", "NEW", "GONE", "A")], "ticker string")
    waits: list[float] = []
    run = lambda start="2020-01-01": prices.update(spark, wanted, start, str(tmp_path / "p"), download, batch=2, pause=4.0, sleep=waits.append)
    assert run() == {"ok": 2, "listed_later": 1, "missing": 1} and waits == [4.0, 8.0]
    assert asked == [["A", "BRK-B"]] * 3 + [["GONE", "NEW"]]
    assert {r["ticker"] for r in prices.read_bars(spark, str(tmp_path / "p")).collect()} == {"A", "BRK.B", "NEW"}
    assert run() == {} and len(asked) == 4
    assert run("2019-01-01") == {"listed_later": 2} and asked[4:] == [["A", "BRK-B"]]  # begin too late for this start; NEW is known to
    assert prices.read_bars(spark, str(tmp_path / "p")).count() == 3
    fails[0] = 9
    assert run("2018-01-01") == {}
    more = spark.createDataFrame([("BRK/B",)], "ticker string")
    assert prices.update(spark, more, "2018-01-01", str(tmp_path / "p"), download, sleep=waits.append) == {"failed": 1}


def test_python_scorer_sorts_by_length_and_keeps_rows(spark):
    def load():
        import numpy as np

        def model(texts):
            assert [len(t) for t in texts] == sorted(len(t) for t in texts) and len(texts) <= 7
            return np.array([[len(t), 0.5, -len(t)] for t in texts], float)

        return model

    df = spark.range(300).select(F.expr("repeat('x', cast(pmod(id * 37, 50) as int))").alias("sentence"), "id")
    got = python_scorer(load, 7)(df).collect()
    assert len(got) == 300 and all((r["p_low"], r["p_neutral"], r["p_high"]) == (len(r["sentence"]), 0.5, -len(r["sentence"])) for r in got)
