"""Crawl bookkeeping: months and sitemaps, the index of fetched pages, and what is left to fetch."""

from __future__ import annotations

import datetime
import itertools
import pathlib
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from earshot.sources.tables import store_of

INDEX = "seq long, url string, published string, status string, ticker string, company string, title string, fiscal_quarter string, file string, error string"


FETCHED = f"{INDEX}, body binary"


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches in path that were written to the end, in order."""
    p, store = store_of(spark, path)
    found = store.listStatus(p) if store.exists(p) else []
    names = [f.getPath().getName() for f in found if f.getPath().getName().startswith("batch=")]
    return sorted(int(n.removeprefix("batch=")) for n in names if store.exists(store_of(spark, f"{path}/{n}/_SUCCESS")[0]))


def write_batch(records: DataFrame, path: str, number: int) -> None:
    """Records of status ok, missing or error with their bodies, all or none: a batch counts once Spark has marked it
    complete. What a stopped run left under this number is written over. Skipped records are never logged."""
    kept = records.filter(F.col("status").isin("ok", "missing", "error"))
    kept.withColumn("body", F.when(F.col("status") == "ok", F.col("body"))).write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, FETCHED) of the batches written to the end. A record and its page are one row, so neither is there without the other."""
    schema = f"{FETCHED}, batch long"
    whole = [f"{path}/batch={n}" for n in committed_batches(spark, path)]
    return spark.read.schema(schema).option("basePath", path).parquet(*whole) if whole else spark.createDataFrame([], schema)


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(month): first days of all months from start to end (YYYY-MM), both included; none if end is earlier."""
    one = spark.range(1).select(F.to_date(F.lit(f"{start}-01")).alias("a"), F.to_date(F.lit(f"{end}-01")).alias("b")).filter("a <= b")
    return one.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


def sitemaps_to_fetch(wanted: DataFrame, cached: DataFrame, today: datetime.date) -> DataFrame:
    """Months of wanted without a cached sitemap, and always the current one."""
    done = cached.select("month").distinct().filter(F.col("month") < F.trunc(F.lit(today), "month"))
    return wanted.join(done, "month", "left_anti")


def discover(sitemaps: DataFrame, pattern: str, xml_col: str = "xml", order: str = "seq") -> DataFrame:
    """(url, published) of all URLs in sitemaps that match pattern, whose groups 1 to 3 are year, month and day; the first sight counts."""
    found = sitemaps.select(F.col(order).alias("_o"), F.posexplode(F.regexp_extract_all(xml_col, F.lit(pattern), 0)).alias("_p", "url"))
    first = found.groupBy("url").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return first.select("url", F.concat_ws("-", *(F.regexp_extract("url", pattern, i) for i in (1, 2, 3))).alias("published"), F.col("_at._o").alias("_o"), F.col("_at._p").alias("_p")).orderBy("_o", "_p").select("url", "published")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The appended JSON lines of the index; seq orders them."""
    return spark.read.schema(INDEX).json(path)


def latest_records(index: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The last record of each key, with first_seq, where the key was first seen (the order of ties later on)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return index.withColumns({"_rn": F.row_number().over(w), "first_seq": F.min(order).over(Window.partitionBy(key))}).filter("_rn = 1").drop("_rn")


def pending(urls: DataFrame, index: DataFrame) -> DataFrame:
    """urls (url, published) to fetch, newest first: those without a record or with one of status error. missing is final."""
    done = latest_records(index).filter("status <> 'error'").select("url")
    return urls.join(done, "url", "left_anti").orderBy(F.desc("published"), "url")


def only_tickers(records: DataFrame, tickers: list[str] | None) -> DataFrame:
    """records with status skipped in place of ok for tickers that aren't wanted; None or none named: all are.

    A ticker is known only once the page is read, so this comes after extraction. Skipped pages are neither stored nor
    logged, so a later crawl without the filter fetches them.
    """
    if not tickers:
        return records
    unwanted = (F.col("status") == "ok") & ~F.coalesce(F.upper("ticker").isin([t.upper() for t in tickers]), F.lit(False))
    return records.withColumn("status", F.when(unwanted, F.lit("skipped")).otherwise(F.col("status")))


def append_index(records: DataFrame, path: str) -> None:
    """Appends records of status ok, missing or error; skipped ones are never logged."""
    records.filter(F.col("status").isin("ok", "missing", "error")).write.mode("append").json(path)


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


class Limiter:
    """Seconds between a worker's requests, shared with the other workers through a folder.

    A worker that is throttled writes until when all are to wait into a file of its own; before each request every worker
    waits for the latest of these. Without a folder, or where it can't be read, a worker knows its own pauses only.
    """

    def __init__(self, interval: float, folder: str = "", clock=time.time, sleep=time.sleep):
        self.interval, self.folder, self.clock, self.sleep = interval, folder, clock, sleep
        self.next_at, self.name = 0.0, f"{uuid.uuid4().hex}.until"

    def _until(self) -> float:
        latest = 0.0
        try:
            for f in pathlib.Path(self.folder).glob("*.until") if self.folder else ():
                latest = max(latest, float(f.read_text() or 0))
        except (OSError, ValueError):
            pass  # being written; the next request reads it
        return latest

    def wait(self) -> None:
        now = self.clock()
        at = max(self.next_at, self._until(), now)
        if at > now:
            self.sleep(at - now)
        self.next_at = at + self.interval

    def penalize(self, seconds: float) -> None:
        until = max(self.next_at, self._until(), self.clock()) + seconds
        self.next_at = until
        if self.folder:
            pathlib.Path(self.folder).mkdir(parents=True, exist_ok=True)
            new = pathlib.Path(self.folder, f"{self.name}.new")
            new.write_text(str(until))
            new.replace(pathlib.Path(self.folder, self.name))


def fetch(url: str, limiter: Limiter, tries: int = 4, wait: float = 5.0, open_=urllib.request.urlopen, sleep=time.sleep) -> tuple[str, bytes | None]:
    """(status, body): ok; missing at once for 404 and 410; error after `tries`, with a longer pause after each.

    Throttled (403, 429, 503), all workers pause, six times as long.
    """
    for k in range(tries):
        limiter.wait()
        try:
            with open_(url, timeout=30) as r:
                return "ok", r.read()
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return "missing", None
            if e.code in (403, 429, 503):
                limiter.penalize(6 * wait * 2**k)
        except OSError:
            pass
        sleep(wait * 2**k)
    return "error", None


class _Share(InputPartition):
    def __init__(self, urls: list[str], interval: float, folder: str):
        self.urls, self.interval, self.folder = urls, interval, folder


class _PageReader(DataSourceReader):
    opener = staticmethod(urllib.request.urlopen)

    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.n, self.rate, self.folder = int(options.get("workers", 3)), float(options.get("rate", 1.5)), options.get("pauses", "")

    def partitions(self) -> list[InputPartition]:
        # each worker has its share of the rate; pauses are shared
        return [_Share(self.urls[i :: self.n], self.n / self.rate, self.folder) for i in range(self.n)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        limiter = Limiter(partition.interval, partition.folder)
        for u in partition.urls:
            yield (u, *fetch(u, limiter, open_=self.opener))


class PageSource(DataSource):
    """Batch source "pages_http": options urls (one a line), rate (requests a second in all), workers and pauses (a shared folder)."""

    @classmethod
    def name(cls) -> str:
        return "pages_http"

    def schema(self) -> str:
        return "url string, status string, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


def crawl_pages(todo: DataFrame, fetched: Callable[[list[str]], DataFrame], store: Callable[[DataFrame], None], batch: int) -> None:
    """Fetches todo (url, published, in order) in batches and stores each batch before the next is asked for.

    So a crawl that stops loses one batch at most. fetched: url, status, body of a list of URLs; store: writes them with
    `published`. The URLs left stream to the driver a partition at a time; only a batch of them is held.
    """
    left = todo.select("url", "published").toLocalIterator(prefetchPartitions=True)
    while rows := list(itertools.islice(left, batch)):
        published = todo.sparkSession.createDataFrame([tuple(r) for r in rows], "url string, published string")
        store(fetched([r["url"] for r in rows]).join(F.broadcast(published), "url"))
