"""The stages from fetched pages to evaluated signals. Each reads the Parquet of the one before and writes its own."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.config import Config
from earshot.functions import text as T
from earshot.operators import events, inventory, linear, report, scoring, sentences, signals, turns
from earshot.sources import crawl, pages, tables
from earshot.sources.lexicon import load_lexicon, read_dictionary
from earshot.streaming import incremental

_INDEX, _FETCHED, _PAGES, _BLOCKS, _TURNS, _STATS = "raw/index", "raw/fetched", "raw", "interim/blocks", "interim/turns", "interim/parse_stats"
_SENTENCES, _SPLITS, _MODEL, _SCORED, _CALLS = "processed/sentences", "processed/splits", "models/scorer", "processed/scored", "processed/calls"


def _lexicon(spark: SparkSession, cfg: Config) -> T.Lexicon:
    return load_lexicon(read_dictionary(spark, cfg.label.lexicon)) if cfg.label.lexicon else T.Lexicon()


def _index(spark: SparkSession, cfg: Config) -> DataFrame:
    """All records of pages fetched: those of an index that was given, and those of this crawl's batches."""
    given, columns = f"{cfg.data}/{_INDEX}", [c.split()[0] for c in crawl.INDEX.split(", ")]
    ours = crawl.read_batches(spark, f"{cfg.data}/{_FETCHED}").select(*columns)
    return crawl.read_index(spark, given).unionByName(ours) if tables.exists(spark, given) else ours


def scrape(spark: SparkSession, cfg: Config, today: datetime.date | None = None, fetched=None) -> DataFrame:
    """Fetches sitemaps of all months and pending pages, batch by batch, into the raw folder; counts by status.

    Pages without an article count as missing; those of tickers that aren't asked for are neither stored nor logged.
    fetched: url, status and body of a list of URLs, by default over the network.
    """
    spark.dataSource.register(crawl.PageSource)
    today = today or datetime.date.today()
    raw = f"{cfg.data}/{_PAGES}"

    def by_http(urls: list[str]) -> DataFrame:
        options = {"urls": "\n".join(urls), "rate": str(cfg.scrape.requests_per_second), "workers": str(cfg.scrape.workers), "pauses": cfg.scrape.pauses}
        return spark.read.format("pages_http").options(**options).load()

    fetched = fetched or by_http
    months = crawl.months(spark, cfg.scrape.start_month, cfg.scrape.end_month or f"{today:%Y-%m}")
    sitemap = lambda m: cfg.scrape.sitemap_url.format(year=m.year, month=m.month)
    cached = spark.read.parquet(f"{raw}/sitemaps") if tables.exists(spark, f"{raw}/sitemaps") else spark.createDataFrame([], "month date, xml string, read timestamp")
    wanted = [r["month"] for r in crawl.sitemaps_to_fetch(months, cached, today).orderBy("month").collect()]  # a row a month
    if wanted:
        by_url = spark.createDataFrame([(sitemap(m), m) for m in wanted], "url string, month date")
        maps = fetched([sitemap(m) for m in wanted]).filter("status = 'ok'").join(by_url, "url")
        maps.select("month", F.col("body").cast("string").alias("xml"), F.current_timestamp().alias("read")).write.mode("append").parquet(f"{raw}/sitemaps")
    maps = spark.read.parquet(f"{raw}/sitemaps").groupBy("month").agg(F.max_by("xml", "read").alias("xml"))
    urls = crawl.discover(maps, cfg.scrape.url_pattern, order="month")
    index, fetched_path = _index(spark, cfg), f"{cfg.data}/{_FETCHED}"
    seen = index.agg(F.max("seq")).first()[0] or 0
    batch = max(crawl.committed_batches(spark, fetched_path), default=-1) + 1
    counts: dict[str, int] = {}

    def store(got: DataFrame) -> None:
        nonlocal seen, batch
        info = pages.extract_metadata(got.withColumn("html", F.col("body").cast("string")), title_suffix=cfg.parse.title_suffix)
        empty = (F.col("status") == "ok") & ~F.col("has_article")
        info = info.withColumns({"status": F.when(empty, "missing").otherwise(F.col("status")), "error": F.when(empty, "ValueError").when(F.col("status") != "ok", F.col("status"))})
        info = crawl.only_tickers(info, cfg.scrape.tickers).withColumn("file", T.page_path(F.col("url"))).persist()
        order = Window.orderBy(F.desc("published"), "url")  # of one batch
        crawl.write_batch(info.select((F.row_number().over(order) + seen).cast("long").alias("seq"), "url", "published", "status", "ticker", "company", "title", "fiscal_quarter", "file", "error", "body"), fetched_path, batch)
        seen, batch = seen + cfg.scrape.batch, batch + 1
        for r in crawl.status_counts(info).collect():
            counts[r["status"]] = counts.get(r["status"], 0) + r["n"]
        info.unpersist()

    crawl.crawl_pages(crawl.pending(urls, index), fetched, store, cfg.scrape.batch)
    return spark.createDataFrame([*counts.items()], "status string, n long")


def parse(spark: SparkSession, cfg: Config) -> DataFrame:
    """Index and pages to speaker turns of kept calls, and statistics of all pages. Pages are this crawl's batches, or gzipped files at the index's paths."""
    records = crawl.latest_records(_index(spark, cfg)).filter("status = 'ok'")
    raw = f"{cfg.data}/{_PAGES}"
    bodies = crawl.read_batches(spark, f"{cfg.data}/{_FETCHED}").filter("status = 'ok'").groupBy("file").agg(F.max_by("body", "seq").cast("string").alias("html"))
    records = records.select("url", "ticker", "company", "fiscal_quarter", "published", F.col("first_seq").alias("seq"), "file")
    if tables.exists(spark, f"{raw}/pages"):  # gzipped files of a crawl before
        given = pages.read_gzip_pages(spark, f"{raw}/pages").withColumn("file", F.concat(F.lit("pages/"), F.regexp_extract("path", r"pages/(.*)$", 1))).drop("path")
        others = records.join(bodies, "file", "left_anti").join(given, "file", "left")
        found = pages.read_blocks(records.join(bodies, "file")).unionByName(pages.read_blocks(others))
    else:
        found = pages.read_blocks(records.join(bodies, "file", "left"))
    found.write.mode("overwrite").parquet(f"{cfg.data}/{_BLOCKS}")  # read twice below, but Python reads pages once
    blocks = spark.read.parquet(f"{cfg.data}/{_BLOCKS}")
    said = turns.speaker_turns(blocks, "url")
    stats = turns.parse_stats(pages.page_records(blocks).select("url", "ticker", "published", "seq", "call_date", "error"), said, "url", cfg.parse.min_section_words)
    stats = turns.first_published(stats)
    stats.write.mode("overwrite").parquet(f"{cfg.data}/{_STATS}")
    kept = spark.read.parquet(f"{cfg.data}/{_STATS}").filter("ok").select("url")
    out = said.join(kept, "url", "left_semi").withColumn("call_id", T.call_id(F.col("ticker"), F.col("call_date")))
    tables.write_by_call(out, f"{cfg.data}/{_TURNS}", rows=cfg.parse.part_rows)
    return turns.parse_summary(spark.read.parquet(f"{cfg.data}/{_STATS}"))


def label(spark: SparkSession, cfg: Config) -> DataFrame:
    """Turns to labelled sentences, and the sampled training, validation and test sets."""
    said = tables.read_columns(spark, f"{cfg.data}/{_TURNS}", ["ticker", "company", "call_date", "call_time_et", "section", "speaker", "role", "speaker_type", "text", "url", "turn"])
    said = said.withColumn("turn_id", F.concat_ws("#", "url", "turn")).drop("url", "turn")
    sentences.with_weak_labels(sentences.to_sentences(said, cfg.label.min_tokens), _lexicon(spark, cfg)).write.mode("overwrite").parquet(f"{cfg.data}/{_SENTENCES}")
    done = spark.read.parquet(f"{cfg.data}/{_SENTENCES}")
    tables.write_splits(sentences.training_sets(done, neutral_ratio=cfg.label.neutral_ratio, max_sentences=cfg.label.max_sentences), f"{cfg.data}/{_SPLITS}")
    return sentences.label_counts(done)


def train(spark: SparkSession, cfg: Config) -> dict:
    """Fits the scorer to the training set; its measures on the others go to metrics.json."""
    sets = spark.read.parquet(f"{cfg.data}/{_SPLITS}")
    part = lambda s: sets.filter(F.col("split") == s)
    run = linear.fit(part("train"), cfg.train.features, cfg.train.steps, cfg.train.rate, cfg.train.warmup, cfg.train.decay)
    run.save(spark, f"{cfg.data}/{_MODEL}")
    out: dict = {"train_sentences": part("train").count(), "train_calls": part("train").select("call_id").distinct().count()}
    for s in ("val", "test"):
        counts = scoring.confusion(scoring.with_confidence(run(part(s)))).cache()
        out[s] = scoring.overall(counts).first().asDict() | {"confusion": [r.asDict() for r in counts.collect()], "report": [r.asDict() for r in scoring.classification_report(counts).collect()]}
    out["context_check"] = scoring.context_check(part("test"), run, _lexicon(spark, cfg)).first().asDict()
    tables.write_json(spark, out, f"{cfg.results}/metrics.json")
    return out


def score(spark: SparkSession, cfg: Config) -> DataFrame:
    """Scores sentences and sums them up by call: only files of sentences that are new, have changed since, or were scored
    by another model. Scores of files that are gone go; a stopped run goes on where it was. With sentiment set, scores have it too."""
    model = f"{cfg.data}/{_MODEL}"
    run = linear.load(spark, model)
    scored = f"{cfg.data}/{_SCORED}"
    incremental.score_changed_files(spark, f"{cfg.data}/{_SENTENCES}", run, scored, tables.modified(spark, f"{model}/_SUCCESS"), scoring.lexicon_sentiment(_lexicon(spark, cfg)) if cfg.score.sentiment else None)
    calls = signals.call_features(spark.read.parquet(f"{scored}/parts").drop("speaker", "role", "turn_id", "part"))
    signals.lag_change(calls, "conf_qna", "delta_qoq").write.mode("overwrite").parquet(f"{cfg.data}/{_CALLS}")
    return scoring.score_summary(spark.read.parquet(f"{cfg.data}/{_CALLS}"))


def make_signals(spark: SparkSession, cfg: Config) -> DataFrame:
    """Calls to signals and the reports' tables."""
    s = cfg.signals
    out = signals.make_signals(spark.read.parquet(f"{cfg.data}/{_CALLS}"), s.min_history, s.buy_z, s.sell_z).cache()
    tables.write_csv(signals.output_columns(out).orderBy("call_date", "ticker"), f"{cfg.results}/signals", digits=4)
    tables.write_csv(signals.output_columns(signals.latest(out, cfg.report.latest_days)), f"{cfg.results}/latest_signals", digits=4)
    tables.write_csv(report.quarter_index(out), f"{cfg.results}/quarter_index", digits=6)
    tables.write_csv(report.z_histogram(out), f"{cfg.results}/z_histogram", digits=6)
    tables.write_csv(report.chart_tickers(out, cfg.report.chart_tickers), f"{cfg.results}/chart_tickers")
    return out.groupBy("signal").agg(F.count("*").alias("n"))


def backtest(spark: SparkSession, cfg: Config) -> dict:
    """Live signals against prices (Parquet at cfg.prices, the benchmark's ticker among them): events, lots and evaluation.json."""
    b, i = cfg.backtest, cfg.inventory
    live = tables.read_signals(spark, f"{cfg.results}/signals").filter("not warmup")
    all_prices = spark.read.parquet(cfg.prices).select("ticker", F.to_date("date").alias("date"), "open", "close", "volume").dropna()
    bench = all_prices.filter(F.col("ticker") == b.benchmark).drop("ticker", "volume")
    mine = all_prices.join(F.broadcast(live.select(T.symbol(F.col("ticker")).alias("ticker")).distinct()), "ticker", "left_semi")
    ev = tables.cut(events.event_returns(live.withColumn("ticker", T.symbol(F.col("ticker"))), mine, bench, b.horizons, b.min_price, b.min_dollar_volume, b.min_bars))
    lot_events = ev.withColumn("seq", F.datediff("call_date", F.lit("1970-01-01").cast("date")).cast("long"))
    log = tables.cut(inventory.trade_log(lot_events, mine, bench, i.lot_dollars, i.max_lots))
    book = tables.cut(inventory.daily_book(log, mine, bench))
    held = tables.cut(inventory.holdings(inventory.lots(lot_events, mine, bench, i.lot_dollars, i.max_lots), mine, bench))
    for df, name in ((ev, "events"), (log, "trades"), (book, "book")):
        tables.write_csv(df, f"{cfg.results}/{name}", digits=6, gzip=True)
    tables.write_csv(held, f"{cfg.results}/inventory", digits=4)
    out = {"events": events.summarize(ev, b.horizons, b.winsorize), "inventory": inventory.summarize(log, book, held)}
    tables.write_json(spark, out, f"{cfg.results}/evaluation.json")
    return out


STAGES = {"scrape": scrape, "parse": parse, "label": label, "train": train, "score": score, "signals": make_signals, "backtest": backtest}
#: What "all" runs; the back test is asked for by name, as it needs prices.
ALL = ("scrape", "parse", "label", "train", "score", "signals")
