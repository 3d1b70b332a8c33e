"""Settings of the stages, with defaults; a YAML or JSON file may change any of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Scrape:
    start_month: str = "2017-01"
    requests_per_second: float = 1.5
    workers: int = 3
    batch: int = 500
    end_month: str = ""
    tickers: list[str] = field(default_factory=list)
    pauses: str = ""
    sitemap_url: str = ""
    url_pattern: str = r"https://[^<\s\"]+/(\d{4})/(\d{2})/(\d{2})/[^<\s\"]+"


@dataclass
class Parse:
    min_section_words: int = 500
    part_rows: int = 200_000
    title_suffix: str = ""


@dataclass
class Label:
    lexicon: str = ""
    min_tokens: int = 6
    neutral_ratio: float = 1.0
    max_sentences: int = 860_000


@dataclass
class Train:
    features: int = 1 << 16
    steps: int = 40
    rate: float = 0.5
    warmup: float = 0.1
    decay: float = 0.01


@dataclass
class Score:
    sentiment: bool = False


@dataclass
class Signals:
    min_history: int = 20
    buy_z: float = 0.5
    sell_z: float = -0.5


@dataclass
class Report:
    latest_days: int = 45
    chart_tickers: list[str] = field(default_factory=list)


@dataclass
class Inventory:
    lot_dollars: float = 1000.0
    max_lots: int = 5


@dataclass
class Backtest:
    benchmark: str = "SPY"
    horizons: tuple[int, ...] = (1, 5, 20, 60)
    min_price: float = 5.0
    min_dollar_volume: float = 1e6
    winsorize: float = 0.01
    min_bars: int = 30


@dataclass
class Config:
    data: str = "data"
    results: str = "results"
    prices: str = ""
    scrape: Scrape = field(default_factory=Scrape)
    parse: Parse = field(default_factory=Parse)
    label: Label = field(default_factory=Label)
    train: Train = field(default_factory=Train)
    score: Score = field(default_factory=Score)
    signals: Signals = field(default_factory=Signals)
    report: Report = field(default_factory=Report)
    inventory: Inventory = field(default_factory=Inventory)
    backtest: Backtest = field(default_factory=Backtest)


def _fill(target, values: dict):
    for f in fields(target):
        if f.name in values:
            now, v = getattr(target, f.name), values[f.name]
            setattr(target, f.name, _fill(now, v) if is_dataclass(now) else tuple(v) if isinstance(now, tuple) else v)
    unknown = set(values) - {f.name for f in fields(target)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return target


def load(path: str | None = None) -> Config:
    if path is None:
        return Config()
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return _fill(Config(), json.loads(text))
    import yaml  # only YAML files need it

    return _fill(Config(), yaml.safe_load(text) or {})
