"""python -m earshot STAGE [--config FILE]: one stage, or all of them."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from earshot import config
from earshot.plans.stages import ALL, STAGES


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="earshot", description=__doc__)
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("--config")
    p.add_argument("--tickers", help="scrape these only, by comma")
    a = p.parse_args(args)
    cfg = config.load(a.config)
    if a.tickers:
        cfg.scrape.tickers = a.tickers.split(",")
    spark = SparkSession.builder.appName(f"earshot-{a.stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in ALL if a.stage == "all" else (a.stage,):
        got = STAGES[name](spark, cfg)
        if isinstance(got, DataFrame):
            got.show(20, truncate=False)
        else:
            print(got)


if __name__ == "__main__":
    main()
