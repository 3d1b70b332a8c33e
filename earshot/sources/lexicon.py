"""Lexicon from a dictionary table or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.text import NOT_HEDGES, Lexicon

SCHEMA = "Word string, Uncertainty int, Modal int"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, uncertainty, modal) of a CSV with a header; words in lower case."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(F.lower("Word").alias("word"), F.col("Uncertainty").cast("int").alias("uncertainty"), F.col("Modal").cast("int").alias("modal"))


def classify(dictionary: DataFrame) -> DataFrame:
    """(word, class): modal 1 strong, 2 moderate, 3 weak; uncertain words that aren't weak; never those that don't hedge."""
    modal = F.when(F.col("modal") == 1, "strong").when(F.col("modal") == 2, "moderate").when((F.col("modal") == 3) & ~F.col("word").isin(*NOT_HEDGES), "weak")
    by_modal = dictionary.withColumn("class", modal).filter("class is not null").select("word", "class")
    weak = dictionary.filter("modal = 3").select("word")
    uncertain = dictionary.filter(F.col("uncertainty") > 0).join(weak, "word", "left_anti").filter(~F.col("word").isin(*NOT_HEDGES))
    return by_modal.unionByName(uncertain.select("word", F.lit("uncertainty").alias("class"))).distinct()


def load_lexicon(dictionary: DataFrame) -> Lexicon:
    """A dictionary has a few thousand words, so its classes are collected."""
    found: dict[str, list[str]] = {"strong": [], "moderate": [], "weak": [], "uncertainty": []}
    for r in classify(dictionary).collect():
        found[r["class"]].append(r["word"])
    return Lexicon(**{k: tuple(sorted(v)) for k, v in found.items()})
