"""Parquet, CSV and JSON tables of the stages."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICES = "ticker string, date date, open double, close double, volume double"
SIGNALS = (
    "ticker string, company string, call_date date, call_time_et string, signal string, confidence double, confidence_z double, conf_prepared double, conf_qna double, "
    "gap double, pct_high double, pct_low double, confidence_change double, sentences long, warmup boolean"
)


def store_of(spark: SparkSession, path: str):
    """The path, and the store it is in, as Hadoop knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has this path."""
    p, store = store_of(spark, path)
    return store.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When this path of any store was written, in milliseconds."""
    p, store = store_of(spark, path)
    return store.getFileStatus(p).getModificationTime()


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


#: Rows of a part, give or take a call; and calls that share a bucket when parts are numbered.
PART_ROWS, BUCKET_CALLS = 200_000, 20_000


def call_parts(df: DataFrame, call: str = "call_id", rows: int = PART_ROWS, bucket_calls: int = BUCKET_CALLS) -> DataFrame:
    """(call, n, part): for each call its rows and its part of the table, so that parts have about `rows` rows and no call is cut.

    Calls are dealt to buckets by a hash and, in the order of buckets and names, numbered by how many rows come before:
    part k has the calls that begin between row k * rows and the next multiple. A call of `rows` rows or more is a part of
    its own. Prefix sums go by buckets, then over the buckets' sums, so no task has all calls. A null call is one, too.
    """
    sizes = df.groupBy(call).agg(F.count("*").alias("n")).withColumn("_key", F.md5(F.coalesce(F.concat(F.lit("="), F.col(call).cast("string")), F.lit(""))))
    buckets = max(1, sizes.count() // bucket_calls)
    sizes = sizes.withColumn("_bucket", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(buckets))).withColumn("_small", F.when(F.col("n") < rows, F.col("n")).otherwise(0))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over a row a bucket
    before = sizes.groupBy("_bucket").agg(F.sum("_small").alias("_sum")).select("_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_in", F.coalesce(F.sum("_small").over(inside), F.lit(0))).join(before, "_bucket")
    number = F.floor((F.col("_before") + F.col("_in")) / rows)
    return placed.select(call, "n", F.when(F.col("n") < rows, F.lpad(number.cast("string"), 9, "0")).otherwise(F.concat(F.lit("call-"), "_key")).alias("part"))


def write_by_call(df: DataFrame, path: str, call: str = "call_id", rows: int = PART_ROWS) -> None:
    """Parquet in a folder for each part of call_parts, so all rows of a call are together and parts are alike in size.

    What is in path is replaced whole. Calls are put in order within a part."""
    parts = call_parts(df, call, rows).withColumnRenamed(call, "_call").drop("n")
    placed = df.join(parts, F.col(call).eqNullSafe(F.col("_call"))).drop("_call")
    placed.repartition("part").sortWithinPartitions("part", call).write.mode("overwrite").partitionBy("part").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each of train, val and test."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c, t in df.dtypes if t in ("double", "float")})


def write_csv(df: DataFrame, path: str, digits: int | None = None, gzip: bool = False) -> None:
    """CSV with a header, numbers rounded half to even; null is an empty field."""
    out = df if digits is None else rounded(df, digits)
    out.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals from CSV. Only empty fields are null, so a ticker NA stays one."""
    return spark.read.option("header", True).schema(SIGNALS).csv(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small result of the driver's as one JSON file, in any store that Spark writes."""
    p, store = store_of(spark, path)
    out = store.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
    finally:
        out.close()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: neither its plan nor its work is repeated by what reads it.

    The folder is spark.checkpoint.dir; one of this machine only if that is unset and the master is local, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="earshot-"))
    return df.checkpoint(eager=True)
