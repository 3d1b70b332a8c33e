"""What the training-data operators share: reading tables, cutting lineage, bounded joins, batches for Python."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that a join sends to every executor; the tables joined so have a few hundred bytes a row.
BROADCAST_ROWS = 100_000
#: Rows of a salted join's smaller side are repeated so often.
SALTS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate results: spark.checkpoint.dir; one of this machine only if unset and the master
    is local, as in tests. On a cluster it must be set: executors share no other folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="earshot-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so that lost executors cost no more than one stage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def python_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Bounds the Arrow batches that go to Python by rows and by bytes, as documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Gives the memory of batches that are done with back to the system. Arrow keeps it otherwise, and Spark the worker
    for later stages, so that the workers of a job of many stages each hold the most that any of them took."""
    pa.default_memory_pool().release_unused()


def small_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """left joined to a table that is mostly small: sent to all executors up to BROADCAST_ROWS rows, salted beyond.

    rows: the number of rows of small where it is known. small has one row for each value of `on`; these are not null.
    """
    n = small.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), on, how)
    return _salted_join(left, small, on, how)


def _salted_join(left: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    (salt,) = unused(left, "salt")
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, salt], how).drop(salt)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df has that name in any case."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        there.add(name.lower())
        out.append(name)
    return out


def hash_uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends only on the values, the same in other SQL engines: 52 bits of md5."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sample_by_hash(df: DataFrame, hash_col: str, rows: int, n: int) -> DataFrame:
    """Those of df's n rows with the least 64-bit hashes, about `rows` of them; all if there are no more.

    The threshold is exact at any n. The number varies as a hash does, by a few times its root; rows of one hash stay or
    go together, so whoever needs a strict bound must cut what repeats.
    """
    if n <= rows:
        return df
    return df.filter(F.col(hash_col) < F.lit((rows << 64) // n - (1 << 63)))


#: Rows of a join's larger side with one key from which that key is joined by broadcast, apart from the others.
HOT_ROWS = 10_000


def weighted_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key and in `weight` how many rows of left have it.

    Keys with more than HOT_ROWS rows, at most one for each HOT_ROWS rows of left, are broadcast; the others are
    shuffled. So no task gets all rows of a frequent key. If there are none, as is usual, it is one plain join; if there
    are more than BROADCAST_ROWS of them, all keys are salted.
    """
    right = right.withColumnRenamed(weight, "_w")
    hot = right.filter(F.col("_w") > HOT_ROWS).drop("_w")
    n = hot.count()
    if n == 0:
        return left.join(right.drop("_w"), key, how)
    if n > BROADCAST_ROWS:
        return _salted_join(left, right.drop("_w"), [key], how)
    cold = right.filter(F.col("_w") <= HOT_ROWS).drop("_w")
    keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key, "inner").unionByName(left.join(keys, key, "left_anti").join(cold, key, how))
