"""Scoring of what is new: a file stream with a checkpoint for files that only get more, and parts renewed with their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earshot.operators.scoring import Scorer, with_confidence
from earshot.sources import tables


def score_new_files(spark: SparkSession, source: str, schema: StructType | str, scorer: Scorer, out: str, checkpoint: str, sentiment: Column | None = None, files: int = 64) -> None:
    """Scores files of source that no earlier run with this checkpoint has scored, and appends them to out.

    The checkpoint remembers the files, `files` at a time, so a stopped run goes on where it was and no file is scored twice. With a new
    model take a new checkpoint and a new output.
    """
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = with_confidence(scorer(new), sentiment).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


MANIFEST = "path string, modified timestamp, model_at long"


def score_changed_files(spark: SparkSession, source: str, scorer: Scorer, out: str, model_at: int, sentiment: Column | None = None, files: int = 64) -> int:
    """Keeps {out}/parts, the scores of each file of source in a partition of its own (part, the file's name), as fresh as
    the files; how many files were scored.

    A file is scored if the manifest, {out}/files, lacks it as it is now by this model, so when it is new or was written
    again, or the model is another. Its scores replace those there were, and no other partition is touched. `files` at a
    time are scored and then noted; a run that stops between the two scores these again, to the same result. Partitions
    of files that are gone are deleted. The driver holds the list of files, as it does for any scan of them.
    """
    there = spark.read.format("binaryFile").load(source).select("path", F.col("modificationTime").alias("modified")).filter(F.col("path").endswith(".parquet"))
    noted, manifest = f"{out}/files", spark.createDataFrame([], MANIFEST)
    if tables.exists(spark, noted):
        manifest = spark.read.schema(MANIFEST).parquet(noted).filter(F.col("model_at") == model_at)
    # As of what they are: a file is fresh if it hasn't changed since it was read for its scores.
    stale = stale_parts(there, manifest.select("path", F.col("modified").alias("scored_at"), F.col("modified").alias("model_at"))).orderBy("path").collect()
    for i in range(0, len(stale), files):
        some = stale[i : i + files]
        rows = spark.read.parquet(*(r["path"] for r in some)).withColumn("part", F.col("_metadata.file_name"))
        scored = with_confidence(scorer(rows), sentiment)
        scored.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{out}/parts")
        spark.createDataFrame([(r["path"], r["modified"], model_at) for r in some], MANIFEST).coalesce(1).write.mode("append").parquet(noted)
    names = {r["path"].rsplit("/", 1)[1] for r in there.select("path").collect()}
    folder, store = tables.store_of(spark, f"{out}/parts")
    for f in store.listStatus(folder) if store.exists(folder) else []:
        name = f.getPath().getName()
        if name.startswith("part=") and name.removeprefix("part=") not in names:
            store.delete(f.getPath(), True)
    return len(stale)


def call_counts(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of a stream's events by window and type; events later than delay behind the latest are left out."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def stale_parts(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """parts (path, modified) that the manifest (path, scored_at, model_at) lacks, or that have changed, or whose model is newer than their score."""
    done = manifest.groupBy("path").agg(F.max_by(F.struct("scored_at", "model_at"), "scored_at").alias("m"))
    fresh = parts.join(done, "path").filter((F.col("modified") <= F.col("m.scored_at")) & (F.col("m.model_at") <= F.col("m.scored_at")))
    return parts.join(fresh.select("path"), "path", "left_anti")
