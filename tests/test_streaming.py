import pytest
from pyspark.sql import functions as F

from earshot.operators.scoring import lexicon_scorer
from earshot.streaming import incremental


def test_only_new_files_are_scored(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    run = lambda: incremental.score_new_files(spark, src, "call_id string, sentence string", lexicon_scorer(), out, cp)
    spark.createDataFrame([("a", "we are confident")], "call_id string, sentence string").write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("b", "it may be too early")], "call_id string, sentence string").write.mode("append").parquet(src)
    run()
    run()
    got = {r["call_id"]: r["pred"] for r in spark.read.parquet(out).collect()}
    assert got == {"a": "high", "b": "low"} and spark.read.parquet(out).count() == 2


def test_changed_files_are_scored_again_and_others_stay(spark, tmp_path):
    import os
    import pathlib
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    src, out = pathlib.Path(f"{tmp_path}/in"), f"{tmp_path}/out"
    src.mkdir()

    def put(name: str, text: str) -> None:
        pq.write_table(pa.table({"call_id": [name], "sentence": [text]}), f"{src}/{name}.parquet")

    asked = []

    def scorer(rows):
        asked.append(sorted(r["call_id"] for r in rows.select("call_id").collect()))
        if stop and len(asked) == stop[0]:
            raise KeyboardInterrupt
        return lexicon_scorer()(rows)

    run = lambda model=1: incremental.score_changed_files(spark, str(src), scorer, out, model, files=2)
    got = lambda: {r["call_id"]: r["pred"] for r in spark.read.parquet(f"{out}/parts").collect()}
    times = lambda: {f.parent.name: f.stat().st_mtime_ns for f in pathlib.Path(f"{out}/parts").glob("part=*/*.parquet")}
    for n in "abc":
        put(n, "we are confident")
    stop = [2]
    with pytest.raises(KeyboardInterrupt):
        run()
    assert got() == {"a": "high", "b": "high"}
    stop.clear()
    assert run() == 1 and asked[2:] == [["c"]] and run() == 0
    before = times()
    time.sleep(1.1)
    put("b", "it may be too early")
    assert run() == 1 and asked[3:] == [["b"]] and got() == {"a": "high", "b": "low", "c": "high"} and spark.read.parquet(f"{out}/parts").count() == 3
    after = times()
    assert {k for k in before if before[k] != after.get(k)} == {"part=b.parquet"}
    os.unlink(f"{src}/a.parquet")
    put("d", "revenue was ten")
    assert run() == 1 and got() == {"b": "low", "c": "high", "d": "neutral"}
    assert run(model=2) == 3 and run(model=2) == 0 and got() == {"b": "low", "c": "high", "d": "neutral"}


def test_stale_parts(spark):
    parts = spark.createDataFrame([("new", 5), ("same", 5), ("changed", 50), ("model", 5)], "path string, modified long")
    done = spark.createDataFrame([("same", 10, 7), ("changed", 10, 7), ("model", 10, 7), ("model", 9, 3), ("same", 3, 9)], "path string, scored_at long, model_at long")
    done = done.withColumn("model_at", F.when(F.col("path") == "model", 11).otherwise(F.col("model_at")))
    assert {r["path"] for r in incremental.stale_parts(parts, done).collect()} == {"new", "changed", "model"}


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:05:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 03:00:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/e")
    q = incremental.call_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["event_type"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
