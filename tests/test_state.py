"""What streams remember: state is gone once the watermark has passed."""

import pytest
from pyspark.sql import functions as F

from frameloom.streaming import items as stream


def batches_of(spark, folder, schema, batches):
    """A stream of one file per batch, in order."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(folder / f"{k}"))
    kind = spark.createDataFrame([], schema).schema
    reader = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(str(folder))


def held(spark, checkpoint, name):
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return {r[0]: tuple(r[1]) for r in rows.select("key", "value").select(F.col("key.*"), "value").collect()}


@pytest.fixture
def rocksdb(spark):
    with stream.rocksdb_state(spark):
        yield


def test_progress_forgets_idle_jobs(spark, tmp_path, rocksdb):
    batches = [
        [(1, "download", "2024-01-01 00:00:00"), (1, "process", "2024-01-01 00:01:00"), (2, "download", "2024-01-01 00:00:00")],
        [(1, "upload", "2024-01-01 00:30:00"), (2, None, "2024-01-01 00:02:00"), (3, "upload", "2024-01-01 00:40:00")],
        [(9, "upload", "2024-01-03 00:00:00")],
        [(9, "upload", "2024-01-03 00:10:00"), (1, "download", "2024-01-03 00:05:00")],
        [(9, "upload", "2024-01-05 00:00:00")],
        [(9, "upload", "2024-01-05 00:20:00")],
    ]
    rows = batches_of(spark, tmp_path / "in", "job_id long, stage string, ts timestamp", batches)
    checkpoint, out = str(tmp_path / "state"), str(tmp_path / "out")
    stream.write_results_once(stream.progress(rows, idle_s=3600), out, checkpoint, "update")
    got = [tuple(r) for r in spark.read.parquet(out).select("batch_id", "job_id", "seen", "downloads", "processed", "uploads", "progress").collect()]
    seen = {(j, n): rest for _, j, n, *rest in got}
    assert seen[1, 2] == [1, 1, 0, 40] and seen[1, 3] == [1, 1, 1, 33] and seen[2, 2] == [1, 0, 0, 5] and seen[3, 1] == [0, 0, 1, 20]
    assert seen[1, 1] == [1, 0, 0, 10]  # after its idle time job 1 counts anew
    assert set(held(spark, checkpoint, "counts")) == {9}


def test_tracker_forgets_settled_items(spark, tmp_path, rocksdb):
    batches = [
        [(1, "2024-01-01 00:00:00", 1, None, True), (2, "2024-01-01 00:00:00", 1, "TIMEOUT", True), (3, "2024-01-01 00:05:00", 1, "NOT_FOUND", False)],
        [(1, "2024-01-01 00:10:00", 2, "NOT_FOUND", False), (2, "2024-01-01 00:11:00", 2, None, True)],
        [(4, "2024-01-01 00:20:00", 1, "TIMEOUT", True)],
        [(9, "2024-01-01 03:00:00", 1, None, True)],
        [(9, "2024-01-01 06:00:00", 2, None, True), (4, "2024-01-01 06:00:00", 2, None, True)],
        [(9, "2024-01-01 09:00:00", 3, None, True), (4, "2024-01-01 08:50:00", 3, None, True)],
        [(9, "2024-01-01 12:00:00", 3, None, True)],
        [(9, "2024-01-01 12:10:00", 4, "NOT_FOUND", False)],
    ]
    rows = batches_of(spark, tmp_path / "in", "item_id long, ts timestamp, seq long, code string, retryable boolean", batches)
    checkpoint, out = str(tmp_path / "state"), str(tmp_path / "out")
    stream.write_results_once(stream.attempt_tracker(rows), out, checkpoint)
    got = sorted((r.item_id, r.status, r.attempts, r.code) for r in spark.read.parquet(out).where("item_id < 9").collect())
    # item 1 is settled by its first row; item 4 times out, its row of that batch is too late, and the next one opens it anew
    assert [g[:3] for g in got] == [(1, "completed", 1), (2, "completed", 2), (3, "failed", 1), (4, "completed", 1), (4, "failed", 1)]
    assert [g[3] for g in got] == [None, None, "NOT_FOUND", None, "TIMEOUT"]
    assert set(held(spark, checkpoint, "attempts")) == {9}
