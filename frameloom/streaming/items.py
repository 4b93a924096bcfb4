"""Work items as streams: arrival, single fetch, progress, latency, attempts and results."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_items(spark: SparkSession, path: str, schema: StructType, glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Items as they arrive as parquet files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Times without a zone cannot carry a watermark: read them in the session's zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def download_once(stream: DataFrame, key: str, delay: str = "1 hour", column: str = "ts") -> DataFrame:
    """First item per input within the watermark. State is dropped once the watermark passes."""
    return stream.withWatermark(column, delay).dropDuplicatesWithinWatermark([key])


def progress(stream: DataFrame, idle_s: int = 86_400, delay: str = "10 minutes") -> DataFrame:
    """Running counts per job of ``job_id, stage, ts`` rows and the weighted percentage, for update mode.

    State is one row of counts per job. It is cleared when the watermark passes the job's last row by ``idle_s``; a job
    that goes on after that starts to count anew.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    stages = ("download", "process", "upload")

    class Counter(StatefulProcessor):
        def init(self, handle):
            self._handle = handle
            self._state = handle.getValueState("counts", "seen long, downloads long, processed long, uploads long, last long")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            held = list(self._state.get()) if self._state.exists() else [0, 0, 0, 0, None]
            before = held[4]
            if before is not None and before + idle_s * 1000 <= timerValues.getCurrentWatermarkInMs():
                held = [0, 0, 0, 0, None]  # rows come before the timers of a batch
            for pdf in rows:
                held[0] += len(pdf)
                for k, stage in enumerate(stages, 1):
                    held[k] += int((pdf["stage"] == stage).sum())
                last = pdf["ts"].max()
                if not pd.isna(last):
                    held[4] = max(held[4] or 0, int(last.value // 1_000_000))
            if held[4] != before:
                if before is not None:
                    self._handle.deleteTimer(before + idle_s * 1000)
                self._handle.registerTimer(held[4] + idle_s * 1000)
            self._state.update(tuple(held))
            yield pd.DataFrame({"job_id": [key[0]], "seen": [held[0]], "downloads": [held[1]], "processed": [held[2]], "uploads": [held[3]]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self._state.clear()
            yield from ()

        def close(self):
            pass

    keyed = stream.select("job_id", "stage", "ts").withWatermark("ts", delay)
    kind = dict(stream.dtypes)["job_id"]
    counts = keyed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Counter(), outputStructType=f"job_id {kind}, seen long, downloads long, processed long, uploads long",
        outputMode="Update", timeMode="EventTime",
    )
    done = (F.col("downloads") * 10 + F.col("processed") * 70 + F.col("uploads") * 20) / F.col("seen")
    return counts.withColumn("progress", F.least(F.floor(done), F.lit(99)).cast("long"))


def stage_latency(stream: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Count, mean and greatest ``seconds`` per stage and event-time window; late rows are dropped."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide), "stage")
        .agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s"), F.max("seconds").alias("max_s"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "stage", "n", "mean_s", "max_s")
    )


def attempt_tracker(stream: DataFrame, max_attempts: int = 3, timeout_s: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """Outcome per item of ``item_id, ts, seq, code, retryable``, once it is known.

    State holds the first ``max_attempts`` attempts and nothing else, whatever their number and order in a
    batch. An item without outcome fails when the watermark passes its first attempt plus the timeout. A settled
    item is a mark without attempts, which keeps later rows of it out; the mark is cleared when the watermark passes
    the settling by the timeout, and rows after that open the item anew. Rows of the batch in which an open item's time
    is over come too late for it.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Tracker(StatefulProcessor):
        def init(self, handle):
            self._handle = handle
            self._state = handle.getValueState("attempts", "body string, done boolean")

        def _load(self):
            import json

            if not self._state.exists():
                return [], False
            body, done = self._state.get()
            return json.loads(body), bool(done)

        @staticmethod
        def _resolve(seen):
            for n, (_, _, code, retryable) in enumerate(seen, 1):
                if code is None:
                    return ("completed", n, None)
                if not retryable:
                    return ("failed", n, code)
            if len(seen) >= max_attempts:
                return ("failed", len(seen), seen[-1][2])
            return None

        def _clear(self):
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._state.clear()

        def _settle(self, at_ms):
            """Keep a mark only, until the timeout after ``at_ms``."""
            self._clear()
            self._state.update((str(at_ms + timeout_s * 1000), True))
            self._handle.registerTimer(at_ms + timeout_s * 1000)

        def _row(self, key, status, attempts, code):
            import pandas as pd

            return pd.DataFrame({"item_id": [key[0]], "status": [status], "attempts": [attempts], "code": [code]})

        def handleInputRows(self, key, rows, timerValues):
            import json

            import pandas as pd

            now = timerValues.getCurrentWatermarkInMs()
            seen, done = self._load()  # rows come before the timers of a batch
            if done and seen <= now:
                self._clear()
                seen, done = [], False
            if not done and seen and seen[0][0] // 1000 + timeout_s * 1000 <= now:
                self._settle(now)
                yield self._row(key, "failed", len(seen), "TIMEOUT")
                done = True
            if not done:
                fresh, last = not seen, 0
                for pdf in rows:
                    new = [
                        [int(t.value // 1000), int(s), None if pd.isna(c) else str(c), bool(r)]
                        for t, s, c, r in zip(pdf["ts"], pdf["seq"], pdf["code"], pdf["retryable"])
                    ]
                    last = max([last, *(a[0] // 1000 for a in new)])
                    seen = sorted(seen + new, key=lambda a: (a[0], a[1]))[:max_attempts]
                out = self._resolve(seen)
                if out:
                    self._settle(max(last, now))
                    yield self._row(key, *out)
                else:
                    if fresh and seen:
                        self._handle.registerTimer(seen[0][0] // 1000 + timeout_s * 1000)
                    self._state.update((json.dumps(seen), False))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            seen, done = self._load()
            if done:
                self._clear()
            elif seen:
                self._settle(timerValues.getCurrentWatermarkInMs())
                yield self._row(key, "failed", len(seen), "TIMEOUT")

        def close(self):
            pass

    keyed = stream.select("item_id", "ts", "seq", "code", "retryable").withWatermark("ts", delay)
    return keyed.groupBy("item_id").transformWithStateInPandas(
        statefulProcessor=Tracker(), outputStructType="item_id long, status string, attempts long, code string",
        outputMode="Append", timeMode="EventTime",
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def write_results_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream to the end of what has arrived, each batch into its own folder.

    A batch that is run again replaces its folder, so rows are never doubled.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived and return the stored rows with their ``batch_id``."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    schema = stream.schema
    write_results_once(stream, path, scratch_path(spark, f"{name}-state"), mode)
    return spark.read.schema(schema.add("batch_id", "long")).parquet(path)


def latest_rows(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of every key of a stream stored in update mode."""
    rest = [c for c in stored.columns if c not in keys and c != "batch_id"]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def first_results(stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of a result store: the earliest, should an item have been delivered again."""
    rest = [c for c in stored.columns if c not in keys and c != "batch_id"]
    return stored.groupBy(*keys).agg(F.min_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
