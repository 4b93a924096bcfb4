"""Work ledger: expand a batch into items, join stage outcomes back, and report on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import RETRY_POLICIES, TOOL_PATHS
from ..functions.keyed import keyed_seed
from ..functions.urls import is_image, is_video, unsafe_reason, variant_url
from .ordered import dealt, first_rows, join_split, tasks_for

MB = 1024.0 * 1024.0


def zip_io(batches: DataFrame) -> DataFrame:
    """Pair ``input_urls`` and ``output_urls`` by position: ``job_id, idx, input_url, output_url, error``.

    A batch with lists of different length gives a single row with the error.
    """
    same = F.size("input_urls") == F.size("output_urls")
    pairs = F.arrays_zip(F.col("input_urls").alias("i"), F.col("output_urls").alias("o"))
    return batches.select(
        "job_id", F.posexplode_outer(F.when(same, pairs)).alias("idx", "p"),
        F.when(~same, F.lit("inputUrls and outputUrls must have same length")).alias("error"),
    ).select("job_id", F.col("idx").cast("long").alias("idx"), F.col("p.i").alias("input_url"), F.col("p.o").alias("output_url"), "error")


def expand_variants(items: DataFrame, n: int, salt: str = "") -> DataFrame:
    """``n`` rows per item with ``variant``, its own ``seed`` and output address (unchanged for n = 1)."""
    out = items.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    url = variant_url(F.col("output_url"), F.col("variant")) if n > 1 else F.col("output_url")
    return out.withColumn("seed", keyed_seed(F.col("input_url"), F.col("variant"), F.lit(salt))).withColumn("output_url", url)


def refuse_unsafe(items: DataFrame, url: str = "input_url") -> DataFrame:
    """Add ``error``: why an input is refused, null where it is not. Refused rows stay in the batch."""
    return items.withColumn("error", unsafe_reason(F.col(url)))


REASONS = ["required", "scheme", "missing host", "localhost", "private network"]


def validate_batches(addresses: DataFrame) -> DataFrame:
    """Per job the first refused address: ``job_id, side, idx, reason``, all null for a sound job.

    ``addresses`` has job_id, side (0 input, 1 output), idx and url. Inputs come before outputs. Side, place and reason
    are one long, whose least value is a hash aggregate that combines before the shuffle.
    """
    reason = unsafe_reason(F.col("url"))
    number = F.array_position(F.array(*[F.lit(r) for r in REASONS]), reason) - 1
    packed = F.when(reason.isNotNull(), (F.col("side").cast("long") * (1 << 55) + F.col("idx").cast("long") * 8 + number))
    first = addresses.groupBy("job_id").agg(F.min(packed).alias("m"))
    place = F.col("m") % (1 << 55)
    return first.select(
        "job_id", F.when(F.col("m") >= (1 << 55), "output").when(F.col("m").isNotNull(), "input").alias("side"),
        F.floor(place / 8).alias("idx"), F.get(F.array(*[F.lit(r) for r in REASONS]), (place % 8).cast("int")).alias("reason"))


def round_robin(idx: Column, workers: int) -> Column:
    return F.pmod(idx, F.lit(workers))


def batch_summary(results: DataFrame) -> DataFrame:
    """Per job: total, completed, failed. Whatever is not completed has failed."""
    done = F.count_if(F.col("status") == "completed")
    return results.groupBy("job_id").agg(
        F.count("*").alias("total"), done.alias("completed"), (F.count("*") - done).alias("failed")
    )


def worker_distribution(results: DataFrame, workers: int) -> DataFrame:
    """Completed items per job and worker, with a row for idle workers too."""
    mine = [F.count_if((F.col("status") == "completed") & (F.col("worker") == w)).alias(f"w{w}") for w in range(workers)]
    wide = results.groupBy("job_id").agg(*mine)
    return wide.select("job_id", F.posexplode(F.array(*[f"w{w}" for w in range(workers)])).alias("worker", "completed"))


def throughput(results: DataFrame, elapsed: Column, slots: int) -> DataFrame:
    """Per job: MB/s read, percentage of slot time spent processing, seconds per completed item."""
    done = F.col("status") == "completed"
    agg = results.groupBy("job_id").agg(
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(done, F.col("process_s"))), F.lit(0.0)).alias("busy"),
        F.count_if(done).alias("completed"),
        F.max(elapsed).alias("elapsed"),
    )
    ran = F.col("elapsed") > 0
    span = F.nullif(F.col("elapsed"), F.lit(0.0))
    return agg.select(
        "job_id",
        F.when(ran, F.col("bytes") / MB / span).otherwise(0.0).alias("mb_per_s"),
        F.when(ran, F.col("busy") / span / slots * 100).otherwise(0.0).alias("efficiency"),
        (F.col("busy") / F.greatest(F.col("completed"), F.lit(1))).alias("avg_s"),
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    """Successful, failed and skipped files per job."""
    ok = F.col("status") == "completed"
    return results.groupBy("job_id").agg(
        F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(F.col("skipped")).alias("skipped")
    )


def transfer_summary(results: DataFrame) -> DataFrame:
    """Per job: bytes of the successes, number of failures and the first error by item order."""
    ok = F.col("status") == "completed"
    sums = results.groupBy("job_id").agg(F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~ok).alias("failed"))
    first = first_rows(results.where(~ok).select("job_id", "idx", "error"), ["job_id"], [("idx", False)])
    return sums.join(first.select("job_id", F.col("error").alias("first_error")), "job_id", "left")


def queue_totals(assigned: DataFrame, workers: int) -> DataFrame:
    """Load per job and worker, zero for idle workers."""
    wide = assigned.groupBy("job_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("worker") == w, F.col("size"))), F.lit(0)).alias(f"w{w}") for w in range(workers)]
    )
    return wide.select("job_id", F.posexplode(F.array(*[f"w{w}" for w in range(workers)])).alias("worker", "load"))


def least_loaded(assigned: DataFrame) -> DataFrame:
    """Per job the worker with the fewest items, lowest id first."""
    counts = assigned.groupBy("job_id", "worker").agg(F.count("*").alias("n"))
    packed = F.col("n") * (1 << 20) + F.col("worker")  # one long, so that the minimum is a hash aggregate
    least = counts.groupBy("job_id").agg(F.min(packed).alias("m"))
    return least.select("job_id", (F.col("m") % (1 << 20)).cast(counts.schema["worker"].dataType).alias("worker"), F.floor(F.col("m") / (1 << 20)).alias("n"))


def primary_output(outputs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First output of every item, its columns after keys and order."""
    rest = [c for c in outputs.columns if c not in keys and c != order]
    return first_rows(outputs, keys, [(order, False)]).select(*keys, order, *rest)


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items without a finished row."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def tool_path(df: DataFrame) -> DataFrame:
    """Add ``path`` and ``error`` by tool and file kind; an unknown tool is a failed row."""
    spark = df.sparkSession
    dim = spark.createDataFrame(TOOL_PATHS, "tool string, kind string, path string")
    special = F.broadcast(dim.where("kind <> '*'"))  # fixed rows
    general = F.broadcast(dim.where("kind = '*'").select("tool", F.col("path").alias("_any")))
    kind = F.when(is_image(F.col("ext")), "image").when(is_video(F.col("ext")), "video").otherwise("other")
    return (
        df.withColumn("kind", kind)
        .join(special, ["tool", "kind"], "left")
        .join(general, "tool", "left")
        .withColumn("path", F.coalesce("path", "_any"))
        .withColumn("error", F.when(F.col("path").isNull(), F.concat(F.lit("Unknown tool: "), F.col("tool"))))
        .drop("_any")
    )


def download_once(items: DataFrame, fetched: DataFrame) -> DataFrame:
    """Give every item the outcome of the one fetch of its input; a failed fetch fails all of them.

    ``fetched`` has one row per distinct input: ``input_url, fetch_error, input_size``.
    """
    return join_split(items, fetched, ["input_url"], "left").withColumn(
        "status", F.when(F.col("fetch_error").isNull(), F.lit("ready")).otherwise(F.lit("failed"))
    )


def next_stage(jobs: DataFrame, outputs: DataFrame, step: int, tool: str) -> tuple[DataFrame, DataFrame]:
    """Outputs of a step as the next step's inputs, and an error row for every job that has none.

    The jobs are dealt over as many tasks as their number asks for.
    """
    tasks = tasks_for(jobs.sparkSession, jobs.count())
    jobs = dealt(jobs, tasks, "job_id") if tasks else jobs
    empty = jobs.join(outputs.select("job_id").distinct(), "job_id", "left_anti").withColumn(
        "error", F.lit(f"Pipeline step {step} ({tool}) produced no output files")
    )
    return outputs, empty


def recombine(ok: DataFrame, failed: DataFrame) -> DataFrame:
    """Success and failure rows as one list."""
    return ok.unionByName(failed, allowMissingColumns=True)


def retry_policies(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``base_s`` and ``multiplier`` by error code; 1 s doubling where a code has no policy."""
    dim = df.sparkSession.createDataFrame(RETRY_POLICIES, "pcode string, max_retries int, pbase double, pmult double")
    return (
        df.join(F.broadcast(dim.drop("max_retries")), F.col(code) == F.col("pcode"), "left")  # fixed rows
        .withColumn("base_s", F.coalesce("pbase", F.lit(1.0)))
        .withColumn("multiplier", F.coalesce("pmult", F.lit(2.0)))
        .drop("pcode", "pbase", "pmult")
    )


def attempt_resolution(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Outcome per item: the first success, the first error that must not be repeated, or exhaustion."""
    n = F.col("attempt")
    in_range = attempts.where(n <= max_attempts)
    agg = in_range.groupBy("item_id").agg(
        F.min(F.when(F.col("code").isNull(), n)).alias("won"),
        F.min(F.when(F.col("code").isNotNull() & ~F.col("retryable"), n)).alias("stopped"),
        F.count("*").alias("tried"), F.max("attempt").alias("last"),
    )
    big = F.lit(1 << 30)
    won, stopped = F.coalesce("won", big), F.coalesce("stopped", big)
    status = (
        F.when(won < stopped, "completed").when(stopped < big, "failed")
        .when(F.col("tried") >= max_attempts, "failed").otherwise("pending")
    )
    at = F.when(won < stopped, F.lit(None)).when(stopped < big, F.col("stopped")).otherwise(F.col("last"))
    settled = agg.select("item_id", status.alias("status"), F.least(won, stopped, F.col("tried")).cast("long").alias("attempts"), at.alias("attempt"))
    # the code is fetched by the number of its attempt, so that only numbers are aggregated
    codes = in_range.where(F.col("code").isNotNull()).select("item_id", "attempt", "code")
    told = first_rows(codes.join(settled.select("item_id", "attempt"), ["item_id", "attempt"]), ["item_id"], [("attempt", False)])
    return settled.drop("attempt").join(told.select("item_id", "code"), "item_id", "left")


def verify(objects: DataFrame, manifests: DataFrame, key: str = "key") -> DataFrame:
    """Check digest, then size, against the manifest; an object without one is accepted unverified."""
    m = manifests.select(key, "content_hash", "size_bytes", F.lit(True).alias("_has"))
    joined = objects.join(m, key, "left")
    expected_size = F.nullif(F.col("size_bytes"), F.lit(0))
    error = (
        F.when((F.coalesce("content_hash", F.lit("")) != "") & (F.col("hash") != F.col("content_hash")), "HASH_MISMATCH")
        .when(expected_size.isNotNull() & (F.col("size") != expected_size), "SIZE_MISMATCH")
    )
    return joined.withColumn("error", error).withColumn(
        "verified", F.coalesce("_has", F.lit(False)) & F.col("error").isNull()
    ).drop("_has", "content_hash", "size_bytes")
