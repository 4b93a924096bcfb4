"""Ordered operations that stay balanced when one key holds a large share of the rows.

A plain window puts all rows of a key into one task. Here the rows of a key are cut into chunks by a coarse,
order-preserving expression given by the caller: a window inside each chunk, one summary row per chunk, a
scan over the narrow summaries, and a join that brings the carried value back. The wide rows are shuffled
once, and a re-run task always cuts them the same way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


#: Rows that one task sorts or folds at most, unless a key or chunk has more of them.
TASK_ROWS = 1 << 18


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Number of tasks for so many rows; none where the session's own number is enough."""
    tasks = math.ceil(rows / TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """Spread the rows by columns over ``tasks`` tasks, or the session's own number."""
    return df.repartition(tasks, *by) if tasks else df.repartition(*by)


def by_chunk(df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], tasks: int | None = None) -> DataFrame:
    """Add ``_chunk`` and spread the rows by key and chunk.

    The repartition is explicit: a window alone would accept rows that are already partitioned by the key,
    and then a heavy key would stay in one task.
    """
    chunk = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(coarse)])
    return dealt(df.withColumn("_chunk", chunk), tasks, *keys, "_chunk")


def chunk_counts(df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], tasks: int | None = None) -> DataFrame:
    """Rows per key and chunk, counted before the rows move: only a few rows per chunk are shuffled.

    With ``tasks`` the keys and chunks are dealt over so many tasks, and the counts then by key.
    """
    chunk = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(coarse)])
    narrow = df.withColumn("_chunk", chunk).select(*keys, "_chunk")
    narrow = narrow.repartition(tasks, *keys, "_chunk") if tasks else narrow
    counts = narrow.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    return counts.repartition(tasks, *keys) if tasks else counts


def sequence_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], coarse: Sequence[Column], out: str = "idx", rows: int | None = None
) -> DataFrame:
    """Position of each row within its key, from 0, in the given total order.

    The tuple ``coarse`` must not decrease along ``order``. ``rows`` is the number of rows, if it is known; they are
    counted otherwise. The number of tasks follows it, so that the memory of one does not grow with the table.
    """
    keys = list(keys)
    tasks = tasks_for(df.sparkSession, df.count() if rows is None else rows)
    part = by_chunk(df, keys, coarse, tasks)
    local = part.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunk_counts(df, keys, coarse, tasks)
        .withColumn("_off", F.sum("_n").over(before))
        .where(F.col("_off").isNotNull())  # the first chunk of a key carries nothing in
        .select(*keys, "_chunk", "_off")
    )
    return (
        local.join(offsets, keys + ["_chunk"], "left")
        .withColumn(out, (F.col("_pos") + F.coalesce("_off", F.lit(0))).cast("long"))
        .drop("_chunk", "_pos", "_off")
    )


def with_halo(df: DataFrame, pos: str, size: int, before: int, after: int) -> DataFrame:
    """Assign rows at integer position ``pos`` to chunks of ``size`` and copy the rows near a border.

    ``before`` / ``after`` are how far a later window looks back / ahead. Adds ``_chunk`` and ``_core``;
    keep only ``_core`` rows after the window has run.
    """
    first = F.greatest(F.floor((F.col(pos) - after) / size), F.lit(0))
    last = F.floor((F.col(pos) + before) / size)
    return (
        df.withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_core", F.col("_chunk") == F.floor(F.col(pos) / size))
    )


def _bucket(value: Column, edges: Column) -> Column:
    """How many of the sorted edges are not above the value, found among every sixteenth first."""
    not_above = lambda e: e <= value
    group = F.size(F.filter(F.filter(edges, lambda e, i: i % 16 == 0), not_above))
    inside = F.size(F.filter(F.slice(edges, F.greatest((group - 1) * 16 + 1, F.lit(1)), F.lit(16)), not_above))
    return F.when(group > 0, (group - 1) * 16 + inside).otherwise(0).cast("long")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], resolution: int = 256
) -> DataFrame:
    """Exact linear-interpolated quantiles per key without gathering a key's values in one task.

    Equal values collapse to counts first. A mergeable sketch of the different values chooses the edges of buckets that
    hold about as many of them each, however they are spread; exact counts of the buckets then locate the ranks, and only
    the buckets that hold a wanted rank are sorted. The sketch's error moves edges, not results.
    """
    keys = list(keys)
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")))
    cuts = F.array(*[F.lit(k / resolution) for k in range(1, resolution)]) if resolution > 1 else F.array(F.lit(0.5))
    span = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"), F.count("*").alias("_many"), F.percentile_approx(value, cuts, F.lit(max(1000, 20 * resolution))).alias("_edges"))
    bucketed = join_split(counts, span, keys, many="_many").withColumn("_b", _bucket(F.col(value), F.col("_edges"))).drop("_edges", "_rows")
    bucketed = bucketed.repartition(*keys, "_b")  # the join may have left a heavy key in one partition
    span = span.select(*keys, "_rows")
    up_to = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        bucketed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.coalesce(F.sum("_bn").over(up_to), F.lit(0)))
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    ranks = (
        span.where(F.col("_rows") > 0)
        .select(*keys, F.explode(wanted).alias("_w"), F.col("_rows"))
        .select(*keys, F.col("_w.name").alias("_name"), (F.col("_w.p") * (F.col("_rows") - 1)).alias("_at"))
        .withColumn("_rank", F.explode(F.array(F.floor("_at"), F.ceil("_at"))))
    )
    located = hist.join(ranks, keys).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bn"))
    )
    within = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    opened = (
        bucketed.join(located.select(*keys, "_b", "_before").distinct(), keys + ["_b"])
        .withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .select(*keys, "_b", F.col(value).alias("_v"), "_first", "_n")
    )
    picked = located.join(opened, keys + ["_b"]).where(
        (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n"))
    )
    frac = F.col("_at") - F.floor("_at")
    per_prob = picked.groupBy(*keys, "_name").agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.max(frac).alias("_f")
    ).withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f"))
    return per_prob.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs]
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first row of each key by columns (name, descending), which are numbers or times and not null.

    Only keys and numbers are in the aggregates, so that they hash and combine before the shuffle; the other columns
    are fetched by a join on what was found. Of rows that are equal in all order columns the least stays.
    """
    keys, found = list(keys), df
    for name, down in order:
        best = found.groupBy(*keys).agg((F.max if down else F.min)(name).alias(name))
        found = found.join(best, [*keys, name])
    names = [n for n, _ in order]
    rest = [c for c in df.columns if c not in keys and c not in names]
    if rest:
        tied = found.groupBy(*keys, *names).agg(F.array_min(F.collect_set(F.struct(*rest))).alias("_rest"))
        found = tied.select(*keys, *names, "_rest.*")
    else:
        found = found.distinct()
    return found.select(*df.columns)


def join_split(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner", many: str | None = None, share: int = 1000) -> DataFrame:
    """Join rows with ``facts``, one row per key, without sending a heavy key to one task.

    Keys that hold more than one in ``share`` of the rows, which are fewer than ``share``, meet their facts by broadcast; all
    others by shuffle. ``many`` names a column of ``facts`` with the number of rows of each key, if it is known, and is dropped.
    """
    keys = list(keys)
    if many:
        facts = cut_lineage(facts)
        sizes, facts = facts.select(*keys, F.col(many).alias("_many")), facts.drop(many)
    else:
        sizes = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_many")))
    total = sizes.agg(F.sum("_many")).first()[0] or 0
    heavy = sizes.where(F.col("_many") > total / share).select(*keys)
    if heavy.isEmpty():
        return df.join(facts, keys, how)
    heavy = F.broadcast(heavy)  # fewer than ``share`` rows
    loud = df.join(heavy, keys, "left_semi").join(F.broadcast(facts.join(heavy, keys, "left_semi")), keys, how)
    return loud.unionByName(df.join(heavy, keys, "left_anti").join(facts, keys, how))
