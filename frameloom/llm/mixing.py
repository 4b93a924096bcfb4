"""Mixing sources to target weights by nested hash thresholds.

Sizes are summed by source and hash bucket, cumulative sums find the bucket in which a source's budget ends, and only that
bucket is refined, four times by 12 bits. A document is then taken by comparing its hash with its source's threshold:
nothing is sorted, and a larger budget always takes a superset. Histograms hold at most 4,096 rows per source, and sums
combine before the shuffle, so a source with a third of all rows is no different from others. The table of sources has one
row per source (a dimension that the caller's weights refer to); everything else is as large as the buckets.

Documents without text have size 0 and are never taken. A null source is a source, the last one. Hashes come from
``doc_id`` alone (null counts as a value), so repeated rows are taken together. An empty table gives an empty result.
Targets are never above ``cap`` times a source, and no document is taken more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.quality_rules import SPACES
from frameloom.llm.staging import keep_row, stage

STEP = 12
LEVELS = 4


def word_count(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES), "")).cast("long")


def doc_hash(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """48 bits that both this engine and plain SQL can state."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Source, its size, and its target: ``share`` of all sizes by weight, capped, the excess shared again by weight.

    In order of size over weight the capped sources come first. With the first k capped, the level is what is left over
    the other weights; of the levels at which the next source fits, the first one is the highest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight.cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = per.select(
        "*", F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"), F.sum("weight").over(after).alias("open"),
    ).withColumn("level", (share * F.col("total") - cap * F.col("capped")) / F.col("open"))
    fits = cap * F.col("source_size") >= F.col("level") * F.col("weight")
    chosen = level.withColumn("chosen", F.max(F.when(fits, F.col("level"))).over(every))
    target = F.least(cap * F.col("source_size"), F.coalesce("chosen", F.lit(float("inf"))) * F.col("weight"))
    return chosen.select("source", "source_size", target.alias("target"))


def _same(a: str, b: str = "source") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(sizes: DataFrame, **options) -> DataFrame:
    """Per source: size, target, full rounds, and the hash below which a document is taken once more.

    ``sizes`` has source, size and h; it should be a stored table, since it is read once per level.
    """
    goal = targets(sizes, **options)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("rounds", rounds.cast("long"))
    # left: what the hash prefix still has to fill; path: the prefix bits found so far
    state = stage(goal.select(F.col("source").alias("s"), "source_size", "target", "rounds", F.lit(0).cast("long").alias("path"),
                              (F.col("target") - F.col("rounds") * F.col("source_size")).alias("left"),
                              F.lit(0.0).alias("found")), "mix-goal")
    for level in range(1, LEVELS + 1):
        shift = STEP * (LEVELS - level)
        inside = sizes.select("source", "size", F.shiftright("h", shift + STEP).alias("up"), F.shiftright("h", shift).alias("bucket"))
        spots = F.broadcast(state) if state.count() <= 100_000 else state
        hist = (inside.join(spots, _same("source", "s") & (F.col("up") == F.col("path")))
                .groupBy("source", "bucket").agg(F.sum("size").alias("filled")))
        order = Window.partitionBy("source").orderBy("bucket")
        upto = hist.withColumn("upto", F.sum("filled").over(order))
        upto = upto.select(F.col("source").alias("source"), "bucket", "filled", "upto")
        at = upto.join(F.broadcast(state.select("s", "left")) if state.count() <= 100_000 else state.select("s", "left"), _same("source", "s"))
        hit = (at.where(F.col("upto") > F.col("left")).groupBy("source")
               .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("filled")).alias("below"), "filled")).alias("hit")))
        state = stage(
            state.join(hit, _same("s"), "left").select(
                "s", "source_size", "target", "rounds",
                F.coalesce(F.col("hit.bucket"), F.lit(1 << (STEP * level))).cast("long").alias("path"),
                (F.col("left") - F.coalesce(F.col("hit.below"), F.lit(0))).alias("left"),
                F.coalesce(F.col("hit.filled"), F.lit(0)).cast("double").alias("found"),
            ), f"mix-level{level}")
    nearer = F.when((F.col("left") * 2 >= F.col("found")) & (F.col("left") > 0), 1).otherwise(0)
    return state.select("s", "source_size", "target", "rounds", (F.col("path") + nearer).alias("cut"))


def with_takes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, h and more) with source_size, target and ``takes``, how many times the mix uses each row."""
    side = F.broadcast(plan) if plan.count() <= 100_000 else plan
    joined = rows.join(side, _same("source", "s"), "left")
    return joined.withColumn("takes", F.col("rounds") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).drop("s", "rounds", "cut")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The slim table that all levels read: doc_id, source, size, h."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), doc_hash(doc_id).alias("h"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and takes of every document."""
    sizes = stage(sized(docs), "mix-sizes")
    return with_takes(sizes, thresholds(sizes, **options))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``; a document taken twice appears twice."""
    sizes = stage(sized(docs), "mix-sizes")
    plan = thresholds(sizes, **options)
    rows = keep_row(docs, F.col("source").alias("source"), doc_hash().alias("h"), word_count().alias("size"))
    taken = with_takes(rows, plan).where((F.col("takes") > 0) & (F.col("size") > 0))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("takes")))).select("row.*")
