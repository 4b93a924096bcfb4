"""Captions over files, word-by-word overlays, caption blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import join_split


def caption_cycle(files: DataFrame, captions: DataFrame, single: DataFrame) -> DataFrame:
    """Give every file of a job its caption: file k takes caption k modulo their number.

    ``files``: job_id, idx. ``captions``: job_id, pos, text. ``single``: job_id, text, for jobs without a list.
    Files meet captions on job and position, so a large job is spread over its captions, and what holds for a whole
    job meets a large job's files by broadcast.
    """
    counts = captions.groupBy("job_id").agg(F.count("*").alias("_n"))
    facts = counts.join(single.select("job_id", F.col("text").alias("_single")), "job_id", "full")
    keyed = join_split(files, facts, ["job_id"], "left")
    keyed = keyed.withColumn("pos", F.when(F.col("_n") > 0, F.pmod(F.col("idx"), F.col("_n")))).drop("_n")
    listed = captions.select("job_id", "pos", F.col("text").alias("_listed"))
    found = keyed.join(listed, ["job_id", "pos"], "left")
    return found.withColumn("text", F.coalesce("_listed", "_single", F.lit(""))).drop("_listed", "_single", "pos")


def word_overlays(overlays: DataFrame) -> DataFrame:
    """Split overlays marked ``word_by_word`` into timed chunks; others stay as they are.

    Columns: id, text, start, dur, word_by_word, per_chunk, word_dur, gap. Chunks that do not fit into the
    overlay's length shrink together.
    """
    chunks = X.word_chunks(F.col("text"), F.greatest(F.lit(1), F.least(F.lit(5), F.col("per_chunk"))))
    n = F.col("_n")
    df = overlays.withColumn("_chunks", F.when(F.col("word_by_word"), chunks)).withColumn("_n", F.size("_chunks"))
    total = F.greatest(F.lit(0.2), F.col("dur"))
    word = F.greatest(F.lit(0.08), F.least(F.lit(1.2), F.col("word_dur")))
    gap = F.greatest(F.lit(0.0), F.least(F.lit(0.5), F.col("gap")))
    used = n * word + F.greatest(n - 1, F.lit(0)) * gap
    df = df.withColumn("_ratio", F.when((n > 0) & (used > total), total / used))
    shrunk_word = F.when(F.col("_ratio").isNotNull(), F.greatest(F.lit(0.06), word * F.col("_ratio"))).otherwise(word)
    shrunk_gap = F.when(F.col("_ratio").isNotNull(), F.greatest(F.lit(0.0), gap * F.col("_ratio"))).otherwise(gap)
    df = df.withColumn("_word", shrunk_word).withColumn("_gap", shrunk_gap)
    whole = F.when(~F.col("word_by_word"), F.array(F.col("text"))).otherwise(F.col("_chunks"))
    rows = df.select("*", F.posexplode(whole).alias("_k", "_text"))
    split = F.col("word_by_word")
    keep = [c for c in overlays.columns if c not in ("id", "text", "start", "dur")]
    return rows.select(
        F.when(split, F.concat("id", F.lit("-w"), (F.col("_k") + 1).cast("string"))).otherwise(F.col("id")).alias("id"),
        F.col("_text").alias("text"),
        F.when(split, F.round(F.greatest(F.lit(0.0), F.col("start")) + F.col("_k") * (F.col("_word") + F.col("_gap")), 3))
        .otherwise(F.col("start")).alias("start"),
        F.when(split, F.round("_word", 3)).otherwise(F.col("dur")).alias("dur"),
        *keep,
    )


def block_size(lines: DataFrame) -> DataFrame:
    """Size of the caption of each picture from ``img_id, block, width, line_height, line_gap, block_gap``.

    One row per text line; a block is as wide as its widest line; several blocks are set apart by a gap.
    """
    blocks = lines.groupBy("img_id", "block").agg(
        F.max("width").alias("w"),
        (F.count("*") * F.max("line_height") + (F.count("*") - 1) * F.max("line_gap")).alias("h"),
        F.max("block_gap").alias("gap"),
    )
    return blocks.groupBy("img_id").agg(
        F.floor(F.max("w")).alias("width"),
        (F.sum("h") + F.when(F.count("*") > 1, F.max("gap")).otherwise(0)).alias("height"),
    )
