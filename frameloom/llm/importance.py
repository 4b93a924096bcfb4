"""Quality by importance resampling.

Two generative models of hashed words and word pairs, one of the target texts and one of all (raw) texts, give each document
the log of its importance weight: the sum of the log ratios of its n-grams. A Gumbel draw is added, and the documents with
the k greatest sums are kept, which samples k documents without replacement in proportion to their weights.

Counts go over all documents, added up inside each task and then by bucket; the models are two tables of 2**16 rows,
whatever the data. The k-th greatest sum is found by histograms that are refined around it, so nothing is sorted.

A null or empty text has no n-gram and weight 1. The draw depends on the id (null counts as a value), so runs agree and
repeated rows are kept or dropped together; rows that tie with the k-th are kept. Without target texts every weight is 1.
Further columns travel in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.staging import bounded, stage
from frameloom.llm.textbytes import Words, annotate, mix, parts, sums_per_text

BITS = 16
BINS = 4096
FEW = 10_000
_TWO = np.uint64(0xD6E8FEB86659FD93)


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and of each word with the one behind it (-1 at the end of a text)."""
    h = words.hashes()
    shift = np.uint64(64 - BITS)
    pair = np.full(len(h), -1, dtype=np.int64)
    if len(h) > 1:
        pair[:-1] = (mix(h[:-1] * _TWO + h[1:]) >> shift).astype(np.int64)
        ends = words.bounds[1:][np.diff(words.bounds) > 0] - 1
        pair[ends] = -1
    return (h >> shift).astype(np.int64), pair


def models(docs: DataFrame, text: str = "text", target: str = "target", smooth: float = 1.0) -> np.ndarray:
    """Log ratio of target and raw probability by bucket; ``target`` is a boolean column of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, goal = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            wanted, at = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), 0
            for words in parts(batch.column(0), lower=True):
                one, two = grams(words)
                own = np.repeat(wanted[at: at + len(words.bounds) - 1], np.diff(words.bounds))
                at += len(words.bounds) - 1
                for bucket, mine in ((one, own), (two[two >= 0], own[two >= 0])):
                    raw += np.bincount(bucket, minlength=1 << BITS)
                    goal += np.bincount(bucket[mine], minlength=1 << BITS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(goal[some])], names=["bucket", "raw", "goal"])

    rows = docs.select(F.col(f"`{text}`"), F.col(f"`{target}`")).mapInArrow(count, "bucket long, raw long, goal long")
    got = rows.groupBy("bucket").agg(F.sum("raw"), F.sum("goal")).toArrow()
    bucket, raw_n, goal_n = (got.column(i).to_numpy() for i in range(3))
    raw, goal = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[bucket], goal[bucket] = raw_n, goal_n
    if not goal.sum():
        return np.zeros(1 << BITS)
    part = lambda c: np.log((c + smooth) / (c.sum() + smooth * len(c)))
    return part(goal) - part(raw)


def gumbel(doc_id: str, seed: str = "gumbel") -> Column:
    """A standard Gumbel draw that depends on the id."""
    u = (F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.lit(seed)), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th greatest value of a stored table by refined histograms: driver and tasks see ``BINS`` rows at a time."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return float("inf")
    above = 0  # rows over hi
    while True:
        inside = rows.where((F.col(column) >= lo) & (F.col(column) <= hi))
        width = (hi - lo) / BINS
        if not width > 0 or lo + width == lo:
            return lo
        spot = F.least(F.floor((F.col(column) - lo) / width), F.lit(BINS - 1))
        bins = inside.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if above + b["n"] >= k:
                break
            above += b["n"]
        else:
            return min(b["lo"] for b in bins)
        lo, hi = b["lo"], b["hi"]
        if lo == hi:
            return lo
        if b["n"] <= FEW:
            few = inside.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).toArrow().column(0).to_numpy()
            return float(np.sort(few)[::-1][k - above - 1])


def resample(docs: DataFrame, targets: DataFrame, share: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, log_weight, draw (weight and Gumbel noise) and kept for every document; ``targets`` has the ids of the target texts."""
    goal = stage(targets.select(F.col(f"`{doc_id}`").alias("wanted")).where("wanted is not null").distinct().withColumn("target", F.lit(True)), "targets")
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = body.join(bounded(goal), F.col("doc_id") == F.col("wanted"), "left").select("text", "target")
    held = docs.sparkSession.sparkContext.broadcast(models(marked))

    def measure():
        ratio = held.value

        def derive(column: pa.Array) -> list[pa.Array]:
            out = [np.zeros(0)]
            for words in parts(column, lower=True):
                one, two = grams(words)
                out.append(sums_per_text(ratio[one] + np.where(two >= 0, ratio[two], 0), words.bounds))
            return [pa.array(np.concatenate(out))]

        return derive

    scored = annotate(body, measure, "log_weight double").select("row.doc_id", "log_weight")
    drawn = stage(scored.withColumn("draw", F.col("log_weight") + gumbel("doc_id")), "draws")
    edge = kth_greatest(drawn, "draw", round(share * drawn.count()))
    return drawn.withColumn("kept", F.col("draw") >= edge)
