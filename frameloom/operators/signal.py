"""Rhythm in sampled signals: ``src, i, v`` with i counting from 0 without gaps.

A source may hold most of the samples, so nothing here gathers one. Sums and extremes combine before the
shuffle; neighbour access runs in chunks that carry a copied margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dimensions import SMOOTH_KERNEL
from ..session import cut_lineage
from .ordered import exact_quantiles, with_halo

CHUNK = 1 << 16
WALK = 1 << 10  # samples whose peaks are walked as one array
FAN = 32  # chunk maps composed at once
MIN_BPM, MAX_BPM = 68.0, 176.0


def _in_chunks(df: DataFrame, size: int, before: int, after: int, fn) -> DataFrame:
    """Add columns from ``fn(window) -> {name: column}`` computed in source order."""
    spread = with_halo(df, "i", size, before, after).repartition("src", "_chunk")
    order = Window.partitionBy("src", "_chunk").orderBy("i")
    return spread.withColumns(fn(order)).where("_core").drop("_chunk", "_core")


def centred(df: DataFrame) -> DataFrame:
    """Subtract each source's mean; sources that are silent after that drop out."""
    stats = df.groupBy("src").agg(F.avg("v").alias("_m"), F.max("v").alias("_hi"), F.min("v").alias("_lo"))
    loud = stats.where(F.greatest(F.abs(F.col("_hi") - F.col("_m")), F.abs(F.col("_lo") - F.col("_m"))) >= 1e-5)
    return df.join(loud.select("src", "_m"), "src").withColumn("v", F.col("v") - F.col("_m")).drop("_m")


def rms_envelope(df: DataFrame, frame: int = 441, hop: int = 220, min_frames: int = 64) -> DataFrame:
    """Root mean square per frame, ``src, i, v`` with i now the frame. A sample goes to every frame over it."""
    first = F.greatest(F.ceil((F.col("i") - frame + 1) / hop), F.lit(0))
    frames = (
        df.withColumn("_k", F.explode(F.sequence(first, F.floor(F.col("i") / hop))))
        .groupBy("src", F.col("_k").alias("i")).agg(F.avg(F.col("v") * F.col("v")).alias("_p"), F.count("*").alias("_n"))
        .where(F.col("_n") == frame).select("src", "i", F.sqrt(F.col("_p") + 1e-9).alias("v"))
    )
    enough = frames.groupBy("src").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_frames).select("src")
    return frames.join(enough, "src", "left_semi")


def onset(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rise from the sample before, falls count as zero, the first sample too."""
    return _in_chunks(df, chunk, 1, 0, lambda w: {"v": F.greatest(F.col("v") - F.lag("v", 1).over(w), F.lit(0.0))}).fillna(0.0, ["v"])


def fir_smooth(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Symmetric seven-tap smoothing, zero outside the signal."""
    total = sum(SMOOTH_KERNEL)

    def taps(w) -> dict[str, Column]:
        out = F.col("v") * (SMOOTH_KERNEL[3] / total)
        for n in (1, 2, 3):
            k = SMOOTH_KERNEL[3 + n] / total
            out = out + (F.coalesce(F.lag("v", n).over(w), F.lit(0.0)) + F.coalesce(F.lead("v", n).over(w), F.lit(0.0))) * k
        return {"_s": out}

    return _in_chunks(df, chunk, 3, 3, taps).select("src", "i", F.col("_s").alias("v"))


def standardise(df: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation per source; constant sources drop out."""
    stats = df.groupBy("src").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_d")).where(F.col("_d") >= 1e-7)
    return df.join(stats, "src").select("src", "i", ((F.col("v") - F.col("_m")) / F.col("_d")).alias("v"))


def onset_strength(df: DataFrame, frame: int, hop: int, min_frames: int = 64, chunk: int = CHUNK) -> DataFrame:
    """Standardised smooth onset of a sampled signal."""
    return standardise(fir_smooth(onset(rms_envelope(centred(df), frame, hop, min_frames), chunk), chunk))


def autocorr(df: DataFrame, lag_min: int, lag_max: int, chunk: int = CHUNK) -> DataFrame:
    """``src, lag, ac``: sums of products at each lag. Lags are columns of one window pass, not joined rows."""
    lags = range(lag_min, lag_max + 1)
    ahead = _in_chunks(df, chunk, 0, lag_max, lambda w: {f"_l{n}": F.lead("v", n).over(w) for n in lags})
    sums = ahead.groupBy("src").agg(*[F.coalesce(F.sum(F.col("v") * F.col(f"_l{n}")), F.lit(0.0)).alias(f"_a{n}") for n in lags])
    rows = F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"_a{n}").alias("ac")) for n in lags])
    return sums.select("src", F.inline(rows))


def lag_range(rate: float) -> tuple[int, int]:
    """Lags of the tempo range at an envelope rate."""
    return max(1, int(rate * 60.0 / MAX_BPM)), int(rate * 60.0 / MIN_BPM)


def tempo(ac: DataFrame, rate: float) -> DataFrame:
    """``src, lag, bpm, confidence``: the strongest lag, and how far it stands out among the lags."""
    best = ac.groupBy("src").agg(
        F.max_by(F.struct("lag", "ac"), F.struct("ac", (-F.col("lag")).alias("o"))).alias("b"),
        F.percentile("ac", F.lit(0.5)).alias("_mid"), F.percentile("ac", F.lit(0.9)).alias("_high"),  # one row per lag
    )
    spread = F.greatest(F.lit(1e-6), F.col("_high") - F.col("_mid"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("b.ac") - F.col("_mid")) / spread))
    return best.select("src", F.col("b.lag").alias("lag"), (F.lit(60.0 * rate) / F.col("b.lag")).alias("bpm"), sure.alias("confidence"))


def _through(maps: Column, first: Column, start: Column) -> Column:
    """Block carried out of consecutive chunks from ``first`` on; a chunk without peaks carries none."""

    def step(s: Column, m: Column) -> Column:
        here = F.when(m["c"] == s["next"], s["block"]).otherwise(0)
        return F.struct((m["c"] + 1).alias("next"), F.element_at(m["ends"], (here + 1).cast("int")).alias("block"))

    begin = F.struct(first.cast("long").alias("next"), start.cast("long").alias("block"))
    return F.aggregate(maps, begin, step, lambda s: F.when(s["next"] == first + FAN, s["block"]).otherwise(0).cast("long"))


def _starts(maps: Column, first: Column, start: Column) -> Column:
    """Chunk and block carried into it, for each of at most FAN consecutive chunks."""

    def step(s: Column, m: Column) -> Column:
        here = F.when(m["c"] == s["next"], s["block"]).otherwise(0).cast("long")
        return F.struct(
            (m["c"] + 1).alias("next"), F.element_at(m["ends"], (here + 1).cast("int")).alias("block"),
            F.array_append(s["out"], F.struct(m["c"].alias("c"), here.alias("start"))).alias("out"))

    begin = F.struct(first.cast("long").alias("next"), start.cast("long").alias("block"), F.array().cast("array<struct<c:bigint,start:bigint>>").alias("out"))
    return F.aggregate(maps, begin, step, lambda s: s["out"])


def carried_blocks(chunks: DataFrame, min_gap: int) -> DataFrame:
    """``src, c, start``: the block that enters each chunk. ``chunks``: stored src, c, ends, the block that leaves for each that enters.

    Maps are composed over groups of FAN chunks, groups of those, and so on until one group holds a source; the blocks then
    pass down the same groups. No group holds more than FAN maps, and a source of n chunks takes log(n) rounds.
    """
    top = chunks.agg(F.max("c")).first()[0] or 0
    levels, maps, first = [], chunks.select("src", "c", "ends"), F.col("p") * FAN
    while True:
        grouped = maps.groupBy("src", F.floor(F.col("c") / FAN).alias("p")).agg(F.array_sort(F.collect_list(F.struct("c", "ends"))).alias("maps"))
        levels.append(cut_lineage(grouped))
        if top < FAN:
            break
        top //= FAN
        through = F.transform(F.sequence(F.lit(0), F.lit(min_gap - 1)), lambda e: _through(F.col("maps"), first, e))
        maps = levels[-1].select("src", F.col("p").alias("c"), through.alias("ends"))
    starts = levels[-1].select("src", F.inline(_starts(F.col("maps"), first, F.lit(0))))
    for level in reversed(levels[:-1]):
        parents = level.join(starts.select("src", F.col("c").alias("p"), "start"), ["src", "p"])
        starts = parents.select("src", F.inline(_starts(F.col("maps"), first, F.col("start"))))
    return starts


def peaks(df: DataFrame, threshold: DataFrame, min_gap: int, chunk: int = CHUNK) -> DataFrame:
    """``src, i`` of local maxima at or above ``threshold(src, thr)``, taken greedily at least ``min_gap`` apart.

    Taking a peak blocks the samples after it, which carries over chunk borders. A chunk turns the block it
    starts with into the block it ends with; these maps are composed over the chunks of a source in rounds
    (``carried_blocks``). Chunks then take their peaks independently.
    """
    sides = _in_chunks(df, chunk, 1, 1, lambda w: {"_p": F.lag("v", 1).over(w), "_n": F.lead("v", 1).over(w)})
    found = sides.join(threshold, "src").where((F.col("v") >= F.col("thr")) & (F.col("v") >= F.col("_p")) & (F.col("v") >= F.col("_n")))
    span = max(min(chunk, WALK), min_gap)
    at = found.groupBy("src", F.floor(F.col("i") / span).alias("c")).agg(F.array_sort(F.collect_list("i")).alias("at"))
    here = F.col("c") * span

    def walk(start: Column) -> Column:
        return F.aggregate("at", start.cast("long"), lambda b, i: F.when(i >= b, i + min_gap).otherwise(b))

    ends = F.transform(F.sequence(F.lit(0), F.lit(min_gap - 1)), lambda e: F.greatest(walk(here + e) - here - span, F.lit(0).cast("long")))
    chunks = cut_lineage(at.withColumn("ends", ends))
    none = F.array().cast("array<bigint>")
    taken = F.aggregate(
        "at", F.struct((here + F.col("start")).cast("long").alias("b"), none.alias("out")),
        lambda s, i: F.struct(
            F.when(i >= s["b"], i + min_gap).otherwise(s["b"]).alias("b"),
            F.when(i >= s["b"], F.array_append(s["out"], i)).otherwise(s["out"]).alias("out")),
        lambda s: s["out"],
    )
    return chunks.select("src", "c", "at").join(carried_blocks(chunks, min_gap), ["src", "c"]).select("src", F.explode(taken).alias("i"))


def interval_regularity(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Peaks per source, their median distance, and 1 - deviation / median. ``found``: src, i.

    Distances are whole numbers: they are counted per value before their median is taken.
    """
    spread = found.withColumn("_chunk", F.floor(F.col("i") / chunk)).repartition("src", "_chunk")
    inside = spread.withColumn("_prev", F.lag("i").over(Window.partitionBy("src", "_chunk").orderBy("i")))
    ends = spread.groupBy("src", "_chunk").agg(F.max("i").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy("src").orderBy("_chunk"))).select("src", "_chunk", "_before")
    gaps = inside.join(ends, ["src", "_chunk"], "left").select("src", (F.col("i") - F.coalesce("_prev", "_before")).alias("gap"), "i")
    counted = gaps.groupBy("src", "gap").agg(F.count("*").alias("_n"), F.min("i").alias("_first"))
    out = counted.groupBy("src").agg(
        F.sum("_n").alias("peaks"), F.min("_first").alias("first"), F.expr("percentile(gap, 0.5, if(gap is null, 0, _n))").alias("median_gap"),
        (F.sum(F.col("gap") * F.col("gap") * F.col("_n")) / F.sum(F.when(F.col("gap").isNotNull(), F.col("_n")))).alias("_sq"),
        (F.sum(F.col("gap") * F.col("_n")) / F.sum(F.when(F.col("gap").isNotNull(), F.col("_n")))).alias("_mean"),
    )
    deviation = F.sqrt(F.greatest(F.col("_sq") - F.col("_mean") * F.col("_mean"), F.lit(0.0)))
    regular = 1.0 - F.least(F.lit(1.0), deviation / F.greatest(F.lit(1e-6), F.col("median_gap")))
    return out.select("src", "peaks", "first", "median_gap", regular.alias("regularity"))


def best_phase(df: DataFrame, lags: DataFrame) -> DataFrame:
    """``src, phase``: the offset within one period with the greatest summed onset, the first of equals.

    ``lags``: src, lag. At least eight periods count, then as many as fit whole.
    """
    n = df.groupBy("src").agg((F.max("i") + 1).alias("_n"))
    periods = lags.join(n, "src").withColumn("_beats", F.greatest(F.lit(8), F.floor(F.col("_n") / F.col("lag"))))
    placed = df.join(periods, "src").where(F.floor(F.col("i") / F.col("lag")) < F.col("_beats"))
    scores = placed.groupBy("src", F.pmod(F.col("i"), F.col("lag")).alias("phase")).agg(F.sum("v").alias("score"))
    return scores.groupBy("src").agg(F.max_by("phase", F.struct("score", (-F.col("phase")).alias("o"))).alias("phase"))


def profile_amount(df: DataFrame, confidence: DataFrame) -> DataFrame:
    """``src, amount, transient``: beat strength from confidence and punch, and share of strong onsets."""
    q = exact_quantiles(df, ["src"], "v", {"p50": 0.5, "p93": 0.93, "p95": 0.95})
    dense = df.join(q.select("src", "p93"), "src").groupBy("src").agg(F.avg((F.col("v") > F.col("p93")).cast("double")).alias("_share"))
    punch = F.greatest(F.lit(0.0), F.col("p95") - F.col("p50"))
    amount = 0.16 + F.col("confidence") * 0.54 + F.least(F.lit(1.0), punch / 2.5) * 0.18
    return q.join(dense, "src").join(confidence.select("src", "confidence"), "src").select(
        "src", F.greatest(F.lit(0.12), F.least(F.lit(0.95), amount)).alias("amount"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_share") * 18.0)).alias("transient"))


def band_energy(df: DataFrame, rate: float, size: int = 1024, hop: int = 512, low=(40.0, 220.0), high=(1800.0, 6500.0), min_frames: int = 9) -> DataFrame:
    """``src, low, high``: share of the summed Hann-windowed magnitudes in two frequency bands, times 6 and 10.

    A frame is a bounded array of ``size`` samples; its transform runs in numpy on batches of frames. Fewer
    than ``min_frames`` frames give no result.
    """
    first = F.greatest(F.ceil((F.col("i") - size + 1) / hop), F.lit(0))
    frames = (
        df.withColumn("_k", F.explode(F.sequence(first, F.floor(F.col("i") / hop))))
        .groupBy("src", "_k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_f"))
        .where(F.size("_f") == size).select("src", F.transform("_f", lambda s: s["v"]).alias("frame"))
    )

    def spectra(batches):
        import numpy as np
        import pandas as pd

        window = np.hanning(size)
        freq = np.fft.rfftfreq(size, d=1.0 / rate)
        in_low, in_high = (freq >= low[0]) & (freq <= low[1]), (freq >= high[0]) & (freq <= high[1])
        for batch in batches:
            if batch.empty:
                continue
            mag = np.abs(np.fft.rfft(np.stack(batch["frame"].to_numpy()) * window, axis=1))
            yield pd.DataFrame({"src": batch["src"], "l": mag[:, in_low].sum(axis=1), "h": mag[:, in_high].sum(axis=1), "t": mag.sum(axis=1)})

    sums = frames.mapInPandas(spectra, "src string, l double, h double, t double").groupBy("src").agg(
        F.sum("l").alias("l"), F.sum("h").alias("h"), F.sum("t").alias("t"), F.count("*").alias("n"))
    share = lambda c, k: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / (F.col("t") + 1e-9) * k)), 3)
    return sums.where(F.col("n") >= min_frames).select("src", share("l", 6.0).alias("low"), share("h", 10.0).alias("high"))


def rhythm_profile(df: DataFrame, rate: float, frame: int, hop: int, min_frames: int = 64, chunk: int = CHUNK) -> DataFrame:
    """``src, bpm, amount, phase_s, confidence, low, high, transient``; sources without a steady beat drop out.

    Tempo from the autocorrelation; where that is weak, from the distances of strong peaks.
    """
    env_rate = rate / hop
    # one row per hop of samples, read by six branches below
    strength = cut_lineage(onset_strength(df, frame, hop, min_frames, chunk))
    estimate = tempo(autocorr(strength, *lag_range(env_rate), chunk), env_rate)
    thr = exact_quantiles(strength, ["src"], "v", {"thr": 0.85})
    gap = max(2, int(env_rate * 60.0 / 196.0))
    steady = interval_regularity(peaks(strength, thr, gap, chunk), chunk)
    both = estimate.join(steady, "src", "left")
    by_peaks = F.lit(60.0 * env_rate) / F.col("median_gap")
    fits = F.coalesce((F.col("peaks") >= 4) & (F.col("median_gap") > 1e-6) & by_peaks.between(MIN_BPM, MAX_BPM), F.lit(False))
    use = (~F.col("bpm").between(MIN_BPM, MAX_BPM) | (F.col("confidence") < 0.07)) & fits
    chosen = both.select(
        "src", "lag", F.when(use, by_peaks).otherwise(F.col("bpm")).alias("bpm"),
        F.when(use, F.greatest("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("regularity"))))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(use, F.col("first") / env_rate).alias("_peak_s"),
    ).where(F.col("bpm").between(MIN_BPM, MAX_BPM))
    phase = best_phase(strength, chosen.select("src", "lag"))
    amount = profile_amount(strength, chosen)
    bands = band_energy(centred(df), rate)
    return (
        chosen.join(phase, "src").join(amount, "src").join(bands, "src", "left")
        .select(
            "src", F.round("bpm", 2).alias("bpm"), F.round("amount", 3).alias("amount"),
            F.round(F.when(F.col("_peak_s") > 1e-9, F.col("_peak_s")).otherwise(F.col("phase") / env_rate), 4).alias("phase_s"),
            F.round("confidence", 3).alias("confidence"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"),
            F.round("transient", 3).alias("transient"))
    )
