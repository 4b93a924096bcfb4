"""Config tables: presets, keyed parameter variation, editor parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import dimensions as D
from ..functions.keyed import uniform, vary


def preset_sections(spark) -> DataFrame:
    """``mode, section, key, factor``: what a preset multiplies. Keys not listed have no row."""
    rows = []
    for mode, spatial, tonal, visual, variation in D.INTENSITY_PRESETS:
        rows += [(mode, "spatial", k, spatial) for k in D.SPATIAL_KEYS]
        rows += [(mode, "tonal", k, tonal) for k in D.TONAL_KEYS]
        rows += [(mode, "visual", k, visual) for k in D.VISUAL_KEYS]
        rows += [(mode, "video", k, spatial) for k in D.VIDEO_SPATIAL_KEYS]
        rows += [(mode, "video", k, tonal) for k in D.VIDEO_TONAL_KEYS]
        rows += [(mode, "video", k, visual) for k in D.VIDEO_VISUAL_KEYS]
        rows += [(mode, "video", k, 1 + variation) for k in D.VIDEO_TIMING_KEYS]
    return spark.createDataFrame(rows, "_mode string, section string, key string, _factor double")


def known_mode(mode: Column) -> Column:
    names = [p[0] for p in D.INTENSITY_PRESETS]
    return F.when(mode.isin(*names), mode).otherwise(F.lit("balanced"))


def variation_of(mode: Column) -> Column:
    return C.lookup({p[0]: p[4] for p in D.INTENSITY_PRESETS}, known_mode(mode))


def apply_preset(settings: DataFrame) -> DataFrame:
    """Scale ``value`` of ``(mode, section, key)`` rows; unknown modes count as balanced."""
    dim = F.broadcast(preset_sections(settings.sparkSession))  # fixed: modes x keys
    value = F.col("value")
    return (
        settings.withColumn("_mode", known_mode(F.col("mode")))
        .join(dim, ["_mode", "section", "key"], "left")
        .withColumn("value", F.when(value > 0, value * F.coalesce("_factor", F.lit(1.0))).otherwise(value))
        .drop("_mode", "_factor")
    )


def randomise_params(settings: DataFrame, variation: Column) -> DataFrame:
    """Vary every positive ``value`` by a keyed factor per ``(seed, key)``. Internal keys are dropped."""
    factor = 1.0 + uniform(F.col("seed"), F.col("key"), -variation, variation)
    return settings.where(~F.col("key").startswith("_")).withColumn(
        "value", vary(F.col("value"), factor, F.col("is_whole"))
    )


def editor_params(df: DataFrame, config: str = "config") -> DataFrame:
    """Replace a config map by its clamped and aliased editor parameters, one column each.

    Reads, casts and clamps are separate projections, so that no expression is repeated in generated code. A value that is
    not a number, NaN included, gives the default.
    """
    keep = [c for c in df.columns if c != config]
    names = {name: keys for name, keys, *_ in D.EDITOR_NUMBERS} | dict(D.EDITOR_FLAGS)
    for name, *keys in [
        ("trimEndSec", "trimEndSec", "trim_end_sec"), ("rotateDeg", "rotateDeg", "rotate_deg"),
        ("audioFadeInSec", "audioFadeInSec", "audio_fade_in_sec"), ("audioFadeOutSec", "audioFadeOutSec", "audio_fade_out_sec"),
        ("audioHighpassHz", "audioHighpassHz", "audio_highpass_hz"), ("audioLowpassHz", "audioLowpassHz", "audio_lowpass_hz"),
        ("fit", "fit"), ("backgroundColor", "backgroundColor", "background_color"),
        ("videoCodec", "videoCodec", "video_codec"), ("preset", "preset"),
    ]:
        names[name] = keys
    # one pass turns the map into fields; a lookup per key would search the map some eighty times
    fields = ", ".join(f"`{k}` string" for keys in names.values() for k in keys)
    struct = df.select(*keep, F.from_json(F.to_json(config), fields).alias("_m"))
    texts = {n: F.coalesce(*[F.nullif(F.col(f"_m.{k}"), F.lit("")) for k in keys]) for n, keys in names.items()}
    read = struct.select(*keep, *[t.alias(n) for n, t in texts.items()])

    flags = [name for name, _ in D.EDITOR_FLAGS]
    words = ["fit", "backgroundColor", "videoCodec", "preset"]
    numeric = [n for n in texts if n not in flags and n not in words]
    unset = {n: F.col(n).isNull() for n in ("trimEndSec", "audioFadeInSec", "audioFadeOutSec")}
    unset |= {n: F.coalesce(F.col(n), F.lit("0")) == "0" for n in ("audioHighpassHz", "audioLowpassHz")}
    cast = read.select(
        *keep, *flags, *words, *[F.nullif(C.to_number(F.col(n)), F.lit(float("nan"))).alias(n) for n in numeric],
        *[u.alias(f"_no_{n}") for n, u in unset.items()],
    )

    def whole(n: Column) -> Column:
        return F.floor(n).cast("int")

    bounded = cast.select(
        *keep, *words,
        *[F.coalesce(C.clamp(F.col(n), lo, hi), F.lit(float(d))).alias(n) for n, _, lo, hi, d in D.EDITOR_NUMBERS],
        *[C.as_flag(F.col(n), False).alias(n) for n in flags],
        F.when(~F.col("_no_trimEndSec"), F.coalesce(C.clamp(F.col("trimEndSec"), 0, 600), F.lit(0.0))).alias("trimEndSec"),
        F.rint("rotateDeg").alias("rotateDeg"),
        *[C.clamp(F.col(n), 0, 10).alias(n) for n in ("audioFadeInSec", "audioFadeOutSec")],
        F.when(F.col("_no_audioHighpassHz"), 0).otherwise(
            whole(F.coalesce(C.clamp(F.col("audioHighpassHz"), 20, 300), F.lit(80.0)))).alias("audioHighpassHz"),
        # a low-pass starts at 1000 Hz and a high-pass ends at 300 Hz, so the two never cross
        F.when(F.col("_no_audioLowpassHz"), 0).otherwise(
            whole(F.coalesce(C.clamp(F.col("audioLowpassHz"), 1000, 20000), F.lit(12000.0)))).alias("audioLowpassHz"),
    )
    fit, speed = F.lower("fit"), F.lower("preset")
    turn = F.col("rotateDeg")
    return bounded.select(
        *keep,
        *[(whole(F.col(n)) if n in D.EDITOR_WHOLE else F.col(n)).alias(n) for n, *_ in D.EDITOR_NUMBERS],
        *flags,
        F.when(F.col("trimEndSec") > F.col("trimStartSec"), F.col("trimEndSec")).alias("trimEndSec"),
        F.when(turn.isin(0.0, 90.0, 180.0, 270.0), turn.cast("int")).otherwise(0).alias("rotateDeg"),
        F.coalesce("audioFadeInSec", "fadeInSec").alias("audioFadeInSec"),
        F.coalesce("audioFadeOutSec", "fadeOutSec").alias("audioFadeOutSec"),
        "audioHighpassHz", "audioLowpassHz",
        F.when(fit.isin(*D.FIT_MODES), fit).otherwise(F.lit("cover")).alias("fit"),
        C.hex_colour(F.coalesce("backgroundColor", F.lit("#000000"))).alias("backgroundColor"),
        F.when(F.lower("videoCodec").isin(*D.CODEC_ALIASES), "libx265").otherwise("libx264").alias("videoCodec"),
        F.when(speed.isin(*D.SPEED_PRESETS), speed).otherwise(F.lit("medium")).alias("preset"),
    )


def split_identity(df: DataFrame, same: Column, reason: str) -> DataFrame:
    """Mark rows that need no work with ``skipped`` and ``reason``, in place: no second scan, no union."""
    return df.withColumn("skipped", same).withColumn("reason", F.when(same, F.lit(reason)))
