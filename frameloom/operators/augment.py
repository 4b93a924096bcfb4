"""Seeded augmentation of pictures for corpus statistics and robustness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed as K
from ..functions import pixels as P
from ..functions.dimensions import INTENSITY_PRESETS
from . import raster as R

# key, section of the preset
TIERS = [
    ("crop", "spatial"), ("brightness", "tonal"), ("gamma", "tonal"), ("contrast", "tonal"),
    ("saturation", "tonal"), ("tint", "visual"), ("noise", "visual"),
]


def variant_params(pictures: DataFrame, n: int, base: dict[str, float], mode: str, salt: str) -> DataFrame:
    """One row per picture ``img_id, w, h`` and variant with every drawn parameter.

    Base values are scaled by the preset, varied per variant, then drawn; all draws are keyed.
    """
    preset = {p[0]: p[1:] for p in INTENSITY_PRESETS}.get(mode, INTENSITY_PRESETS[2][1:])
    scale = dict(zip(("spatial", "tonal", "visual"), preset[:3]))
    spread = preset[3]
    seed = F.col("seed")

    def strength(key: str) -> Column:
        section = dict(TIERS)[key]
        return F.lit(base.get(key, 0.0) * scale[section]) * (1.0 + K.uniform(seed, key, -spread, spread))

    def factor(key: str, lo: float, hi: float) -> Column:
        drawn = 1.0 + K.uniform(seed, f"{key}.draw", -1, 1) * F.col(f"_{key}")
        return F.greatest(F.lit(lo), F.least(F.lit(hi), drawn))

    def margin(side: str, size: str) -> Column:
        return F.floor(F.col(size) * (K.unit_draw(seed, f"crop.{side}") * F.col("_crop") / 100.0))

    rows = pictures.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "seed", K.keyed_seed(F.col("img_id"), F.col("variant"), F.lit(salt)))
    rows = rows.select("*", *[strength(k).alias(f"_{k}") for k, _ in TIERS])
    return rows.select(
        "img_id", "variant", "seed", "w", "h", (K.unit_draw(seed, "flip") > 0.5).alias("flip"),
        *[margin(s, d).alias(s) for s, d in (("left", "w"), ("right", "w"), ("top", "h"), ("bottom", "h"))],
        factor("brightness", 0.0, 10.0).alias("brightness"), factor("gamma", 0.5, 2.0).alias("gamma"),
        factor("contrast", 0.5, 1.5).alias("contrast"), factor("saturation", 0.5, 1.5).alias("saturation"),
        *[(K.uniform(seed, f"tint.{c}", -1, 1) * F.col("_tint")).alias(f"tint_{c}") for c in "rgb"], F.col("_noise").alias("noise"),
    )


def augment(df: DataFrame, n: int, base: dict[str, float], mode: str = "balanced", salt: str = "") -> DataFrame:
    """``n`` variants of every picture, as ``img_id, variant, y, x, band, v``.

    Pixels come long, or wide with r, g and b. Order: flip, crop, brightness, gamma, contrast, saturation, tint, noise. Parameters are drawn once per
    variant and meet the pixels in one join on the picture; the whole chain is then one projection.
    """
    wide = df if "r" in df.columns else R.to_wide(df)
    size = wide.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    px = wide.join(variant_params(size, n, base, mode, salt), "img_id")
    px = px.withColumn("x", F.when(F.col("flip"), F.col("w") - 1 - F.col("x")).otherwise(F.col("x")).cast("int"))
    whole = (F.col("left") + F.col("right") >= F.col("w") * 0.5) | (F.col("top") + F.col("bottom") >= F.col("h") * 0.5)
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("w") - F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("h") - F.col("bottom"))
    px = px.withColumn("_whole", whole).where(F.col("_whole") | inside)
    px = px.withColumns({a: F.when(F.col("_whole"), F.col(a)).otherwise(F.col(a) - F.col(m)).cast("int") for a, m in (("x", "left"), ("y", "top"))})
    tone = lambda c: P.contrast(P.store(F.pow(P.gain(c, F.col("brightness")) / 255.0, F.col("gamma")) * 255.0 + P.EPS), F.col("contrast"))
    px = px.withColumns({c: tone(F.col(c)) for c in "rgb"})
    grey = F.floor(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114 + P.EPS)
    px = px.withColumn("_grey", grey)
    px = px.withColumns({c: P.store(P.store(F.col("_grey") + (F.col(c) - F.col("_grey")) * F.col("saturation") + P.EPS) + F.col(f"tint_{c}")) for c in "rgb"})
    at = F.concat_ws(".", F.lit("noise"), F.col("y").cast("string"), F.col("x").cast("string"))
    px = px.withColumns({c: P.store(F.col(c) + K.normal(F.col("seed"), at, slot) * F.col("noise") * 2.0) for slot, c in enumerate("rgb")})
    return R.to_long(px.select("img_id", "variant", "y", "x", "r", "g", "b"))
