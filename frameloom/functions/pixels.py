"""Pixel values as column expressions. Stored levels are whole numbers in 0-255: clamp, then truncate."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def store(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("double")


def by_band(band: Column, r: Column | float, g: Column | float, b: Column | float) -> Column:
    r, g, b = [c if isinstance(c, Column) else F.lit(float(c)) for c in (r, g, b)]
    return F.when(band == 0, r).when(band == 1, g).otherwise(b)


def gain(v: Column, k) -> Column:
    return store(v * k)


def contrast(v: Column, k, about=128.0) -> Column:
    return store(about + (v - about) * k)


def percent(v: Column, brightness=0.0, contrast_pct=0.0) -> Column:
    """Brightness and contrast given in percent."""
    return contrast(gain(v, 1.0 + brightness / 100.0), 1.0 + contrast_pct / 100.0)


def gamma(v: Column, g: float) -> Column:
    return store(F.pow(v / 255.0, F.lit(max(0.5, min(2.0, g)))) * 255.0 + EPS)


def tint(v: Column, band: Column, r, g, b) -> Column:
    return store(v + by_band(band, r, g, b))


def temperature(v: Column, band: Column, shift) -> Column:
    """Warmer for a positive shift: red up, blue down, by up to 30 levels."""
    return store(v + by_band(band, F.lit(30.0) * shift, 0.0, F.lit(-30.0) * shift))


def levels(v: Column, clip: int) -> Column:
    return store((v - clip) * (255.0 / (255.0 - 2 * clip)))


def centre_distance2(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Squared distance from the centre, 1 in the corner at the origin."""
    cx, cy = w / 2.0, h / 2.0
    return (F.pow(x - cx, F.lit(2.0)) + F.pow(y - cy, F.lit(2.0))) / (F.pow(cx, F.lit(2.0)) + F.pow(cy, F.lit(2.0)))


def vignette(v: Column, x: Column, y: Column, w: Column, h: Column, s: float) -> Column:
    m = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - centre_distance2(x, y, w, h) * s))
    return store(v * m + EPS)


def vignette_overlay(v: Column, x: Column, y: Column, w: Column, h: Column, s: float, colour: Column) -> Column:
    """Lay a colour over the picture, denser towards the corners."""
    alpha = store(F.pow(centre_distance2(x, y, w, h), F.lit(0.75)) * s * 255.0 + EPS) / 255.0
    return store(colour * alpha + v * (1.0 - alpha) + EPS)


def gradient(v: Column, x: Column, y: Column, w: Column, h: Column, s: float) -> Column:
    return store(v * (1.0 + ((x / w + y / h) / 2.0 - 0.5) * s * 2.0) + EPS)


def scanline(v: Column, y: Column, s: float, period: float = 2.0) -> Column:
    """Lines lighter and darker in turn; at a period of two whole lines the wave is 0 on every line."""
    return store(v * (1.0 + F.sin(y * (2.0 * math.pi / period)) * s) + EPS)


def channel_mix(r: Column, g: Column, b: Column, mix: float) -> tuple[Column, Column, Column]:
    keep, add = 1.0 - mix, mix * 0.5
    return store(r * keep + g * add + EPS), store(g * keep + b * add + EPS), store(b * keep + r * add + EPS)


def yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return (
        r * 0.299 + g * 0.587 + b * 0.114,
        r * -0.14713 - g * 0.28886 + b * 0.436 + 128.0,
        r * 0.615 - g * 0.51499 - b * 0.10001 + 128.0,
    )


def from_yuv(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    return (
        store(y + (v - 128.0) * 1.13983),
        store(y - (u - 128.0) * 0.39465 - (v - 128.0) * 0.58060),
        store(y + (u - 128.0) * 2.03211),
    )


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0-179, saturation and value in 0-255, all truncated. Of equal maxima blue counts, then green."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    span = F.nullif(delta, F.lit(0.0))
    hue = (
        F.when(delta == 0, 0.0).when(top == b, 60.0 * ((r - g) / span + 4.0)).when(top == g, 60.0 * ((b - r) / span + 2.0))
        .otherwise(60.0 * F.pmod((g - b) / span, F.lit(6.0)))
    )
    sat = F.when(top > 0, delta * 255.0 / F.nullif(top, F.lit(0.0))).otherwise(0.0)
    return F.floor(hue / 2.0 + EPS).cast("double"), F.floor(sat + EPS).cast("double"), top


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    turn = h / 30.0
    c = v * s / 255.0
    x = c * (1.0 - F.abs(F.pmod(turn, F.lit(2.0)) - 1.0))
    m = v - c
    k = F.pmod(F.floor(turn), F.lit(6))

    def pick(*six: Column) -> Column:
        out = six[5]
        for i in (4, 3, 2, 1, 0):
            out = F.when(k == i, six[i]).otherwise(out)
        return F.floor(out + m + EPS).cast("double")

    z = F.lit(0.0)
    return pick(c, x, z, z, x, c), pick(x, c, c, x, z, z), pick(z, z, x, c, c, x)
