"""Keyed draws: randomness that depends on a key and not on partitioning or run order."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(1 << 32)
PRIME = (1 << 31) - 1
STEP = 0x2545F491  # below 2**30, so that a step of a 31-bit counter fits a long


def keyed_seed(*parts: Column, digest: str = "sha256") -> Column:
    """32-bit seed from the first eight hex digits of a digest over the joined parts."""
    key = F.concat_ws("_", *[p.cast("string") for p in parts])
    digits = F.sha2(key, 256) if digest == "sha256" else F.md5(key)
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def unit_draw(seed: Column, name: Column | str) -> Column:
    """Number in [0, 1) for one named parameter of one seed."""
    return keyed_seed(seed, F.lit(name) if isinstance(name, str) else name) / SPAN


def uniform(seed: Column, name: Column | str, lo: Column | float, hi: Column | float) -> Column:
    """Number in [lo, hi) for one named parameter of one seed."""
    lo, hi = [b if isinstance(b, Column) else F.lit(float(b)) for b in (lo, hi)]
    return lo + (hi - lo) * unit_draw(seed, name)


def whole(seed: Column, name: str, lo: int, hi: int) -> Column:
    """Whole number in [lo, hi], both ends possible."""
    return (F.lit(lo) + F.floor(unit_draw(seed, name) * (hi - lo + 1))).cast("long")


def normal(seed: Column, name: Column | str, slot: int | Column = 0) -> Column:
    """Standard normal draw by the Box-Muller transform from two 32-bit draws of a digest.

    One digest has room for four draws: draws of the same name in different slots share its cost.
    """
    digits = F.sha2(F.concat_ws("_", seed.cast("string"), F.lit(name) if isinstance(name, str) else name), 256)
    slot = F.lit(slot) if isinstance(slot, int) else slot

    def unit(at: int) -> Column:
        return F.conv(F.substr(digits, (slot * 16 + at).cast("int"), F.lit(8)), 16, 10).cast("long") / SPAN

    return F.sqrt(F.lit(-2.0) * F.ln(1.0 - unit(1))) * F.cos(F.lit(6.283185307179586) * unit(9))


def cell_key(seed: Column, purpose: str, *counters: Column) -> Column:
    """Whole number in [0, PRIME) for a seed, a purpose and counters, as arithmetic on longs: no string is built.

    Every counter is one round h * h + counter * STEP + 1 modulo PRIME, which never leaves a long.
    """
    h = F.pmod(seed.cast("long"), F.lit(PRIME)) + F.lit(zlib.crc32(purpose.encode()) % PRIME)
    h = F.pmod(h, F.lit(PRIME))
    for c in counters:
        h = (h * h + c.cast("long") * F.lit(STEP) + F.lit(1)) % F.lit(PRIME)
    return h


def cell_normal(key: Column, slot: int | Column = 0) -> Column:
    """Standard normal draw by the Box-Muller transform, from a ``cell_key`` that is a column; one key has any number of slots."""
    slot = (F.lit(slot) if isinstance(slot, int) else slot).cast("long")

    def unit(n: int) -> Column:
        h = key
        for c in (slot * 2 + (n + 1), F.lit(7), F.lit(11)):
            h = (h * h + c.cast("long") * F.lit(STEP) + F.lit(1)) % F.lit(PRIME)
        return h / float(PRIME)

    return F.sqrt(F.lit(-2.0) * F.ln(1.0 - unit(0))) * F.cos(F.lit(6.283185307179586) * unit(1))


def vary(value: Column, factor: Column, is_whole: Column) -> Column:
    """Scale a positive number by a factor; whole numbers stay whole by truncation; others pass through."""
    scaled = value * factor
    return F.when(value > 0, F.when(is_whole, F.floor(scaled)).otherwise(scaled)).otherwise(value)
