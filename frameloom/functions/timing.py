"""Durations, transitions, beat factors, progress and retry arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import clamp, clamp_number, first_set, hex_colour, lookup
from .dimensions import MOTION_ALIASES, MOTION_PRESETS, TRANSITION_TARGETS, TRANSITION_TYPES
from .keyed import unit_draw
from .text import effect_name


def overlay_timing(start: Column, dur: Column, total: Column) -> Column:
    """Struct (end, fade_in, fade_out) of an overlay; null where it would end before it starts."""
    start = F.greatest(F.lit(0.0), start)
    dur = F.greatest(F.lit(0.15), dur)
    end = F.least(F.greatest(F.lit(0.1), total), start + dur)

    def fade(floor: float) -> Column:
        wanted = F.least(F.lit(0.35), F.greatest(F.lit(floor), dur * 0.22))
        return F.greatest(F.lit(0.03), F.least(wanted, dur / 2.0))

    return F.when(end > start, F.struct(end.alias("end"), fade(0.06).alias("fade_in"), fade(0.08).alias("fade_out")))


def transition_kind(raw: Column) -> Column:
    """Type of a transition map: ``fade`` where it names none, ``none`` for an unknown one or a null map."""
    kind = effect_name(first_set(raw, "type", "transitionType", "transition_type", "name", default=F.lit("fade")))
    return F.when(raw.isNotNull() & kind.isin(*TRANSITION_TYPES), kind).otherwise(F.lit("none"))


def transition_length(raw: Column) -> Column:
    """Length text of a transition map; a zero counts as unset, and 0.3 stands in where none is set."""
    zero = "^0(\\.0*)?$"
    lengths = [F.nullif(F.regexp_replace(first_set(raw, k), zero, ""), F.lit("")) for k in ("durationSec", "duration_sec", "duration")]
    return F.coalesce(*lengths, F.lit("0.3"))


def transition(raw: Column) -> Column:
    """Struct (type, seconds, direction, color, easing) from a transition map."""
    kind = transition_kind(raw)
    known = kind != "none"
    paint = first_set(raw, "color", "dipColor")
    return F.struct(
        kind.alias("type"),
        F.when(known, clamp_number(transition_length(raw), 0, 5, 0.3)).otherwise(F.lit(0.0)).alias("seconds"),
        F.when(known, F.lower(first_set(raw, "direction", "dir", default=F.lit("left")))).otherwise(F.lit("left")).alias("direction"),
        F.when(known & paint.isNotNull(), hex_colour(paint)).otherwise(F.lit("#000000")).alias("color"),
        F.when(known, F.lower(first_set(raw, "easing", "ease", default=F.lit("linear")))).otherwise(F.lit("linear")).alias("easing"),
    )


def transition_target(kind: Column) -> Column:
    """Renderer name of a transition type, ``fade`` if it has none."""
    kind = F.lower(kind)
    return F.coalesce(lookup(TRANSITION_TARGETS, kind), F.lit("fade"))


def motion_preset(value: Column, default: str = "none") -> Column:
    name = F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-"))
    name = F.coalesce(lookup(MOTION_ALIASES, name), name)
    return F.when(name.isin(*MOTION_PRESETS), name).otherwise(F.lit(default))


def tempo_factors(rate: Column) -> Column:
    """One or two factors, each in [0.5, 2], whose product is the rate clamped to [0.25, 4]."""
    r = clamp(rate, 0.25, 4.0)
    return (
        F.when(r > 2.0, F.array(F.lit(2.0), r / 2.0))
        .when(r < 0.5, F.array(F.lit(0.5), r * 2.0))
        .otherwise(F.array(r))
    )


def beat_zoom(low: Column) -> Column:
    return clamp(0.85 + low * 0.95, 0.65, 2.2)


def beat_shake(high: Column, transient: Column) -> Column:
    return clamp(0.75 + high * 0.95 + transient * 0.65, 0.65, 2.4)


def fallback_bpm(given: Column) -> Column:
    return clamp_number(given, 80, 180, 132)


def progress_scale(share: Column) -> Column:
    """Overall percentage of a single job whose tool reports a share."""
    return F.floor(10 + share * 80).cast("long")


def stage_progress(total: Column, downloads: Column, processed: Column, uploads: Column) -> Column:
    """Percentage of a batch from its stage counts, weighted 10 / 70 / 20 and held below 100."""
    done = downloads / total * 10 + processed / total * 70 + uploads / total * 20
    return F.least(F.floor(done), F.lit(99)).cast("long")


def backoff(attempt: Column, base: Column, multiplier: Column, seed: Column, cap: float = 30.0) -> Column:
    """Wait before the next attempt: exponential, within 25 % either way, capped.

    The power stops rising after 100 attempts, where it is long above the cap and still a finite number.
    """
    jitter = 0.75 + unit_draw(seed, "jitter") * 0.5
    return F.least(base * F.pow(multiplier, F.least(attempt - 1, F.lit(100))) * jitter, F.lit(cap))


def render_span(start: Column, end: Column, duration: Column, rate: Column) -> Column:
    """Seconds to render: the trimmed span, or the duration, over the playback rate."""
    span = F.when(end > start, end - start).otherwise(duration)
    return F.greatest(F.lit(0.01), F.when(rate > 0, span / rate).otherwise(span))


def clip_window(trim_in: Column, trim_out: Column, dur: Column, clip_speed: Column, effect_speed: Column) -> Column:
    """Struct (speed, trim_end): combined speed and the source position where a clip ends."""
    speed = F.greatest(F.lit(0.25), F.least(F.lit(4.0), clip_speed * effect_speed))
    trim_in = F.greatest(F.lit(0.0), trim_in)
    open_end = trim_in + F.greatest(F.lit(0.1), dur * speed)
    end = F.when(trim_out.isNull(), open_end).otherwise(F.greatest(trim_in + 0.05, trim_out))
    return F.struct(speed.alias("speed"), end.alias("trim_end"))


def beat_phase(phase: Column, start: Column, bpm: Column) -> Column:
    """Phase of a global beat at the start of a clip."""
    period = 60.0 / F.greatest(F.lit(1e-6), bpm)
    return F.pmod(phase + start, period)
