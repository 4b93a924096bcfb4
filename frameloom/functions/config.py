"""Typed reads from free configuration maps: aliases, defaults, clamps, flags, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"


def lookup(table: dict[str, object], key: Column) -> Column:
    """Value of ``key`` in a small literal table, null where it is missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def get(config: Column, key: str) -> Column:
    return F.try_element_at(config, F.lit(key))


def first_set(config: Column, *keys: str, default: Column | None = None) -> Column:
    """First key whose value is neither null nor the empty string."""
    reads = [F.nullif(get(config, k), F.lit("")) for k in keys]
    return F.coalesce(*reads, default) if default is not None else F.coalesce(*reads)


def camel_to_snake(key: Column) -> Column:
    """An underscore where a word begins: before a capital after small letters, and before the last capital of a row."""
    return F.lower(F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", "_"))


def either_case(config: Column, key: str, default: Column | None = None) -> Column:
    """Value under the camel-case key, else under its snake-case form; blanks, 0 and false count as set."""
    snake = "".join("_" + c.lower() if c.isupper() else c for c in key)
    reads = [get(config, key), get(config, snake)]
    return F.coalesce(*reads, default) if default is not None else F.coalesce(*reads)


def camel_case(key: Column) -> Column:
    """Camel-case form of a snake-case key, word by word."""
    words = F.split(key, "_")
    tail = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.initcap)
    return F.when(key.contains("_"), F.concat(F.element_at(words, 1), F.array_join(tail, ""))).otherwise(key)


def normalise_keys(config: Column) -> Column:
    """Map with camel-case keys; of two keys that fall together the later one stays."""
    renamed = F.transform(F.map_entries(config), lambda e: F.struct(camel_case(e["key"]).alias("k"), e["value"].alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    kept = F.aggregate(renamed, none, lambda seen, e: F.array_append(F.filter(seen, lambda s: s["k"] != e["k"]), e))
    return F.map_from_entries(kept)


def to_number(value: Column) -> Column:
    """Text to double; anything that is not a plain decimal number, NaN or infinity is null."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def clamp(number: Column, lo: Column | float, hi: Column | float) -> Column:
    """Bound a number. Null stays null and NaN passes through, as neither compares with a bound."""
    lo, hi = [b if isinstance(b, Column) else F.lit(float(b)) for b in (lo, hi)]
    return F.when(F.isnan(number), number).when(number < lo, lo).when(number > hi, hi).otherwise(number)


def clamp_number(value: Column, lo: Column | float, hi: Column | float, default: Column | float) -> Column:
    """Cast and bound; a value that is no number gives the default unbounded."""
    default = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(clamp(to_number(value), lo, hi), default)


def as_flag(value: Column, default: bool | Column) -> Column:
    """Boolean from text: yes / no words, else the default."""
    word = F.lower(F.trim(value))
    default = default if isinstance(default, Column) else F.lit(default)
    return (
        F.when(word.isin("1", "true", "yes", "y", "on"), F.lit(True))
        .when(word.isin("0", "false", "no", "n", "off", ""), F.lit(False))
        .otherwise(default)
    )


def number_flag(value: Column) -> Column:
    """Boolean from a number: anything but zero."""
    return value != 0


def hex_colour(value: Column) -> Column:
    """``#rrggbb`` in lower case from 3 or 6 digits, with or without the hash; else black."""
    digits = F.lower(F.regexp_replace(F.trim(value), "^#", ""))
    doubled = F.regexp_replace(digits, "^(.)(.)(.)$", "$1$1$2$2$3$3")
    return F.when(doubled.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), doubled)).otherwise(F.lit("#000000"))


def hex_to_rgb(value: Column, fallback: int) -> Column:
    """Struct (r, g, b) from hex text; the fallback level in all three where it cannot be read."""
    digits = F.regexp_replace(value, "^#+", "")
    wide = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    ok = wide.rlike("^[0-9a-fA-F]{5,}")
    level = [F.when(ok, F.conv(F.substring(wide, i, 2), 16, 10).cast("int")).otherwise(F.lit(fallback)) for i in (1, 3, 5)]
    return F.struct(level[0].alias("r"), level[1].alias("g"), level[2].alias("b"))


def force_overrides(config: Column, forced: dict[str, str], enabled: Column) -> Column:
    """Write fixed values over a map where enabled; an empty map where not."""
    fixed = F.create_map(*[F.lit(x) for kv in forced.items() for x in kv])
    kept = F.map_filter(F.coalesce(config, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*forced))
    return F.when(enabled, F.map_concat(kept, fixed)).otherwise(F.create_map().cast("map<string,string>"))
