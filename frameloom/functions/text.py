"""Caption text expressions: format, emoji clusters, width, wrapping, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One emoji cluster: a pair of regional indicators, or an emoji followed by modifiers and joined characters.
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}]{1,2}"
    r"|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]"
    r"(?:[\x{FE0F}\x{20E3}\x{1F3FB}-\x{1F3FF}]|\x{200D}[\s\S]|\x{200D}$)*"
)
PLAIN = r"[^\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]+"
TOKEN = f"{EMOJI}|{PLAIN}"


def curly_quotes(text: Column) -> Column:
    """Straight quotes to typographic ones: odd ones open, even ones close."""

    def pair(value: Column, straight: str, opening: str, closing: str) -> Column:
        pieces = F.split(value, straight)
        marked = F.transform(
            pieces,
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(F.when(i % 2 == 1, F.lit(opening)).otherwise(F.lit(closing)), p)
            ),
        )
        return F.array_join(marked, "")

    return pair(pair(text, '"', "“", "”"), "'", "‘", "’")


def parse_caption(text: Column, allow_title: bool = True) -> Column:
    """Struct (title, body): a leading ``##Title##`` and ``&&&`` as line break."""
    text = curly_quotes(text)
    lead = r"^##(.+?)##\s*"
    has = text.rlike(lead) if allow_title else F.lit(False)
    title = F.when(has, F.regexp_extract(text, lead, 1))
    rest = F.when(has, F.regexp_replace(text, lead, "")).otherwise(text)
    return F.struct(title.alias("title"), F.replace(rest, F.lit("&&&"), F.lit("\n")).alias("body"))


def emoji_tokens(text: Column) -> Column:
    """Array of alternating plain-text and emoji-cluster tokens."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def is_emoji(token: Column) -> Column:
    return token.rlike(f"^(?:{EMOJI})$")


# Advance classes in hundredths of the font size; they stand in for the metrics of a font file.
NARROW = (r"[ilj.,:;'|!]", 28)
SLIM = (r"[ftr()\[\] -]", 36)
BROAD = (r"[mwMW@%]", 86)
UPPER = (r"[A-LN-VX-Z]", 66)
FULL = (r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FF60}]", 100)
OTHER = 54


def emoji_size(size: Column) -> Column:
    return F.greatest(F.lit(12), F.floor(size * 1.05))


def _advance(text: Column) -> tuple[Column, Column]:
    """Plain advance in hundredths of the font size, and number of emoji clusters."""
    plain = F.regexp_replace(text, f"({EMOJI})", "")
    units = F.length(plain) * OTHER
    for pattern, advance in (NARROW, SLIM, BROAD, UPPER, FULL):
        units = units + F.regexp_count(plain, F.lit(pattern)) * (advance - OTHER)
    return units, F.regexp_count(text, F.lit(f"({EMOJI})"))


def _pixels(units: Column, clusters: Column, size: Column) -> Column:
    emoji = emoji_size(size)
    gap = F.greatest(F.lit(1), F.floor(emoji * 0.08))
    return units * size / 100.0 + clusters * (emoji + gap)


def text_width(text: Column, size: Column) -> Column:
    """Width of one line in pixels. Emoji count as a square of 1.05 font sizes plus a gap of 8 %."""
    return _pixels(*_advance(text), size)


def wrap(text: Column, size: Column, limit: Column) -> Column:
    """Greedy word wrap per paragraph; blank lines stay. A word wider than the limit has its own line.

    Each word is measured once; a line's width is carried as a sum.
    """
    empty = F.array().cast("array<string>")
    space = SLIM[1]

    def measured(w: Column) -> Column:
        units, clusters = _advance(w)
        return F.struct(w.alias("w"), units.alias("u"), clusters.alias("c"))

    def paragraph(p: Column) -> Column:
        ws = F.transform(F.split(p, " "), measured)
        head = F.element_at(ws, 1)
        start = F.struct(empty.alias("lines"), head["w"].alias("line"), head["u"].alias("u"), head["c"].alias("c"))

        def step(s: Column, w: Column) -> Column:
            fits = _pixels(s["u"] + space + w["u"], s["c"] + w["c"], size) <= limit
            return F.struct(
                F.when(fits, s["lines"]).otherwise(F.array_append(s["lines"], s["line"])).alias("lines"),
                F.when(fits, F.concat(s["line"], F.lit(" "), w["w"])).otherwise(w["w"]).alias("line"),
                F.when(fits, s["u"] + space + w["u"]).otherwise(w["u"]).alias("u"),
                F.when(fits, s["c"] + w["c"]).otherwise(w["c"]).alias("c"),
            )

        rest = F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))
        return F.aggregate(rest, start, step, lambda s: F.array_append(s["lines"], s["line"]))

    return F.array_join(F.flatten(F.transform(F.split(text, "\n"), paragraph)), "\n")


def words(text: Column) -> Column:
    """Words of a text: split at any white space, none empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_chunks(text: Column, n: Column) -> Column:
    """Groups of ``n`` words, joined by single spaces."""
    all_words = words(text)
    count = F.size(all_words)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / n).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(all_words, (i * n + 1).cast("int"), n.cast("int")), " "))


def style_name(value: Column) -> Column:
    return F.coalesce(F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-")), F.lit("default"))


def effect_name(value: Column) -> Column:
    return F.coalesce(F.translate(F.lower(F.trim(value)), "_-", ""), F.lit(""))
