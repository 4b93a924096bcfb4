"""Quality rules: one table of thresholds compiled into one projection of ratios.

Words are the runs of characters outside space and U+0009 to U+000D. Everything is measured inside the row with built-in
functions, so the operator moves no data; a very long text costs its own length (times a logarithm, where it repeats
itself).

Null and empty texts measure 0 everywhere and fail the base rules. Repeated rows are judged alike, one by one. Further
columns, whatever their names, travel in ``row``. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.staging import keep_row

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for was with on are as he his this from be by or an at which not have "
    "der die und das von zu mit ein eine ist den im für auf dem nicht sich des als auch "
    "le la les de et à un une en est que pour dans du au par sur des il qui ne pas "
    "el los las y del por con no es se una su para lo como más"
).split()


class Rule(NamedTuple):
    """A text is kept only if ``least <= feature <= most``; ``None`` leaves a side open."""

    feature: str
    least: float | None
    most: float | None


#: Production thresholds. The features are ratios, so that a rule means the same at every length.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.20),
    Rule("stop_word_share", 0.02, None),
    Rule("duplicate_line_share", None, 0.50),
    Rule("repeat_word_share", None, 0.45),
)


def _repeat_words(ranked: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``ranked`` holds (window, place) in order."""
    twice = F.filter(ranked, lambda x, i: F.coalesce(F.get(ranked, i - 1)["g"] == x["g"], F.lit(False))
                     | F.coalesce(F.get(ranked, i + 1)["g"] == x["g"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])


def _verdict(rules) -> Column:
    ok = F.lit(True)
    for rule in rules:
        value = F.col(rule.feature)
        if rule.least is not None:
            ok = ok & (value >= rule.least)
        if rule.most is not None:
            ok = ok & (value <= rule.most)
    return ok


def judge(docs: DataFrame, text: str = "text", rules=RULES, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """``row`` (all input columns) and ``quality``: the counts, the ratios, ``base_failed`` and ``kept`` per document."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.array_remove(F.split(body, SPACES), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = keep_row(docs, words.alias("w"), lines.alias("lines"),
                   F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long").alias("n_symbols"))
    n = F.size("w")
    grams = F.transform(F.slice("w", F.lit(1), F.greatest(n - 2, F.lit(0))),
                        lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    counted = cut.select(
        "row", "n_symbols", grams.alias("grams"), n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
    )
    pairs = F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("p")))
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    ranked = counted.withColumn("ranked", F.when(again, F.sort_array(pairs))).drop("grams")
    measured = ranked.withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("ranked")), F.lit(0))).drop("ranked")
    some = F.greatest(F.col("n_words"), F.lit(1))
    ratios = measured.select(
        "*",
        (F.col("word_chars") / some).alias("mean_word_chars"),
        (F.col("n_symbols") / some).alias("symbols_per_word"),
        (F.col("n_stop") / some).alias("stop_word_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("duplicate_line_share"),
        (F.col("n_repeat_words") / some).alias("repeat_word_share"),
        ((F.col("n_words") < least_words)
         | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))).alias("base_failed"),
    )
    parts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word",
             "stop_word_share", "duplicate_line_share", "repeat_word_share", "base_failed"]
    quality = F.struct(*parts, (~F.col("base_failed") & _verdict(rules)).alias("kept"))
    # a generator keeps a filter on the verdict above the measures; pushed down, it would repeat them word by word
    return ratios.select("row", F.explode(F.array(quality)).alias("quality"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their columns as they came."""
    return judge(docs, **options).where("quality.kept").select("row.*")
