"""URL filters: rules by host and path, and gradient-boosted trees for the urls that no rule fits.

The trees see lexical features only: lengths, depth, digit ratio, entropy, counts of parameters and labels, and what is known
of the host's last label and last two labels among labelled urls (share blocked, how many). They learn from the urls that a
rule fits, a sample of about ``bound`` of them chosen by hash; statistics of suffixes go over all labelled urls.

A null url, or one without ``://``, has an empty host and path and fits no rule; it is judged like any other. Repeated rows
are judged one by one. If the labelled urls have one verdict only, that is the verdict of the rest, and ``allow`` if there
are none. Further columns travel in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.staging import keep_row, stage
from frameloom.llm.textbytes import annotate

BOUND = 20_000
TREES, DEPTH = 12, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def lexical(url: str) -> list[float]:
    """Features of the characters of one url."""
    n = max(len(url), 1)
    head, _, query = url.partition("?")
    host = head.partition("://")[2].partition("/")[0]
    path = head.partition("://")[2].partition("/")[2].partition("#")[0]
    spread = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    return [float(x) for x in (
        len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), spread,
        len([p for p in query.partition("#")[0].split("&") if p]), host.count("."), host.count("-"),
        max((len(x) for x in host.split(".")), default=0), sum(c.isdigit() for c in path), url.startswith("https"), "#" in url,
    )]


def _features():
    def derive(column: pa.Array) -> list[pa.Array]:
        return [pa.array([lexical(u or "") for u in column.to_pylist()], pa.list_(pa.float64()))]

    return derive


def _known(labelled: DataFrame, suffix: str, name: str) -> DataFrame:
    """Smoothed share of blocked urls and log count of each suffix; counts combine before the shuffle."""
    blocked = (F.sum("label") + 1) / (F.count("*") + 2)
    return stage(labelled.groupBy(suffix).agg(blocked.alias(f"{name}_share"), F.log1p(F.count("*").cast("double")).alias(f"{name}_count"))
                 .withColumnRenamed(suffix, f"{name}_key"), f"suffix-{name}")


def judge(pages: DataFrame, url: str = "url", rules=RULES, bound: int = BOUND, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> DataFrame:
    """``row``, host, path, rule, verdict and block_score (null where the trees were not asked) of every url."""
    rows = keep_row(pages, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), F.col(f"`{url}`").alias("url"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.select("*", name.alias("rule"), verdict.alias("by_rule"))
    measured = annotate(ruled, _features, "lex array<double>", "url").select("row.*", "lex")
    measured = (measured.withColumn("one", F.substring_index("host", ".", -1)).withColumn("two", F.substring_index("host", ".", -2))
                .withColumn("label", (F.col("by_rule") == "block").cast("double")))
    slim = stage(measured.drop("row"), "urls")
    labelled = slim.where("by_rule is not null")
    n, blocked = labelled.agg(F.count("*"), F.sum("label")).first()
    if not n or blocked in (0.0, float(n)):
        rest = "block" if n and blocked else "allow"
        return ruled.select("row", "host", "path", "rule", F.coalesce("by_rule", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    one, two = _known(labelled, "one", "one"), _known(labelled, "two", "two")

    def vectors(df: DataFrame) -> DataFrame:
        joined = df.join(one, F.col("one") == F.col("one_key"), "left").join(two, F.col("two") == F.col("two_key"), "left")
        known = F.array(*[F.coalesce(c, F.lit(v)) for c, v in (("one_share", 0.5), ("one_count", 0.0), ("two_share", 0.5), ("two_count", 0.0))])
        return joined.withColumn("features", array_to_vector(F.concat("lex", known)))

    # each class of different urls by a rate of its own, so that neither a hot url nor a rare class weighs by its rows
    different = stage(labelled.dropDuplicates(["url"]), "urls-learn")
    rate = {r["label"]: min(1.0, bound / 2 / r["n"]) for r in different.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 20)) < F.when(F.col("label") == 1, int(rate[1.0] * (1 << 20))).otherwise(int(rate[0.0] * (1 << 20)))
    learn = stage(vectors(different.where(draw)).select("features", "label"), "url-sample").coalesce(4)  # about ``bound`` rows
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(learn)
    scored = model.transform(vectors(measured)).withColumn("p", vector_to_array("probability")[1])
    judged = F.coalesce("by_rule", F.when(F.col("p") >= 0.5, "block").otherwise("allow"))
    return scored.select("row", "host", "path", "rule", judged.alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("p")).alias("block_score"))
