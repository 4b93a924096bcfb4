"""Finding near-duplicate pictures: perceptual hashes, distances, clusters."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BANDS, BAND_BITS = 4, 16
BUCKET_ROWS = 20_000  # hashes of one bucket that one task compares


def _pack(bits: Column) -> Column:
    """Array of at most 64 booleans to a long, first one lowest."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    words = F.transform(bits, lambda b, k: F.when(b, F.call_function("shiftleft", one, k)).otherwise(zero))
    return F.aggregate(words, zero, lambda a, w: a.bitwiseOR(w))


def _above(cells: str, level: Column, n: int) -> Column:
    """Bits of the cells above a level. Repeating the level first keeps it out of the per-cell function."""
    return _pack(F.zip_with(cells, F.array_repeat(level, n), lambda c, m: c > m))


def dct_hash(df: DataFrame, n: int = 32, size: int = 8) -> DataFrame:
    """``img_id, hash`` from grey pictures of n x n pixels ``img_id, y, x, v``.

    The lowest size x size cosine coefficients against their median. The transform is separable and every
    coefficient is a sum, so both passes combine before their shuffle. A coefficient counts as above the median
    only beyond a small margin: those of flat pictures differ from it by rounding alone, which would make
    their bits depend on the order of summation.
    """
    basis = F.array(*[
        F.array(*[F.lit(math.cos(math.pi * (2 * x + 1) * u / (2 * n))) for u in range(size)]) for x in range(n)
    ])
    weights = F.element_at(basis, F.col("x") + 1)
    lines = df.select("img_id", "y", "v", weights.alias("_w")).groupBy("img_id", "y").agg(
        *[F.sum(F.col("v") * F.col("_w")[u]).alias(f"c{u}") for u in range(size)])
    down = lines.select("img_id", *[f"c{u}" for u in range(size)], F.posexplode(F.element_at(basis, F.col("y") + 1)).alias("t", "_w"))
    rows = down.groupBy("img_id", "t").agg(*[F.sum(F.col(f"c{u}") * F.col("_w")).alias(f"c{u}") for u in range(size)])
    # size rows of size coefficients per picture: a bounded group
    ordered = F.array_sort(F.collect_list(F.struct("t", F.array(*[f"c{u}" for u in range(size)]).alias("k"))))
    coefficients = rows.groupBy("img_id").agg(ordered.alias("_r")).select(
        "img_id", F.flatten(F.transform("_r", lambda r: r["k"])).alias("k"))
    ranked, half = F.sort_array("k"), size * size // 2
    middle = (F.element_at(ranked, half) + F.element_at(ranked, half + 1)) / 2.0
    return coefficients.select("img_id", _above("k", middle + 1e-6, size * size).alias("hash"))


def _cells(df: DataFrame) -> DataFrame:
    """The 64 cells of each 8 x 8 picture as one ordered array."""
    return df.groupBy("img_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda c: c["v"]).alias("k"))


def average_hash(df: DataFrame) -> DataFrame:
    """``img_id, hash`` of 8 x 8 grey pictures: cells above their mean."""
    mean = F.aggregate("k", F.lit(0.0), lambda a, v: a + v) / 64.0
    return _cells(df).select("img_id", _above("k", mean, 64).alias("hash"))


def difference_hash(df: DataFrame) -> DataFrame:
    """``img_id, hash`` of 8 x 8 grey pictures: cells brighter than the one to their left."""
    k = F.col("k")
    bits = F.transform(F.sequence(F.lit(0), F.lit(55)), lambda i: F.element_at(k, (F.floor(i / 7) * 8 + i % 7 + 2).cast("int")) > F.element_at(k, (F.floor(i / 7) * 8 + i % 7 + 1).cast("int")))
    return _cells(df).select("img_id", _pack(bits).alias("hash"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distinct_hashes(hashes: DataFrame) -> DataFrame:
    """One row per hash with its first picture and number of copies: copies never meet each other."""
    return hashes.groupBy("hash").agg(F.min("img_id").alias("first_id"), F.count("*").alias("copies"))


def _band(h: Column, i: int) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(i * BAND_BITS)).bitwiseAND(F.lit((1 << BAND_BITS) - 1).cast("long"))


def near_hashes(distinct: DataFrame, max_dist: int) -> DataFrame:
    """Pairs of different hashes within ``max_dist`` bits: ``a, b, a_id, b_id, dist`` with a seen first.

    Two hashes within d bits agree to d // 4 bits in one of four 16-bit bands, so one side looks up all band
    values that close. A pair is kept only at the first band that qualifies, so none appears twice. Buckets are
    counted first; the count of a bucket, at most 4 x 65,536 rows whatever the data, drops lookups of empty
    buckets before the shuffle and salts large ones.
    """
    reach = max_dist // BANDS
    flips = [sum(1 << b for b in c) for r in range(reach + 1) for c in combinations(range(BAND_BITS), r)]
    banded = F.posexplode(F.array(*[_band(F.col("hash"), i) for i in range(BANDS)]))
    index = distinct.select("hash", "first_id", banded.alias("band", "value"))
    buckets = index.groupBy("band", "value").agg(F.count("*").alias("_n"))
    buckets = F.broadcast(buckets.select("band", "value", F.ceil(F.col("_n") / BUCKET_ROWS).cast("int").alias("_salts")))
    stored = index.join(buckets, ["band", "value"]).select(
        "band", "value", F.pmod(F.xxhash64("hash"), F.col("_salts")).cast("int").alias("_salt"), F.col("hash").alias("a"), F.col("first_id").alias("a_id"))
    masks = F.array(*[F.lit(m).cast("long") for m in flips])
    probes = (
        index.withColumn("_mask", F.explode(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("_mask")))
        .join(buckets, ["band", "value"])
        .select("band", "value", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.col("hash").alias("b"), F.col("first_id").alias("b_id"))
    )
    a, b = F.col("a"), F.col("b")
    first_band = F.lit(BANDS)
    for i in reversed(range(BANDS)):
        first_band = F.when(distance(_band(a, i), _band(b, i)) <= reach, F.lit(i)).otherwise(first_band)
    return (
        stored.join(probes, ["band", "value", "_salt"])
        .where((F.col("a_id") < F.col("b_id")) & (distance(a, b) <= max_dist) & (first_band == F.col("band")))
        .select("a", "b", "a_id", "b_id", distance(a, b).alias("dist"))
    )


def nearest_earlier(hashes: DataFrame, max_dist: int) -> DataFrame:
    """Per picture the least distance to any earlier picture, null where none is within ``max_dist``.

    A later copy of a hash has distance 0; only first pictures of different hashes are compared.
    """
    hashes = cut_lineage(hashes)  # two narrow columns, read three times below
    distinct = cut_lineage(distinct_hashes(hashes))
    best = near_hashes(distinct, max_dist).groupBy(F.col("b").alias("hash")).agg(F.min("dist").alias("_d"))
    return (
        hashes.join(distinct.select("hash", "first_id").join(best, "hash", "left"), "hash")
        .select("img_id", "hash", F.when(F.col("img_id") > F.col("first_id"), F.lit(0)).otherwise(F.col("_d")).cast("int").alias("min_dist"))
    )


def hash_stats(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, least and greatest distance over those above zero, and the least of all."""
    d = F.when(F.col("dist") > 0, F.col("dist"))
    return distances.groupBy(*keys).agg(
        F.avg(d).alias("avg_dist"), F.min(d).alias("min_dist"), F.max(d).alias("max_dist"), F.min("dist").alias("least"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component.

    Every round takes the least label among neighbours and then the label of that label, so long chains
    close in few rounds. Each round is stored, so neither the plan nor a lost executor's share grows.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_l"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_l", "label")).alias("_next"))
        jump = labels.select(F.col("node").alias("_next"), F.col("label").alias("_up"))
        new = cut_lineage(lower.join(jump, "_next").select("node", "_old", F.least("_next", "_up").alias("label")))
        moved = new.where(F.col("label") != F.col("_old")).limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def duplicate_clusters(hashes: DataFrame, max_dist: int) -> DataFrame:
    """Groups of pictures chained by distances within ``max_dist``, with their spread. Singles are left out.

    Columns: cluster (first picture), pictures, hashes, min_dist, avg_dist, max_dist over the linked pairs.
    """
    distinct = cut_lineage(distinct_hashes(hashes))
    pairs = cut_lineage(near_hashes(distinct, max_dist))
    edges = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    labels = components(distinct.select(F.col("first_id").alias("node")), edges)
    sized = distinct.join(labels, distinct["first_id"] == labels["node"]).groupBy("label").agg(
        F.sum("copies").alias("pictures"), F.count("*").alias("hashes"))
    spread = pairs.join(labels, pairs["a_id"] == labels["node"]).groupBy("label").agg(
        F.min("dist").alias("min_dist"), F.avg("dist").alias("avg_dist"), F.max("dist").alias("max_dist"))
    return sized.where("pictures > 1").join(spread, "label", "left").withColumnRenamed("label", "cluster")
