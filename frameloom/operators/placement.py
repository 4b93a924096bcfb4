"""Caption placement around detected boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import ALIGNMENTS, EDGE_Y, FACE_MARGIN, SCAN_Y, ZONE_Y
from ..functions.geometry import caption_y_ratio


def _fixed_candidates() -> list[tuple[str, float, str]]:
    zones = [(name, y, a) for name, y in ZONE_Y for a in ALIGNMENTS]
    return zones + [("custom", y, a) for y in SCAN_Y + EDGE_Y for a in ALIGNMENTS]


def candidates(position: Column, align: Column, custom_y: Column) -> Column:
    """Array of candidate placements in order of preference: the wanted one first."""
    y = caption_y_ratio(position, custom_y)

    def one(p: Column, at: Column, a: Column) -> Column:
        return F.struct(p.alias("position"), at.alias("y"), a.alias("align"))

    first = [one(position, y, align)] + [one(position, y, F.lit(a)) for a in ALIGNMENTS]
    fixed = [one(F.lit(p), F.lit(at), F.lit(a)) for p, at, a in _fixed_candidates()]
    return F.concat(F.array(*first), F.array(*fixed))


def _blocks(box: dict[str, Column], cand: Column, cw: Column, ch: Column) -> Column:
    """Does a box, widened by its margin, overlap the caption at a candidate? Touching is no overlap."""
    left = (
        F.when(cand["align"] == "left", F.lit(0.05)).when(cand["align"] == "right", 0.95 - cw).otherwise(0.5 - cw / 2)
    )
    right = (
        F.when(cand["align"] == "left", 0.05 + cw).when(cand["align"] == "right", F.lit(0.95)).otherwise(0.5 + cw / 2)
    )
    top = F.greatest(F.lit(0.0), cand["y"] - ch / 2)
    bottom = F.least(F.lit(1.0), cand["y"] + ch / 2)
    return (
        (left < box["x"] + box["w"] * (1 + FACE_MARGIN)) & (right > box["x"] - box["w"] * FACE_MARGIN)
        & (top < box["y"] + box["h"] * (1 + FACE_MARGIN)) & (bottom > box["y"] - box["h"] * FACE_MARGIN)
    )


def blocked_mask(pictures: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add ``cands`` and ``mask`` (bit k set: candidate k overlaps a box) to each picture.

    Each box marks the candidates it covers in one 64-bit word, and words combine by OR before the shuffle:
    no candidate is ever joined with a box, and a picture with very many boxes costs one word per task.
    """
    sized = pictures.select("img_id", F.col("cap_w"), F.col("cap_h"), "position", "align", "custom_y")
    joined = boxes.select("img_id", "x", "y", "w", "h").join(sized, "img_id")
    box = {c: F.col(c) for c in "xywh"}
    cands = candidates(F.col("position"), F.col("align"), F.col("custom_y"))
    hits = F.transform(cands, lambda c: _blocks(box, c, F.col("cap_w"), F.col("cap_h")))
    word = F.aggregate(
        F.transform(hits, lambda hit, k: F.when(hit, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )
    masks = joined.groupBy("img_id").agg(F.bit_or(word).alias("mask"))
    return pictures.join(masks, "img_id", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))).withColumn("cands", cands)


def free_placements(pictures: DataFrame, boxes: DataFrame) -> DataFrame:
    """Candidate placements of each picture that overlap none of its boxes, by ``rank``."""
    df = blocked_mask(pictures, boxes).select("img_id", "mask", F.posexplode("cands").alias("rank", "c"))
    free = F.call_function("shiftright", F.col("mask"), F.col("rank")).bitwiseAND(F.lit(1).cast("long")) == 0
    return df.where(free).select("img_id", "rank", "c.position", "c.y", "c.align")


def first_placement(pictures: DataFrame, boxes: DataFrame) -> DataFrame:
    """The first free candidate of each picture; bottom centre at 0.88 where none is free."""
    df = blocked_mask(pictures, boxes)
    free = F.bitwise_not(F.col("mask"))
    rank = F.bit_count(free.bitwiseAND(-free) - 1)  # index of the lowest clear bit
    pick = F.try_element_at(F.col("cands"), rank.cast("int") + 1)
    return df.select(
        "img_id",
        F.coalesce(pick["position"], F.lit("bottom")).alias("position"),
        F.coalesce(pick["y"], F.lit(0.88)).alias("y"),
        F.coalesce(pick["align"], F.lit("center")).alias("align"),
    )
