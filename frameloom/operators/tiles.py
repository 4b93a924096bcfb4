"""Pictures in tiles with a halo, so that pixels read each other without a join of pixels.

A tile is one row: the pixels of a square and of a margin around it, and what its own pixels ask for. A read that falls into
the tile or its margin is an array access. Reads that fall farther are grouped by their own tile and the tile they fall into,
and meet that tile as one row each. No array holds more than a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TILE = 64
HALO = 8


def _rectangle(tile: int, halo: int) -> dict[str, Column]:
    """Rows and columns that a tile holds, margin included, within the picture."""
    low = lambda c: F.greatest(F.col(c) * tile - halo, F.lit(0))
    high = lambda c, n: F.least(F.col(c) * tile + tile + halo, F.col(n))
    return {"_y0": low("_ty"), "_x0": low("_tx"), "_y1": high("_ty", "h"), "_x1": high("_tx", "w")}


def _read(sy: Column, sx: Column) -> Column:
    """Value at (sy, sx) of the tile, null if there is none."""
    width = F.col("_x1") - F.col("_x0")
    at = (sy - F.col("_y0")) * width + sx - F.col("_x0")
    whole = F.size("_cells") == (F.col("_y1") - F.col("_y0")) * width
    # cells are in order; where pixels are missing their places have to be looked for
    found = F.when(whole, F.get("_cells", at.cast("int"))["v"]).otherwise(F.get(F.filter("_cells", lambda c: c["at"] == at), 0)["v"])
    return F.when(_inside(sy, sx), found)


def _inside(sy: Column, sx: Column) -> Column:
    return (sy >= F.col("_y0")) & (sy < F.col("_y1")) & (sx >= F.col("_x0")) & (sx < F.col("_x1"))


def read_pixels(df: DataFrame, reads: dict[str, tuple[Column, Column]], reach: int | None = None, tile: int = TILE) -> DataFrame:
    """Add a column per read: the value ``v`` of the same picture and band at (row, column), null outside.

    ``df`` needs ``w`` and ``h``; rows are pixels, further columns stay. All reads of a pixel have to lie within the halo of
    each other. With ``reach`` no read is farther than that from its pixel, in rows or in columns, and one pass does; without
    it the tiles are stored and far reads join them.
    """
    halo = HALO if reach is None else reach
    keys = ["img_id"] + (["band"] if "band" in df.columns else [])
    rest = [c for c in df.columns if c not in keys]
    names = list(reads)
    asked = df.withColumns({f"_r{k}{a}": c.cast("int") for k, n in enumerate(names) for a, c in zip("yx", reads[n], strict=True)})
    places = [f"_r{k}{a}" for k in range(len(names)) for a in "yx"]
    span = lambda c, n: F.sequence(
        F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / tile).cast("int"), F.floor(F.least(F.col(c) + halo, F.col(n) - 1) / tile).cast("int"))
    dealt = asked.withColumn("_ty", F.explode(span("y", "h"))).withColumn("_tx", F.explode(span("x", "w")))
    dealt = dealt.withColumns(_rectangle(tile, halo))
    own = (F.col("_ty") == F.floor(F.col("y") / tile)) & (F.col("_tx") == F.floor(F.col("x") / tile))
    at = (F.col("y") - F.col("_y0")) * (F.col("_x1") - F.col("_x0")) + F.col("x") - F.col("_x0")
    tiles = dealt.groupBy(*keys, "_ty", "_tx").agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("v")))).alias("_cells"),
        F.collect_list(F.when(own, F.struct(*rest, *places))).alias("_asked"),
        F.max("_y0").alias("_y0"), F.max("_x0").alias("_x0"), F.max("_y1").alias("_y1"), F.max("_x1").alias("_x1"), F.max("w").alias("_w"), F.max("h").alias("_h"))

    def answered(rows: DataFrame) -> DataFrame:
        read = lambda r: F.struct(*[r[c].alias(c) for c in rest], *[_read(r[f"_r{k}y"], r[f"_r{k}x"]).alias(n) for k, n in enumerate(names)])
        return rows.select(*keys, F.inline(F.transform("_asked", read))).select(*df.columns, *names)

    if reach is not None:
        return answered(tiles)
    tiles = cut_lineage(tiles)

    def far(r: Column) -> Column:
        """Some read is in the picture but not in the tile."""
        out = F.lit(False)
        for k in range(len(names)):
            sy, sx = r[f"_r{k}y"], r[f"_r{k}x"]
            out = out | ((sy >= 0) & (sy < F.col("_h")) & (sx >= 0) & (sx < F.col("_w")) & ~_inside(sy, sx))
        return F.coalesce(out, F.lit(False))

    near = answered(tiles.withColumn("_asked", F.filter("_asked", lambda r: ~far(r))))
    held = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c), F.col(n) - 1))
    distant = tiles.select(*keys, "_ty", "_tx", "_h", "_w", F.explode(F.filter("_asked", far)).alias("_a"))
    distant = distant.withColumns({"_fy": F.col("_a")["_r0y"], "_fx": F.col("_a")["_r0x"]}).select(
        *keys, F.col("_ty").alias("_oy"), F.col("_tx").alias("_ox"), "_a",
        F.floor(held("_fy", "_h") / tile).cast("int").alias("_ty"), F.floor(held("_fx", "_w") / tile).cast("int").alias("_tx"))
    grouped = distant.groupBy(*keys, "_oy", "_ox", "_ty", "_tx").agg(F.collect_list("_a").alias("_asked"))
    return near.union(answered(grouped.join(tiles.drop("_asked"), [*keys, "_ty", "_tx"])))
