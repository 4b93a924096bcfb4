"""Reads within tiles, across their borders and far away."""

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import raster, tiles


def picture(spark, w, h, missing=()):
    rows = [(i, y, x, b, float((i * 31 + y * 17 + x * 5 + b) % 251), w, h) for i in (1, 2) for y in range(h) for x in range(w) for b in (0, 1) if (y, x) not in missing]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "img_id int, y int, x int, band int, v double, w int, h int"), {(r[0], r[3], r[1], r[2]): r[4] for r in rows}


def got(df, *names):
    return {(r["img_id"], r["band"], r["y"], r["x"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("reach,sy,sx", [(3, "y + 3", "x - 2"), (None, "y + 3", "x - 2"), (None, "h - 1 - y", "w - 1 - x"), (None, "x * 3 - 20", "y * 2"), (None, "0", "0")])
def test_reads_near_and_far(spark, reach, sy, sx):
    w, h = 37, 29
    df, value = picture(spark, w, h, missing={(4, 4), (20, 9)})
    out = got(tiles.read_pixels(df, {"a": (F.expr(sy), F.expr(sx)), "b": (F.expr(sy), F.expr(f"({sx}) + 1"))}, reach, tile=8), "a", "b", "v")
    assert len(out) == len(value)
    for (i, b, y, x), (near, next_one, v) in out.items():
        ty, tx = (eval(e, {"y": y, "x": x, "w": w, "h": h}) for e in (sy, sx))
        assert (near, next_one, v) == (value.get((i, b, ty, tx)), value.get((i, b, ty, tx + 1)), value[i, b, y, x])


def test_no_join_and_one_scan(spark, tmp_path):
    df, _ = picture(spark, 12, 9)
    df.write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    bounded = raster.elastic(px, 1.0, 1, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in bounded and bounded.count("FileScan") == 1
    for out in (raster.shear(px, 0.5), raster.rotate(px, 30.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "_sy" not in plan  # from the stored tiles, no pixel is a key of a join


def test_a_picture_over_many_tiles_turns_like_one(spark):
    df, value = picture(spark, 90, 70)
    out = got(raster.remap(df, F.col("h") - 1 - F.col("y"), F.col("w") - 1 - F.col("x")), "v")
    assert out == {(i, b, y, x): (value[i, b, 69 - y, 89 - x],) for i, b, y, x in value}


def test_no_pixels(spark):
    df, _ = picture(spark, 3, 3)
    assert raster.remap(df.where("img_id > 5"), F.col("y") + 1, F.col("x"), fill=0.0).count() == 0
