"""Media facts from probe JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE_SCHEMA = (
    "streams ARRAY<STRUCT<codec_type: STRING, width: STRING, height: STRING, r_frame_rate: STRING>>, "
    "format STRUCT<duration: STRING>, error STRING"
)


def probe_normalise(json: Column) -> Column:
    """Struct (width, height, fps, duration, has_audio) with defaults; unreadable JSON gives all defaults."""
    info = F.from_json(json, PROBE_SCHEMA, {"mode": "PERMISSIVE"})
    streams = F.coalesce(info["streams"], F.array().cast(
        "array<struct<codec_type:string,width:string,height:string,r_frame_rate:string>>"))
    readable = info.isNotNull() & (info["streams"].isNotNull() | info["format"].isNotNull())
    video = F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(1))
    rate = F.coalesce(video["r_frame_rate"], F.lit("30/1"))
    part = F.split(rate, "/")
    num, den = part[0].try_cast("int"), F.try_element_at(part, F.lit(2)).try_cast("int")
    fps = F.when(rate.contains("/"), F.when(den != 0, num / F.nullif(den, F.lit(0)))).otherwise(rate.try_cast("double"))
    return F.struct(
        F.coalesce(video["width"].try_cast("int"), F.lit(1920)).alias("width"),
        F.coalesce(video["height"].try_cast("int"), F.lit(1080)).alias("height"),
        F.coalesce(fps, F.lit(30.0)).alias("fps"),
        F.coalesce(info["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration"),
        F.when(readable, F.exists(streams, lambda s: s["codec_type"] == "audio")).otherwise(F.lit(True)).alias("has_audio"),
    )
