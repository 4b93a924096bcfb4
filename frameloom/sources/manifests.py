"""Content manifests: digest, size and type of an object, kept beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import MANIFEST_REQUIRED
from ..functions.urls import content_type, last_segment, raw_extension

MANIFEST_SCHEMA = (
    "version STRING, fileKey STRING, contentHash STRING, sizeBytes LONG, contentType STRING, "
    "uploadedAt STRING, uploadedBy STRING, metadata MAP<STRING, STRING>"
)


def build_manifest(objects: DataFrame, uploaded_by: str = "worker") -> DataFrame:
    """One manifest row per object with columns ``url`` and ``content``."""
    return objects.select(
        F.lit("1.0").alias("version"),
        last_segment(F.col("url")).alias("file_key"),
        F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        content_type(raw_extension(last_segment(F.col("url")))).alias("content_type"),
        F.current_timestamp().alias("uploaded_at"),
        F.lit(uploaded_by).alias("uploaded_by"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def manifest_json(manifest: DataFrame) -> Column:
    """JSON text of a manifest row in the field names readers expect."""
    return F.to_json(F.struct(
        F.col("version"), F.col("file_key").alias("fileKey"), F.col("content_hash").alias("contentHash"),
        F.col("size_bytes").alias("sizeBytes"), F.col("content_type").alias("contentType"),
        F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("uploadedAt"),
        F.col("uploaded_by").alias("uploadedBy"), F.col("metadata"),
    ))


def read_manifest(json: Column) -> Column:
    """Struct (manifest, error). No text is no manifest and no error; a missing field or bad JSON is an error."""
    present = F.from_json(json, "MAP<STRING, STRING>")
    absent = F.lit(None).cast("string")
    for field in reversed(MANIFEST_REQUIRED):
        absent = F.when(~F.map_contains_key(present, field), F.lit(field)).otherwise(absent)
    error = (
        F.when(json.isNull(), F.lit(None))
        .when(present.isNull() | absent.isNotNull(), F.lit("MANIFEST_INVALID"))
    )
    body = F.from_json(json, MANIFEST_SCHEMA)
    return F.struct(F.when(error.isNull() & json.isNotNull(), body).alias("manifest"), error.alias("error"), absent.alias("missing"))
