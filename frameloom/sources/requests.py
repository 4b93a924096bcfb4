"""Job requests: JSON lines with optional fields; a missing field is a reason, never an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_SCHEMA = "job_id STRING, tool STRING, inputUrl STRING, outputUrl STRING, config MAP<STRING, STRING>"
BATCH_TOOLS = ["batch", "batch_pipeline"]


def resolve_requests(raw: DataFrame) -> DataFrame:
    """Defaults, lower-case tool, and ``error`` naming the first missing field."""
    tool = F.lower(F.coalesce("tool", F.lit("")))
    whole_batch = tool.isin(*BATCH_TOOLS)
    error = (
        F.when(tool == "", F.lit("Missing 'tool' parameter"))
        .when(~whole_batch & (F.coalesce("inputUrl", F.lit("")) == ""), F.lit("Missing 'inputUrl' parameter"))
        .when(~whole_batch & (F.coalesce("outputUrl", F.lit("")) == ""), F.lit("Missing 'outputUrl' parameter"))
    )
    return raw.select(
        "job_id", tool.alias("tool"), F.col("inputUrl").alias("input_url"), F.col("outputUrl").alias("output_url"),
        F.coalesce("config", F.create_map().cast("map<string,string>")).alias("config"), error.alias("error"),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON-lines files."""
    return resolve_requests(spark.read.schema(REQUEST_SCHEMA).json(path))


def parse_requests(df: DataFrame, column: str = "json") -> DataFrame:
    """Requests from a JSON text column."""
    return resolve_requests(df.select(F.from_json(column, REQUEST_SCHEMA).alias("r")).select("r.*"))
