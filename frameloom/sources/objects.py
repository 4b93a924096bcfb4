"""Objects to process: listing, kinds and size limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dimensions import KIND_EXTENSIONS, MAX_ITEM_BYTES


def scan_objects(spark: SparkSession, root: str, glob: str = "*", content: bool = False, partitions: bool = False) -> DataFrame:
    """Files below a folder. The bytes are only read where ``content`` asks for them.

    With ``partitions`` the folders are named column=value and become columns, and filters on them leave folders out.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = reader.load(root) if partitions else reader.option("recursiveFileLookup", "true").load(root)
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return files.select(*columns, *[c for c in files.columns if c not in (*columns, "content")])


def size_reason(size: Column, limit: int = MAX_ITEM_BYTES) -> Column:
    """Why an object of this size is refused; null if it is not."""
    return F.when(size == 0, F.lit("empty")).when(size > limit, F.lit("too large"))


def kind_dimension(spark: SparkSession) -> DataFrame:
    """``rule, ext, kind``: the file kinds each tool accepts."""
    rows = [(tool, ext, kind) for (tool, kind), exts in KIND_EXTENSIONS.items() for ext in exts]
    return spark.createDataFrame(rows, "rule string, ext string, kind string")


def media_kind(df: DataFrame, tool: str = "tool", ext: str = "ext") -> DataFrame:
    """Add ``kind`` by the rule of the tool, or by the general rule where it has none."""
    own = sorted({t for t, _ in KIND_EXTENSIONS if t != "*"})
    dim = F.broadcast(kind_dimension(df.sparkSession).withColumnRenamed("ext", "_ext"))  # fixed, about 60 rows
    rule = F.when(F.col(tool).isin(*own), F.col(tool)).otherwise(F.lit("*"))
    return (
        df.withColumn("_rule", rule)
        .join(dim, (F.col("_rule") == F.col("rule")) & (F.lower(F.col(ext)) == F.col("_ext")), "left")
        .withColumn("kind", F.coalesce("kind", F.lit("other")))
        .drop("_rule", "rule", "_ext")
    )
