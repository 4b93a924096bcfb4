"""Written intermediate tables: later steps read stored rows, whichever executors are lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import scratch_path


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and return a reader of it."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if partition_by:  # these come last from the reader
        stored = stored.select(*df.columns)
    stored.stage_path = path
    return stored


def discard(*stages: DataFrame) -> None:
    """Remove tables that ``stage`` returned, once what was made of them is stored and nothing will read them again."""
    for stored in stages:
        context = stored.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(stored.stage_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def keep_row(df: DataFrame, *derived):
    """All input columns as one struct ``row`` beside derived ones, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *derived)


#: A side with at most so many rows (some tens of bytes each) is broadcast, a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a stored table of short rows, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def look_up(rows: DataFrame, facts: DataFrame, *on: str) -> DataFrame:
    """Inner join of stored ``rows`` with ``facts``, which has one row per key.

    Keys that hold more than a thousandth of the rows, fewer than 1,000, are broadcast; the others are joined by shuffle.
    """
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_many"))
    heavy = stage(sizes.where(F.col("_many") > rows.count() / 1000).select(*on), "heavy")
    loud = F.broadcast(facts.join(F.broadcast(heavy), list(on)))
    rest = rows.join(F.broadcast(heavy), list(on), "left_anti").join(facts.join(F.broadcast(heavy), list(on), "left_anti"), list(on))
    return rows.join(loud, list(on)).unionByName(rest)
