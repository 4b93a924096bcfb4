"""Result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per item, failures included, in a folder per status. Rows are not shuffled for it."""
    results.write.mode(mode).partitionBy("status").parquet(path)
