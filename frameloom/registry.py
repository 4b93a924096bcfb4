"""Tools by name, and chains of tools over pixel tables ``img_id, y, x, band, v``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import pixels as P
from .operators import raster as R

Tool = Callable[[DataFrame, dict], DataFrame]
TOOLS: dict[str, Tool] = {}
COLUMNS = ["img_id", "y", "x", "band", "v"]


def tool(name: str) -> Callable[[Tool], Tool]:
    """Register a picture tool. It is given pixel rows with the picture size ``w, h`` and returns the same, with the new size."""

    def add(fn: Tool) -> Tool:
        TOOLS[name] = fn
        return fn

    return add


@tool("vignettes")
def vignettes(df: DataFrame, config: dict) -> DataFrame:
    at = [F.col(c) for c in ("v", "x", "y", "w", "h")]
    return df.withColumn("v", P.vignette(*at, float(config.get("intensity", 50)) / 100.0))


@tool("resize")
def resize(df: DataFrame, config: dict) -> DataFrame:
    width, height = int(config["width"]), int(config["height"])
    return R.resize_nearest(df, width, height).withColumns({"w": F.lit(width), "h": F.lit(height)})


@tool("tone")
def tone(df: DataFrame, config: dict) -> DataFrame:
    return df.withColumn("v", P.percent(F.col("v"), float(config.get("brightness", 0)), float(config.get("contrast", 0))))


@tool("blur")
def blur(df: DataFrame, config: dict) -> DataFrame:
    return R.box_blur(df, int(config.get("radius", 1)))


@tool("flip")
def flip(df: DataFrame, config: dict) -> DataFrame:
    return R.flip(df, bool(config.get("horizontal", True)))


def apply_tool(df: DataFrame, name: str, config: dict) -> tuple[DataFrame, DataFrame | None]:
    """Result pixels of one tool; for a tool that is not available, error rows per picture instead."""
    fn = TOOLS.get(name.lower())
    if fn is None:
        failed = df.select("img_id").distinct().withColumn("status", F.lit("failed")).withColumn("error", F.lit(f"Unknown tool: {name}"))
        return df.limit(0), failed
    sized = df if {"w", "h"} <= set(df.columns) else R.with_size(df)
    return sized.transform(fn, config).select(*COLUMNS, "w", "h"), None


def tool_chain(df: DataFrame, steps: Sequence[tuple[str, dict]]) -> tuple[DataFrame, DataFrame | None]:
    """Feed pictures through named tools in order: one lazy plan. The first missing tool ends the chain.

    The size is measured once, if the pictures arrive without it, and carried from tool to tool.
    """
    for name, config in steps:
        df, failed = apply_tool(df, name, config)
        if failed is not None:
            return df, failed
    return df.select(*COLUMNS), None


def caption_index(source_idx: Column, step_idx: Column, per_source: bool) -> Column:
    """Which caption a file takes: by its source in a batch of sources, by its place in the step otherwise."""
    return source_idx if per_source else step_idx


def batch_scorer(df: DataFrame, load: Callable[[], Callable], column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Score vectors with a model that every task loads once. ``load()`` returns ``fn(matrix) -> scores``."""

    def score(batches):
        import numpy as np
        import pandas as pd

        model = load()
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": batch["key"], "score": model(np.stack(batch["x"].to_numpy()))})

    named = df.select(F.col(key).alias("key"), F.col(column).alias("x"))
    return named.mapInPandas(score, "key long, score double").withColumnRenamed("key", key)
