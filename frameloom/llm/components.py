"""Connected components of an edge table by least labels with label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (a, b: long).

    Every round stores its labels, so a lost executor costs one round at most. Labels are minima, which combine before the
    shuffle, so a node with very many edges is no single task's work; the joins are on stored tables with one row per node
    on one side, which adaptive execution can split.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        step = stage(step, "labels-step")
        far = step.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        jumped = stage(step.join(far, step["label"] == far["at"], "left")
                       .select("node", F.least("label", F.coalesce("jump", "label")).alias("label"), "old"), "labels")
        labels = jumped.select("node", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels
