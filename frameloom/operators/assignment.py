"""Size-balanced assignment: by rank in alternating direction, or largest first to the worker with the least load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import sequence_index

BLOCK = 1 << 20


def size_runs(sizes: DataFrame, workers: int, memory: Sequence[int] | None = None) -> DataFrame:
    """Items each worker takes of every size: ``job_id, size, worker, load, taken``.

    ``sizes`` has one row per job and distinct size with its count ``n``. The rule is sequential in a job, so a
    job's sizes pass through one task in falling order, as a stream: the task keeps only the worker loads. A run
    of equal sizes is placed by arithmetic, not item by item.
    """
    weight = [max(int(m), 1) for m in (memory or [1] * workers)]

    def place(batches):
        import heapq
        from fractions import Fraction

        import pandas as pd

        current, load = None, None
        equal = all(w == weight[0] for w in weight)

        def rank(w):
            return load[w] if equal else Fraction(load[w], weight[w])

        for batch in batches:
            out = []
            for job, size, n in zip(batch["job_id"].tolist(), batch["size"].tolist(), batch["n"].tolist()):
                if job != current:
                    current, load = job, [0] * workers
                if n == 1:
                    w = min(range(workers), key=rank)
                    out.append((job, size, w, load[w], 1))
                    load[w] += size
                    continue
                if size == 0:
                    w = min(range(workers), key=rank)
                    out.append((job, size, w, load[w], n))
                    continue
                # all placements that start below a common level t come before the others
                def below(t):
                    return [max(0, -((load[w] - t * weight[w]) // size)) for w in range(workers)]

                lo, hi = 0, max(load) + size * (n + 1)
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    if sum(below(mid)) <= n:
                        lo = mid
                    else:
                        hi = mid - 1
                taken = below(lo)
                start = list(load)
                load = [load[w] + taken[w] * size for w in range(workers)]
                heap = [(rank(w), w) for w in range(workers)]
                heapq.heapify(heap)
                for _ in range(n - sum(taken)):
                    w = heap[0][1]
                    taken[w] += 1
                    load[w] += size
                    heapq.heapreplace(heap, (rank(w), w))
                out.extend((job, size, w, start[w], taken[w]) for w in range(workers) if taken[w])
            yield pd.DataFrame(out, columns=["job_id", "size", "worker", "load", "taken"])

    ordered = sizes.repartition("job_id").sortWithinPartitions("job_id", F.desc("size"))
    return ordered.select("job_id", "size", "n").mapInPandas(
        place, "job_id long, size long, worker int, load long, taken long"
    )


def lpt_assign(items: DataFrame, workers: int, memory: Sequence[int] | None = None) -> DataFrame:
    """Add ``worker`` to ``job_id, idx, size``. Ties go to the lowest worker id, equal sizes in item order.

    Only distinct sizes with their counts meet per job. A worker's share of a run is spread out again to one
    row per item, ranked by the load it starts from, and met with the items by their rank among equal sizes.
    """
    weight = [float(max(int(m), 1)) for m in (memory or [1] * workers)]
    sizes = items.groupBy("job_id", "size").agg(F.count("*").alias("n"))
    rows = items.count()  # as many as places
    runs = size_runs(sizes, workers, memory)
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / BLOCK)))
    within = F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("taken") - F.col("_b") * BLOCK).cast("int") - 1)
    places = (
        runs.withColumn("_b", block)
        .withColumn("_k", F.explode(within))
        .withColumn("_k", F.col("_k") + F.col("_b") * BLOCK)
        .withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weight]), F.col("worker") + 1))
        .withColumn("_key", (F.col("load") + F.col("_k") * F.col("size")) / F.col("_w"))
    )
    coarse = F.floor(F.when(F.col("size") > 0, F.col("_key") / (F.col("size") * BLOCK)).otherwise(F.col("_k") / BLOCK))
    places = sequence_index(places, ["job_id", "size"], ["_key", "worker", "_k"], [coarse], "_rank", rows)
    ranked = sequence_index(items, ["job_id", "size"], ["idx"], [F.floor(F.col("idx") / BLOCK)], "_rank", rows)
    return ranked.join(places.select("job_id", "size", "_rank", "worker"), ["job_id", "size", "_rank"]).drop("_rank")


def balanced_assign(items: DataFrame, workers: int) -> DataFrame:
    """Add ``worker`` to ``job_id, idx, size``: ranks by falling size are dealt forth and back over the workers.

    The rank is a distributed position, so a job of any size is many tasks' work. Loads of two workers differ by the largest
    item at most.
    """
    ordered = items.withColumn("_neg", -F.col("size"))
    coarse = [F.col("_neg"), F.floor(F.col("idx") / 65536)]  # items of one size are many chunks if need be
    ranked = sequence_index(ordered, ["job_id"], ["_neg", "idx"], coarse, "_rank")
    place = F.col("_rank") % workers
    forth = F.floor(F.col("_rank") / workers) % 2 == 0
    return ranked.withColumn("worker", F.when(forth, place).otherwise(workers - 1 - place).cast("int")).drop("_neg", "_rank")
