"""Headline queries on the tables at ``$BENCH_SF_DIR``; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from frameloom.plans import load_all
from frameloom.plans.catalog import QUERIES, table
from frameloom.session import local_session

HEADLINE = [
    "plan_batch", "file_index", "worker_distribution", "throughput", "transfer_summary", "download_once", "verify", "balanced_assign",
    "apply_preset", "layout_by_frame", "caption_cycle", "first_placement",
    "clip_cursor", "resolve_effects", "template_overlays",
    "gain", "hue_shift", "box_blur", "median3", "auto_levels", "augment",
    "dct_hash", "nearest_earlier", "duplicate_clusters", "rms_envelope", "autocorr", "peaks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "frameloom-bench")
    load_all()
    table(spark, sf_dir, "lineitem").count()  # start the executor threads before the clock
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    items = table(spark, sf_dir, "lineitem").count()
    pixels = table(spark, sf_dir, "embeddings").count() * 192
    rates = {
        "batch_items_per_s": round(items / seconds["file_index"]),
        "timeline_clips_per_s": round(items / seconds["clip_cursor"]),
        "augmented_pixels_per_s": round(2 * pixels / seconds["augment"]),
    }
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
