"""Queries on streams, tool chains and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import sequence_index
from ..registry import TOOLS, apply_tool, batch_scorer, caption_index, tool_chain
from ..streaming import items as S
from . import fixtures as fx
from .catalog import CHECKS, query, table
from .rasters import COLS, RGB, d, st, stp


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return S.event_time(S.stream_items(spark, sf_dir, schema, "events.parquet"))


STAGE = {"view": "download", "click": "process", "purchase": "upload", "signup": "process", "error": "download"}
_STAGE_SQL = fx.sql_case("event_type", STAGE)


def _stage():
    out = F.lit(None).cast("string")
    for k, v in STAGE.items():
        out = F.when(F.col("event_type") == k, F.lit(v)).otherwise(out)
    return out


@query("stream_items", "SELECT event_id, user_id, event_type, value FROM events")
def stream_items(spark, sf_dir):
    return S.run_to_table(_events(spark, sf_dir).select("event_id", "user_id", "event_type", "value"), "items").drop("batch_id")


@query("stream_download_once", "SELECT DISTINCT user_id AS input_id FROM events")
def stream_download_once(spark, sf_dir):
    stream = _events(spark, sf_dir).select(F.col("user_id").alias("input_id"), "ts")
    return S.run_to_table(S.download_once(stream, "input_id", "60 days"), "fetches").select("input_id")


@query("stream_progress", f"""SELECT job_id, seen, downloads, processed, uploads, least(floor((downloads * 10 + processed * 70 + uploads * 20) / seen), 99)::BIGINT AS progress FROM (
  SELECT user_id AS job_id, count(*) AS seen, count(*) FILTER (s = 'download') AS downloads, count(*) FILTER (s = 'process') AS processed, count(*) FILTER (s = 'upload') AS uploads
  FROM (SELECT user_id, {_STAGE_SQL} AS s FROM events) GROUP BY user_id)""")
def stream_progress(spark, sf_dir):
    stream = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), _stage().alias("stage"), "ts")
    with S.rocksdb_state(spark):
        return S.latest_rows(S.run_to_table(S.progress(stream), "progress", "update"), ["job_id"])


def _latency(spark, sf_dir, width, slide=None):
    stream = _events(spark, sf_dir).select("ts", _stage().alias("stage"), F.col("value").alias("seconds"))
    out = S.run_to_table(S.stage_latency(stream, width, slide), "latency")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(text("start").alias("start"), text("end").alias("end"), "stage", "n", F.round("mean_s", 8).alias("mean_s"), "max_s")


_LATENCY = """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, strftime(w + INTERVAL {width}, '%Y-%m-%d %H:%M:%S') AS "end", stage, count(*) AS n, round(avg(value), 8) AS mean_s, max(value) AS max_s
  FROM (SELECT {stage} AS stage, value, {w} AS w FROM events) WHERE w + INTERVAL {width} <= (SELECT max(date_trunc('milliseconds', ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL"""


@query("stage_latency", _LATENCY.format(width="1 HOUR", stage=_STAGE_SQL, w="date_trunc('hour', ts)"))
def stage_latency(spark, sf_dir):
    return _latency(spark, sf_dir, "1 hour")


@query("stage_latency_sliding", _LATENCY.format(width="1 HOUR", stage=_STAGE_SQL, w="unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])"))
def stage_latency_sliding(spark, sf_dir):
    return _latency(spark, sf_dir, "1 hour", "30 minutes")


# items still open when the stream ends fail if the watermark has passed their time, and give no row if not
_TRACKED = f"""WITH settled AS ({CHECKS["attempt_resolution"]}), span AS (SELECT user_id AS item_id, min(ts) AS first_ts, (SELECT max(ts) FROM events) AS last_ts FROM events GROUP BY user_id)
SELECT item_id, CASE WHEN status = 'pending' THEN 'failed' ELSE status END AS status, attempts, CASE WHEN status = 'pending' THEN 'TIMEOUT' ELSE code END AS code
FROM settled JOIN span USING (item_id) WHERE status <> 'pending' OR first_ts + INTERVAL 1800 SECOND < last_ts - INTERVAL 10 MINUTE"""


@query("attempt_tracker", _TRACKED)
def attempt_tracker(spark, sf_dir):
    codes = {"purchase": "HASH_MISMATCH", "click": "TIMEOUT", "signup": "NETWORK_ERROR", "error": "NOT_FOUND"}
    code = F.lit(None).cast("string")
    for k, v in codes.items():
        code = F.when(F.col("event_type") == k, F.lit(v)).otherwise(code)
    stream = _events(spark, sf_dir).select(
        F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"), code.alias("code"), (F.col("event_type") != "error").alias("retryable"))
    with S.rocksdb_state(spark):
        return S.run_to_table(S.attempt_tracker(stream), "attempts").drop("batch_id")


@query("stream_results_sink", "SELECT l_returnflag AS status, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem) GROUP BY l_returnflag")
def stream_results_sink(spark, sf_dir):
    stream = S.stream_items(spark, sf_dir, table(spark, sf_dir, "lineitem").schema, "lineitem.parquet")
    rows = stream.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("status"), F.lit(1).alias("one"))
    stored = S.run_to_table(rows, "results")
    once = S.first_results(stored, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status"])
    return once.groupBy("status").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


# --- tools --------------------------------------------------------------------------------------------------

CHAIN = [("tone", {"brightness": 10, "contrast": -10}), ("flip", {"horizontal": True}), ("blur", {"radius": 1}), ("resize", {"width": 12, "height": 10})]
_TONE = st(f"128.0::DOUBLE + ({st(f'v * {d(1.1)}')} - 128.0::DOUBLE) * {d(1.0 + -10 / 100.0)}")
_W = "OVER (PARTITION BY img_id, band, {a} ORDER BY {b} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query("tool_chain", RGB + f""", t AS (SELECT img_id, y, 7 - x AS x, band, {_TONE} AS v FROM rgb), b1 AS (SELECT {COLS}, avg(v) {_W.format(a='y', b='x')} AS v FROM t),
b2 AS (SELECT {COLS}, {stp('avg(v) ' + _W.format(a='x', b='y'))} AS v FROM b1), oy AS (SELECT unnest(range(10))::INTEGER AS p), ox AS (SELECT unnest(range(12))::INTEGER AS p)
SELECT img_id, oy.p AS y, ox.p AS x, band, v FROM oy, ox, b2 WHERE b2.y = oy.p * 8 // 10 AND b2.x = ox.p * 8 // 12""")
def chain(spark, sf_dir):
    return tool_chain(fx.sized(fx.rgb(spark, sf_dir)), CHAIN)[0]


@query("tool_registry", f"""SELECT vec_id AS img_id, t.tool, CASE WHEN t.known THEN 'completed' ELSE 'failed' END AS status, CASE WHEN NOT t.known THEN 'Unknown tool: ' || t.tool END AS error
FROM embeddings, (VALUES {', '.join(f"('{t}', {str(t in TOOLS).lower()})" for t in ('vignettes', 'flip', 'bg_remove'))}) t(tool, known)""")
def registry(spark, sf_dir):
    px = fx.sized(fx.rgb(spark, sf_dir))
    parts = []
    for name in ("vignettes", "flip", "bg_remove"):
        out, failed = apply_tool(px, name, {})
        if failed is None:
            failed = out.groupBy("img_id").agg(F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
        parts.append(failed.withColumn("tool", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("chain_caption_index", fx.with_parts("items") + """, v AS (SELECT job_id, idx, k, row_number() OVER (PARTITION BY job_id ORDER BY idx, k) - 1 AS step_idx FROM items, (SELECT unnest([0, 1]) AS k))
SELECT job_id, idx, k, idx AS by_source, step_idx AS by_step FROM v""")
def chain_caption_index(spark, sf_dir):
    outputs = fx.items(spark, sf_dir).select("job_id", "idx").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    placed = sequence_index(outputs, ["job_id"], ["idx", "k"], [F.floor(F.col("idx") / 65536)], "step_idx")
    at = (F.col("idx"), F.col("step_idx"))
    return placed.select("job_id", "idx", "k", caption_index(*at, True).alias("by_source"), caption_index(*at, False).alias("by_step"))


@query("batch_scorer", """SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(embedding, lambda e, i: e::DOUBLE * (((i - 1) * 7) % 13 - 6) / 10.0::DOUBLE)))), 6) AS score FROM embeddings""")
def scorer(spark, sf_dir):
    def load():
        import numpy as np

        weights = ((np.arange(64) * 7) % 13 - 6) / 10.0
        return lambda x: 1.0 / (1.0 + np.exp(-(x.astype("float64") @ weights)))

    return batch_scorer(table(spark, sf_dir, "embeddings"), load).withColumn("score", F.round("score", 6))
