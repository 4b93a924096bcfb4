"""Queries on batch plans, item results, retries, integrity and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keyed as K
from ..functions import timing as T
from ..functions import urls as U
from ..functions.dimensions import RETRY_POLICIES, TOOL_PATHS
from ..operators import assignment as A
from ..operators import ledger as L
from ..operators.ordered import sequence_index
from . import fixtures as fx
from .catalog import query, table
from .intake import EXT_SQL, SAFE_SQL, sql_values

G = fx.WORKERS
SEED = "('0x' || substr(sha256({}), 1, 8))::BIGINT"


def draw(*parts: str) -> str:
    """SQL for a keyed draw in [0, 1) from text parts."""
    return f"({SEED.format(' || chr(95) || '.join(parts))} / 4294967296.0)"


VARIANT_SQL = """CASE WHEN contains({u}, '.') THEN regexp_extract({u}, '(?s)^(.*)\\.([^.]*)$', 1) || '_v' || printf('%04d', {k})
 || '.' || regexp_extract({u}, '(?s)^(.*)\\.([^.]*)$', 2) ELSE {u} || '_v' || printf('%04d', {k}) END"""


def _inputs(spark, sf_dir):
    """Inputs of the batches, with the reason for those that are refused."""
    rows = fx.urls(spark, sf_dir).select(
        U.url_host(F.col("url")).alias("job_id"), "id", F.col("url").alias("input_url"),
        U.classify_extension(F.col("url")).alias("ext"),
        F.concat(F.lit("https://out.example.com/"), F.col("id").cast("string"), F.lit(".jpg")).alias("output_url"),
    )
    return L.refuse_unsafe(rows)


def _variants(spark, sf_dir):
    """Variants of the accepted inputs; a refused one stays as a single row with its error."""
    rows = _inputs(spark, sf_dir)
    made = L.expand_variants(rows.where("error is null"), 3, "batch")
    none = F.lit(None)
    refused = rows.where("error is not null").withColumns({"variant": none.cast("int"), "seed": none.cast("long"), "output_url": none.cast("string")})
    return made.unionByName(refused)


def _plan(spark, sf_dir):
    variants = _variants(spark, sf_dir).where("error is null")
    numbered = sequence_index(variants, ["job_id"], ["id", "variant"], [F.floor(F.col("id") / 65536)])
    return numbered.withColumn("worker", L.round_robin(F.col("idx"), G))


_PLAN_SQL = fx.with_parts("urls") + f""", {SAFE_SQL}, plan AS (SELECT host AS job_id, id, k AS variant, {EXT_SQL} AS ext,
  {SEED.format("url || '_' || k || '_batch'")} AS seed,
  {VARIANT_SQL.format(u="('https://out.example.com/' || id || '.jpg')", k='k')} AS output_url,
  row_number() OVER (PARTITION BY host ORDER BY id, k) - 1 AS idx
  FROM safe, (SELECT unnest([0, 1, 2]) AS k) WHERE reason IS NULL)"""


@query("plan_batch", _PLAN_SQL + f"""SELECT j.job_id, w.worker::INTEGER AS worker, count(p.id) AS items, count(DISTINCT p.id) AS inputs,
  coalesce(max(p.seed), -1) AS max_seed, max(j.refused) AS refused
  FROM (SELECT host AS job_id, count(*) FILTER (reason IS NOT NULL) AS refused FROM safe GROUP BY host) j CROSS JOIN (SELECT unnest(range({G})) AS worker) w
  LEFT JOIN plan p ON p.job_id = j.job_id AND p.idx % {G} = w.worker GROUP BY ALL""")
def plan_batch(spark, sf_dir):
    per = _plan(spark, sf_dir).groupBy("job_id", "worker").agg(
        F.count("*").alias("items"), F.count_distinct("id").alias("inputs"), F.max("seed").alias("max_seed"))
    no = F.lit(None).cast("long")
    turned = _inputs(spark, sf_dir).groupBy("job_id").agg(F.count("error").alias("refused"))
    rows = per.withColumn("refused", no).unionByName(turned.withColumns({"worker": no, "items": no, "inputs": no, "max_seed": no}))
    # idle workers get their zero row from the aggregate itself, and plain maxima combine in a hash table
    parts = [F.coalesce(F.max(F.when(F.col("worker") == w, F.col(c))), F.lit(empty).cast("long")).alias(f"{c}{w}")
             for w in range(G) for c, empty in (("items", 0), ("inputs", 0), ("max_seed", -1))]
    wide = rows.groupBy("job_id").agg(*parts, F.max("refused").alias("refused"))
    each = F.array(*[F.struct(*[F.col(f"{c}{w}").alias(c) for c in ("items", "inputs", "max_seed")]) for w in range(G)])
    return wide.select("job_id", "refused", F.posexplode(each).alias("worker", "s")).select("job_id", "worker", "s.*", "refused")


@query("expand_variants", _PLAN_SQL + f"""SELECT job_id, id, variant, ext, seed, output_url, NULL::VARCHAR AS error FROM plan
  UNION ALL SELECT host, id, NULL, {EXT_SQL}, NULL, NULL, reason FROM safe WHERE reason IS NOT NULL""")
def expand_variants(spark, sf_dir):
    return _variants(spark, sf_dir).drop("input_url")


@query("batch_validate", fx.with_parts("urls") + f""", {SAFE_SQL}, a AS (SELECT id % 60 AS job_id, 0 AS side, id // 60 AS idx, reason FROM safe
  UNION ALL SELECT id % 60, 1, id // 60, CASE WHEN id % 23 = 5 THEN 'required' WHEN id % 29 = 3 THEN 'scheme' END FROM urls),
f AS (SELECT job_id, arg_min(struct_pack(side := side, idx := idx, reason := reason), side * 1000000000 + idx) FILTER (reason IS NOT NULL) AS f FROM a GROUP BY job_id)
SELECT job_id, CASE f.side WHEN 0 THEN 'input' WHEN 1 THEN 'output' END AS side, f.idx::BIGINT AS idx, f.reason AS reason FROM f""")
def batch_validate(spark, sf_dir):
    rows = fx.urls(spark, sf_dir)
    at = [(F.col("id") % 60).alias("job_id"), F.floor(F.col("id") / 60).alias("idx")]
    out = F.when(F.col("id") % 23 == 5, "").when(F.col("id") % 29 == 3, "ftp://out.example.com/x").otherwise("https://out.example.com/x")
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("url")), F.struct(F.lit(1).alias("side"), out.alias("url")))
    return L.validate_batches(rows.select(*at, F.inline(both)))


@query("round_robin", _PLAN_SQL + f"SELECT job_id, id, variant, idx, idx % {G} AS worker FROM plan")
def round_robin(spark, sf_dir):
    return _plan(spark, sf_dir).select("job_id", "id", "variant", "idx", "worker")


@query("zip_io", """SELECT c.conv_id AS job_id, CASE WHEN c.conv_id % 9 = 4 THEN NULL ELSE c.turn END AS idx,
  CASE WHEN c.conv_id % 9 = 4 THEN NULL ELSE 'in/' || c.conv_id || '/' || c.turn END AS input_url,
  CASE WHEN c.conv_id % 9 = 4 THEN NULL ELSE 'out/' || c.conv_id || '/' || c.turn END AS output_url,
  CASE WHEN c.conv_id % 9 = 4 THEN 'inputUrls and outputUrls must have same length' END AS error
  FROM conversations c WHERE c.conv_id % 9 <> 4 OR c.turn = 0""")
def zip_io(spark, sf_dir):
    # a request carries its own two lists; here they are laid out again from the number of turns
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    id_ = F.col("conv_id").cast("string")
    path = lambda side: (lambda i: F.concat(F.lit(side), id_, F.lit("/"), i.cast("string")))
    steps = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    outs = F.transform(steps, path("out/"))
    batches = n.select(
        F.col("conv_id").alias("job_id"), F.transform(steps, path("in/")).alias("input_urls"),
        F.when(F.col("conv_id") % 9 == 4, F.array_append(outs, F.lit("x"))).otherwise(outs).alias("output_urls"),
    )
    return L.zip_io(batches)


@query("file_index", fx.with_parts("items") + "SELECT job_id, l_linenumber, l_partkey, l_suppkey, size, idx FROM items")
def file_index(spark, sf_dir):
    return fx.items(spark, sf_dir).select("job_id", "l_linenumber", "l_partkey", "l_suppkey", "size", "idx")


@query("batch_summary", fx.with_parts("items") + """SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  count(*) - count(*) FILTER (status = 'completed') AS failed FROM items GROUP BY job_id""")
def batch_summary(spark, sf_dir):
    return L.batch_summary(fx.bare_items(spark, sf_dir))


@query("worker_distribution", fx.with_parts("items") + f"""SELECT j.job_id, w.worker::INTEGER AS worker, count(i.job_id) AS completed
  FROM (SELECT DISTINCT job_id FROM items) j CROSS JOIN (SELECT unnest(range({G})) AS worker) w
  LEFT JOIN items i ON i.job_id = j.job_id AND i.worker = w.worker AND i.status = 'completed' GROUP BY ALL""")
def worker_distribution(spark, sf_dir):
    return L.worker_distribution(fx.bare_items(spark, sf_dir), G)


_RATE = """SELECT job_id, {elapsed} AS elapsed, count(*) FILTER (status = 'completed') AS completed,
  coalesce(sum(size) FILTER (status = 'completed'), 0) AS bytes, coalesce(sum(process_s) FILTER (status = 'completed'), 0.0) AS busy
  FROM items GROUP BY job_id"""


@query("throughput", fx.with_parts("items") + f"""SELECT job_id, round(CASE WHEN elapsed > 0 THEN bytes / 1048576.0 / elapsed ELSE 0.0 END, 6) AS mb_per_s,
  round(CASE WHEN elapsed > 0 THEN busy / elapsed / 8 * 100 ELSE 0.0 END, 4) AS efficiency
  FROM ({_RATE.format(elapsed="(job_id % 5)::DOUBLE * 30")})""")
def throughput(spark, sf_dir):
    elapsed = (F.col("job_id") % 5).cast("double") * 30
    out = L.throughput(fx.bare_items(spark, sf_dir), elapsed, 8)
    return out.select("job_id", F.round("mb_per_s", 6).alias("mb_per_s"), F.round("efficiency", 4).alias("efficiency"))


@query("avg_time_per_item", fx.with_parts("items") + f"""SELECT job_id, round(busy / greatest(completed, 1), 4) AS avg_s
  FROM ({_RATE.format(elapsed="1.0")})""")
def avg_time_per_item(spark, sf_dir):
    return L.throughput(fx.bare_items(spark, sf_dir), F.lit(1.0), 8).select("job_id", F.round("avg_s", 4).alias("avg_s"))


@query("outcome_counts", fx.with_parts("items") + """SELECT job_id, count(*) FILTER (status = 'completed') AS successful,
  count(*) FILTER (status <> 'completed') AS failed, count(*) FILTER (size % 10 = 0) AS skipped FROM items GROUP BY job_id""")
def outcome_counts(spark, sf_dir):
    return L.outcome_counts(fx.bare_items(spark, sf_dir).withColumn("skipped", F.col("size") % 10 == 0))


@query("transfer_summary", fx.with_parts("items") + """SELECT job_id, coalesce(sum(size) FILTER (status = 'completed'), 0)::BIGINT AS bytes,
  count(*) FILTER (status <> 'completed') AS failed,
  arg_min(status || ' at ' || idx, idx) FILTER (status <> 'completed') AS first_error FROM items GROUP BY job_id""")
def transfer_summary(spark, sf_dir):
    error = F.concat(F.col("status"), F.lit(" at "), F.col("idx").cast("string"))
    return L.transfer_summary(fx.items(spark, sf_dir).withColumn("error", error))


@query("queue_totals", fx.with_parts("items") + f"""SELECT j.job_id, w.worker::INTEGER AS worker, coalesce(sum(i.size), 0)::BIGINT AS load
  FROM (SELECT DISTINCT job_id FROM items) j CROSS JOIN (SELECT unnest(range({G})) AS worker) w
  LEFT JOIN items i ON i.job_id = j.job_id AND i.worker = w.worker GROUP BY ALL""")
def queue_totals(spark, sf_dir):
    return L.queue_totals(fx.bare_items(spark, sf_dir), G)


@query("least_loaded", fx.with_parts("items") + """SELECT job_id, worker, n FROM (SELECT job_id, worker, count(*) AS n,
  row_number() OVER (PARTITION BY job_id ORDER BY count(*), worker) AS r FROM items GROUP BY job_id, worker) WHERE r = 1""")
def least_loaded(spark, sf_dir):
    return L.least_loaded(fx.bare_items(spark, sf_dir))


@query("primary_output", fx.with_parts("items") + "SELECT job_id, idx, size, status FROM items WHERE idx = 0")
def primary_output(spark, sf_dir):
    df = fx.items(spark, sf_dir).select("job_id", "idx", "size", "status")
    return L.primary_output(df, ["job_id"], "idx")


@query("order_by_size_desc", fx.with_parts("items") + "SELECT job_id, idx, size FROM items ORDER BY size DESC, job_id, idx")
def order_by_size_desc(spark, sf_dir):
    return fx.items(spark, sf_dir).select("job_id", "idx", "size").orderBy(F.desc("size"), "job_id", "idx")


@query("order_results", fx.with_parts("items") + "SELECT job_id, idx, status FROM items ORDER BY job_id, idx")
def order_results(spark, sf_dir):
    return fx.items(spark, sf_dir).select("job_id", "idx", "status").orderBy("job_id", "idx")


@query("pending", fx.with_parts("items") + "SELECT job_id, idx, status FROM items WHERE status <> 'completed'")
def pending(spark, sf_dir):
    df = fx.items(spark, sf_dir).select("job_id", "idx", "status")
    return L.pending(df, df.where("status = 'completed'"), ["job_id", "idx"])


_PATHS = sql_values(TOOL_PATHS)


@query("tool_path", fx.with_parts("urls") + f""", paths(tool, kind, path) AS ({_PATHS}),
t AS (SELECT id, {fx.sql_choose('(id * 7) % 10', fx.TOOLS)} AS tool, {EXT_SQL} AS ext FROM urls),
k AS (SELECT *, CASE WHEN ext IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.gif') THEN 'image'
  WHEN ext IN ('.mp4', '.mov', '.avi', '.webm', '.mkv', '.m4v') THEN 'video' ELSE 'other' END AS kind FROM t)
SELECT k.id, k.tool, k.ext, k.kind, coalesce(a.path, b.path) AS path,
  CASE WHEN coalesce(a.path, b.path) IS NULL THEN 'Unknown tool: ' || k.tool END AS error
FROM k LEFT JOIN paths a ON a.tool = k.tool AND a.kind = k.kind LEFT JOIN paths b ON b.tool = k.tool AND b.kind = '*'""")
def tool_path(spark, sf_dir):
    df = fx.urls(spark, sf_dir).select(
        "id", fx.choose((F.col("id") * 7) % 10, fx.TOOLS).alias("tool"), U.classify_extension(F.col("url")).alias("ext")
    )
    return L.tool_path(df)


@query("download_once", fx.with_parts("items") + """SELECT job_id, idx, input_url, f.input_size,
  CASE WHEN f.fetch_error IS NULL THEN 'ready' ELSE 'failed' END AS status, f.fetch_error FROM
  (SELECT job_id, idx, 'part/' || l_partkey AS input_url FROM items) i LEFT JOIN
  (SELECT 'part/' || l_partkey AS input_url, max(size) AS input_size,
     CASE WHEN l_partkey % 11 = 0 THEN 'unreachable' END AS fetch_error FROM items GROUP BY l_partkey) f USING (input_url)""")
def download_once(spark, sf_dir):
    df = fx.items(spark, sf_dir).select("job_id", "idx", F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("input_url"), "size", "l_partkey")
    fetched = df.groupBy("input_url").agg(
        F.max("size").alias("input_size"), F.max(F.when(F.col("l_partkey") % 11 == 0, "unreachable")).alias("fetch_error"))
    return L.download_once(df.drop("size", "l_partkey"), fetched)


@query("next_stage_files", fx.with_parts("items", "jobs") + """SELECT job_id, idx, size, NULL::VARCHAR AS error FROM items WHERE status = 'completed'
  UNION ALL SELECT job_id, NULL, NULL, 'Pipeline step 2 (resize) produced no output files' FROM jobs
  WHERE job_id NOT IN (SELECT job_id FROM items WHERE status = 'completed')""")
def next_stage_files(spark, sf_dir):
    done = fx.items(spark, sf_dir).where("status = 'completed'").select("job_id", "idx", "size")
    files, empty = L.next_stage(fx.jobs(spark, sf_dir).select("job_id"), done, 2, "resize")
    return L.recombine(files, empty)


@query("status_split", fx.with_parts("items") + """SELECT job_id, idx, CASE WHEN status = 'completed' THEN size END AS size,
  CASE WHEN status <> 'completed' THEN 'Download failed: ' || status END AS error FROM items""")
def status_split(spark, sf_dir):
    df = fx.items(spark, sf_dir).select("job_id", "idx", "size", "status")
    ok = df.where("status = 'completed'").select("job_id", "idx", "size")
    bad = df.where("status <> 'completed'").select("job_id", "idx", F.concat(F.lit("Download failed: "), "status").alias("error"))
    return L.recombine(ok, bad)


@query("retry_sequence", fx.with_parts("attempts") + f"""SELECT item_id, attempt, code,
  {SEED.format("'item_' || item_id || '_' || attempt")} AS seed FROM attempts""")
def retry_sequence(spark, sf_dir):
    seed = K.keyed_seed(F.lit("item"), F.col("item_id"), F.col("attempt"))
    return fx.attempts(spark, sf_dir).select("item_id", "attempt", "code", seed.alias("seed"))


@query("attempt_resolution", fx.with_parts("attempts") + """, r AS (SELECT item_id,
  min(attempt) FILTER (code IS NULL) AS won, min(attempt) FILTER (code IS NOT NULL AND NOT retryable) AS stopped,
  count(*) AS tried, arg_max(coalesce(code, ''), attempt) AS last_code,
  arg_min(code, attempt) FILTER (code IS NOT NULL AND NOT retryable) AS stop_code
  FROM attempts WHERE attempt <= 3 GROUP BY item_id)
SELECT item_id, CASE WHEN coalesce(won, 99) < coalesce(stopped, 99) THEN 'completed' WHEN stopped IS NOT NULL THEN 'failed'
  WHEN tried >= 3 THEN 'failed' ELSE 'pending' END AS status,
  least(coalesce(won, 99), coalesce(stopped, 99), tried) AS attempts,
  CASE WHEN coalesce(won, 99) < coalesce(stopped, 99) THEN NULL WHEN stopped IS NOT NULL THEN stop_code ELSE last_code END AS code FROM r""")
def attempt_resolution(spark, sf_dir):
    return L.attempt_resolution(fx.attempts(spark, sf_dir))


_POL = sql_values([(c, b, m) for c, _, b, m in RETRY_POLICIES])


@query("retry_policy", fx.with_parts("attempts") + f""", pol(code, base_s, multiplier) AS ({_POL})
SELECT a.event_id, a.code, a.retryable, coalesce(p.base_s, 1.0)::DOUBLE AS base_s, coalesce(p.multiplier, 2.0)::DOUBLE AS multiplier
FROM attempts a LEFT JOIN pol p ON p.code = a.code WHERE a.code IS NOT NULL""")
def retry_policy(spark, sf_dir):
    df = fx.attempts(spark, sf_dir).where("code is not null").select("event_id", "code", "retryable")
    return L.retry_policies(df)


@query("backoff", fx.with_parts("attempts") + f""", pol(code, base_s, multiplier) AS ({_POL})
SELECT a.event_id, round(least(coalesce(p.base_s, 1.0) * pow(coalesce(p.multiplier, 2.0), least(a.attempt - 1, 100))
  * (0.75 + {draw("a.event_id", "'jitter'")} * 0.5), 30.0), 6) AS wait_s
FROM attempts a LEFT JOIN pol p ON p.code = a.code""")
def backoff(spark, sf_dir):
    df = L.retry_policies(fx.attempts(spark, sf_dir))
    wait = T.backoff(F.col("attempt"), F.col("base_s"), F.col("multiplier"), F.col("event_id"))
    return df.select("event_id", F.round(wait, 6).alias("wait_s"))


@query("progress", fx.with_parts("items") + """SELECT job_id, floor(10 + 80 * done / total)::BIGINT AS single,
  least(floor(total / total * 10 + done / total * 70 + up / total * 20), 99)::BIGINT AS batch FROM (SELECT job_id,
  count(*)::DOUBLE AS total, count(*) FILTER (status <> 'failed') AS done, count(*) FILTER (status = 'completed') AS up FROM items GROUP BY job_id)""")
def progress(spark, sf_dir):
    agg = fx.bare_items(spark, sf_dir).groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") != "failed").alias("done"),
        F.count_if(F.col("status") == "completed").alias("up"))
    return agg.select(
        "job_id", T.progress_scale(F.col("done") / F.col("total")).alias("single"),
        T.stage_progress(F.col("total"), F.col("total"), F.col("done"), F.col("up")).alias("batch"))


@query("verify", """WITH o AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS size FROM documents),
m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'bad' ELSE h END AS content_hash,
  CASE WHEN doc_id % 11 = 0 THEN size + 1 WHEN doc_id % 17 = 0 THEN 0 ELSE size END AS size_bytes FROM o WHERE doc_id % 13 <> 0)
SELECT o.doc_id AS key, o.size, e.error, m.doc_id IS NOT NULL AND e.error IS NULL AS verified FROM o LEFT JOIN m USING (doc_id),
LATERAL (SELECT CASE WHEN m.content_hash <> o.h THEN 'HASH_MISMATCH' WHEN m.size_bytes <> 0 AND m.size_bytes <> o.size THEN 'SIZE_MISMATCH' END AS error) e""")
def verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    key = F.col("key")
    manifests = docs.where(key % 13 != 0).select(
        "key", F.when(key % 7 == 0, "bad").otherwise(F.col("hash")).alias("content_hash"),
        F.when(key % 11 == 0, F.col("size") + 1).when(key % 17 == 0, 0).otherwise(F.col("size")).alias("size_bytes"))
    return L.verify(docs, manifests).drop("hash")


def _lpt_sql(memory):
    """The greedy rule step by step: one level of the recursion per item rank."""
    weight = "[" + ", ".join(str(float(m)) for m in memory) + "]"
    score = f"list_transform(range({G}), lambda w: s.load[w + 1] / {weight}[w + 1])"
    return fx.with_parts("items").replace("WITH", "WITH RECURSIVE", 1) + f""",
r AS (SELECT job_id, idx, size, row_number() OVER (PARTITION BY job_id ORDER BY size DESC, idx) AS rk FROM items),
s AS (SELECT DISTINCT job_id, 0::BIGINT AS rk, [0, 0, 0, 0]::BIGINT[] AS load, -1::INTEGER AS worker, -1::BIGINT AS idx, 0::BIGINT AS size FROM items
  UNION ALL SELECT job_id, rk, list_transform(range({G}), lambda w: load[w + 1] + CASE WHEN w = best THEN size ELSE 0 END)::BIGINT[], best, idx, size
  FROM (SELECT r.job_id, r.rk, r.idx, r.size, s.load, (list_position({score}, list_min({score})) - 1)::INTEGER AS best
        FROM s JOIN r ON r.job_id = s.job_id AND r.rk = s.rk + 1))
"""


@query("lpt_assign", _lpt_sql([1] * G) + "SELECT job_id, idx, size, worker FROM s WHERE rk > 0")
def lpt_assign(spark, sf_dir):
    return A.lpt_assign(fx.items(spark, sf_dir).select("job_id", "idx", "size"), G)


@query("lpt_totals", _lpt_sql([24, 24, 12, 48]) + f"""SELECT j.job_id, w.worker::INTEGER AS worker, coalesce(sum(s.size), 0)::BIGINT AS load
  FROM (SELECT DISTINCT job_id FROM items) j CROSS JOIN (SELECT unnest(range({G})) AS worker) w
  LEFT JOIN s ON s.job_id = j.job_id AND s.worker = w.worker AND s.rk > 0 GROUP BY ALL""")
def lpt_totals(spark, sf_dir):
    assigned = A.lpt_assign(fx.items(spark, sf_dir).select("job_id", "idx", "size"), G, [24, 24, 12, 48])
    return L.queue_totals(assigned, G)


@query("balanced_assign", fx.with_parts("items") + f""", r AS (SELECT job_id, idx, size, row_number() OVER (PARTITION BY job_id ORDER BY size DESC, idx) - 1 AS rk FROM items)
SELECT job_id, idx, size, (CASE WHEN rk // {G} % 2 = 0 THEN rk % {G} ELSE {G} - 1 - rk % {G} END)::INTEGER AS worker FROM r""")
def balanced_assign(spark, sf_dir):
    return A.balanced_assign(fx.items(spark, sf_dir).select("job_id", "idx", "size"), G)
