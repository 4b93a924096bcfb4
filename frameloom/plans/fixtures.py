"""Work tables derived from the given tables, in Spark and as SQL fragments for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_host
from ..operators.ordered import sequence_index
from ..operators.raster import from_planes
from .catalog import table

WORKERS = 4
SUFFIXES = [".mp4", ".JPG", ".png", "", ".mov", ".zip", ".mp3", ".tiff", ".webm", ".gif", ".jpeg", ".flv"]
HOSTS = {
    0: "http://localhost",
    1: "http://10.1.2.3",
    2: "https://172.20.0.9",
    3: "http://127.0.0.2:8080",
    4: "ftp://files.example.com",
    5: "https://user@192.168.0.1",
    6: "http://172.32.0.1",
    8: "http://[::1]:9000",
    9: "http://",
}
TOOLS = ["augment", "captioner", "vignettes", "resize", "pic_to_video", "bg_remove", "upscale", "video_reframe", "editor", "sharpener"]
MODES = {"1-URGENT": "maximum", "2-HIGH": "strong", "3-MEDIUM": "light", "4-NOT SPECIFIED": "unheard", "5-LOW": "minimal"}
STATUS = {"A": "completed", "R": "failed", "N": "upload_failed"}
#: Microseconds in one chunk of events; smaller steps where events are denser.
STEP_US = 3_600_000_000
ITEM_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate",
]


def choose(index: Column, values: list) -> Column:
    """Value at a position of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_choose(index: str, values: list) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{listed}])[({index}) + 1]"


def sql_case(key: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in mapping.items())
    return f"(CASE {key} {arms} ELSE {default} END)"


def with_parts(*names: str) -> str:
    """``WITH`` clause with the named fragments."""
    return "WITH " + ", ".join(FRAGMENTS[n] for n in names) + " "


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal packed rows out by their key before they unfold into many."""
    return df.repartition(key)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, url``: page addresses with media extensions and some hosts that must be refused."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("page"))
    head = F.regexp_extract("page", "^([^?#]*)", 1)
    tail = F.regexp_extract("page", "^[^?#]*(.*)$", 1)
    host = choose(F.col("id") % 19, [HOSTS.get(k) for k in range(19)])
    swapped = F.when(host.isNull(), head).otherwise(F.regexp_replace(head, F.lit("^https?://[^/]+"), host))
    url = F.concat(swapped, choose(F.col("id") % len(SUFFIXES), SUFFIXES), tail)
    url = F.when(F.col("id") % 19 == 7, F.lit("")).otherwise(url)
    # a generator keeps later filters from repeating this derivation, as a stored column would
    return pages.select("id", F.explode(F.array(url)).alias("url"))


def _urls_sql() -> str:
    arms = " ".join(
        f"WHEN page_id % 19 = {k} THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^https?://[^/]+', '{h}')"
        for k, h in HOSTS.items()
    )
    return (
        "urls AS (SELECT page_id AS id, CASE WHEN page_id % 19 = 7 THEN '' ELSE "
        f"(CASE {arms} ELSE regexp_extract(url, '^([^?#]*)', 1) END) || "
        f"{sql_choose(f'page_id % {len(SUFFIXES)}', SUFFIXES)} || regexp_extract(url, '^[^?#]*(.*)$', 1) END AS url "
        "FROM pages)"
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, idx, size, worker, status, process_s`` and the line's own columns."""
    lines = table(spark, sf_dir, "lineitem")
    numbered = sequence_index(
        lines, ["l_orderkey"], ITEM_ORDER, [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 4096)]
    )
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed")
    return numbered.select(
        F.col("l_orderkey").alias("job_id"),
        "idx",
        F.floor("l_extendedprice").cast("long").alias("size"),
        (F.col("l_suppkey") % WORKERS).alias("worker"),
        status.otherwise("upload_failed").alias("status"),
        F.col("l_quantity").alias("process_s"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        (F.col("l_discount") + 0.0).alias("l_discount"),
        F.col("l_tax"),
    )


def bare_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without their position: enough for totals, and free of any shuffle."""
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.floor("l_extendedprice").cast("long").alias("size"),
        (F.col("l_suppkey") % WORKERS).alias("worker"),
        status.otherwise("upload_failed").alias("status"),
        F.col("l_quantity").alias("process_s"),
        "l_partkey", "l_suppkey", "l_linenumber",
    )


_ITEMS_SQL = f"""items AS (SELECT l_orderkey AS job_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ITEM_ORDER)}) - 1 AS idx,
  floor(l_extendedprice)::BIGINT AS size, l_suppkey % {WORKERS} AS worker,
  {sql_case("l_returnflag", STATUS)} AS status, l_quantity AS process_s,
  l_partkey, l_suppkey, l_linenumber, l_returnflag, l_discount + 0.0::DOUBLE AS l_discount, l_tax FROM lineitem)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, mode``; one mode is unknown to the presets."""
    mode = F.col("o_orderpriority")
    arms = None
    for k, v in MODES.items():
        arms = F.when(mode == k, v) if arms is None else arms.when(mode == k, v)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), arms.alias("mode"))


_JOBS_SQL = f"jobs AS (SELECT o_orderkey AS job_id, {sql_case('o_orderpriority', MODES)} AS mode FROM orders)"


def time_step(ts: str, step: int = STEP_US) -> Column:
    """Number of the step in which a moment falls: as many chunks as the time covered asks for."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / step)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, attempt, code, retryable``: the events of a user read as attempts of one item."""
    codes = {"view": None, "purchase": "HASH_MISMATCH", "click": "TIMEOUT", "signup": "NETWORK_ERROR", "error": "NOT_FOUND"}
    ev = table(spark, sf_dir, "events")
    numbered = sequence_index(ev, ["user_id"], ["ts", "event_id"], [time_step("ts")], "attempt")
    code = F.lit(None).cast("string")
    for k, v in codes.items():
        code = F.when(F.col("event_type") == k, F.lit(v)).otherwise(code)
    return numbered.select(
        F.col("user_id").alias("item_id"), (F.col("attempt") + 1).alias("attempt"), code.alias("code"),
        (F.col("event_type") != "error").alias("retryable"), "event_id",
    )


_ATTEMPTS_SQL = """attempts AS (SELECT user_id AS item_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
  CASE event_type WHEN 'purchase' THEN 'HASH_MISMATCH' WHEN 'click' THEN 'TIMEOUT'
       WHEN 'signup' THEN 'NETWORK_ERROR' WHEN 'error' THEN 'NOT_FOUND' END AS code,
  event_type <> 'error' AS retryable, event_id FROM events)"""

EMOJI_BITS = ["😀", "👍🏽", "🇫🇷", "☀️", "👩‍💻", "⭐"]


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``job_id, idx, text``: turns with titles, line-break marks, quotes and emoji worked in."""
    turn = F.col("turn")
    text = F.col("text")
    text = F.when(turn % 3 == 0, F.concat(F.lit("##Part "), turn.cast("string"), F.lit("## "), text)).otherwise(text)
    text = F.when(turn % 2 == 1, F.concat(text, F.lit('&&&it\'s "done"'))).otherwise(text)
    text = F.when(turn % 4 == 2, F.concat(choose(F.col("conv_id") % 6, EMOJI_BITS), F.lit(" "), text, F.lit("🎬🎬 end"))).otherwise(text)
    return spread(table(spark, sf_dir, "conversations"), "turn").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), text.alias("text"), "role"
    )


_CAPTIONS_SQL = f"""captions AS (SELECT conv_id AS job_id, turn AS idx, role,
  CASE WHEN turn % 4 = 2 THEN {sql_choose('conv_id % 6', EMOJI_BITS)} || ' ' ELSE '' END
  || CASE WHEN turn % 3 = 0 THEN '##Part ' || turn || '## ' ELSE '' END || text
  || CASE WHEN turn % 2 = 1 THEN '&&&it''s "done"' ELSE '' END
  || CASE WHEN turn % 4 = 2 THEN '🎬🎬 end' ELSE '' END AS text FROM conversations)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img_id, y, x, v``: every vector as an 8 x 8 grey picture."""
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    e = e.select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "e"))
    level = F.floor((F.col("e").cast("double") + 0.6) / 1.2 * 255)
    return e.select(
        "img_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
        F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("double").alias("v"),
    )


def sized(df: DataFrame) -> DataFrame:
    """Add the size that the packed row implies: 64 elements are 8 by 8."""
    return df.withColumns({"w": F.lit(8), "h": F.lit(8)})


_PIXELS_SQL = """pixels AS (SELECT img_id, (pos // 8)::INTEGER AS y, (pos % 8)::INTEGER AS x,
  greatest(0, least(255, floor((e::DOUBLE + 0.6) / 1.2 * 255)))::DOUBLE AS v
  FROM (SELECT vec_id AS img_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img_id, y, x, band, v``: every vector as an 8 x 8 colour picture; band b of pixel p is element p + 21 b, in a circle."""
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    e = e.select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("pos", "e"))
    level = F.floor((F.col("e").cast("double") + 0.6) / 1.2 * 255)
    e = e.withColumn("band", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    cell = F.pmod(F.col("pos") - 21 * F.col("band"), F.lit(64))
    return e.select(
        "img_id", F.floor(cell / 8).cast("int").alias("y"), (cell % 8).cast("int").alias("x"), "band",
        F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("double").alias("v"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img_id, y, x, r, g, b``: the same pictures, the bands of a pixel side by side as in the packed row."""
    level = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.6) / 1.2 * 255))).cast("double")
    packed = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.transform("embedding", level).alias("e"))
    turned = lambda n: F.concat(F.slice("e", n + 1, 64 - n), F.slice("e", 1, n)) if n else F.col("e")
    return from_planes(packed, {c: turned(21 * band) for band, c in enumerate("rgb")}, 8)


_RGB_SQL = """rgb AS (SELECT img_id, (p // 8)::INTEGER AS y, (p % 8)::INTEGER AS x, band,
  greatest(0, least(255, floor((embedding[(p + 21 * band) % 64 + 1]::DOUBLE + 0.6) / 1.2 * 255)))::DOUBLE AS v
  FROM (SELECT vec_id AS img_id, embedding, unnest(range(64)) AS p FROM embeddings), (SELECT unnest([0, 1, 2])::INTEGER AS band))"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, i, v``: the values of an event type in time order."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), "ts", "event_id", F.col("value").alias("v"))
    return sequence_index(ev, ["src"], ["ts", "event_id"], [time_step("ts")], "i").select("src", "i", "v")


_SIGNAL_SQL = """signal AS (SELECT event_type AS src,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"""

FRAGMENTS = {
    "urls": _urls_sql(),
    "items": _ITEMS_SQL,
    "jobs": _JOBS_SQL,
    "attempts": _ATTEMPTS_SQL,
    "captions": _CAPTIONS_SQL,
    "pixels": _PIXELS_SQL,
    "rgb": _RGB_SQL,
    "signal": _SIGNAL_SQL,
}


def host_of(df: DataFrame) -> DataFrame:
    return df.withColumn("host", url_host(F.col("url")))
