"""Queries on requests, URLs, objects, archives and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dimensions import CONTENT_TYPES, IMAGE_EXTENSIONS, INPUT_EXTENSIONS, KIND_EXTENSIONS, VIDEO_EXTENSIONS
from ..session import scratch_path
from ..sources import archives, manifests, objects, probe, requests, sink
from . import fixtures as fx
from .catalog import query, table

RAW_EXT = "lower(regexp_extract(regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1), '[^.].*(\\.[^.]*)$', 1))"
IN_LIST = ", ".join(f"'{e}'" for e in INPUT_EXTENSIONS)
EXT_SQL = f"CASE WHEN {RAW_EXT} IN ({IN_LIST}) THEN {RAW_EXT} ELSE '.jpg' END"
HOST_SQL = (
    "lower(CASE WHEN bare LIKE '[%' THEN regexp_extract(bare, '^\\[([^\\]]*)', 1) "
    "ELSE regexp_replace(bare, ':.*$', '') END)"
)
SAFE_SQL = f"""net AS (SELECT id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc FROM urls),
hosts AS (SELECT id, url, scheme, netloc, {HOST_SQL} AS host
  FROM (SELECT *, regexp_replace(netloc, '^.*@', '') AS bare FROM net)),
safe AS (SELECT id, url, host, CASE WHEN url = '' THEN 'required'
  WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN netloc = '' THEN 'missing host'
  WHEN host IN ('localhost', '0.0.0.0', '::1') OR host LIKE '127.%' THEN 'localhost'
  WHEN host LIKE '10.%' OR host LIKE '192.168.%' OR host LIKE '169.254.%'
    OR TRY_CAST(regexp_extract(host, '^172\\.(\\d+)', 1) AS INTEGER) BETWEEN 16 AND 31 THEN 'private network' END AS reason
  FROM hosts)"""


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_values(rows) -> str:
    """``VALUES`` rows of a literal dimension."""
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


@query("classify_extension", fx.with_parts("urls") + f"""SELECT id, url, {EXT_SQL} AS ext,
  CASE WHEN id % 5 = 0 THEN '.png' WHEN id % 5 = 1 THEN '.jpg' ELSE {EXT_SQL} END AS given_ext FROM urls""")
def classify_extension(spark, sf_dir):
    df = fx.urls(spark, sf_dir)
    given = F.when(F.col("id") % 5 == 0, "PNG").when(F.col("id") % 5 == 1, ".exe").otherwise("")
    return df.select(
        "id", "url", U.classify_extension(F.col("url")).alias("ext"),
        U.classify_extension(F.col("url"), given).alias("given_ext"),
    )


_KINDS = [(t, e, k) for (t, k), es in KIND_EXTENSIONS.items() for e in es]


@query("media_kind", fx.with_parts("urls") + f""", kinds(rule, ext, kind) AS ({sql_values(_KINDS)}),
named AS (SELECT id, {RAW_EXT} AS ext, {fx.sql_choose(f'id % {len(fx.TOOLS)}', ['editor', 'reframe', 'augment', 'resize', 'captioner', 'reframe', 'editor', 'vignettes', 'resize', 'augment'])} AS tool FROM urls)
SELECT n.id, n.tool, n.ext, coalesce(k.kind, 'other') AS kind FROM named n LEFT JOIN kinds k
ON k.ext = n.ext AND k.rule = CASE WHEN n.tool IN ('editor', 'reframe', 'augment', 'resize') THEN n.tool ELSE '*' END""")
def media_kind(spark, sf_dir):
    tools = ["editor", "reframe", "augment", "resize", "captioner", "reframe", "editor", "vignettes", "resize", "augment"]
    df = fx.urls(spark, sf_dir).select(
        "id", U.raw_extension(U.before_query(F.col("url"))).alias("ext"), fx.choose(F.col("id") % 10, tools).alias("tool")
    )
    return objects.media_kind(df)


@query("size_guard", """SELECT reason, count(*) AS n, sum(size)::BIGINT AS bytes FROM (
  SELECT size, CASE WHEN size = 0 THEN 'empty' WHEN size > 524288000 THEN 'too large' ELSE 'ok' END AS reason FROM (
    SELECT CASE WHEN l_quantity = 1 THEN 0 ELSE floor(l_extendedprice)::BIGINT * 6000 END AS size FROM lineitem))
  GROUP BY reason""")
def size_guard(spark, sf_dir):
    size = F.when(F.col("l_quantity") == 1, 0).otherwise(F.floor("l_extendedprice") * 6000).cast("long")
    df = table(spark, sf_dir, "lineitem").select(size.alias("size"))
    return (
        df.withColumn("reason", F.coalesce(objects.size_reason(F.col("size")), F.lit("ok")))
        .groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    )


@query("safe_url", fx.with_parts("urls") + f", {SAFE_SQL} SELECT id, host, reason, reason IS NULL AS ok FROM safe")
def safe_url(spark, sf_dir):
    reason = U.unsafe_reason(F.col("url"))
    return fx.urls(spark, sf_dir).select("id", U.url_host(F.col("url")).alias("host"), reason.alias("reason"), reason.isNull().alias("ok"))


@query("content_type", fx.with_parts("urls") + f""", types(ext, mime) AS ({sql_values(CONTENT_TYPES.items())})
SELECT u.id, coalesce(t.mime, 'application/octet-stream') AS mime
FROM (SELECT id, {RAW_EXT} AS ext FROM urls) u LEFT JOIN types t USING (ext)""")
def content_type(spark, sf_dir):
    ext = U.raw_extension(U.before_query(F.col("url")))
    return fx.urls(spark, sf_dir).select("id", U.content_type(ext).alias("mime"))


@query("read_requests", fx.with_parts("urls") + f"""SELECT id::VARCHAR AS job_id,
  CASE WHEN id % 7 = 0 THEN '' WHEN id % 7 = 6 THEN 'batch' ELSE 'resize' END AS tool,
  CASE WHEN id % 7 = 1 THEN NULL ELSE url END AS input_url,
  CASE WHEN id % 7 IN (2, 6) THEN NULL ELSE 'https://out.example.com/' || id END AS output_url,
  CASE WHEN id % 7 = 3 THEN NULL ELSE (id % 50)::VARCHAR END AS width,
  CASE WHEN id % 7 = 0 THEN 'Missing ''tool'' parameter' WHEN id % 7 = 6 THEN NULL
       WHEN id % 7 = 1 OR url = '' THEN 'Missing ''inputUrl'' parameter'
       WHEN id % 7 = 2 THEN 'Missing ''outputUrl'' parameter' END AS error FROM urls""")
def read_requests(spark, sf_dir):
    mod = F.col("id") % 7
    raw = fx.urls(spark, sf_dir).select(F.to_json(F.struct(
        F.col("id").cast("string").alias("job_id"),
        F.when(mod == 6, "BATCH").when(mod != 0, "Resize").alias("tool"),
        F.when(mod != 1, F.col("url")).alias("inputUrl"),
        F.when(~mod.isin(2, 6), F.concat(F.lit("https://out.example.com/"), F.col("id").cast("string"))).alias("outputUrl"),
        F.when(mod != 3, F.struct((F.col("id") % 50).alias("width"))).alias("config"),
    )).alias("json"))
    parsed = requests.parse_requests(raw)
    return parsed.withColumn("width", F.try_element_at("config", F.lit("width"))).drop("config")


_OUT = f"""CASE WHEN tool = 'bg_remove' THEN '.png' WHEN tool IN ('pic_to_video', 'video_gen', 'editor') THEN '.mp4'
 WHEN tool IN ('augment', 'captioner', 'vignettes', 'resize', 'video_reframe')
 THEN CASE WHEN ext IN ({sql_list(VIDEO_EXTENSIONS)}) THEN ext ELSE '.jpg' END ELSE ext END"""
_STEP = """CASE WHEN tool = 'bg_remove' THEN '.png' WHEN tool IN ('pic_to_video', 'video_gen', 'editor') THEN '.mp4'
 WHEN ext = '' THEN '.jpg' ELSE ext END"""


@query("output_extension", fx.with_parts("urls") + f"""SELECT id, tool, {_OUT} AS batch_ext, {_STEP.replace('ext', 'raw')} AS step_ext
FROM (SELECT id, {fx.sql_choose('id % 10', fx.TOOLS)} AS tool, {EXT_SQL} AS ext, {RAW_EXT} AS raw FROM urls)""")
def output_extension(spark, sf_dir):
    tool = fx.choose(F.col("id") % 10, fx.TOOLS)
    ext = U.classify_extension(F.col("url"))
    return fx.urls(spark, sf_dir).select(
        "id", tool.alias("tool"), U.output_extension(tool, ext).alias("batch_ext"),
        U.step_extension(tool, U.raw_extension(U.before_query(F.col("url")))).alias("step_ext"),
    )


@query("manifest_url", fx.with_parts("urls") + """SELECT id, split_part(url, '?', 1) || '.manifest.json' ||
  CASE WHEN contains(url, '?') THEN '?' || split_part(url, '?', 2) ELSE '' END AS sidecar FROM urls""")
def manifest_url(spark, sf_dir):
    return fx.urls(spark, sf_dir).select("id", U.manifest_url(F.col("url")).alias("sidecar"))


_FNAME = "regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1)"


@query("file_names", fx.with_parts("urls") + f""", n AS (SELECT id, url, {_FNAME} AS name,
  regexp_extract({_FNAME}, '[^.].*(\\.[^.]*)$', 1) AS own FROM urls)
SELECT id, substr(name, 1, length(name) - length(own)) || '_resized' || own AS resized,
  substr(name, 1, length(name) - length(own)) || '_reframed'
    || CASE WHEN lower(own) IN ({sql_list(['.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tiff', '.tif'])}) THEN '.jpg' ELSE '.mp4' END AS reframed,
  substr(trim(regexp_replace(url, '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), 1, 20) AS safe,
  url LIKE 'http://%' OR url LIKE 'https://%' AS is_url FROM n""")
def file_names(spark, sf_dir):
    name = U.last_segment(F.col("url"))
    ext = U.raw_extension(name)
    as_image = F.when(ext.isin(*KIND_EXTENSIONS[("reframe", "image")]), ".jpg").otherwise(".mp4")
    return fx.urls(spark, sf_dir).select(
        "id", U.output_name(name, "_resized").alias("resized"), U.output_name(name, "_reframed", as_image).alias("reframed"),
        U.safe_name(F.col("url")).alias("safe"), U.looks_like_url(F.col("url")).alias("is_url"),
    )


VARIANTS = [0, 1, 2, 9999, 12345, 1234567]


@query("variant_url", fx.with_parts("urls") + """SELECT id, k, CASE WHEN contains(url, '.')
  THEN regexp_extract(url, '(?s)^(.*)\\.([^.]*)$', 1) || '_v' || printf('%04d', k) || '.' || regexp_extract(url, '(?s)^(.*)\\.([^.]*)$', 2)
  ELSE url || '_v' || printf('%04d', k) END AS variant FROM urls, (SELECT unnest([0, 1, 2, 9999, 12345, 1234567]) AS k)""")
def variant_url(spark, sf_dir):
    df = fx.urls(spark, sf_dir).withColumn("k", F.explode(F.array(*[F.lit(k) for k in VARIANTS])))
    return df.select("id", "k", U.variant_url(F.col("url"), F.col("k")).alias("variant"))


@query("probe_normalise", """SELECT event_id,
  CASE WHEN event_id % 6 IN (0, 5) THEN 1920 ELSE 100 + user_id::INTEGER END AS width,
  CASE WHEN event_id % 6 IN (0, 5) THEN 1080 ELSE 200 + user_id::INTEGER END AS height,
  CASE event_id % 6 WHEN 1 THEN 30000 / 1001 WHEN 2 THEN 25.0 WHEN 3 THEN 30.0 WHEN 4 THEN 30.0 ELSE 30.0 END::DOUBLE AS fps,
  CASE WHEN event_id % 6 IN (0, 5) THEN 0.0 ELSE value END AS duration,
  event_id % 6 IN (0, 1, 3) AS has_audio FROM events""")
def probe_normalise(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    case = F.col("event_id") % 6
    rate = F.when(case == 1, "30000/1001").when(case == 2, "25").when(case == 3, "30/0").otherwise("x/y")
    video = F.struct(
        F.lit("video").alias("codec_type"), (F.col("user_id") + 100).cast("string").alias("width"),
        (F.col("user_id") + 200).cast("string").alias("height"), rate.alias("r_frame_rate"),
    )
    blank = F.lit(None).cast("string")
    audio = F.struct(F.lit("audio").alias("codec_type"), blank.alias("width"), blank.alias("height"), blank.alias("r_frame_rate"))
    streams = F.when(case.isin(1, 3), F.array(audio, video)).otherwise(F.array(video))
    json = (
        F.when(case == 0, F.lit("{broken"))
        .when(case == 5, F.lit('{"streams": [], "format": {}}'))
        .otherwise(F.to_json(F.struct(streams.alias("streams"), F.struct(F.col("value").cast("string").alias("duration")).alias("format"))))
    )
    return ev.select("event_id", probe.probe_normalise(json).alias("p")).select("event_id", "p.*")


def _objects(spark, sf_dir):
    ext = fx.choose(F.col("doc_id") % 4, [".mp4", ".png", ".bin", ""])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("https://store.example.com/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext, F.lit("?sig=1")).alias("url"),
        F.col("text").alias("content"),
    )


@query("build_manifest", f"""SELECT '1.0' AS version, doc_id || {fx.sql_choose('doc_id % 4', ['.mp4', '.png', '.bin', ''])} AS file_key,
  sha256(text) AS content_hash, strlen(text) AS size_bytes,
  {fx.sql_choose('doc_id % 4', ['video/mp4', 'image/png', 'application/octet-stream', 'application/octet-stream'])} AS content_type,
  'worker' AS uploaded_by FROM documents""")
def build_manifest(spark, sf_dir):
    return manifests.build_manifest(_objects(spark, sf_dir)).drop("uploaded_at", "metadata")


@query("read_manifest", """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 4) THEN NULL ELSE sha256(text) END AS content_hash,
  CASE WHEN doc_id % 5 IN (0, 4, 3) THEN NULL ELSE strlen(text) END AS size_bytes,
  CASE WHEN doc_id % 5 IN (3, 4) THEN 'MANIFEST_INVALID' END AS error,
  CASE WHEN doc_id % 5 = 3 THEN 'sizeBytes' END AS missing
  FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE text END AS text FROM documents)""")
def read_manifest(spark, sf_dir):
    case = F.col("doc_id") % 5
    body = F.to_json(F.struct(
        F.lit("1.0").alias("version"), F.col("doc_id").cast("string").alias("fileKey"), F.sha2("text", 256).alias("contentHash"),
        F.when(case != 3, F.octet_length("text")).alias("sizeBytes"), F.lit("text/plain").alias("contentType"),
    ))
    json = F.when(case == 4, F.lit("{not json")).when(case != 0, body)
    return (
        table(spark, sf_dir, "documents").select("doc_id", manifests.read_manifest(json).alias("m"))
        .select("doc_id", F.col("m.manifest.contentHash").alias("content_hash"), F.col("m.manifest.sizeBytes").alias("size_bytes"),
                F.col("m.error").alias("error"), F.col("m.missing").alias("missing"))
    )


def _zips(df):
    """One small archive per document: a picture, a clip in a folder, a text, and an escaping path."""

    @F.udf("binary", useArrow=False)
    def pack(key, text):
        import io
        import zipfile

        data = text.encode()
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr(f"{key}.jpg", data)
            archive.writestr(f"clips/{key}.MP4", data + b"x")
            archive.writestr("notes.txt", b"skip")
            archive.writestr(f"a/../../{key}.png", b"out")
        return buffer.getvalue()

    return df.select("key", pack("key", "text").alias("content"))


@query("expand_archives", """SELECT doc_id::VARCHAR AS key, doc_id || '.jpg' AS member, strlen(text) AS size, sha256(text) AS digest, '.jpg' AS ext, true AS safe FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'clips/' || doc_id || '.MP4', strlen(text) + 1, sha256(text || 'x'), '.mp4', true FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'a/../../' || doc_id || '.png', 3, sha256('out'), '.png', false FROM documents""")
def expand_archives(spark, sf_dir):
    docs = fx.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    packed = _zips(docs.select(F.col("doc_id").cast("string").alias("key"), "text"))
    return archives.expand_archives(packed, IMAGE_EXTENSIONS + VIDEO_EXTENSIONS).drop("pos")


@query("scan_objects", """SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, 0::BIGINT AS refused FROM documents GROUP BY lang""")
def scan_objects(spark, sf_dir):
    """The texts as files of one folder per language, found again with their sizes."""
    path = scratch_path(spark, "objects")
    table(spark, sf_dir, "documents").select("text", "lang").write.partitionBy("lang").text(path)
    found = objects.scan_objects(spark, path, "*.txt", partitions=True)
    refused = F.count_if(objects.size_reason(F.col("length"), 1 << 40).isNotNull())
    return found.groupBy(F.coalesce("lang", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("lang")).agg(F.sum("length").alias("bytes"), refused.alias("refused"))


@query("write_results", fx.with_parts("items") + "SELECT status, count(*) AS n, sum(size)::BIGINT AS bytes FROM items GROUP BY status")
def write_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    sink.write_results(fx.bare_items(spark, sf_dir).select("job_id", "size", "worker", "process_s", "status"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
