"""Queries on caption text and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import captions as P
from ..operators import placement as L
from . import fixtures as fx
from .catalog import query, table

CAP = fx.with_parts("captions")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PAIR = ("list_reduce(list_transform(string_split({t}, '{q}'), lambda p, i: CASE WHEN i = 1 THEN p WHEN i % 2 = 0 THEN '{o}' || p ELSE '{c}' || p END), lambda a, b: a || b)")
CURLY = _PAIR.format(t=_PAIR.format(t="text", q='"', o="“", c="”"), q="''", o="‘", c="’")
PARSED = f""", curly AS (SELECT job_id, idx, {CURLY} AS t FROM captions),
parsed AS (SELECT job_id, idx, nullif(regexp_extract(t, '^##(.+?)##\\s*', 1), '') AS title, replace(regexp_replace(t, '^##(.+?)##\\s*', ''), '&&&', chr(10)) AS body FROM curly)"""


@query("parse_caption", CAP + PARSED + "SELECT job_id, idx, title, body FROM parsed")
def parse_caption(spark, sf_dir):
    return fx.captions(spark, sf_dir).select("job_id", "idx", X.parse_caption(F.col("text")).alias("p")).select("job_id", "idx", "p.*")


@query("emoji_tokens", CAP + f"""SELECT job_id, idx, generate_subscripts(toks, 1)::INTEGER - 1 AS pos, unnest(toks) AS token,
  regexp_full_match(unnest(toks), {sql_text(X.EMOJI)}) AS emoji FROM (SELECT job_id, idx, regexp_extract_all(text, {sql_text(X.TOKEN)}) AS toks FROM captions)""")
def emoji_tokens(spark, sf_dir):
    df = fx.captions(spark, sf_dir).select("job_id", "idx", F.posexplode(X.emoji_tokens(F.col("text"))).alias("pos", "token"))
    return df.withColumn("emoji", X.is_emoji(F.col("token")))


def width_sql(t: str, size: str) -> str:
    plain = f"regexp_replace({t}, {sql_text('(' + X.EMOJI + ')')}, '', 'g')"
    units = f"length({plain}) * {X.OTHER}"
    for pattern, advance in (X.NARROW, X.SLIM, X.BROAD, X.UPPER, X.FULL):
        units += f" + len(regexp_extract_all({plain}, {sql_text(pattern)})) * {advance - X.OTHER}"
    emoji = f"greatest(12, floor({size} * 1.05::DOUBLE))"
    return f"(({units}) * {size} / 100.0::DOUBLE + len(regexp_extract_all({t}, {sql_text('(' + X.EMOJI + ')')})) * ({emoji} + greatest(1, floor({emoji} * 0.08::DOUBLE))))"


@query("text_width", CAP + f"SELECT job_id, idx, {width_sql('text', '(20 + job_id % 30)')} AS width FROM captions")
def text_width(spark, sf_dir):
    return fx.captions(spark, sf_dir).select("job_id", "idx", X.text_width(F.col("text"), 20 + F.col("job_id") % 30).alias("width"))


_WRAP = CAP.replace("WITH", "WITH RECURSIVE", 1) + f""",
para AS (SELECT job_id, idx, generate_subscripts(p, 1) AS pno, unnest(p) AS p FROM (SELECT job_id, idx, string_split(text, chr(10)) AS p FROM captions)),
words AS (SELECT job_id, idx, pno, string_split(p, ' ') AS w FROM para),
fold AS (SELECT job_id, idx, pno, w, 1 AS k, w[1] AS line, []::VARCHAR[] AS lines FROM words
  UNION ALL SELECT job_id, idx, pno, w, k + 1, CASE WHEN fits THEN line || ' ' || w[k + 1] ELSE w[k + 1] END, CASE WHEN fits THEN lines ELSE list_append(lines, line) END
  FROM (SELECT *, {width_sql("(line || ' ' || w[k + 1])", '40')} <= 600 AS fits FROM fold WHERE k < len(w))),
done AS (SELECT job_id, idx, pno, array_to_string(list_append(lines, line), chr(10)) AS t FROM fold WHERE k = len(w))
SELECT job_id, idx, string_agg(t, chr(10) ORDER BY pno) AS wrapped FROM done GROUP BY job_id, idx"""


@query("wrap", _WRAP)
def wrap(spark, sf_dir):
    return fx.captions(spark, sf_dir).select("job_id", "idx", X.wrap(F.col("text"), F.lit(40), F.lit(600)).alias("wrapped"))


_CHUNKED = """, w AS (SELECT job_id, idx, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, 1 + idx % 3 AS n FROM captions),
c AS (SELECT job_id, idx, n, unnest(range(ceil(len(w) / n)::BIGINT)) AS k, w, ceil(len(w) / n)::BIGINT AS total FROM w),
chunks AS (SELECT job_id, idx, k, total, array_to_string(w[(k * n + 1):((k + 1) * n)], ' ') AS chunk FROM c)"""


@query("word_chunks", CAP + _CHUNKED + "SELECT job_id, idx, k::INTEGER AS k, chunk FROM chunks")
def word_chunks(spark, sf_dir):
    chunks = X.word_chunks(F.col("text"), 1 + F.col("idx") % 3)
    return fx.captions(spark, sf_dir).select("job_id", "idx", F.posexplode(chunks).alias("k", "chunk"))


@query("word_overlays", CAP + _CHUNKED + """, t AS (SELECT job_id, idx, k, total, chunk, idx * 0.5::DOUBLE AS start, greatest(0.2, 1.0 + job_id % 5)::DOUBLE AS dur FROM chunks WHERE idx % 2 = 0),
u AS (SELECT *, total * 0.28::DOUBLE + (total - 1) * 0.03::DOUBLE AS used FROM t),
v AS (SELECT *, CASE WHEN used > dur THEN greatest(0.06, 0.28::DOUBLE * (dur / used)) ELSE 0.28::DOUBLE END AS word, CASE WHEN used > dur THEN 0.03::DOUBLE * (dur / used) ELSE 0.03::DOUBLE END AS gap FROM u)
SELECT 'txt-' || job_id || '.' || idx || '-w' || (k + 1) AS id, chunk AS text, round(start + k * (word + gap), 3)::DOUBLE AS start, round(word, 3)::DOUBLE AS dur FROM v
UNION ALL SELECT 'txt-' || job_id || '.' || idx, text, idx * 0.5::DOUBLE, (1.0 + job_id % 5)::DOUBLE FROM captions WHERE idx % 2 = 1""")
def word_overlays(spark, sf_dir):
    df = fx.captions(spark, sf_dir).select(
        F.concat(F.lit("txt-"), F.col("job_id").cast("string"), F.lit("."), F.col("idx").cast("string")).alias("id"), "text",
        (F.col("idx") * 0.5).alias("start"), (1.0 + F.col("job_id") % 5).alias("dur"), (F.col("idx") % 2 == 0).alias("word_by_word"),
        (1 + F.col("idx") % 3).alias("per_chunk"), F.lit(0.28).alias("word_dur"), F.lit(0.03).alias("gap"))
    return P.word_overlays(df).select("id", "text", "start", "dur")


_STYLES = [" Captioner_TikTok ", "NEON", "slide-up", None, "Fade_In"]


@query("style_names", f"""SELECT event_id, coalesce(replace(lower(trim(s)), '_', '-'), 'default') AS style, coalesce(replace(replace(lower(trim(s)), '_', ''), '-', ''), '') AS effect
  FROM (SELECT event_id, {fx.sql_choose(f'event_id % {len(_STYLES)}', _STYLES)} AS s FROM events)""")
def style_names(spark, sf_dir):
    s = fx.choose(F.col("event_id") % len(_STYLES), _STYLES)
    return table(spark, sf_dir, "events").select("event_id", X.style_name(s).alias("style"), X.effect_name(s).alias("effect"))


@query("caption_cycle", fx.with_parts("items") + """, files AS (SELECT job_id, idx FROM items),
caps AS (SELECT conv_id AS job_id, turn AS pos, text FROM conversations), n AS (SELECT job_id, count(*) AS n FROM caps GROUP BY job_id)
SELECT f.job_id, f.idx, coalesce(c.text, CASE WHEN f.job_id % 2 = 0 THEN 'single ' || f.job_id END, '') AS text FROM files f LEFT JOIN n USING (job_id)
LEFT JOIN caps c ON c.job_id = f.job_id AND c.pos = f.idx % n.n""")
def caption_cycle(spark, sf_dir):
    files = fx.items(spark, sf_dir).select("job_id", "idx")
    caps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("pos"), "text")
    single = fx.jobs(spark, sf_dir).where("job_id % 2 = 0").select("job_id", F.concat(F.lit("single "), F.col("job_id").cast("string")).alias("text"))
    return P.caption_cycle(files, caps, single)


@query("block_size", CAP + PARSED + f""", blocks AS (SELECT job_id * 100 + idx AS img_id, 'title' AS block, title AS t, 60 AS size FROM parsed WHERE title IS NOT NULL
  UNION ALL SELECT job_id * 100 + idx, 'body', body, 36 FROM parsed WHERE body <> ''),
lines AS (SELECT img_id, block, size, unnest(string_split(t, chr(10))) AS line FROM blocks),
b AS (SELECT img_id, block, max({width_sql("CASE WHEN line = '' THEN ' ' ELSE line END", 'size')}) AS w, count(*) * max(size + 4) + (count(*) - 1) * 3 AS h FROM lines GROUP BY img_id, block)
SELECT img_id, floor(max(w))::BIGINT AS width, (sum(h) + CASE WHEN count(*) > 1 THEN 40 ELSE 0 END)::BIGINT AS height FROM b GROUP BY img_id""")
def block_size(spark, sf_dir):
    parsed = fx.captions(spark, sf_dir).select((F.col("job_id") * 100 + F.col("idx")).alias("img_id"), X.parse_caption(F.col("text")).alias("p"))
    blocks = F.array(
        F.struct(F.lit("title").alias("block"), F.col("p.title").alias("t"), F.lit(60).alias("size")),
        F.struct(F.lit("body").alias("block"), F.nullif(F.col("p.body"), F.lit("")).alias("t"), F.lit(36).alias("size")),
    )
    lines = (
        parsed.select("img_id", F.inline(F.filter(blocks, lambda b: b["t"].isNotNull())))
        .select("img_id", "block", "size", F.explode(F.split("t", "\n")).alias("line"))
        .select("img_id", "block", X.text_width(F.coalesce(F.nullif("line", F.lit("")), F.lit(" ")), F.col("size")).alias("width"),
                (F.col("size") + 4).cast("long").alias("line_height"), F.lit(3).cast("long").alias("line_gap"), F.lit(40).cast("long").alias("block_gap"))
    )
    return P.block_size(lines)


_POS = ["top", "center", "bottom", "custom", "elsewhere"]


def _placed(spark, sf_dir):
    """Pictures with a wanted placement and boxes: four elements of the vector are a box, the last four the caption."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.transform("embedding", lambda v: (v.cast("double") + 0.6) / 1.2).alias("u"))
    i = F.col("img_id")
    pictures = e.select(
        "img_id", F.round(F.element_at("u", -4) * 0.4, 3).alias("cap_w"), F.round(F.element_at("u", -3) * 0.2, 3).alias("cap_h"),
        fx.choose(i % 5, _POS).alias("position"), fx.choose(i % 3, ["left", "center", "right"]).alias("align"), F.round((F.element_at("u", -2) + F.element_at("u", -1)) / 2, 3).alias("custom_y"))
    boxes = e.select("img_id", "u", F.explode(F.sequence(F.lit(0), F.floor(F.size("u") / 4).cast("int") - 2)).alias("k"))
    at = lambda o: F.element_at("u", F.col("k") * 4 + o + 1)
    boxes = boxes.select("img_id", F.round(at(0), 3).alias("x"), F.round(at(1), 3).alias("y"), F.round(at(2) / 8, 3).alias("w"), F.round(at(3) / 8, 3).alias("h"))
    return pictures, boxes


def _cands_sql():
    rows = [(4 + k, p, y, a) for k, (p, y, a) in enumerate(L._fixed_candidates())]
    fixed = ", ".join(f"({k}, '{p}', {y}::DOUBLE, '{a}')" for k, p, y, a in rows)
    return f"""WITH e AS (SELECT vec_id AS img_id, list_transform(embedding, lambda v: (v::DOUBLE + 0.6) / 1.2) AS u FROM embeddings),
pics AS (SELECT img_id, u, round(u[-4] * 0.4, 3) AS cw, round(u[-3] * 0.2, 3) AS ch, {fx.sql_choose('img_id % 5', _POS)} AS position, {fx.sql_choose('img_id % 3', ['left', 'center', 'right'])} AS align, round((u[-2] + u[-1]) / 2, 3) AS cy FROM e),
boxes AS (SELECT img_id, round(u[k * 4 + 1], 3) AS x, round(u[k * 4 + 2], 3) AS y, round(u[k * 4 + 3] / 8, 3) AS w, round(u[k * 4 + 4] / 8, 3) AS h
  FROM (SELECT img_id, u, unnest(range(len(u) // 4 - 1)) AS k FROM e)),
own AS (SELECT *, CASE position WHEN 'top' THEN 0.15 WHEN 'bottom' THEN 0.82 WHEN 'custom' THEN cy ELSE 0.5 END::DOUBLE AS py FROM pics),
cand AS (SELECT img_id, cw, ch, 0 AS rank, position, py AS y, align FROM own
  UNION ALL SELECT img_id, cw, ch, a.r, position, py, a.a FROM own, (VALUES (1, 'center'), (2, 'left'), (3, 'right')) a(r, a)
  UNION ALL SELECT img_id, cw, ch, f.r, f.p, f.y, f.a FROM own, (VALUES {fixed}) f(r, p, y, a)),
geo AS (SELECT *, CASE align WHEN 'left' THEN 0.05::DOUBLE WHEN 'right' THEN 0.95::DOUBLE - cw ELSE 0.5::DOUBLE - cw / 2 END AS l,
  CASE align WHEN 'left' THEN 0.05::DOUBLE + cw WHEN 'right' THEN 0.95::DOUBLE ELSE 0.5::DOUBLE + cw / 2 END AS r, greatest(0, y - ch / 2) AS t, least(1, y + ch / 2) AS b FROM cand),
free AS (SELECT * FROM geo g WHERE NOT EXISTS (SELECT 1 FROM boxes x WHERE x.img_id = g.img_id AND g.l < x.x + x.w * 1.3::DOUBLE AND g.r > x.x - x.w * 0.3::DOUBLE
  AND g.t < x.y + x.h * 1.3::DOUBLE AND g.b > x.y - x.h * 0.3::DOUBLE))"""


@query("free_placements", _cands_sql() + "SELECT img_id, rank::INTEGER AS rank, position, y, align FROM free")
def free_placements(spark, sf_dir):
    return L.free_placements(*_placed(spark, sf_dir))


@query("first_placement", _cands_sql() + """SELECT p.img_id, coalesce(f.position, 'bottom') AS position, coalesce(f.y, 0.88) AS y, coalesce(f.align, 'center') AS align
  FROM pics p LEFT JOIN (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY rank) = 1) f USING (img_id)""")
def first_placement(spark, sf_dir):
    return L.first_placement(*_placed(spark, sf_dir))
