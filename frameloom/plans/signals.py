"""Queries on rhythm, hashes, duplicates and augmentation."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions import pixels as P
from ..functions import keyed as K
from ..operators import augment as A
from ..operators import dedup as U
from ..operators import signal as S
from ..operators.ordered import exact_quantiles
from ..session import cut_lineage
from . import fixtures as fx
from .catalog import query
from .ledger import SEED, draw
from .rasters import d, digest_normal_sql, normal_sql, st, stp

RATE, FRAME, HOP = 160.0, 16, 8
ENV_RATE = RATE / HOP
LAGS = S.lag_range(ENV_RATE)
GAP = max(2, int(ENV_RATE * 60.0 / 196.0))
CHUNK = 64  # small, so that the tables of the checks span several chunks

_K = [k / sum(D.SMOOTH_KERNEL) for k in D.SMOOTH_KERNEL]
_TAPS = " + ".join(f"coalesce({'lag' if n < 0 else 'lead'}(v, {abs(n)}) OVER w, 0.0) * {d(_K[3 + n])}" if n else f"v * {d(_K[3])}" for n in range(-3, 4))
SIG = fx.with_parts("signal") + f""", cent AS (SELECT src, i, v - avg(v) OVER (PARTITION BY src) AS v FROM signal),
fr AS (SELECT src, v, unnest(range(greatest(0, (i - {FRAME} + {HOP}) // {HOP}), i // {HOP} + 1)) AS k FROM cent),
env0 AS (SELECT src, k AS i, sqrt(avg(v * v) + 1e-9::DOUBLE) AS v FROM fr GROUP BY src, k HAVING count(*) = {FRAME}),
env AS (SELECT * FROM env0 WHERE src IN (SELECT src FROM env0 GROUP BY src HAVING count(*) >= 64)),
ons AS (SELECT src, i, greatest(v - lag(v, 1, v) OVER (PARTITION BY src ORDER BY i), 0.0) AS v FROM env),
fir AS (SELECT src, i, {_TAPS} AS v FROM ons WINDOW w AS (PARTITION BY src ORDER BY i)),
std AS (SELECT src, i, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS v FROM fir WINDOW p AS (PARTITION BY src)),
lags AS (SELECT unnest(range({LAGS[0]}, {LAGS[1] + 1})) AS lag),
ac AS (SELECT a.src, l.lag, sum(a.v * b.v) AS ac FROM lags l, std a JOIN std b ON b.src = a.src AND b.i = a.i + l.lag GROUP BY a.src, l.lag),
tempo AS (SELECT src, arg_max(lag, ac) AS lag, greatest(0.0, least(1.0, (max(ac) - quantile_cont(ac, 0.5)) / greatest(1e-6, quantile_cont(ac, 0.9) - quantile_cont(ac, 0.5)))) AS confidence FROM ac GROUP BY src),
q AS (SELECT src, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.85) AS p85, quantile_cont(v, 0.93) AS p93, quantile_cont(v, 0.95) AS p95 FROM std GROUP BY src),
cand AS (SELECT s.src, i FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z FROM std WINDOW w AS (PARTITION BY src ORDER BY i)) s JOIN q USING (src) WHERE v >= p85 AND v >= a AND v >= z),
pk AS (SELECT src, unnest(list_reduce(list_transform(list(i ORDER BY i), lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= {GAP} THEN list_concat(acc, x) ELSE acc END)) AS i FROM cand GROUP BY src)
"""


def strength(spark, sf_dir):
    return cut_lineage(S.onset_strength(fx.signal(spark, sf_dir), FRAME, HOP, 64, CHUNK))


def rounded(df, n, *cols):
    return df.withColumns({c: F.round(c, n) + 0.0 for c in cols})


@query("exact_quantiles", fx.with_parts("signal") + "SELECT src, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.937) AS p937 FROM signal GROUP BY src")
def quantiles(spark, sf_dir):
    return exact_quantiles(fx.signal(spark, sf_dir), ["src"], "v", {"p05": 0.05, "p50": 0.5, "p937": 0.937}, 256)


@query("rms_envelope", SIG + "SELECT src, i, round(v, 6) AS v FROM env")
def rms_envelope(spark, sf_dir):
    return rounded(S.rms_envelope(S.centred(fx.signal(spark, sf_dir)), FRAME, HOP), 6, "v")


@query("onset", SIG + "SELECT src, i, round(v, 6) + 0.0 AS v FROM ons")
def onset(spark, sf_dir):
    return rounded(S.onset(S.rms_envelope(S.centred(fx.signal(spark, sf_dir)), FRAME, HOP), CHUNK), 6, "v").select("src", "i", "v")


@query("fir_smooth", SIG + "SELECT src, i, round(v, 6) + 0.0 AS v FROM fir")
def fir_smooth(spark, sf_dir):
    env = S.rms_envelope(S.centred(fx.signal(spark, sf_dir)), FRAME, HOP)
    return rounded(S.fir_smooth(S.onset(env, CHUNK), CHUNK), 6, "v")


@query("standardise", SIG + "SELECT src, i, round(v, 6) + 0.0 AS v FROM std")
def standardise(spark, sf_dir):
    return rounded(strength(spark, sf_dir), 6, "v")


@query("autocorr", SIG + "SELECT src, lag::INTEGER AS lag, round(ac, 4) + 0.0 AS ac FROM ac")
def autocorr(spark, sf_dir):
    return rounded(S.autocorr(strength(spark, sf_dir), *LAGS, CHUNK), 4, "ac")


@query("tempo", SIG + f"SELECT src, lag::INTEGER AS lag, round({d(60.0 * ENV_RATE)} / lag, 4) AS bpm, round(confidence, 4)::DOUBLE AS confidence FROM tempo")
def tempo(spark, sf_dir):
    return rounded(S.tempo(S.autocorr(strength(spark, sf_dir), *LAGS, CHUNK), ENV_RATE), 4, "bpm", "confidence")


def found_peaks(spark, sf_dir):
    s = strength(spark, sf_dir)
    return S.peaks(s, exact_quantiles(s, ["src"], "v", {"thr": 0.85}), GAP, CHUNK)


@query("peaks", SIG + "SELECT src, i FROM pk")
def peaks(spark, sf_dir):
    return found_peaks(spark, sf_dir)


@query("interval_regularity", SIG + """, g AS (SELECT src, i, i - lag(i) OVER (PARTITION BY src ORDER BY i) AS gap FROM pk)
SELECT src, count(*)::BIGINT AS peaks, min(i) AS first, quantile_cont(gap, 0.5)::DOUBLE AS median_gap, round(1 - least(1.0, stddev_pop(gap) / greatest(1e-6, quantile_cont(gap, 0.5))), 4)::DOUBLE AS regularity FROM g GROUP BY src""")
def interval_regularity(spark, sf_dir):
    return rounded(S.interval_regularity(found_peaks(spark, sf_dir), CHUNK), 4, "regularity")


@query("best_phase", SIG + """, n AS (SELECT src, max(i) + 1 AS n FROM std GROUP BY src), sc AS (SELECT s.src, s.i % t.lag AS phase, sum(s.v) AS score FROM std s JOIN tempo t USING (src) JOIN n USING (src)
  WHERE s.i // t.lag < greatest(8, n.n // t.lag) GROUP BY ALL) SELECT src, arg_max(phase, score) AS phase FROM sc GROUP BY src""")
def best_phase(spark, sf_dir):
    s = strength(spark, sf_dir)
    lags = S.tempo(S.autocorr(s, *LAGS, CHUNK), ENV_RATE).select("src", "lag")
    return S.best_phase(s, lags)


@query("profile_amount", SIG + """SELECT s.src, round(greatest(0.12, least(0.95, 0.16 + 0.54 * max(t.confidence) + 0.18 * least(1.0, greatest(0.0, max(p95) - max(p50)) / 2.5))), 4)::DOUBLE AS amount,
  round(greatest(0.0, least(1.0, avg(CASE WHEN s.v > q.p93 THEN 1.0 ELSE 0.0 END) * 18.0)), 4)::DOUBLE AS transient FROM std s JOIN q USING (src) JOIN tempo t USING (src) GROUP BY s.src""")
def profile_amount(spark, sf_dir):
    s = strength(spark, sf_dir)
    t = S.tempo(S.autocorr(s, *LAGS, CHUNK), ENV_RATE)
    return rounded(S.profile_amount(s, t), 4, "amount", "transient")


_HANN = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 31))"


@query("band_energy", fx.with_parts("signal") + f""", cent AS (SELECT src, i, v - avg(v) OVER (PARTITION BY src) AS v FROM signal),
fr AS (SELECT src, i, v, unnest(range(greatest(0, (i - 16) // 16), i // 16 + 1)) AS k FROM cent), ok AS (SELECT src, k FROM fr GROUP BY src, k HAVING count(*) = 32),
fl AS (SELECT src, k, i - k * 16 AS n, v FROM fr SEMI JOIN ok USING (src, k)), b AS (SELECT unnest(range(17)) AS b),
m AS (SELECT src, k, b, sqrt(pow(sum(v * {_HANN} * cos(2 * pi() * b * n / 32)), 2) + pow(sum(v * {_HANN} * sin(2 * pi() * b * n / 32)), 2)) AS m FROM fl, b GROUP BY ALL),
t AS (SELECT src, sum(m) FILTER (b * 5 BETWEEN 10 AND 25) AS l, sum(m) FILTER (b * 5 BETWEEN 50 AND 70) AS h, sum(m) AS t, count(DISTINCT k) AS n FROM m GROUP BY src)
SELECT src, round(greatest(0.0, least(1.0, l / (t + 1e-9) * 6.0)), 3)::DOUBLE AS low, round(greatest(0.0, least(1.0, h / (t + 1e-9) * 10.0)), 3)::DOUBLE AS high FROM t WHERE n >= 9""")
def band_energy(spark, sf_dir):
    return S.band_energy(S.centred(fx.signal(spark, sf_dir)), RATE, 32, 16, (10.0, 25.0), (50.0, 70.0))


_PROFILE = SIG + f""", g AS (SELECT src, i, i - lag(i) OVER (PARTITION BY src ORDER BY i) AS gap FROM pk),
steady AS (SELECT src, count(*) AS peaks, min(i) AS first, quantile_cont(gap, 0.5) AS median_gap, 1 - least(1.0, stddev_pop(gap) / greatest(1e-6, quantile_cont(gap, 0.5))) AS regularity FROM g GROUP BY src),
est AS (SELECT t.src, t.lag, t.confidence, {d(60.0 * ENV_RATE)} / t.lag AS bpm, s.first, s.regularity, {d(60.0 * ENV_RATE)} / s.median_gap AS by_peaks,
  coalesce(s.peaks >= 4 AND s.median_gap > 1e-6 AND {d(60.0 * ENV_RATE)} / s.median_gap BETWEEN {d(S.MIN_BPM)} AND {d(S.MAX_BPM)}, false) AS fits FROM tempo t LEFT JOIN steady s USING (src)),
used AS (SELECT *, (bpm NOT BETWEEN {d(S.MIN_BPM)} AND {d(S.MAX_BPM)} OR confidence < 0.07) AND fits AS used FROM est),
chosen AS (SELECT src, lag, CASE WHEN used THEN by_peaks ELSE bpm END AS bpm, CASE WHEN used THEN greatest(confidence, greatest(0.0, least(1.0, regularity))) ELSE confidence END AS confidence,
  CASE WHEN used THEN first / {d(ENV_RATE)} END AS peak_s FROM used),
n AS (SELECT src, max(i) + 1 AS n FROM std GROUP BY src),
sc AS (SELECT s.src, s.i % t.lag AS phase, sum(s.v) AS score FROM std s JOIN chosen t USING (src) JOIN n USING (src) WHERE s.i // t.lag < greatest(8, n.n // t.lag) GROUP BY ALL),
ph AS (SELECT src, arg_max(phase, score) AS phase FROM sc GROUP BY src),
am AS (SELECT s.src, greatest(0.12, least(0.95, 0.16 + 0.54 * max(t.confidence) + 0.18 * least(1.0, greatest(0.0, max(p95) - max(p50)) / 2.5))) AS amount,
  greatest(0.0, least(1.0, avg(CASE WHEN s.v > q.p93 THEN 1.0 ELSE 0.0 END) * 18.0)) AS transient FROM std s JOIN q USING (src) JOIN chosen t USING (src) GROUP BY s.src),
bf AS (SELECT src, i, v, unnest(range(greatest(0, (i - 512) // 512), i // 512 + 1)) AS k FROM cent), bok AS (SELECT src, k FROM bf GROUP BY src, k HAVING count(*) = 1024),
bl AS (SELECT src, k, i - k * 512 AS n, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - k * 512) / 1023)) AS v FROM bf SEMI JOIN bok USING (src, k)),
bm AS (SELECT src, k, b, sqrt(pow(sum(v * cos(2 * pi() * (b * n % 1024) / 1024)), 2) + pow(sum(v * sin(2 * pi() * (b * n % 1024) / 1024)), 2)) AS m FROM bl, (SELECT unnest(range(513)) AS b) GROUP BY ALL),
bands AS (SELECT src, coalesce(sum(m) FILTER (b * {d(RATE)} / 1024 BETWEEN 40 AND 220), 0) AS l, coalesce(sum(m) FILTER (b * {d(RATE)} / 1024 BETWEEN 1800 AND 6500), 0) AS h, sum(m) AS t, count(DISTINCT k) AS n FROM bm GROUP BY src)
SELECT c.src, round(bpm, 2)::DOUBLE AS bpm, round(amount, 3)::DOUBLE AS amount, round(CASE WHEN peak_s > 1e-9 THEN peak_s ELSE phase / {d(ENV_RATE)} END, 4)::DOUBLE AS phase_s, round(confidence, 3)::DOUBLE AS confidence,
  coalesce(CASE WHEN bands.n >= 9 THEN round(greatest(0.0, least(1.0, l / (t + 1e-9) * 6.0)), 3) END, 0.0)::DOUBLE AS low, coalesce(CASE WHEN bands.n >= 9 THEN round(greatest(0.0, least(1.0, h / (t + 1e-9) * 10.0)), 3) END, 0.0)::DOUBLE AS high,
  round(transient, 3)::DOUBLE AS transient FROM chosen c JOIN ph USING (src) JOIN am USING (src) LEFT JOIN bands USING (src) WHERE bpm BETWEEN {d(S.MIN_BPM)} AND {d(S.MAX_BPM)}"""


@query("rhythm_profile", _PROFILE)
def rhythm_profile(spark, sf_dir):
    return S.rhythm_profile(fx.signal(spark, sf_dir), RATE, FRAME, HOP, 64, CHUNK)


# --- duplicates ---------------------------------------------------------------------------------------------


def noisy(spark, sf_dir):
    """Four pictures per vector: itself, two with noise, and a copy."""
    px = fx.pixels(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    px = px.withColumn("_k", K.cell_key(F.col("img_id"), "n", F.col("k"), F.col("y"), F.col("x")))
    level = F.when(F.col("k").isin(1, 2), F.col("k") * 4.0).otherwise(0.0)
    v = F.when(level > 0, P.store(F.col("v") + K.cell_normal(F.col("_k")) * level)).otherwise(F.col("v"))
    return px.select((F.col("img_id") * 4 + F.col("k")).alias("img_id"), "y", "x", v.alias("v"))


_NOISE = normal_sql("img_id", "n", "k", "y", "x")
_DUP = fx.with_parts("pixels") + f""", var AS (SELECT img_id * 4 + k AS img_id, y, x, CASE WHEN k IN (1, 2) THEN {st(f"v + {_NOISE} * (k * 4.0::DOUBLE)")} ELSE v END AS v FROM pixels, (SELECT unnest(range(4)) AS k)),
uv AS (SELECT a.n AS u, b.n AS t FROM (SELECT unnest(range(8)) AS n) a, (SELECT unnest(range(8)) AS n) b),
lines AS (SELECT img_id, y, u, sum(v * cos(pi() * (2 * x + 1) * u / 16)) AS c FROM var, (SELECT unnest(range(8)) AS u) GROUP BY ALL),
coef AS (SELECT img_id, t, u, sum(c * cos(pi() * (2 * y + 1) * t / 16)) AS k FROM lines, (SELECT unnest(range(8)) AS t) GROUP BY ALL),
med AS (SELECT img_id, quantile_cont(k, 0.5) AS m FROM coef GROUP BY img_id)"""
_SIGNED = "CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT"


def packed(bit: str, pos: str) -> str:
    return f"sum(CASE WHEN {bit} THEN (1::HUGEINT << ({pos})::INTEGER) ELSE 0::HUGEINT END)::HUGEINT"


_DCT = _DUP + f""", hashes AS (SELECT img_id, {_SIGNED} AS hash FROM (SELECT img_id, {packed('k > m + 1e-6', 't * 8 + u')} AS h FROM coef JOIN med USING (img_id) GROUP BY img_id))"""


@query("dct_hash", _DCT + " SELECT img_id, hash FROM hashes")
def dct_hash(spark, sf_dir):
    return U.dct_hash(noisy(spark, sf_dir), 8)


@query("average_hash", fx.with_parts("pixels") + f""", m AS (SELECT *, avg(v) OVER (PARTITION BY img_id) AS m FROM pixels) SELECT img_id, {_SIGNED} AS hash FROM (SELECT img_id, {packed('v > m', 'y * 8 + x')} AS h FROM m GROUP BY img_id)""")
def average_hash(spark, sf_dir):
    return U.average_hash(fx.pixels(spark, sf_dir))


@query("difference_hash", fx.with_parts("pixels") + f""", m AS (SELECT *, lag(v) OVER (PARTITION BY img_id, y ORDER BY x) AS l FROM pixels) SELECT img_id, {_SIGNED} AS hash FROM (SELECT img_id, {packed('v > l', 'y * 7 + x - 1')} AS h FROM m WHERE x > 0 GROUP BY img_id)""")
def difference_hash(spark, sf_dir):
    return U.difference_hash(fx.pixels(spark, sf_dir))


_NEAR = _DCT.replace("WITH", "WITH RECURSIVE", 1) + """, firsts AS (SELECT hash, min(img_id) AS id, count(*) AS copies FROM hashes GROUP BY hash),
near AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INTEGER AS dist FROM firsts a JOIN firsts b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 10)"""


@query("nearest_earlier", _NEAR + """ SELECT h.img_id, h.hash, CASE WHEN h.img_id > f.id THEN 0 ELSE n.d END::INTEGER AS min_dist
FROM hashes h JOIN firsts f USING (hash) LEFT JOIN (SELECT b, min(dist) AS d FROM near GROUP BY b) n ON n.b = f.id""")
def nearest_earlier(spark, sf_dir):
    return U.nearest_earlier(U.dct_hash(noisy(spark, sf_dir), 8), 10)


@query("similar_pairs", _NEAR + " SELECT a, b, dist FROM near")
def similar_pairs(spark, sf_dir):
    distinct = cut_lineage(U.distinct_hashes(U.dct_hash(noisy(spark, sf_dir), 8)))
    return U.near_hashes(distinct, 10).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "dist")


@query("hash_stats", _DCT + """, dist AS (SELECT o.img_id // 4 AS vec_id, bit_count(xor(o.hash, v.hash))::INTEGER AS dist FROM hashes o JOIN hashes v ON v.img_id // 4 = o.img_id // 4 AND v.img_id > o.img_id WHERE o.img_id % 4 = 0)
SELECT vec_id, round(avg(dist) FILTER (dist > 0), 6) AS avg_dist, min(dist) FILTER (dist > 0) AS min_dist, max(dist) FILTER (dist > 0) AS max_dist, min(dist) AS least FROM dist GROUP BY vec_id""")
def hash_stats(spark, sf_dir):
    hashes = U.dct_hash(noisy(spark, sf_dir), 8).withColumn("vec_id", F.floor(F.col("img_id") / 4))
    first = hashes.where("img_id % 4 = 0").select("vec_id", F.col("hash").alias("own"))
    dist = hashes.where("img_id % 4 > 0").join(first, "vec_id").select("vec_id", U.distance(F.col("hash"), F.col("own")).alias("dist"))
    return U.hash_stats(dist, ["vec_id"]).withColumn("avg_dist", F.round("avg_dist", 6))


@query("duplicate_clusters", _NEAR + """, sym AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT id AS node, id AS root FROM firsts UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.node),
lab AS (SELECT node, min(root) AS cluster FROM reach GROUP BY node),
sz AS (SELECT cluster, sum(copies)::BIGINT AS pictures, count(*) AS hashes FROM firsts JOIN lab ON lab.node = firsts.id GROUP BY cluster),
sp AS (SELECT cluster, min(dist) AS min_dist, round(avg(dist), 6) AS avg_dist, max(dist) AS max_dist FROM near JOIN lab ON lab.node = near.a GROUP BY cluster)
SELECT sz.*, min_dist, avg_dist, max_dist FROM sz LEFT JOIN sp USING (cluster) WHERE pictures > 1""")
def duplicate_clusters(spark, sf_dir):
    out = U.duplicate_clusters(U.dct_hash(noisy(spark, sf_dir), 8), 10)
    return out.withColumn("avg_dist", F.round("avg_dist", 6))


BASE = {"crop": 20.0, "brightness": 0.08, "gamma": 0.1, "contrast": 0.07, "saturation": 0.1, "tint": 2.5, "noise": 1.5}


def _augment_sql():
    scale = {"spatial": 2.5, "tonal": 2.0, "visual": 2.5}
    u = lambda name: draw("seed", f"'{name}'")
    strength = {k: f"({d(BASE[k] * scale[s])} * (1.0::DOUBLE + (-0.5 + 1.0 * {u(k)})))" for k, s in A.TIERS}
    fac = lambda k, lo, hi: f"greatest({lo}, least({hi}, 1.0::DOUBLE + (-1 + 2 * {u(k + '.draw')}) * {strength[k]}))::DOUBLE AS {k}"
    tints = ", ".join(f"(-1 + 2 * {u('tint.' + c)}) * {strength['tint']} AS tint_{c}" for c in "rgb")
    margins = ", ".join(f"floor(8 * ({u('crop.' + s)} * {strength['crop']} / 100.0))::INTEGER AS m_{s}" for s in ("left", "right", "top", "bottom"))
    tone = lambda c: st(f"128.0::DOUBLE + ({stp(f'pow({st(f'{c} * brightness')} / 255.0::DOUBLE, gamma) * 255.0::DOUBLE')} - 128.0::DOUBLE) * contrast")
    sat = lambda c: st(f"{stp(f'grey + ({c} - grey) * saturation')} + tint_{c}")
    noise = lambda c: st(f"{c} + {digest_normal_sql('seed', "'noise.' || y || '.' || x", str('rgb'.index(c)))} * noise * 2.0::DOUBLE")
    return fx.with_parts("rgb") + f""", wide AS (SELECT img_id, y, x, max(v) FILTER (band = 0) AS r, max(v) FILTER (band = 1) AS g, max(v) FILTER (band = 2) AS b FROM rgb GROUP BY ALL),
par AS (SELECT img_id, variant, seed, {u('flip')} > 0.5 AS flip, {margins}, {fac('brightness', '0.0', '10.0')}, {fac('gamma', '0.5', '2.0')}, {fac('contrast', '0.5', '1.5')}, {fac('saturation', '0.5', '1.5')}, {tints}, {strength['noise']} AS noise
  FROM (SELECT img_id, k AS variant, {SEED.format("img_id || '_' || k || '_aug'")} AS seed FROM (SELECT DISTINCT img_id FROM rgb), (SELECT unnest([0, 1]) AS k))),
a AS (SELECT w.* REPLACE (CASE WHEN flip THEN 7 - x ELSE x END AS x), p.* EXCLUDE (img_id), m_left + m_right >= 8 * 0.5 OR m_top + m_bottom >= 8 * 0.5 AS whole FROM wide w JOIN par p USING (img_id)),
c AS (SELECT a.* REPLACE (CASE WHEN whole THEN x ELSE x - m_left END AS x, CASE WHEN whole THEN y ELSE y - m_top END AS y) FROM a WHERE whole OR (x >= m_left AND x < 8 - m_right AND y >= m_top AND y < 8 - m_bottom)),
t AS (SELECT * REPLACE ({tone('r')} AS r, {tone('g')} AS g, {tone('b')} AS b) FROM c),
s AS (SELECT *, floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 1e-9::DOUBLE) AS grey FROM t),
s2 AS (SELECT * REPLACE ({sat('r')} AS r, {sat('g')} AS g, {sat('b')} AS b) FROM s), o AS (SELECT img_id, variant, y, x, {noise('r')} AS r, {noise('g')} AS g, {noise('b')} AS b FROM s2)
SELECT img_id, variant, y::INTEGER AS y, x::INTEGER AS x, band, v FROM (SELECT img_id, variant, y, x, 0 AS band, r AS v FROM o UNION ALL SELECT img_id, variant, y, x, 1, g FROM o UNION ALL SELECT img_id, variant, y, x, 2, b FROM o)"""


@query("augment", _augment_sql())
def augment(spark, sf_dir):
    return A.augment(fx.wide(spark, sf_dir), 2, BASE, "strong", "aug")
