"""Edit timelines: shred, normalise, schedule, and match overlays with frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import config as C
from ..functions import dimensions as D
from ..functions import text as X
from ..functions import timing as T
from ..functions.templates import SLOT_DEFAULTS, STYLE_VARIANTS, TEMPLATE_COLUMNS, TEMPLATES
from ..functions.urls import looks_like_url
from ..session import cut_lineage
from .ordered import by_chunk, dealt, first_rows, sequence_index, tasks_for

MAP = "map<string,string>"
TRACKED = 1 << 48  # places tracked effects after every own effect
LISTS = ["video", "videos", "clips", "items", "segments", "effects", "text", "captions", "titles", "overlays"]
LABELS = ["type", "trackType", "track_type", "kind", "name"]
LIST_SCHEMA = ", ".join(f"{n} array<string>" for n in LISTS)
ROOT_SCHEMA = f"tracks string, textOverlays array<string>, text_overlays array<string>, {LIST_SCHEMA}"
TRACK_SCHEMA = ", ".join(f"{n} string" for n in LABELS) + ", " + LIST_SCHEMA
TRACK_KINDS = {
    "video": (["video", "videos", "media", "main"], ["clips", "items", "segments", "video"]),
    "effects": (["effect", "effects", "fx", "filters"], ["effects", "clips", "items", "segments"]),
    "text": (
        ["text", "caption", "captions", "title", "titles", "overlay", "overlays", "graphics"],
        ["captions", "titles", "text", "overlays", "clips", "items"],
    ),
}
OBJECT_KEYS = {
    "video": ["video", "videos"], "effects": ["effects"], "text": ["text", "captions", "titles", "overlays"],
}
ROOT_KEYS = {
    "video": ["video", "videos", "clips", "items", "segments"], "effects": ["effects"],
    "text": ["textOverlays", "text_overlays", "captions", "titles", "overlays"],
}


def _objects(listed: Column) -> Column:
    """Texts of the JSON objects of a list; anything else in it is left out."""
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda e: e.startswith("{"))


def _all_of(of: Column, keys: Sequence[str]) -> Column:
    return F.concat(*[_objects(of[k]) for k in keys])


def _first_of(of: Column, keys: Sequence[str]) -> Column:
    """The first list under any of the keys that has an object."""
    lists = [_objects(of[k]) for k in keys]
    return F.coalesce(*[F.when(F.size(e) > 0, e) for e in lists], F.array().cast("array<string>"))


def shred_timeline(df: DataFrame, json: str = "json") -> DataFrame:
    """Replace timeline JSON by arrays ``video``, ``effects`` and ``text`` of entry texts, and ``error``.

    ``tracks`` may be an object of lists or a list of typed tracks; lists at the root count only where the
    tracks have none of that kind. The text is parsed once per level: root, then tracks.
    """
    keep = [c for c in df.columns if c != json]
    rooted = df.select(*keep, F.from_json(json, ROOT_SCHEMA).alias("_root"), F.try_parse_json(json).isNotNull().alias("_ok"), F.col(json).isNotNull().alias("_given"))
    tracks = F.ltrim(F.col("_root.tracks"))
    split = rooted.select(
        "*",
        F.when(tracks.startswith("{"), F.from_json(tracks, LIST_SCHEMA)).alias("_obj"),
        F.when(tracks.startswith("["), F.transform(
            _objects(F.from_json(tracks, "array<string>")), lambda t: F.from_json(t, TRACK_SCHEMA))).alias("_arr"),
    )

    def from_list(kind: str) -> Column:
        names, keys = TRACK_KINDS[kind]

        def payload(t: Column) -> Column:
            label = F.coalesce(*[F.nullif(t[n], F.lit("")) for n in LABELS], F.lit(""))
            fits = F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit("-")).isin(*names)
            return F.when(fits, _first_of(t, keys)).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.col("_arr"), payload))

    found = split.select(
        *keep, "_root", "_given", "_ok",
        *[F.when(F.col("_obj").isNotNull(), _all_of(F.col("_obj"), OBJECT_KEYS[k])).otherwise(from_list(k)).alias(k) for k in TRACK_KINDS],
    )
    root = F.col("_root")
    at_root = {k: (_first_of if k == "video" else _all_of)(root, keys) for k, keys in ROOT_KEYS.items()}
    return found.select(
        *keep,
        *[F.when(F.size(k) > 0, F.col(k)).otherwise(at_root[k]).alias(k) for k in TRACK_KINDS],
        F.when(F.col("_given") & ~F.col("_ok"), F.lit("Invalid timeline JSON")).alias("error"),
    )


def entry_rows(shredded: DataFrame, kind: str) -> DataFrame:
    """``job_id, ord, entry``: the entries of one kind as maps.

    Parsing sits inside an outer generator: no filter is derived from it or pushed through it, either of
    which would parse the text again below.
    """
    parsed = F.transform(kind, lambda e: F.from_json(e, MAP))
    return shredded.select("job_id", F.posexplode_outer(parsed).alias("ord", "entry")).where(F.col("ord").isNotNull())


def normalise_clips(entries: DataFrame, default_duration: float = 8.0) -> DataFrame:
    """Typed clip columns from ``job_id, ord, entry``. Only video and image entries are clips."""
    m = F.col("entry")
    pick = lambda *k: C.first_set(m, *k)
    numbers = {
        "_start": ["startSec", "start_sec"], "_dur": ["durationSec", "duration_sec"], "_in": ["trimInSec", "trim_in_sec"],
        "_out": ["trimOutSec", "trim_out_sec"], "_speed": ["speed"],
    }
    fades = {
        "_fade_in": ["transitionIn", "transition_in", "inTransition", "in_transition"],
        "_fade_out": ["transitionOut", "transition_out", "outTransition", "out_transition"],
    }
    read = entries.select(
        "job_id", "ord", F.lower(F.coalesce(pick("mediaType", "media_type"), F.lit("unknown"))).alias("media_type"),
        pick("sourceUrl", "source_url").alias("source"), F.nullif(F.trim(C.get(m, "id")), F.lit("")).alias("id"),
        *[pick(*k).alias(n) for n, k in numbers.items()], *[pick(*k).alias(n) for n, k in fades.items()],
    ).where(F.col("media_type").isin("video", "image"))
    cast = read.select(
        "job_id", "ord", "media_type", F.when(looks_like_url(F.col("source")), F.col("source")).alias("source"),
        F.coalesce("id", F.concat(F.lit("clip-"), (F.col("ord") + 1).cast("string"))).alias("clip_id"), F.col("_out").isNotNull().alias("_has_out"),
        *[C.to_number(F.col(n)).alias(n) for n in numbers], *[F.from_json(n, MAP).alias(n) for n in fades],
    )
    cast = cast.select(
        *[c for c in cast.columns if c not in fades],
        *[T.transition_kind(F.col(n)).alias(f"{n}_kind") for n in fades], *[T.transition_length(F.col(n)).alias(f"{n}_len") for n in fades],
    )
    typed = cast.select(
        "job_id", "ord", "clip_id", "media_type", "source",
        F.coalesce(C.clamp(F.col("_start"), 0, 7200), F.lit(0.0)).alias("start"),
        F.coalesce(C.clamp(F.col("_dur"), 0.1, 7200), F.lit(default_duration)).alias("dur"),
        F.coalesce(C.clamp(F.col("_in"), 0, 7200), F.lit(0.0)).alias("trim_in"),
        F.when(F.col("_has_out"), F.coalesce(C.clamp(F.col("_out"), 0, 7200), F.lit(0.0))).alias("trim_out"),
        F.coalesce(C.clamp(F.col("_speed"), 0.25, 4), F.lit(1.0)).alias("speed"),
        *[F.when(F.col(f"{n}_kind") == "none", 0.0).otherwise(C.clamp_number(F.col(f"{n}_len"), 0, 5, 0.3)).alias(n[1:]) for n in fades],
    )
    return typed.withColumn("trim_out", F.when(F.col("trim_out") > F.col("trim_in"), F.col("trim_out")))


def assign_fallback_source(clips: DataFrame, urls: DataFrame, inputs: DataFrame) -> DataFrame:
    """The k-th clip without a source takes the k-th fallback address of its job; entry 0 may use the input.

    ``urls``: job_id, k, url. ``inputs``: job_id, input_path. Clips left without a source are dropped.
    """
    clips = cut_lineage(clips)  # read by three branches
    ready = clips.where(F.col("source").isNotNull())
    lacking = sequence_index(clips.where(F.col("source").isNull()), ["job_id"], ["ord"], [F.floor(F.col("ord") / 4096)], "k")
    filled = (
        lacking.join(urls, ["job_id", "k"], "left").join(inputs, "job_id", "left")
        .withColumn("source", F.coalesce("url", F.when(F.col("ord") == 0, F.col("input_path"))))
        .where(F.col("source").isNotNull())
    )
    return ready.unionByName(filled.select(*clips.columns))


def effect_stacks(own: DataFrame, tracked: DataFrame, clips: DataFrame) -> DataFrame:
    """Effects of every clip in long form, own ones before tracked ones: no clip's stack is gathered in a row.

    ``own``: job_id, clip_id, ord, effect. ``tracked``: job_id, target, ord, effect. A clip without effects
    keeps one row with a null effect. ``at`` orders the stack.
    """
    stack = own.select("job_id", "clip_id", F.col("ord").cast("long").alias("at"), "effect")
    moved = tracked.select("job_id", F.trim("target").alias("clip_id"), (F.col("ord") + TRACKED).alias("at"), "effect")
    return clips.select("job_id", "clip_id").join(stack.unionByName(moved), ["job_id", "clip_id"], "left")


def effect_value(effect: Column, params: Column, *keys: str) -> Column:
    """First set of the keys, each read at the top level and then among the parameters."""
    return F.coalesce(*[F.coalesce(C.get(effect, k), C.get(params, k)) for k in keys])


def resolve_effects(effects: DataFrame, keys: Sequence[str], clip_duration: str = "dur", rows: int | None = None) -> DataFrame:
    """Fold each clip's effects to one settings row: the last valid value of every setting, clamped.

    ``effects``: keys, ``at`` (order, a long), ``effect`` map, ``clip_duration``. An ordered fold is not
    needed: the last valid value is a maximum by order, which combines before the shuffle. ``rows`` is the number of
    effects, if it is known. Where they ask for more tasks than the session's own number, the short rows are dealt out by
    clip first: a task holds the wide row of few clips then, however many there are.
    """
    m = F.col("effect")
    tasks = tasks_for(effects.sparkSession, effects.count() if rows is None else rows)
    enabled = C.as_flag(C.get(m, "enabled"), True)
    label = C.first_set(m, "type", "effectType", "effect_type", "name", "effect", default=F.lit(""))
    base = (
        effects.where(m.isNotNull() & enabled)
        .select(*keys, "at", clip_duration, "effect", F.from_json(C.get(m, "params"), MAP).alias("params"),
                C.lookup(D.EFFECT_ALIASES, X.effect_name(label)).alias("setting"))
        .where(F.col("setting").isNotNull())
    )
    base = dealt(base, tasks, *keys) if tasks else base
    p = F.col("params")
    raw, number = {}, {}
    for name, names, *_ in D.EFFECT_NUMBERS:
        number[name] = (name, F.coalesce(effect_value(m, p, *names[:-1]), C.get(m, names[-1])))
    for parent, name, names, _lo, _hi, absent, _d in D.EFFECT_PARTS:
        number[name] = (parent, F.coalesce(effect_value(m, p, *names), F.lit(str(absent))))
    for name in D.EFFECT_FADES:
        number[name] = (name, F.coalesce(effect_value(m, p, "durationSec", "duration", "value"), F.lit("0")))
    number["rotateDeg"] = ("rotateDeg", F.coalesce(effect_value(m, p, "degrees", "value"), F.lit("0")))
    for name in D.EFFECT_FLAGS:
        raw[name] = (name, F.coalesce(effect_value(m, p, "value"), F.lit("true")))
    raw["motionPreset"] = ("motion", F.coalesce(effect_value(m, p, "preset", "style", "value"), F.lit("dynamic")))
    wide = base.select(
        *keys, "at", clip_duration,
        *[F.when(F.col("setting") == s, C.to_number(v)).alias(n) for n, (s, v) in number.items() if n != "rotateDeg"],
        # an unreadable angle counts as zero, unlike other settings
        F.when(F.col("setting") == "rotateDeg", F.rint(F.coalesce(C.to_number(number["rotateDeg"][1]), F.lit(0.0)))).alias("rotateDeg"),
        *[F.when(F.col("setting") == s, C.as_flag(v, F.lit(None).cast("boolean"))).alias(n) for n, (s, v) in raw.items() if n in D.EFFECT_FLAGS],
        F.when(F.col("setting") == "motion", F.nullif(F.trim(raw["motionPreset"][1]), F.lit(""))).alias("motionPreset"),
    )

    def last(name: str, ok: Column | None = None) -> Column:
        ok = F.col(name).isNotNull() if ok is None else ok
        return F.max_by(F.col(name), F.when(ok, F.col("at"))).alias(name)

    turn = F.col("rotateDeg")
    names = [n for n in number if n != "rotateDeg"] + D.EFFECT_FLAGS
    folded = wide.groupBy(*keys).agg(
        *[last(n) for n in names], last("rotateDeg", turn.isin(0.0, 90.0, 180.0, 270.0)), F.max(clip_duration).alias("_dur")
    )
    # a string would make the fold sort its rows: the last preset is fetched by its place in the stack
    preset = first_rows(wide.where(F.col("motionPreset").isNotNull()).select(*keys, "at", "motionPreset"), keys, [("at", True)])
    folded = folded.join(preset.drop("at"), list(keys), "left")
    longest = F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("_dur")))
    return folded.select(
        *keys,
        *[F.coalesce(C.clamp(F.col(n), lo, hi), F.lit(d)).alias(n) for n, _, lo, hi, d in D.EFFECT_NUMBERS],
        *[F.coalesce(C.clamp(F.col(n), lo, hi), F.lit(d)).alias(n) for _, n, _, lo, hi, _, d in D.EFFECT_PARTS],
        *[F.coalesce(C.clamp(F.col(n), F.lit(0.0), longest), F.lit(0.0)).alias(n) for n in D.EFFECT_FADES],
        *[F.coalesce(n, F.lit(False)).alias(n) for n in D.EFFECT_FLAGS],
        F.coalesce(turn.cast("int"), F.lit(0)).alias("rotateDeg"),
        F.coalesce("motionPreset", F.lit("none")).alias("motionPreset"),
    )


def clip_cursor(clips: DataFrame, coarse: Sequence[Column]) -> DataFrame:
    """Add ``begin`` and ``end``: a clip starts at its own start, or where the one before it ends.

    The recurrence has a closed form: with S the running sum of lengths, the end is S plus the running
    maximum of ``start - S + dur``. Both carry over chunks, so a long job is not held in one task.
    """
    part = by_chunk(clips, ["job_id"], coarse)
    so_far = Window.partitionBy("job_id", "_chunk").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0)
    local = part.withColumn("_s", F.sum("dur").over(so_far)).withColumn("_slack", F.col("start") - F.col("_s") + F.col("dur"))
    local = cut_lineage(local.withColumn("_m", F.max("_slack").over(so_far)))  # its chunks are summed up and joined to it
    earlier = Window.partitionBy("job_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy("job_id", "_chunk").agg(F.sum("dur").alias("_sum"), F.max("_slack").alias("_max"))
        .withColumn("_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
        .withColumn("_prev", F.max(F.col("_max") - F.col("_off")).over(earlier))
        .where(F.col("_prev").isNotNull())
        .select("job_id", "_chunk", "_off", "_prev")
    )
    off = F.coalesce("_off", F.lit(0.0))
    end = F.col("_s") + off + F.greatest(F.col("_m") - off, F.col("_prev"))
    return (
        local.join(carried, ["job_id", "_chunk"], "left").withColumn("end", end).withColumn("begin", end - F.col("dur"))
        .drop("_chunk", "_s", "_slack", "_m", "_off", "_prev")
    )


def timeline_duration(clips: DataFrame, default: float) -> DataFrame:
    """Latest end of a job's clips, at least the default."""
    longest = F.max(F.col("start") + F.greatest(F.lit(0.1), F.col("dur")))
    return clips.groupBy("job_id").agg(F.greatest(F.lit(max(0.1, default)), longest).alias("duration"), F.sum("dur").alias("joined"))


def normalise_overlays(entries: DataFrame, default_duration: Column) -> DataFrame:
    """Typed overlay columns from ``job_id, ord, entry``; entries without text are dropped."""
    m = F.col("entry")
    pick = lambda *k: F.coalesce(*[C.get(m, x) for x in k])
    words = {
        "text": pick("text", "value"), "id": C.get(m, "id"), "style": pick("style", "textStyle", "text_style", "captionStyle"),
        "position": pick("position"), "align": pick("align", "alignment"), "font": pick("font", "fontFamily"),
        "color": pick("color"), "strokeColor": pick("strokeColor", "stroke_color"), "boxColor": pick("boxColor", "box_color"),
        "animation": pick("animation"), "bold": pick("bold"), "uppercase": pick("uppercase"), "box": pick("box"),
        "wordByWord": pick("wordByWord", "word_by_word"),
    }
    numbers = {
        "startSec": ["startSec", "start_sec"], "durationSec": ["durationSec", "duration_sec"], "yPercent": ["yPercent", "y_percent"],
        "fontSize": ["fontSize", "font_size"], "strokeWidth": ["strokeWidth", "stroke_width"],
        "boxOpacity": ["boxOpacity", "box_opacity"], "boxBorderW": ["boxBorderW", "box_border_w"],
        "motionStrength": ["motionStrength", "motion_strength"], "maxWordsPerChunk": ["maxWordsPerChunk", "max_words_per_chunk"],
        "wordDurationSec": ["wordDurationSec", "word_duration_sec"], "wordGapSec": ["wordGapSec", "word_gap_sec"],
    }
    read = entries.select(
        "job_id", "ord", default_duration.alias("_total"), *[w.alias(n) for n, w in words.items()],
        *[C.to_number(pick(*k)).alias(n) for n, k in numbers.items()],
    ).where(F.trim("text") != "").withColumn("style", X.style_name(F.col("style")))
    df = read.withColumn("captioner", F.col("style").isin(*D.CAPTION_STYLES))
    styled = F.col("captioner")
    either = lambda a, b: F.when(styled, F.lit(a)).otherwise(F.lit(b))

    def bound(n: str, lo, hi, default) -> Column:
        default = default if isinstance(default, Column) else F.lit(float(default))
        return F.coalesce(C.clamp(F.col(n), lo, hi), default).alias(n)

    def flag(n: str, default: bool) -> Column:
        return F.when(F.col(n).isNull(), F.lit(default)).otherwise(C.as_flag(F.col(n), default)).alias(n)

    def paint(n: str, default: Column) -> Column:
        return C.hex_colour(F.coalesce(F.col(n), default)).alias(n)

    whole = lambda c, n: F.floor(c).cast("int").alias(n)
    total = F.col("_total")
    return df.select(
        "job_id", "ord", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat(F.lit("txt-"), (F.col("ord") + 1).cast("string"))).alias("id"),
        F.trim("text").alias("text"), "style", "captioner",
        bound("startSec", F.lit(0.0), F.greatest(F.lit(0.1), total), 0.0), bound("durationSec", F.lit(0.15), F.greatest(F.lit(0.15), total), 1.5),
        F.coalesce("position", F.lit("bottom")).alias("position"), F.coalesce("align", F.lit("center")).alias("align"),
        bound("yPercent", 0.05, 0.95, 0.8), whole(bound("fontSize", 20, 190, 64), "fontSize"),
        F.coalesce("font", F.when(styled, F.lit("TikTokBold.otf"))).alias("font"),
        flag("bold", True), flag("uppercase", False), paint("color", either("#000000", "#FFFFFF")), paint("strokeColor", F.lit("#000000")),
        bound("strokeWidth", 0, 14, either(0.0, 4.0)), flag("box", True), paint("boxColor", either("#FFFFFF", "#000000")),
        bound("boxOpacity", 0, 1, either(1.0, 0.38)), whole(bound("boxBorderW", 0, 52, either(18.0, 12.0)), "boxBorderW"),
        F.lower(F.trim(F.coalesce("animation", F.lit("pop")))).alias("animation"), bound("motionStrength", 0, 1, 0.9),
        flag("wordByWord", False), whole(bound("maxWordsPerChunk", 1, 5, 1), "maxWordsPerChunk"),
        bound("wordDurationSec", 0.08, 1.2, 0.28), bound("wordGapSec", 0, 0.5, 0.03),
    )


def template_overlays(jobs: DataFrame) -> DataFrame:
    """Scripted overlays of every job with a known style or the switch on.

    ``jobs``: job_id, duration, style_preset, enabled, and slot texts hook, offer, proof, cta (null or blank
    for the stock text).
    """
    dim = F.broadcast(jobs.sparkSession.createDataFrame(TEMPLATES, TEMPLATE_COLUMNS))  # fixed, 28 rows
    style = F.lower(F.trim(F.coalesce("style_preset", F.lit("none"))))
    named = C.lookup(STYLE_VARIANTS, style)
    total = F.greatest(F.lit(3.0), F.col("duration"))
    chosen = (
        jobs.withColumn("variant", F.coalesce(named, F.when(F.col("enabled"), F.lit("default"))))
        .where(F.col("variant").isNotNull()).withColumn("_total", total).join(dim, "variant")
    )
    length = F.least(F.col("len_cap"), F.greatest(F.col("len_floor"), F.col("_total") * F.col("len_share")))
    start = F.when(F.col("from_end"), F.greatest(F.lit(0.0), F.col("_total") - length)).otherwise(
        F.greatest(F.col("start_floor"), F.col("_total") * F.col("start_share")))
    text = F.col("template")
    for slot, stock in SLOT_DEFAULTS.items():
        text = F.replace(text, F.lit("{" + slot + "}"), F.coalesce(F.nullif(F.trim(slot), F.lit("")), F.lit(stock)))
    return chosen.select(
        "job_id", "variant", "pos", "id", text.alias("text"),
        F.least(F.col("_total"), start).alias("start"), F.greatest(F.lit(0.15), F.least(F.col("_total"), length)).alias("dur"),
        "position", "font_size", "animation", "strength", "per_chunk", "word_dur", "word_by_word",
    )


def merge_overlays(*parts: DataFrame) -> DataFrame:
    """Overlays of several origins as one list, ``origin`` keeping their order."""
    tagged = [p.withColumn("origin", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def order_timeline(df: DataFrame) -> DataFrame:
    """Stable order by start within a job."""
    return df.orderBy("job_id", "start", "ord")


def normal_path(path: Column) -> Column:
    """Path without empty, ``.`` and resolvable ``..`` parts."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")

    def step(kept: Column, p: Column) -> Column:
        top = F.try_element_at(kept, F.lit(-1))
        up = p == ".."
        pops = up & top.isNotNull() & (top != "..")
        return (
            F.when(pops, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(up & rooted & top.isNull(), kept).otherwise(F.array_append(kept, p))
        )

    joined = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit(".")))


def distinct_sources(sources: DataFrame) -> DataFrame:
    """First row per job and normalised path of ``job_id, ord, path``."""
    return sources.groupBy("job_id", normal_path(F.col("path")).alias("source")).agg(F.min("ord").alias("ord"))


def best_profile(profiles: DataFrame) -> DataFrame:
    """The most confident profile per job, the first of equals; none without any confidence."""
    rest = [c for c in profiles.columns if c not in ("job_id", "ord", "confidence")]
    best = first_rows(profiles.where(F.col("confidence") > 0), ["job_id"], [("confidence", True), ("ord", False)])
    return best.select("job_id", "ord", "confidence", *rest)


def dyadic_nodes(lo: Column, hi: Column) -> Column:
    """The fewest intervals ``level, node`` (node * 2**level and so many on) that make up the whole numbers lo to hi."""
    long = lambda c: c.cast("long")

    def step(s: Column, level: Column) -> Column:
        odd = (s["lo"] <= s["hi"]) & (F.pmod(s["lo"], F.lit(2)) == 1)
        lo = s["lo"] + odd.cast("long")
        even = (lo <= s["hi"]) & (F.pmod(s["hi"], F.lit(2)) == 0)
        node = lambda c: F.struct(level.cast("int").alias("level"), long(c).alias("node"))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        hi = s["hi"] - even.cast("long")
        return F.struct(
            # nothing is left once lo has passed hi
            F.when(lo <= hi, F.floor(lo / 2)).otherwise(lo).alias("lo"), F.when(lo <= hi, F.floor(hi / 2)).otherwise(hi).alias("hi"),
            F.concat(s["out"], F.when(odd, F.array(node(s["lo"]))).otherwise(none), F.when(even, F.array(node(s["hi"]))).otherwise(none)).alias("out"))

    begin = F.struct(long(lo).alias("lo"), long(hi).alias("hi"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))
    height = F.ceil(F.log2((F.greatest(hi - lo, F.lit(0)) + 1).cast("double"))).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(0), height), begin, step, lambda s: s["out"])


def active_overlays(frames: DataFrame, overlays: DataFrame, width: float = 1.0) -> DataFrame:
    """Frames ``job_id, t`` with the overlays ``job_id, id, start, end`` shown at them, ends included.

    The buckets of an overlay are made up of dyadic intervals, two for each level at most, however long it shows. A frame
    looks up the intervals around its bucket, one for each level that some overlay uses.
    """
    bucket = lambda c: F.floor(F.col(c) / float(width))
    nodes = dyadic_nodes(bucket("start"), bucket("end"))
    laid = overlays.withColumn("_n", F.explode(nodes)).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    levels = sorted(r[0] for r in laid.select("_level").distinct().collect())  # one row per level, 64 at most
    at = frames.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    at = at.withColumn("_node", F.floor(bucket("t") / F.pow(F.lit(2.0), F.col("_level"))))
    met = at.join(laid, ["job_id", "_level", "_node"])
    return met.where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end"))).drop("_level", "_node")
