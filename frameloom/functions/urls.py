"""URL and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import lookup
from .dimensions import (
    CONTENT_TYPES,
    IMAGE_EXTENSIONS,
    INPUT_EXTENSIONS,
    KEEPS_VIDEO_TOOLS,
    MAKES_VIDEO_TOOLS,
    VIDEO_EXTENSIONS,
)


def before_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def last_segment(url: Column) -> Column:
    """File name: what follows the last slash, without the query string."""
    return F.regexp_extract(before_query(url), "([^/]*)$", 1)


def raw_extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for names that only start with dots."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"[^.].*(\.[^.]*)$", 1))


def classify_extension(url: Column, given: Column | None = None) -> Column:
    """Accepted input extension of a URL: an explicit one wins, unknown ones become ``.jpg``."""
    found = F.nullif(raw_extension(before_query(url)), F.lit(""))
    ext = F.coalesce(F.nullif(given, F.lit("")), found) if given is not None else found
    ext = F.lower(F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext)))
    return F.when(ext.isin(*INPUT_EXTENSIONS), ext).otherwise(F.lit(".jpg"))


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(*IMAGE_EXTENSIONS)


def is_video(ext: Column) -> Column:
    return F.lower(ext).isin(*VIDEO_EXTENSIONS)


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and brackets; empty if there is none."""
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(netloc, "^.*@", "")
    plain = F.regexp_replace(bare, ":.*$", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)", 1)).otherwise(plain))


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be fetched or written; null if it may."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = url_host(url)
    second = F.regexp_extract(host, r"^172\.(\d{1,3})(\.|$)", 1).try_cast("int")
    return (
        F.when(url.isNull() | (url == ""), F.lit("required"))
        .when(~scheme.isin("http", "https"), F.lit("scheme"))
        .when(netloc == "", F.lit("missing host"))
        .when(host.isin("localhost", "0.0.0.0", "::1") | host.startswith("127."), F.lit("localhost"))
        .when(host.rlike(r"^(10\.|192\.168\.|169\.254\.)") | second.between(16, 31), F.lit("private network"))
    )


def looks_like_url(value: Column) -> Column:
    return value.startswith("http://") | value.startswith("https://")


def content_type(ext: Column) -> Column:
    return F.coalesce(lookup(CONTENT_TYPES, F.lower(ext)), F.lit("application/octet-stream"))


def manifest_url(url: Column) -> Column:
    """Sidecar address: suffix before the query, of which only the first segment is kept."""
    query = F.split(url, r"\?")
    tail = F.when(F.size(query) > 1, F.concat(F.lit("?"), F.element_at(query, 2))).otherwise(F.lit(""))
    return F.concat(before_query(url), F.lit(".manifest.json"), tail)


def output_extension(tool: Column, ext: Column) -> Column:
    """Extension of a batch item's output."""
    return (
        F.when(tool == "bg_remove", F.lit(".png"))
        .when(tool.isin(*MAKES_VIDEO_TOOLS), F.lit(".mp4"))
        .when(tool.isin(*KEEPS_VIDEO_TOOLS), F.when(is_video(ext), ext).otherwise(F.lit(".jpg")))
        .otherwise(ext)
    )


def step_extension(tool: Column, ext: Column) -> Column:
    """Extension of a step's output inside a chain of tools."""
    return (
        F.when(tool == "bg_remove", F.lit(".png"))
        .when(tool.isin(*MAKES_VIDEO_TOOLS), F.lit(".mp4"))
        .otherwise(F.coalesce(F.nullif(ext, F.lit("")), F.lit(".jpg")))
    )


def variant_url(url: Column, k: Column) -> Column:
    """Insert ``_v0000`` before the last dot, or append it where there is no dot; longer numbers stay whole."""
    tag = F.format_string("_v%04d", k.cast("long"))
    head = F.regexp_extract(url, r"(?s)^(.*)\.([^.]*)$", 1)
    tail = F.regexp_extract(url, r"(?s)^(.*)\.([^.]*)$", 2)
    return F.when(url.contains("."), F.concat(head, tag, F.lit("."), tail)).otherwise(F.concat(url, tag))


def output_name(path: Column, suffix: str, ext: Column | None = None) -> Column:
    """File name with a suffix after the stem, keeping or replacing the extension."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    own = F.regexp_extract(name, r"[^.].*(\.[^.]*)$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(own))
    return F.concat(stem, F.lit(suffix), own if ext is None else ext)


def safe_name(text: Column) -> Column:
    """Letters, digits, space, dash and underscore only, trimmed, first twenty characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "")), 1, 20)


def traverses(member: Column) -> Column:
    """True for an archive member whose path leaves the folder it is unpacked to."""
    depth = F.aggregate(
        F.filter(F.split(member, "/"), lambda p: ~p.isin("", ".")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"),
            F.least(s["low"], s["at"] + F.when(p == "..", -1).otherwise(1)).alias("low"),
        ),
        lambda s: s["low"],
    )
    return member.startswith("/") | (depth < 0)
