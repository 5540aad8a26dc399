"""URL handling as column expressions, on the generic URI grammar rather than a strict parser."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxtable import rules
from voxtable.functions.text import let, one_of

# scheme, authority, path, query
URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URI, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URI, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URI, 3)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, URI, 4)


def full_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?([^:]*)", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(full_host(url), r"^www\.", "")


def host_in(h: Column, suffixes) -> Column:
    """Is the host one of the names, or below one of them?"""
    listed = F.array(*[F.lit(s) for s in suffixes])
    return F.exists(listed, lambda s: (h == s) | h.endswith(F.concat(F.lit("."), s)))


def _param(url: Column, name: str) -> Column:
    raw = F.regexp_extract(query_string(url), rf"(?:^|&){name}=([^&]+)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def unwrap_redirect(url: Column) -> Column:
    """Take the target out of the two search-engine redirect forms."""
    token = F.translate(F.regexp_replace(_param(url, "u"), "^a1", ""), "-_", "+/")
    padded = F.rpad(token, F.ceil(F.length(token) / 4).cast("int") * 4, "=")
    target = F.try_to_binary(padded, F.lit("base64")).cast("string")
    inner = _param(url, "uddg")
    return (
        F.when(
            full_host(url).contains("bing.com") & path(url).contains("/ck/"),
            F.when(target.startswith("http"), target).otherwise(url),
        )
        .when(
            full_host(url).contains("duckduckgo.com") & query_string(url).contains("uddg"),
            F.coalesce(F.try_url_decode(inner), inner),
        )
        .otherwise(url)
    )


def normalize(url: Column) -> Column:
    """http(s) only, redirects unwrapped, tracking parameters and fragment gone; '' when unusable."""

    def rebuilt(u):
        kept = F.filter(
            F.split(query_string(u), "&"),
            lambda p: (p != "") & ~one_of(F.lower(F.substring_index(p, "=", 1)), rules.TRACKING_PARAMS),
        )
        q = F.array_join(kept, "&")
        plain = F.concat(scheme(u), F.lit("://"), authority(u), path(u))
        clean = F.when(q == "", plain).otherwise(F.concat(plain, F.lit("?"), q))
        return F.when(one_of(scheme(u), ["http", "https"]), clean).otherwise(F.lit(""))

    return let(unwrap_redirect(F.trim(F.coalesce(url, F.lit("")))), rebuilt)


def extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"(\.[^./]*)$", 1)


def media_kind(url: Column, mime: Column) -> Column:
    m = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    ext = extension(url)
    return (
        F.when(m.startswith("video/") | one_of(ext, rules.VIDEO_EXT), F.lit("video"))
        .when(m.contains("mpegurl") | one_of(ext, rules.STREAM_EXT), F.lit("stream"))
        .when(m.startswith("image/") | one_of(ext, rules.IMAGE_EXT), F.lit("image"))
        .when(ext == ".zip", F.lit("download"))
    )


def file_name(url: Column, default: Column | str) -> Column:
    """Decoded last path part with unsafe characters replaced, at most 120 characters."""
    fallback = F.lit(default) if isinstance(default, str) else default
    # A plus sign is literal in a path, so it must survive the form decoder.
    decoded = F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B")))
    base = F.regexp_extract(F.coalesce(decoded, path(url)), r"([^/]*)/*$", 1)
    safe = F.btrim(F.regexp_replace(F.when(base == "", fallback).otherwise(base), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.substring(F.when(safe == "", fallback).otherwise(safe), 1, 120)


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)

