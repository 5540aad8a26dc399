"""Media found in crawled HTML, one narrow pass over the pages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import urls
from voxtable.functions.text import let

MEDIA_FIELDS = "struct<kind:string,url:string,via:string,mime:string,width:int,height:int>"


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, '' when absent."""
    raw = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.replace(raw, F.lit("&amp;"), F.lit("&"))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{name})(?:\s[^>]*)?>"), F.lit(0))


def meta(html: Column, prop: str) -> Column:
    tag = F.regexp_extract(html, rf"(?i)<meta\s[^>]*property\s*=\s*[\"']{prop}[\"'][^>]*>", 0)
    return attr(tag, "content")


def absolute(ref: Column, page_url: Column) -> Column:
    origin = F.concat(urls.scheme(page_url), F.lit("://"), urls.authority(page_url))
    folder = F.regexp_extract(urls.path(page_url), r"^(.*/)", 1)
    return (
        F.when(ref == "", F.lit(""))
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(urls.scheme(page_url), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    )


def _row(kind, url, via, mime=None, width=None, height=None) -> Column:
    null_str, null_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    return F.struct(
        kind.alias("kind"),
        url.alias("url"),
        F.lit(via).alias("via"),
        (null_str if mime is None else mime).alias("mime"),
        (null_int if width is None else width).alias("width"),
        (null_int if height is None else height).alias("height"),
    )


def page_title(html: Column) -> Column:
    og = meta(html, "og:title")
    return F.when(og != "", og).otherwise(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_license(html: Column) -> Column:
    link = attr(F.regexp_extract(html, r"(?i)<link\s[^>]*rel\s*=\s*[\"']license[\"'][^>]*>", 0), "href")
    short = F.regexp_extract(html, r"(?is)class\s*=\s*[\"'][^\"']*licensetpl_short[^\"']*[\"'][^>]*>([^<]*)<", 1)
    item = F.regexp_extract(html, r"(?i)<[a-z]+\s[^>]*itemprop\s*=\s*[\"']license[\"'][^>]*>", 0)
    return F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in (link, short, attr(item, "content"), attr(item, "href"))], F.lit("")))


def page_media(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, kind, url, page_url, via, mime, title, width, height, license_hint).

    All tag classes of a page are gathered in one array in document-class order and
    de-duplicated inside the row, so nothing is shuffled.
    """
    html, page_url = F.col("html"), F.col("url")

    def clean(ref):
        return urls.normalize(absolute(ref, page_url))

    def number(tag, name):
        return F.nullif(attr(tag, name).try_cast("int"), F.lit(0))

    videos = F.transform(
        tags(html, "video|source"),
        lambda t: _row(
            F.coalesce(urls.media_kind(attr(t, "src"), attr(t, "type")), F.lit("video")),
            clean(attr(t, "src")),
            "dom",
            F.nullif(attr(t, "type"), F.lit("")),
        ),
    )
    images = F.transform(
        F.filter(F.slice(tags(html, "img"), 1, 40), lambda t: F.coalesce(number(t, "width") >= 160, F.lit(True))),
        lambda t: _row(F.lit("image"), clean(attr(t, "src")), "dom", None, number(t, "width"), number(t, "height")),
    )
    og_video = F.coalesce(F.nullif(meta(html, "og:video"), F.lit("")), meta(html, "og:video:url"))
    og = F.array(
        _row(F.lit("image"), clean(meta(html, "og:image")), "og"),
        _row(F.coalesce(urls.media_kind(og_video, F.lit("")), F.lit("video")), clean(og_video), "og"),
    )
    links = F.filter(
        tags(html, "a"),
        lambda t: t.rlike(r"(?i)\sdownload[\s=>]") | attr(t, "href").rlike(r"\.(mp4|webm|mov|zip)$"),
    )
    downloads = F.transform(
        links,
        lambda t: _row(
            F.coalesce(urls.media_kind(attr(t, "href"), F.lit("")), F.lit("download")), clean(attr(t, "href")), "download_link"
        ),
    )
    embeds = F.transform(tags(html, "iframe"), lambda t: _row(F.lit("embed"), clean(attr(t, "src")), "dom"))

    def distinct(rows):
        return let(
            F.transform(rows, lambda r: r["url"]),
            lambda names: F.filter(rows, lambda r, i: F.array_position(names, r["url"]) == i + 1),
        )

    found = F.filter(F.concat(videos, images, og, downloads, embeds), lambda r: r["url"] != "")
    return pages.select(
        "page_id",
        page_url.alias("page_url"),
        page_title(html).alias("title"),
        page_license(html).alias("license_hint"),
        F.posexplode(let(found, distinct)).alias("ordinal", "m"),
    ).select("page_id", "ordinal", "m.*", "page_url", "title", "license_hint")
