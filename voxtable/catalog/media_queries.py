"""URL, rights, ranking and candidate queries over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable import rules
from voxtable.catalog.base import lit, pick, sql_list, sql_pick, table
from voxtable.catalog.registry import query
from voxtable.functions import urls
from voxtable.operators import media as M
from voxtable.operators.ordered import first_per
from voxtable.sources.pages import page_media

URI = lit(urls.URI)


def s_scheme(u):
    return f"lower(regexp_extract({u}, {URI}, 1))"


def s_auth(u):
    return f"regexp_extract({u}, {URI}, 2)"


def s_path(u):
    return f"regexp_extract({u}, {URI}, 3)"


def s_query(u):
    return f"regexp_extract({u}, {URI}, 4)"


def s_host(u):
    return f"regexp_replace(lower(regexp_extract({s_auth(u)}, '^(?:[^@]*@)?([^:]*)', 1)), '^www\\.', '')"


def s_host_in(h, values):
    return f"(len(list_filter({sql_list(values)}, lambda s: {h} = s OR ends_with({h}, '.' || s))) > 0)"


def s_any(h, values):
    return f"(len(list_filter({sql_list(values)}, lambda s: contains({h}, s))) > 0)"


def s_plain_normal(u):
    """http(s) address without tracking parameters and fragment (no redirect unwrapping)."""
    kept = (
        f"array_to_string(list_filter(string_split({s_query(u)}, '&'), lambda p: p <> '' AND NOT "
        f"list_contains({sql_list(rules.TRACKING_PARAMS)}, lower(string_split(p, '=')[1]))), '&')"
    )
    base = f"{s_scheme(u)} || '://' || {s_auth(u)} || {s_path(u)}"
    return (
        f"CASE WHEN {s_scheme(u)} NOT IN ('http', 'https') THEN '' WHEN {kept} = '' THEN {base} ELSE {base} || '?' || {kept} END"
    )


# --- addresses: every page url in one of eight written forms -----------------------------------

def addresses(spark, sf):
    u, b64 = F.col("url"), F.regexp_replace(F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_"), "=+$", "")
    forms = [
        u,
        F.concat(u, F.lit("?utm_source=x&keep=1&FBCLID=2&gclid=#frag")),
        F.concat(F.lit("https://www.bing.com/ck/a?!&&p=9&u=a1"), b64, F.lit("&ntb=1")),
        F.concat(F.lit("https://duckduckgo.com/l/?uddg="), F.url_encode(u), F.lit("&rut=7")),
        F.concat(F.lit("ftp://host/"), F.col("page_id").cast("string")),
        F.concat(F.lit("  HTTPS://User:pw@WWW.Example.org:8080/a%20b/My%2BFile+v"), F.col("page_id").cast("string"), F.lit(".MP4;x=1?q#z ")),
        F.concat(F.lit("https://cdn.site.net/live/"), F.col("page_id").cast("string"), F.lit("/index.m3u8?b=2&&c=3")),
        F.concat(F.lit("https://img.site.net/._%2F"), F.col("page_id").cast("string"), F.lit("_.PNG")),
    ]
    chosen = F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int"))
    mimes = pick(F.col("page_id") * 3, ["", "video/mp4; codecs=x", "application/vnd.apple.mpegurl", "IMAGE/png", "text/html"])
    return table(spark, sf, "pages").select("page_id", chosen.alias("href"), mimes.alias("mime"))


_b64 = "rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=')"
ADDRESSES = f"""addresses AS (SELECT page_id, url AS target, page_id % 8 AS form, CASE page_id % 8
  WHEN 0 THEN url
  WHEN 1 THEN url || '?utm_source=x&keep=1&FBCLID=2&gclid=#frag'
  WHEN 2 THEN 'https://www.bing.com/ck/a?!&&p=9&u=a1' || {_b64} || '&ntb=1'
  WHEN 3 THEN 'https://duckduckgo.com/l/?uddg=' || url_encode(url) || '&rut=7'
  WHEN 4 THEN 'ftp://host/' || page_id
  WHEN 5 THEN '  HTTPS://User:pw@WWW.Example.org:8080/a%20b/My%2BFile+v' || page_id || '.MP4;x=1?q#z '
  WHEN 6 THEN 'https://cdn.site.net/live/' || page_id || '/index.m3u8?b=2&&c=3'
  ELSE 'https://img.site.net/._%2F' || page_id || '_.PNG' END AS href,
  {sql_pick("page_id * 3", ["", "video/mp4; codecs=x", "application/vnd.apple.mpegurl", "IMAGE/png", "text/html"])} AS mime FROM pages),
unwrapped AS (SELECT *, CASE
  WHEN contains({s_host('href')}, 'bing.com') AND contains({s_path('href')}, '/ck/')
    THEN decode(from_base64(rpad(translate(regexp_extract({s_query('href')}, '(?:^|&)u=a1([^&]+)', 1), '-_', '+/'),
         (4 * ceil(length(regexp_extract({s_query('href')}, '(?:^|&)u=a1([^&]+)', 1)) / 4.0))::INT, '=')))
  WHEN contains({s_host('href')}, 'duckduckgo.com') AND contains({s_query('href')}, 'uddg')
    THEN url_decode(regexp_extract({s_query('href')}, '(?:^|&)uddg=([^&]+)', 1))
  ELSE trim(href) END AS u FROM addresses)"""

query("url_normalize", f"WITH {ADDRESSES} SELECT page_id, {s_plain_normal('u')} AS url FROM unwrapped")(
    lambda spark, sf: addresses(spark, sf).select("page_id", urls.normalize(F.col("href")).alias("url"))
)
_suffixes = ["example.com", "example.org", "site.net"]
query(
    "url_host_suffix",
    f"WITH {ADDRESSES} SELECT page_id, {s_host('trim(href)')} AS host, {s_host_in(s_host('trim(href)'), _suffixes)} AS listed FROM addresses",
)(
    lambda spark, sf: addresses(spark, sf)
    .select("page_id", urls.host(F.trim(F.col("href"))).alias("host"))
    .withColumn("listed", urls.host_in(F.col("host"), _suffixes))
)
_ext = f"regexp_extract(lower({s_path('href')}), '(\\.[^./]*)$', 1)"
_mime = "lower(trim(string_split(mime, ';')[1]))"


def s_kind(ext, mime):
    return (
        f"CASE WHEN starts_with({mime}, 'video/') OR list_contains({sql_list(rules.VIDEO_EXT)}, {ext}) THEN 'video' "
        f"WHEN contains({mime}, 'mpegurl') OR list_contains({sql_list(rules.STREAM_EXT)}, {ext}) THEN 'stream' "
        f"WHEN starts_with({mime}, 'image/') OR list_contains({sql_list(rules.IMAGE_EXT)}, {ext}) THEN 'image' "
        f"WHEN {ext} = '.zip' THEN 'download' END"
    )


query("url_media_kind", f"WITH {ADDRESSES} SELECT page_id, {s_kind(_ext, _mime)} AS kind FROM addresses")(
    lambda spark, sf: addresses(spark, sf).select("page_id", urls.media_kind(F.col("href"), F.col("mime")).alias("kind"))
)
_base = f"regexp_extract(url_decode(replace({s_path('trim(href)')}, '+', '%2B')), '([^/]*)/*$', 1)"
_safe = f"trim(regexp_replace(CASE WHEN {_base} = '' THEN 'asset' ELSE {_base} END, '[^A-Za-z0-9._-]+', '_', 'g'), '._')"
query("url_filename", f"WITH {ADDRESSES} SELECT page_id, (CASE WHEN {_safe} = '' THEN 'asset' ELSE {_safe} END)[1:120] AS name FROM addresses")(
    lambda spark, sf: addresses(spark, sf).select("page_id", urls.file_name(F.trim(F.col("href")), "asset").alias("name"))
)

# --- pages with media tags ---------------------------------------------------------------------
TAGS = [
    '<video src="/v/clip.mp4" type="video/mp4"></video><source src="https://cdn.example.org/s.m3u8?utm_source=a&amp;k=1">',
    '<img src="pic.png" width="640" height="360"><img src="/tiny.gif" width="20"><img src="//img.example.com/c.webp">',
    '<meta property="og:image" content="https://img.example.com/og.jpg#x"><meta property="og:title" content="OG title">'
    '<link rel="license" href="https://creativecommons.org/licenses/by/4.0/">',
    '<a download href="/files/pack.zip">zip</a><a href="https://upload.wikimedia.org/a.webm">w</a>',
    '<iframe src="https://www.youtube.com/embed/1"></iframe><iframe></iframe><img src="data:image/png;base64,AA==">',
    '<p>none</p><meta property="og:video" content="https://v.example.com/o.webm"><img src="https://img.example.com/og.jpg">',
]


def tagged_pages(spark, sf):
    extra = F.concat(pick(F.col("page_id"), TAGS), pick(F.col("page_id") * 5 + 1, TAGS))
    return table(spark, sf, "pages").select("page_id", "url", F.replace("html", F.lit("<nav>"), F.concat(F.lit("<nav>"), extra)).alias("html"))


def s_attr(t, name):
    return f"replace(regexp_extract({t}, '(?i)\\s{name}\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), '&amp;', '&')"


def s_meta(prop):
    return s_attr(f"regexp_extract(html, '(?i)<meta\\s[^>]*property\\s*=\\s*[\"'']{prop}[\"''][^>]*>', 0)", "content")


def s_abs(r, p):
    origin = f"{s_scheme(p)} || '://' || {s_auth(p)}"
    folder = f"regexp_extract({s_path(p)}, '^(.*/)', 1)"
    return (
        f"CASE WHEN {r} = '' THEN '' WHEN regexp_matches({r}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {r} "
        f"WHEN starts_with({r}, '//') THEN {s_scheme(p)} || ':' || {r} WHEN starts_with({r}, '/') THEN {origin} || {r} "
        f"ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {r} END"
    )


def s_tags(cls, rank, name, cap=""):
    return (
        f"SELECT page_id, {rank} AS cls, unnest(range(len(a))) AS n, unnest(a) AS t, '{cls}' AS c FROM "
        f"(SELECT page_id, (regexp_extract_all(html, '(?i)<(?:{name})(?:\\s[^>]*)?>')){cap} AS a FROM tagged)"
    )


_src, _type, _href = s_attr("t", "src"), s_attr("t", "type"), s_attr("t", "href")
_width = f"nullif(TRY_CAST({s_attr('t', 'width')} AS INT), 0)"
_height = f"nullif(TRY_CAST({s_attr('t', 'height')} AS INT), 0)"


def s_ext(u):
    return f"regexp_extract(lower({s_path(u)}), '(\\.[^./]*)$', 1)"


PAGE_MEDIA = f"""tagged AS (SELECT page_id, url, replace(html, '<nav>', '<nav>' || {sql_pick('page_id', TAGS)} || {sql_pick('page_id * 5 + 1', TAGS)}) AS html FROM pages),
tag_rows AS ({s_tags('v', 0, 'video|source')} UNION ALL {s_tags('i', 1, 'img', '[1:40]')} UNION ALL {s_tags('a', 4, 'a')} UNION ALL {s_tags('f', 5, 'iframe')}),
refs AS (
  SELECT page_id, cls, n, CASE WHEN c = 'a' THEN {_href} ELSE {_src} END AS ref, c,
     CASE WHEN c = 'v' THEN nullif({_type}, '') END AS mime, CASE WHEN c = 'i' THEN {_width} END AS width, CASE WHEN c = 'i' THEN {_height} END AS height
  FROM tag_rows WHERE (c <> 'i' OR {_width} IS NULL OR {_width} >= 160)
    AND (c <> 'a' OR regexp_matches(t, '(?i)\\sdownload[\\s=>]') OR regexp_matches({_href}, '\\.(mp4|webm|mov|zip)$'))
  UNION ALL SELECT page_id, 2, 0, {s_meta('og:image')}, 'og', NULL, NULL, NULL FROM tagged
  UNION ALL SELECT page_id, 3, 0, {s_meta('og:video')}, 'ov', NULL, NULL, NULL FROM tagged),
absd AS (SELECT r.*, t.url AS page_url, t.html, {s_abs('ref', 't.url')} AS a FROM refs r JOIN tagged t USING (page_id)),
normed AS (SELECT *, {s_plain_normal('a')} AS u FROM absd),
kinded AS (SELECT page_id, cls, n, u AS url, mime, width, height, page_url,
   CASE c WHEN 'i' THEN 'image' WHEN 'og' THEN 'image' WHEN 'f' THEN 'embed'
     WHEN 'v' THEN COALESCE({s_kind(s_ext('ref'), "lower(trim(string_split(COALESCE(mime, ''), ';')[1]))")}, 'video')
     WHEN 'ov' THEN COALESCE({s_kind(s_ext('ref'), "''")}, 'video') ELSE COALESCE({s_kind(s_ext('ref'), "''")}, 'download') END AS kind,
   CASE WHEN c IN ('og', 'ov') THEN 'og' WHEN c = 'a' THEN 'download_link' ELSE 'dom' END AS via,
   CASE WHEN {s_meta('og:title')} <> '' THEN {s_meta('og:title')} ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS title,
   {s_attr("regexp_extract(html, '(?i)<link\\s[^>]*rel\\s*=\\s*[" + chr(34) + "'']license[" + chr(34) + "''][^>]*>', 0)", "href")} AS license_hint
   FROM normed WHERE u <> ''),
firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY cls, n) AS rn FROM kinded),
media AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY cls, n) - 1 AS ordinal, kind, url, page_url, via, mime, title, width, height, license_hint FROM firsts WHERE rn = 1)"""
query("src_pages_media", f"WITH {PAGE_MEDIA} SELECT * FROM media")(lambda spark, sf: page_media(tagged_pages(spark, sf)))

# --- media rows for rights and ranking: one row per page, hosts and licences from a cycle ------
HOSTS = [
    "commons.wikimedia.org", "www.youtube.com", "cdn.example.com", "news.bbc.co.uk", "images.nasa.gov", "files.example.org",
    "media.gettyimages.com", "static.pexels.com", "videos.example.net", "x.com", "notx.com",
]
LICENCES = [
    "", "CC BY-SA 4.0", "All Rights  Reserved.", "Public_Domain", "Released under the MIT License.", "AFP photo, cc0",
    "", "Unsplash License", "for review only",
]
KINDS = ["video", "image", "embed", "stream", "download"]
VIAS = ["api", "dom", "og", "download_link", "network"]
QUERY = "the example video of nasa 2024"


def media_rows(spark, sf):
    i = F.col("page_id")
    own = F.regexp_extract("html", r"<p>(Released under[^<]*|All rights reserved[^<]*)<", 1)
    hint = pick(i * 4 + 1, LICENCES)
    return table(spark, sf, "pages").select(
        (i % 7).alias("job_id"),
        i.alias("ordinal"),
        pick(i * 3, KINDS).alias("kind"),
        F.concat(F.lit("https://"), pick(i, HOSTS), F.lit("/v/"), (i % 90).cast("string"), F.lit("?p="), (i % 2).cast("string")).alias("url"),
        F.when(i % 5 == 0, F.concat(F.lit("https://"), pick(i * 2 + 3, HOSTS), F.lit("/page"))).otherwise(F.col("url")).alias("page_url"),
        pick(i * 2, VIAS).alias("via"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.when(hint == "", own).otherwise(hint).alias("license_hint"),
    )


MEDIA = f"""media_rows AS (SELECT page_id % 7 AS job_id, page_id AS ordinal, {sql_pick('page_id * 3', KINDS)} AS kind,
  'https://' || {sql_pick('page_id', HOSTS)} || '/v/' || (page_id % 90) || '?p=' || (page_id % 2) AS url,
  CASE WHEN page_id % 5 = 0 THEN 'https://' || {sql_pick('page_id * 2 + 3', HOSTS)} || '/page' ELSE url END AS page_url,
  {sql_pick('page_id * 2', VIAS)} AS via,
  CASE WHEN page_id % 4 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  COALESCE(nullif({sql_pick('page_id * 4 + 1', LICENCES)}, ''), regexp_extract(html, '<p>(Released under[^<]*|All rights reserved[^<]*)<', 1)) AS license_hint
  FROM pages)"""
_blob = "trim(regexp_replace(replace(lower(license_hint), '_', ' '), '\\s+', ' ', 'g'))"
_lic = f"CASE WHEN {s_any(_blob, rules.REJECT_MARKERS)} THEN 'copyrighted' WHEN {s_any(_blob, rules.REUSABLE_MARKERS)} THEN 'reusable' END"
RIGHTS = f"""{MEDIA},
facts AS (SELECT *, {s_host('url')} AS mh, {s_host('page_url')} AS ph, {_lic} AS ls, trim(license_hint)[1:120] AS ll FROM media_rows),
flags AS (SELECT *, {s_host_in('mh', rules.BLOCKED_HOSTS)} AS mb, {s_host_in('ph', rules.BLOCKED_HOSTS)} AS pb,
  {s_host_in('mh', rules.REUSABLE_HOSTS)} OR {s_host_in('ph', rules.REUSABLE_HOSTS)} AS ok FROM facts),
ruled AS (SELECT *, CASE WHEN kind IN ('embed', 'stream') AND mb THEN 1 WHEN mb OR pb THEN 2 WHEN ls = 'copyrighted' THEN 3 WHEN ok THEN 4 WHEN ls = 'reusable' THEN 5 ELSE 6 END AS rule FROM flags),
rights AS (SELECT job_id, ordinal, kind, url, page_url, via, title, license_hint,
  (['copyrighted', 'copyrighted', 'copyrighted', 'reusable', 'reusable', 'unknown'])[rule] AS status,
  CASE WHEN ll <> '' THEN ll ELSE (['embedded/streamed third-party media', 'news/stock/social host', '', 'allowlisted reusable-media host', '', 'no license found'])[rule] END AS label,
  (['Blocked host for streams/embeds. A media URL is not a reuse license.', 'Host is treated as copyrighted news, social, or stock media.',
    'Page license text is not reusable.', 'Source is on the reusable-media allowlist.', 'Page advertised a Creative Commons / public-domain license.',
    'No reusable license detected. Unknown media is not downloaded.'])[rule] AS reason,
  CASE WHEN mh <> '' THEN mh ELSE ph END AS source_domain FROM ruled),
candidates AS (SELECT *, CASE WHEN status <> 'reusable' THEN 0.0 ELSE 40 + CASE kind WHEN 'video' THEN 25 WHEN 'image' THEN 12 WHEN 'download' THEN 18 ELSE 0 END
    + CASE WHEN via IN ('api', 'download_link') THEN 8 ELSE 0 END
    + 3 * len(list_filter(string_split({lit(QUERY)}, ' '), lambda t: length(t) > 2 AND contains(lower(title || ' ' || url || ' ' || page_url), t))) END::DOUBLE AS rank,
  CASE WHEN status = 'copyrighted' THEN 'blocked' ELSE 'skipped' END AS action,
  COALESCE(nullif(title, ''), page_url) AS shown_title FROM rights)"""


def cands(spark, sf):
    return M.candidates(media_rows(spark, sf), F.lit(QUERY))


query("lab_license_text", f"WITH {RIGHTS} SELECT ordinal, ls AS status, ll AS label FROM facts")(
    lambda spark, sf: media_rows(spark, sf).select(
        "ordinal", M.license_status(F.col("license_hint")).alias("status"), M.license_label(F.col("license_hint")).alias("label")
    )
)
query("lab_rights", f"WITH {RIGHTS} SELECT ordinal, status, label, reason, source_domain FROM rights")(
    lambda spark, sf: M.with_rights(media_rows(spark, sf)).select("ordinal", "status", "label", "reason", "source_domain")
)
query("score_media_rank", f"WITH {RIGHTS} SELECT ordinal, rank FROM candidates")(lambda spark, sf: cands(spark, sf).select("ordinal", "rank"))
query("lab_candidates", f"WITH {RIGHTS} SELECT * FROM candidates")(lambda spark, sf: cands(spark, sf))
query(
    "topk_downloads",
    f"""WITH {RIGHTS}, d AS (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY kind <> 'video', rank DESC, ordinal) AS u FROM candidates WHERE status = 'reusable'),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY kind <> 'video', rank DESC, ordinal) AS rank_no FROM d WHERE u = 1)
SELECT job_id, rank_no, ordinal, url, kind, rank FROM k WHERE rank_no <= 8""",
)(lambda spark, sf: M.select_downloads(cands(spark, sf), 8, "job_id").select("job_id", "rank_no", "ordinal", "url", "kind", "rank"))


def downloaded(spark, sf):
    """Candidates with file facts; the reusable ones count as downloaded."""
    i = F.col("ordinal")
    return cands(spark, sf).withColumns(
        {
            "is_downloaded": F.col("status") == "reusable",
            "probe_ok": i % 9 != 0,
            "file_name": urls.file_name(F.col("url"), "asset"),
        }
    )


def needles(spark, sf):
    """Search needles of each job: page title words, plus the words of the job query."""
    words_in = F.explode(F.split(F.concat_ws(" ", F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(QUERY)), " "))
    return table(spark, sf, "pages").select((F.col("page_id") % 7).alias("job_id"), words_in.alias("needle"))


_fname = "trim(regexp_replace(regexp_extract(regexp_extract(url, " + URI + ", 3), '([^/]*)/*$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '._')"
RELEVANCE = f"""{RIGHTS},
dl AS (SELECT *, status = 'reusable' AS is_downloaded, ordinal % 9 <> 0 AS probe_ok, CASE WHEN {_fname} = '' THEN 'asset' ELSE {_fname} END AS file_name FROM candidates),
needles AS (SELECT DISTINCT page_id % 7 AS job_id, lower(unnest(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || {lit(QUERY)}, ' '))) AS needle FROM pages),
hit AS (SELECT job_id, ordinal, count(*) AS h FROM dl JOIN needles USING (job_id)
  WHERE length(needle) > 2 AND contains(lower(title || ' ' || url || ' ' || file_name || ' ' || label), needle) GROUP BY ALL),
relevant AS (SELECT dl.*, COALESCE(h, 0) AS hits, CASE WHEN probe_ok THEN least(1.0, (2 + 2 * COALESCE(h, 0)) / 10.0) ELSE 0.0 END::DOUBLE AS rule_score,
  status = 'reusable' AND probe_ok AND COALESCE(h, 0) >= 2 AS rule_keep FROM dl LEFT JOIN hit USING (job_id, ordinal))"""


def relevant(spark, sf):
    return M.relevance(downloaded(spark, sf), needles(spark, sf), ["job_id"])


query("score_asset_relevance", f"WITH {RELEVANCE} SELECT job_id, ordinal, hits, rule_score, rule_keep FROM relevant")(
    lambda spark, sf: relevant(spark, sf).select("job_id", "ordinal", "hits", "rule_score", "rule_keep")
)


def verdicts(spark, sf):
    """Model verdicts for documents, read as verdicts on the candidate of the same number."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("ordinal"),
        F.lit(0).alias("verdict_no"),
        (F.col("quality") == 1).alias("keep"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(1.7)).when(F.col("doc_id") % 3 == 1, F.lit(0.0)).otherwise(F.lit(0.45)).alias("score"),
    )


REVIEWED = f"""{RELEVANCE},
vd AS (SELECT doc_id AS ordinal, quality = 1 AS keep, CASE doc_id % 3 WHEN 0 THEN 1.7 WHEN 1 THEN 0.0 ELSE 0.45 END AS score FROM labels),
reviewed AS (SELECT r.job_id, r.ordinal, r.rank,
  CASE WHEN NOT probe_ok THEN false ELSE COALESCE(v.keep, rule_keep) END AS verdict_keep,
  CASE WHEN NOT probe_ok THEN 0.0 WHEN v.keep IS NOT NULL THEN greatest(0.0, least(1.0, COALESCE(nullif(v.score, 0.0), CASE WHEN v.keep THEN 0.8 ELSE 0.2 END))) ELSE rule_score END::DOUBLE AS verdict_score,
  CASE WHEN NOT probe_ok THEN 'probe' WHEN v.keep IS NOT NULL THEN 'model' ELSE 'rule' END AS verdict_from,
  CASE WHEN NOT is_downloaded THEN action WHEN NOT probe_ok THEN 'rejected' WHEN COALESCE(v.keep, rule_keep) THEN 'accepted' ELSE 'rejected' END AS action,
  r.title, r.kind, r.url, r.page_url, r.reason, r.is_downloaded
  FROM relevant r LEFT JOIN vd v USING (ordinal))"""


def reviewed(spark, sf):
    return M.review(relevant(spark, sf), verdicts(spark, sf), ["ordinal"])


query("join_verdicts", f"WITH {REVIEWED} SELECT job_id, ordinal, verdict_keep, verdict_score, verdict_from, action FROM reviewed")(
    lambda spark, sf: reviewed(spark, sf).select("job_id", "ordinal", "verdict_keep", "verdict_score", "verdict_from", "action")
)
query(
    "agg_candidate_counts",
    f"""WITH {REVIEWED} SELECT job_id, count(*) FILTER (WHERE action = 'accepted') AS accepted, count(*) FILTER (WHERE action = 'rejected') AS rejected,
 count(*) FILTER (WHERE action = 'blocked') AS blocked, count(*) FILTER (WHERE action = 'skipped') AS skipped, count(*) FILTER (WHERE is_downloaded) AS downloaded FROM reviewed GROUP BY job_id""",
)(
    lambda spark, sf: reviewed(spark, sf)
    .groupBy("job_id")
    .agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("accepted", "rejected", "blocked", "skipped")],
        F.count_if("is_downloaded").alias("downloaded"),
    )
)
query(
    "sort_candidates",
    f"WITH {REVIEWED} SELECT job_id, ordinal, action, CASE WHEN is_downloaded THEN verdict_score ELSE rank END AS sort_score FROM reviewed ORDER BY job_id, action <> 'accepted', sort_score DESC, ordinal",
)(
    lambda spark, sf: reviewed(spark, sf)
    .select("job_id", "ordinal", "action", F.when(F.col("is_downloaded"), F.col("verdict_score")).otherwise(F.col("rank")).alias("sort_score"))
    .orderBy("job_id", F.col("action") != "accepted", F.col("sort_score").desc(), "ordinal")
)

# --- search results ----------------------------------------------------------------------------

def result_rows(spark, sf):
    i = F.col("page_id")
    return addresses(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").select(
        pick(i, ["bing", "duckduckgo", "google"]).alias("engine"),
        F.concat(F.lit("query "), (i % 11).cast("string")).alias("query"),
        i.alias("ordinal"),
        F.when(i % 6 == 0, F.lit("https://accounts.google.com/x")).otherwise(F.col("href")).alias("href"),
        F.when(i % 5 == 0, F.lit(" ")).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract("html", "<p>([^<]*)<", 1).alias("snippet"),
    )


HITS = f"""{ADDRESSES},
rows_ AS (SELECT {sql_pick('page_id', ['bing', 'duckduckgo', 'google'])} AS engine, 'query ' || (page_id % 11) AS query, page_id AS ordinal,
  CASE WHEN page_id % 6 = 0 THEN 'https://accounts.google.com/x' ELSE u END AS u,
  CASE WHEN page_id % 5 = 0 THEN ' ' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, regexp_extract(html, '<p>([^<]*)<', 1) AS snippet
  FROM unwrapped JOIN (SELECT page_id, html FROM pages) USING (page_id)),
cleaned AS (SELECT * EXCLUDE (u), {s_plain_normal('u')} AS url FROM rows_),
hosted AS (SELECT *, {s_host('url')} AS host FROM cleaned WHERE url <> ''),
hits AS (SELECT engine, query, ordinal, url, host, (CASE WHEN trim(title) = '' THEN host ELSE trim(title) END)[1:200] AS title, trim(snippet)[1:280] AS snippet,
  row_number() OVER (PARTITION BY engine, query ORDER BY ordinal) AS rank_no FROM hosted WHERE NOT {s_host_in('host', rules.SEARCH_HOSTS)} QUALIFY rank_no <= 6)"""


def hits(spark, sf):
    return M.hits_from_rows(result_rows(spark, sf), 6).select("engine", "query", "ordinal", "url", "host", "title", "snippet", "rank_no")


query("limit_hits", f"WITH {HITS} SELECT * FROM hits")(hits)
def hit_media(spark, sf):
    """One medium behind every third hit; hits of neighbouring rows share some, and some are pages of other hits."""
    i = F.col("ordinal")
    own = F.when(i % 12 == 0, F.col("url")).otherwise(F.concat(F.lit("https://media.example/"), F.floor(i / 9).cast("string")))
    return hits(spark, sf).filter(i % 3 == 0).select("ordinal", own.alias("media_url"))


query(
    "union_hits",
    f"""WITH {HITS}, md AS (SELECT ordinal, CASE WHEN ordinal % 12 = 0 THEN url ELSE 'https://media.example/' || (ordinal // 9) END AS url FROM hits WHERE ordinal % 3 = 0),
ev AS (SELECT ordinal, 'hit' AS part, url FROM hits UNION ALL SELECT ordinal, 'media', url FROM md),
f AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal, part) = 1)
SELECT * FROM f WHERE ordinal NOT IN (SELECT ordinal FROM md WHERE ordinal NOT IN (SELECT ordinal FROM f WHERE part = 'media'))""",
)(lambda spark, sf: M.union_hits(hits(spark, sf), hit_media(spark, sf)))
query(
    "topk_pages_per_host",
    f"""WITH {HITS}, n AS (SELECT query, ordinal, url, string_split(url, '/')[3] AS netloc FROM hits),
h AS (SELECT *, row_number() OVER (PARTITION BY query, netloc ORDER BY ordinal) AS r FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ordinal) AS pool_no FROM h WHERE r = 1)
SELECT query, ordinal, netloc, pool_no, pool_no AS visit_no FROM p WHERE pool_no <= 12 AND pool_no <= 5""",
)(lambda spark, sf: M.pages_to_visit(hits(spark, sf).drop("rank_no"), ["query"]).select("query", "ordinal", "netloc", "pool_no", "visit_no"))
ENGINES = ["bing", "duckduckgo", "google", "wikimedia"]
query(
    "anti_engine_gap",
    f"""WITH {HITS}, q AS (SELECT DISTINCT 'query ' || (page_id % 13) AS query FROM pages)
SELECT 'fallback' AS kind, query AS value FROM q WHERE query NOT IN (SELECT query FROM hits WHERE engine = 'duckduckgo' GROUP BY query HAVING count(*) >= 2)
UNION ALL SELECT 'unseen', e FROM (SELECT unnest({sql_list(ENGINES)}) AS e) WHERE e NOT IN (SELECT engine FROM hits)""",
)(
    lambda spark, sf: M.engine_gaps(
        table(spark, sf, "pages").select(F.concat(F.lit("query "), (F.col("page_id") % 13).cast("string")).alias("query")).distinct(),
        hits(spark, sf).filter("engine = 'duckduckgo'"),
        8,
    )
    .select(F.lit("fallback").alias("kind"), F.col("query").alias("value"))
    .unionByName(M.unseen_engines(spark.createDataFrame([(e,) for e in ENGINES], "engine string"), hits(spark, sf)).select(F.lit("unseen").alias("kind"), F.col("engine").alias("value")))
)
query(
    "dedupe_first",
    f"""WITH {MEDIA}, k AS (SELECT job_id, ordinal, string_split(url, '?')[1] AS bare, row_number() OVER (PARTITION BY job_id, string_split(url, '?')[1] ORDER BY ordinal) AS rn FROM media_rows)
SELECT job_id, ordinal, bare FROM k WHERE rn = 1""",
)(
    lambda spark, sf: first_per(
        media_rows(spark, sf).select("job_id", "ordinal", urls.without_query(F.col("url")).alias("bare")), ["job_id", "bare"], "ordinal"
    )
)


def api_dump(spark, sf):
    i = F.col("ordinal")
    return media_rows(spark, sf).select(
        F.concat(F.lit("q"), F.col("job_id").cast("string")).alias("query"),
        "ordinal",
        F.when(i % 17 == 0, F.lit("")).otherwise(F.col("url")).alias("url"),
        pick(i, ["image/jpeg", "video/webm", "audio/mpeg", "Application/OGG", "application/x-ogm", "image/png"]).alias("mime"),
        pick(i * 5, [0, 3999, 4000, 80_000_000, 80_000_001, 123456]).alias("size"),
        "license_hint",
    )


query(
    "lab_wiki_filter",
    f"""WITH {RIGHTS}, d AS (SELECT 'q' || job_id AS query, ordinal, CASE WHEN ordinal % 17 = 0 THEN '' ELSE url END AS url, license_hint, ls,
  lower({sql_pick('ordinal', ["image/jpeg", "video/webm", "audio/mpeg", "Application/OGG", "application/x-ogm", "image/png"])}) AS mime,
  ([0, 3999, 4000, 80000000, 80000001, 123456])[(ordinal * 5) % 6 + 1] AS size FROM facts),
k AS (SELECT query, ordinal, url, CASE WHEN starts_with(mime, 'video/') OR mime = 'application/x-ogm' THEN 'video' ELSE 'image' END AS kind,
  row_number() OVER (PARTITION BY query ORDER BY ordinal) AS rank_no FROM d
  WHERE url <> '' AND NOT starts_with(mime, 'audio/') AND mime <> 'application/ogg' AND (size = 0 OR size BETWEEN 4000 AND 80000000)
    AND ls IS DISTINCT FROM 'copyrighted')
SELECT * FROM k WHERE rank_no <= 10""",
)(lambda spark, sf: M.api_dump_media(api_dump(spark, sf), 10).select("query", "ordinal", "url", "kind", "rank_no"))
