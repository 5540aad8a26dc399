"""Quality checks, joins with model answers and summary aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable import rules
from voxtable.catalog.base import SEGMENTS, WORDS, lit, pick, segments, sql_list, sql_pick, table, words
from voxtable.catalog.caption_queries import (
    CAPS, DUR, LINES, SQUEEZED, ZOOM, caps, durations, lines, raw_beats, squeezed, zoom_plan, ICONS, MOODS, KINDS, _li,
)
from voxtable.catalog.registry import query
from voxtable.catalog.speech_queries import LABELS, MOTION, hot_videos, labelled
from voxtable.catalog.text_queries import sql_content, sql_fix_asr, sql_norm, sql_squish, sql_stabilize_cte, sql_stem, sql_tokens
from voxtable.functions import text as X
from voxtable.operators import joins as J
from voxtable.operators import labels as L
from voxtable.operators import quality as Q


def s_rules(src, ids, conds):
    arr = ", ".join(f"CASE WHEN {c} THEN {lit(n)} END" for n, c in conds.items())
    return f"SELECT * FROM (SELECT {', '.join(ids)}, unnest([{arr}]) AS rule FROM {src}) WHERE rule IS NOT NULL"


def broken_caps(spark, sf):
    """Captions at double speed, some moved, emptied or cut so that each rule is met."""
    c = squeezed(spark, sf).join(durations(spark, sf), "video_id")
    i = F.col("caption_id")
    return c.withColumns(
        {
            "text": F.when(i % 31 == 0, F.lit("  ")).otherwise(F.col("text")),
            "start_ms": F.when(i % 37 == 0, F.col("start_ms") - 2000).otherwise(F.col("start_ms")),
            "end_ms": F.when(i % 41 == 0, F.col("start_ms") - 5).otherwise(F.col("end_ms")),
            "duration_ms": F.floor(F.col("duration_ms") / 3),
        }
    )


query(
    "dq_caption_rows",
    f"""WITH {SQUEEZED}, b AS (SELECT video_id, caption_id, CASE WHEN caption_id % 31 = 0 THEN '  ' ELSE text END AS text, CASE WHEN caption_id % 37 = 0 THEN s.start_ms - 2000 ELSE s.start_ms END AS st,
  CASE WHEN caption_id % 41 = 0 THEN s.start_ms - 5 ELSE s.end_ms END AS en, s.ws, duration_ms // 3 AS dur FROM sq s JOIN (SELECT video_id, caption_id, text FROM caps) USING (video_id, caption_id) JOIN durations USING (video_id))
{s_rules('b', ['video_id', 'caption_id'], {'empty text': "trim(text) = ''", 'start below zero': 'st < 0', 'end not after start': 'en <= st', 'word starts before caption': 'len(list_filter(ws, lambda w: w.s < st - 1)) > 0',
 'word ends after caption': 'len(list_filter(ws, lambda w: w.e > en + 1)) > 0', 'word end not after start': 'len(list_filter(ws, lambda w: w.e <= w.s)) > 0', 'past the video': 'en > dur + 50', 'too short': 'en - st < 120'})}""",
)(lambda spark, sf: Q.caption_rows(broken_caps(spark, sf)))


def overlapping_zooms(spark, sf):
    z = zoom_plan(spark, sf).filter("action = 'apply'").join(durations(spark, sf), "video_id")
    i = F.col("sentence_id")
    return z.withColumns(
        {
            "zoom_no": i,
            "span_end_ms": F.when(i % 3 == 0, F.col("span_end_ms") + 9000).otherwise(F.col("span_end_ms")),
            "target_scale": F.when(i % 7 == 0, F.lit(1.4)).otherwise(F.col("target_scale")),
            "duration_ms": F.floor(F.col("duration_ms") * 3 / 4),
        }
    )


query(
    "dq_interval_overlap",
    f"""WITH RECURSIVE {ZOOM}, b AS (SELECT video_id, sentence_id AS zoom_no, start_ms, end_ms, CASE WHEN sentence_id % 3 = 0 THEN span_end_ms + 9000 ELSE span_end_ms END AS se, CASE WHEN sentence_id % 7 = 0 THEN 1.4 ELSE target_scale END AS sc, duration_ms * 3 // 4 AS dur
  FROM zoomed JOIN durations USING (video_id) WHERE action = 'apply'),
n AS (SELECT *, max(se) OVER (PARTITION BY video_id ORDER BY zoom_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
{__import__('voxtable.catalog.caption_queries', fromlist=['sql_caps']).sql_caps()}, beats AS (SELECT video_id, caption_id AS beat_id, start_ms, start_ms + 2000 + caption_id % 9 * 1000 AS end_ms, duration_ms * 3 // 4 AS dur FROM caps JOIN durations USING (video_id)),
m AS (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY beat_id) AS p FROM beats)
SELECT 'zoom' AS entity, video_id, zoom_no AS idx, rule FROM ({s_rules('n', ['video_id', 'zoom_no'], {'past the video': 'end_ms > dur + 80', 'scale too large': 'sc > 1.35', 'overlaps previous': 'start_ms < COALESCE(reach, -1000) - 50'})})
UNION ALL SELECT 'card', video_id, beat_id, rule FROM ({s_rules('m', ['video_id', 'beat_id'], {'past the video': 'end_ms > dur + 120', 'overlaps previous': 'start_ms < COALESCE(p, -1000) - 20'})})""",
)(
    lambda spark, sf: Q.zoom_overlaps(overlapping_zooms(spark, sf), hot_videos(spark, sf))
    .select(F.lit("zoom").alias("entity"), "video_id", F.col("zoom_no").alias("idx"), "rule")
    .unionByName(
        Q.card_overlaps(raw_beats(spark, sf).withColumn("duration_ms", F.floor(F.col("duration_ms") * 3 / 4)), hot_videos(spark, sf)).select(
            F.lit("card").alias("entity"), "video_id", F.col("beat_id").alias("idx"), "rule"
        )
    )
)


def _sig(i, n):
    return (F.col("l_orderkey") * (i + 3) + F.col("l_linenumber")) % n


def numbers(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (_sig(1, 13) / 10).alias("sig_emphasis"), (_sig(2, 11) / 10).alias("sig_cta"), (_sig(3, 12) / 10).alias("intensity"),
        (_sig(4, 1300)).alias("delay_ms"), (_sig(5, 3200)).alias("hold_ms"), (_sig(6, 100) / 80).alias("w"), (1 + _sig(7, 50) / 100).alias("target_scale"),
        (_sig(8, 90) / 100).alias("gain"), (_sig(9, 11)).alias("max_queries"), (_sig(10, 16)).alias("max_results_per_query"),
        (_sig(11, 18)).alias("max_pages_to_open"), (_sig(12, 23)).alias("max_downloads"),
    )


_n = lambda i, m: f"((l_orderkey * {i + 3} + l_linenumber) % {m})"
NUMBERS = f"""nums AS (SELECT l_orderkey, l_linenumber, {_n(1, 13)} / 10 AS sig_emphasis, {_n(2, 11)} / 10 AS sig_cta, {_n(3, 12)} / 10 AS intensity, {_n(4, 1300)} AS delay_ms, {_n(5, 3200)} AS hold_ms,
  {_n(6, 100)} / 80 AS w, 1 + {_n(7, 50)} / 100 AS target_scale, {_n(8, 90)} / 100 AS gain, {_n(9, 11)} AS max_queries, {_n(10, 16)} AS max_results_per_query, {_n(11, 18)} AS max_pages_to_open, {_n(12, 23)} AS max_downloads FROM lineitem)"""
_ids = ["l_orderkey", "l_linenumber"]


def _s_range(entity):
    have = ["sig_emphasis", "sig_cta", "intensity", "delay_ms", "hold_ms", "w", "target_scale", "gain", "max_queries", "max_results_per_query", "max_pages_to_open", "max_downloads"]
    return {c: f"({c} < {lo} OR {c} > {hi})" for c, (lo, hi) in Q.RANGES[entity].items() if c in have}


query(
    "dq_model_ranges",
    f"WITH {NUMBERS} " + " UNION ALL ".join(f"SELECT '{e}' AS entity, * FROM ({s_rules('nums', _ids, _s_range(e))})" for e in ("signals", "motion", "box", "decision", "cue")),
)(lambda spark, sf: Q.out_of_ranges(numbers(spark, sf), _ids, ["signals", "motion", "box", "decision", "cue"]))


query("dq_request", f"WITH {NUMBERS} {s_rules('nums', _ids, _s_range('request'))}")(lambda spark, sf: Q.out_of_range(numbers(spark, sf), _ids, "request"))


def scripts(spark, sf):
    """Caption lines of four words per segment; some segments lose lines, gain words or have none."""
    s = segments(spark, sf).withColumn("toks", X.tokens(F.col("txt")))
    n = F.size("toks")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda k: F.array_join(F.slice("toks", k * 4 + 1, 4), " "))
    i = F.col("video_id") * 3 + F.col("segment_id")
    made = (
        F.when(i % 7 == 0, F.array().cast("array<string>"))
        .when(i % 5 == 0, F.slice(cut, 1, 2))
        .when(i % 4 == 0, F.concat(cut, F.array(F.lit("completely invented marvellous thing and more"))))
        .otherwise(cut)
    )
    return s.select(
        "video_id", "segment_id", F.col("txt").alias("text"), F.lit("").alias("heard"), (n * 350).alias("seconds_ms"), n.alias("n_words"), made.alias("lines")
    )


_stems = lambda e: f"list_distinct(list_transform({sql_content(e)}, lambda t: {sql_stem('t')}))"
query(
    "dq_script",
    f"""WITH {SEGMENTS}, s AS (SELECT video_id, segment_id, txt, {sql_tokens('txt')} AS toks FROM segments),
c AS (SELECT *, list_transform(range((len(toks) - 1) // 4 + 1), lambda k: array_to_string(toks[k * 4 + 1:k * 4 + 4], ' ')) AS cut, (video_id * 3 + segment_id) AS i FROM s),
m AS (SELECT *, len(toks) AS n, CASE WHEN i % 7 = 0 THEN [] WHEN i % 5 = 0 THEN cut[1:2] WHEN i % 4 = 0 THEN list_append(cut, 'completely invented marvellous thing and more') ELSE cut END AS ls FROM c),
f AS (SELECT *, array_to_string(ls, ' ') AS shown_text, greatest(1, round_even(n * 350 / 1450, 0)::INT) AS wanted FROM m),
g AS (SELECT *, {_stems('shown_text')} AS shown, {_stems('txt')} AS source FROM f),
h AS (SELECT *, list_filter(source, lambda x: NOT list_contains(shown, x)) AS dropped, list_filter(shown, lambda x: NOT list_contains(source, x)) AS invented FROM g)
{s_rules('h', ['video_id', 'segment_id'], {'no lines': 'len(ls) = 0', 'too few lines': 'len(ls) > 0 AND n >= 4 AND len(ls) < greatest(1, wanted * 7 // 10)', 'drops spoken words': 'len(ls) > 0 AND len(dropped) > greatest(2, len(source) * 3 // 10)',
 'adds words': 'len(ls) > 0 AND (len(invented) > greatest(1, len(shown) // 5) OR len(list_filter(invented, lambda x: length(x) >= 7)) > 0)', 'long line': "len(list_filter(ls, lambda x: len(list_filter(string_split(x, ' '), lambda t: t <> '')) > 5)) > 0"})}""",
)(lambda spark, sf: Q.script_rows(scripts(spark, sf)))


def noted_lines(spark, sf):
    i = F.col("video_id") * 5 + F.col("line_id") * 3
    gone = F.col("line_id") % (F.col("video_id") % 9 + 3) == 0
    return lines(spark, sf).withColumns(
        {
            "key": F.when(i % 3 == 0, F.lit("nowhere")).otherwise(F.get(X.tokens(F.col("text")), F.lit(0))),
            "weight": F.when(gone, F.lit(None)).otherwise(F.col("weight")),
            "mood": F.when(gone | (F.col("video_id") % 4 == 0), F.lit("neutral")).otherwise(F.col("mood")),
            "icon": F.when(gone, F.lit(None)).otherwise(F.col("icon")),
            "cta": F.col("cta") & ~gone,
        }
    )


query(
    "dq_annotations",
    f"""WITH {LINES}, x AS (SELECT *, line_id % (video_id % 9 + 3) = 0 AS gone, CASE WHEN ({_li}) % 3 = 0 THEN 'nowhere' ELSE {sql_tokens('text')}[1] END AS key FROM lines),
p AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE gone) AS missing, count(*) FILTER (WHERE NOT gone AND key <> '' AND NOT contains({sql_norm('text')}, {sql_norm('key')})) AS keys, count(*) FILTER (WHERE NOT gone AND weight >= 3) AS heavy,
 count(*) FILTER (WHERE NOT gone AND video_id % 4 <> 0 AND mood IN ('surprise', 'excited')) AS popped, count(*) FILTER (WHERE NOT gone AND icon <> 'none') AS iconed, count(*) FILTER (WHERE NOT gone AND cta) AS asks FROM x GROUP BY video_id)
{s_rules('p', ['video_id'], {'missing': 'missing > n // 10', 'key not in line': 'keys > 0', 'too many heavy': 'heavy > greatest(2, n // 6)', 'too many moods': 'popped > greatest(4, n // 5)', 'no mood': 'n >= 15 AND popped = 0',
 'too many icons': 'iconed > greatest(6, n // 4)', 'no icon': 'n >= 15 AND iconed = 0', 'too many asks': 'asks > greatest(2, n // 15)'})}""",
)(lambda spark, sf: Q.annotation_rows(noted_lines(spark, sf)))
_mimes = ["image/png", "video/mp4", "text/html", "empty", "image/svg+xml", "application/octet-stream"]


def probes(spark, sf):
    i = F.col("page_id")
    return table(spark, sf, "pages").select(
        i.alias("file_id"), (i % 11 != 0).alias("present"), (F.length("html") % 900).cast("bigint").alias("bytes"), pick(i, _mimes).alias("mime"),
        (i % 160).alias("width"), (i * 13 % 400).alias("duration_ms"), (i * 7 % 90 + 100).alias("height"), (i % 5 * 90.0 - 90).alias("rotation"), (i % 6 != 0).alias("has_audio"),
    )


PROBES = f"probes AS (SELECT page_id AS file_id, page_id % 11 <> 0 AS present, length(html) % 900 AS bytes, {sql_pick('page_id', _mimes)} AS mime, page_id % 160 AS width, page_id * 13 % 400 AS duration_ms, page_id * 7 % 90 + 100 AS height, page_id % 5 * 90.0 - 90 AS rotation, page_id % 6 <> 0 AS has_audio FROM pages)"
query(
    "dq_files",
    f"""WITH {PROBES}, r AS (SELECT file_id, CASE WHEN NOT present THEN 'file missing' WHEN bytes < 512 THEN 'file too small' WHEN mime = 'text/html' THEN 'downloaded HTML, not media' WHEN mime = 'empty' THEN 'empty file'
 WHEN mime = 'image/png' AND width BETWEEN 1 AND 79 THEN 'image too small' WHEN mime = 'video/mp4' AND duration_ms BETWEEN 1 AND 199 THEN 'video duration too short' END AS rule FROM probes) SELECT * FROM r WHERE rule IS NOT NULL""",
)(lambda spark, sf: Q.file_rows(probes(spark, sf)).select("file_id", "rule"))
query(
    "dq_source_media",
    f"""WITH {PROBES}, t AS (SELECT *, (abs(rotation)::INT % 360) IN (90, 270) AS sw FROM probes)
SELECT file_id, CASE WHEN sw THEN height - height % 2 ELSE width - width % 2 END AS show_width, CASE WHEN sw THEN width - width % 2 ELSE height - height % 2 END AS show_height,
 CASE WHEN duration_ms <= 0 THEN 'no duration' WHEN duration_ms > 300 THEN 'too long' WHEN NOT has_audio THEN 'no audio' ELSE 'ok' END AS rule FROM t""",
)(lambda spark, sf: Q.source_media(probes(spark, sf), 300).select("file_id", "show_width", "show_height", "rule"))

# --- joins with model answers -------------------------------------------------------------------

def seg_words(spark, sf):
    w = F.struct("word_id", F.col("word").alias("text"), "start_ms", "end_ms", F.lit(1.0).alias("probability"))
    packed = words(spark, sf).groupBy("video_id", "segment_id").agg(
        F.transform(
            F.array_sort(F.collect_list(w)),
            lambda x: F.struct(x["text"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["probability"].alias("probability")),
        ).alias("words")
    )
    return packed.join(segments(spark, sf).select("video_id", "segment_id", F.col("txt").alias("text")), ["video_id", "segment_id"])


def repairs(spark, sf):
    i = F.col("video_id") + F.col("segment_id")
    full = F.concat(F.lit("Repaired: "), F.col("txt"))
    same = F.array_join(F.reverse(X.tokens(F.col("txt"))), " ")
    return segments(spark, sf).filter(i % 3 != 0).select(
        "video_id", "segment_id", F.lit(0).alias("ord"), F.when(i % 3 == 1, full).otherwise(same).alias("text")
    )


query("join_repairs")(
    lambda spark, sf: J.apply_repairs(seg_words(spark, sf), repairs(spark, sf))
    .select("video_id", "segment_id", F.posexplode("words").alias("i", "w"))
    .select("video_id", "segment_id", "i", F.col("w.text").alias("word"), "w.start_ms", "w.end_ms", "w.probability")
)


def notes(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "labels").select(
        (i % 100).alias("video_id"), F.floor(i / 100).alias("line_id"), i.alias("ord"), F.lit(" key ").alias("key"), (F.col("quality") * 5 - 1).alias("weight"),
        pick(i, ["Payoff", "term", "bogus"]).alias("kind"), pick(i, ["surprise", "ANGRY", " happy "]).alias("mood"), pick(i, ["money", "bogus", "star"]).alias("icon"), (F.col("toxic") == 1).alias("cta"),
    )


query(
    "join_line_notes",
    f"""WITH {LINES}, n AS (SELECT doc_id % 100 AS video_id, doc_id // 100 AS line_id, quality * 5 - 1 AS w, lower(trim({sql_pick('doc_id', ['Payoff', 'term', 'bogus'])})) AS k, lower(trim({sql_pick('doc_id', ['surprise', 'ANGRY', ' happy '])})) AS m,
  {sql_pick('doc_id', ['money', 'bogus', 'star'])} AS ic, toxic = 1 AS c FROM labels)
SELECT l.video_id, l.line_id, CASE WHEN w IS NULL THEN '' ELSE 'key' END AS key, greatest(0, least(3, COALESCE(w, 1))) AS weight, CASE WHEN k IN ('payoff', 'term') THEN k ELSE 'normal' END AS kind, CASE WHEN m IN ('surprise', 'happy') THEN m ELSE 'neutral' END AS mood,
 CASE WHEN ic IN ('money', 'star') THEN ic ELSE 'none' END AS icon, COALESCE(c, false) AS cta FROM lines l LEFT JOIN n USING (video_id, line_id)""",
)(
    lambda spark, sf: J.line_notes(lines(spark, sf).select("video_id", "line_id"), notes(spark, sf)).select(
        "video_id", "line_id", "key", "weight", "kind", "mood", "icon", "cta"
    )
)


def edits(spark, sf):
    i = F.col("video_id") * 5 + F.col("line_id") * 3
    toks = X.tokens(F.col("text"))
    new = (
        F.when(i % 5 == 0, F.concat(F.col("text"), F.lit(" polished")))
        .when(i % 5 == 1, F.concat_ws(" ", F.slice(toks, 2, 9)))
        .when(i % 5 == 2, F.concat(F.col("text"), F.lit(" with three new words")))
        .when(i % 5 == 3, F.col("text"))
    )
    return lines(spark, sf).select("video_id", (F.col("line_id") + F.when(i % 10 == 1, 1).otherwise(0)).alias("line_id"), F.col("line_id").alias("ord"), new.alias("edit")).filter("edit IS NOT NULL")


_ct = lambda e: sql_content(e)
query(
    "join_review_edits",
    f"""WITH {LINES}, e0 AS (SELECT video_id, line_id + CASE WHEN ({_li}) % 10 = 1 THEN 1 ELSE 0 END AS line_id, line_id AS ord, trim(CASE ({_li}) % 5 WHEN 0 THEN text || ' polished' WHEN 1 THEN array_to_string({sql_tokens('text')}[2:10], ' ') WHEN 2 THEN text || ' with three new words' WHEN 3 THEN text END) AS e FROM lines),
e1 AS (SELECT * FROM e0 WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, line_id ORDER BY ord) = 1),
n AS (SELECT video_id, line_id, text, COALESCE(lag(text) OVER v, '') AS b, COALESCE(lead(text) OVER v, '') AS a FROM lines WINDOW v AS (PARTITION BY video_id ORDER BY line_id)),
j AS (SELECT n.*, e, list_filter({_ct('e')}, lambda x: NOT list_contains({_ct('text')}, x)) AS fresh, {_ct('b')} AS cb, {_ct('a')} AS ca FROM n LEFT JOIN e1 USING (video_id, line_id)),
d AS (SELECT *, COALESCE(e <> '' AND e <> text AND len({sql_tokens('e')}) <= 5 AND len({sql_tokens('e')}) <= len({sql_tokens('text')}) + 2 AND NOT list_has_any(fresh, cb) AND NOT list_has_any(fresh, ca), false) AS edited FROM j)
SELECT video_id, line_id, CASE WHEN edited THEN e ELSE text END AS text, edited FROM d""",
)(lambda spark, sf: J.review_edits(lines(spark, sf).select("video_id", "line_id", "text"), edits(spark, sf), hot_videos(spark, sf)))


def brief_parts(spark, sf):
    i = F.col("video_id") + F.col("segment_id")
    return segments(spark, sf).withColumn("window_no", F.explode(F.array(F.lit(0), F.lit(1)))).filter(i % 3 != 0).select(
        "video_id", "segment_id", "window_no", F.when((i % 5 == 0) & (F.col("window_no") == 1), F.lit(" ")).otherwise(F.concat(F.lit("w"), F.col("window_no").cast("string"), F.lit(" "), F.col("speaker"))).alias("text")
    )


query(
    "join_brief_windows",
    f"""WITH {SEGMENTS}, {sql_stabilize_cte('segments', 'stable', 'txt', 'video_id, segment_id')},
g AS (SELECT video_id, speaker, min(segment_id) AS o FROM segments GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY o) AS place FROM g)
SELECT s.video_id, s.segment_id, CASE WHEN (s.video_id + s.segment_id) % 3 <> 0 AND (s.video_id + s.segment_id) % 5 <> 0 THEN 'w1 ' || speaker ELSE st END AS text, k.place FROM segments s JOIN stable USING (video_id, segment_id) LEFT JOIN k USING (video_id, speaker)""",
)(
    lambda spark, sf: J.brief_segments(segments(spark, sf).select("video_id", "segment_id", "speaker", F.col("txt").alias("text")), brief_parts(spark, sf)).join(
        J.distinct_in_order(segments(spark, sf), ["video_id"], ["speaker"], "segment_id", 8).drop("segment_id"), ["video_id", "speaker"], "left"
    ).select("video_id", "segment_id", "text", "place")
)


def brief_windows(spark, sf):
    """A window result per segment: its words are the terms, its speaker the idea."""
    toks = F.filter(F.split("txt", " "), lambda t: F.length(t) > 6)
    return segments(spark, sf).select(
        "video_id", F.col("segment_id").alias("window_no"), F.concat(F.lit("topic "), "speaker").alias("topic"), F.when(F.col("segment_id") > 0, F.col("txt")).alias("hook"),
        pick(F.col("video_id"), J.BRIEF_MOODS + ["loud"]).alias("music_mood"), F.transform(toks, lambda t: F.struct(F.lower(t).alias("heard"), t.alias("correct"))).alias("glossary"),
        F.array(F.lit(" "), F.col("speaker"), F.substring("txt", 1, 9)).alias("key_ideas"),
    )


query(
    "join_brief_heads",
    f"""WITH {SEGMENTS}, g AS (SELECT video_id, segment_id, pos, u FROM (SELECT video_id, segment_id, list_filter(string_split(txt, ' '), lambda t: length(t) > 6) AS t FROM segments), LATERAL (SELECT unnest(t) AS u, unnest(range(len(t))) AS pos)),
gd AS (SELECT video_id, u, row_number() OVER (PARTITION BY video_id ORDER BY o) AS p FROM (SELECT video_id, u, min(segment_id * 100000 + pos) AS o FROM g GROUP BY ALL)),
k AS (SELECT video_id, segment_id, unnest([speaker, substring(txt, 1, 9)]) AS u, unnest([1, 2]) AS pos FROM segments),
kd AS (SELECT video_id, u, row_number() OVER (PARTITION BY video_id ORDER BY o) AS p FROM (SELECT video_id, u, min(segment_id * 10 + pos) AS o FROM k WHERE trim(u) <> '' GROUP BY ALL)),
h AS (SELECT video_id, 'topic ' || arg_min(speaker, segment_id) AS topic, CASE WHEN min(segment_id) > 0 THEN arg_min(txt, segment_id) ELSE '' END AS hook FROM segments GROUP BY 1)
SELECT video_id, topic, hook, (CASE WHEN {sql_pick('video_id', J.BRIEF_MOODS + ['loud'])} = 'loud' THEN 'warm_inspiring' ELSE {sql_pick('video_id', J.BRIEF_MOODS + ['loud'])} END) AS music_mood,
  (SELECT string_agg(u, ',' ORDER BY p) FROM gd WHERE gd.video_id = h.video_id AND p <= 30) AS glossary, (SELECT string_agg(u, ',' ORDER BY p) FROM kd WHERE kd.video_id = h.video_id AND p <= 8) AS key_ideas FROM h""",
)(
    lambda spark, sf: J.brief_heads(brief_windows(spark, sf)).select(
        "video_id", "topic", "hook", "music_mood", F.array_join(F.transform("glossary", lambda g: g["correct"]), ",").alias("glossary"), F.array_join("key_ideas", ",").alias("key_ideas")
    )
)


def script_lines(spark, sf):
    i = F.col("line_id")
    return lines(spark, sf).select("video_id", "line_id", F.floor(i / 6).alias("segment_id"), F.floor(i / 6 + i % 6 / 3).alias("first"), F.floor(i / 6 + i % 6 / 3).alias("last"), "text")


query(
    "align_lines_fold",
    f"""WITH {LINES}, b AS (SELECT video_id, line_id, line_id // 6 AS seg, floor(line_id / 6 + line_id % 6 / 3)::BIGINT AS first, text FROM lines),
n AS (SELECT *, CASE WHEN lag(first) OVER v = first AND lag(seg) OVER v = seg THEN 0 ELSE 1 END AS fresh FROM b WINDOW v AS (PARTITION BY video_id ORDER BY line_id)),
d AS (SELECT *, (sum(fresh) OVER (PARTITION BY video_id ORDER BY line_id))::BIGINT - 1 AS draft_id FROM n)
SELECT video_id, draft_id, min(first) AS first, arg_max(first, line_id) AS last, string_agg(text, ' ' ORDER BY line_id) AS text FROM d GROUP BY ALL""",
)(lambda spark, sf: J.fold_shared_lines(script_lines(spark, sf), hot_videos(spark, sf)))

# --- summaries ------------------------------------------------------------------------------------
query(
    "agg_video_metrics",
    f"""WITH {LINES}, {__import__('voxtable.catalog.caption_queries', fromlist=['sql_caps']).sql_caps()}
SELECT w.video_id, n_words, n_segments, n_captions, n_moody, n_iconed, n_cta FROM (SELECT video_id, count(*) AS n_words, count(DISTINCT segment_id) AS n_segments FROM words GROUP BY ALL) w
JOIN (SELECT video_id, count(*) AS n_captions FROM caps GROUP BY ALL) USING (video_id)
JOIN (SELECT video_id, count(*) FILTER (WHERE mood <> 'neutral') AS n_moody, count(*) FILTER (WHERE icon <> 'none') AS n_iconed, count(*) FILTER (WHERE cta) AS n_cta FROM lines GROUP BY ALL) USING (video_id)""",
)(
    lambda spark, sf: words(spark, sf).groupBy("video_id").agg(F.count("*").alias("n_words"), F.countDistinct("segment_id").alias("n_segments"))
    .join(caps(spark, sf).groupBy("video_id").agg(F.count("*").alias("n_captions")), "video_id")
    .join(
        lines(spark, sf).groupBy("video_id").agg(
            F.count_if(F.col("mood") != "neutral").alias("n_moody"), F.count_if(F.col("icon") != "none").alias("n_iconed"), F.count_if("cta").alias("n_cta")
        ),
        "video_id",
    )
)
query(
    "agg_phase_timing",
    """WITH m AS (SELECT event_type AS phase, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ms FROM events)
SELECT phase, count(*) AS jobs, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95 FROM m GROUP BY phase""",
)(lambda spark, sf: phase_timing(spark, sf))


def phase_timing(spark, sf):
    """Jobs carry a map of phase timings; one row per phase with exact percentiles of whole milliseconds."""
    jobs = table(spark, sf, "events").select(
        F.create_map(F.col("event_type"), F.get_json_object("props", "$.k").cast("double")).alias("metrics")
    )
    counted = jobs.select(F.explode("metrics").alias("phase", "ms")).groupBy("phase", "ms").agg(F.count("*").alias("c"))
    return counted.groupBy("phase").agg(
        F.sum("c").alias("jobs"), F.percentile("ms", F.lit(0.5), F.col("c")).alias("p50"), F.percentile("ms", F.lit(0.95), F.col("c")).alias("p95")
    )
