"""Gates, intervals, acoustics and plans over captions cut from the conversation words."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable import rules
from voxtable.catalog.base import WORDS, lit, pick, placed_turns, sql_list, sql_matches, sql_pick, table, words
from voxtable.catalog.registry import query
from voxtable.catalog.speech_queries import LABELS, MOTION, SCORES, hot_videos, labelled, scored
from voxtable.catalog.text_queries import sql_content_word, sql_fix_asr, sql_norm, sql_terms, sql_tokens
from voxtable.functions import text as X
from voxtable.operators import acoustics as A
from voxtable.operators import gates as G
from voxtable.operators import intervals as I
from voxtable.plans import cards as K
from voxtable.plans import cues as C
from voxtable.plans.zoom import plan_zoom
from voxtable.session import cut_lineage, once

TREATS = ["plain", "mix", "oval", "serif", "blob", "plain", "underline", "quote", "tape", "stack", "bubble"]
MOODS = ["neutral", "surprise", "neutral", "excited", "happy", "neutral", "urgent"]
ICONS = ["none", "money", "none", "star", "bogus", "none", "fire", "none"]
STYLES = ["plain", "plain", "plain", "mix", "plain", "plain", "plain", "plain", "serif", "chip", "plain", "mix"]


def durations(spark, sf):
    """The end of the last word and 1.5 s; within a turn the last word ends last, so turns tell it without their words."""
    said = placed_turns(spark, sf).filter(F.size("toks") > 0).withColumn("_last", F.col("base") + F.size("toks") - 1)
    end = 350 * F.col("_last") + 600 * F.col("segment_id") + 500 * F.floor(F.col("_last") / 23) + 300
    return said.groupBy("video_id").agg((F.max(end) + 1500).alias("duration_ms"))


DUR = "durations AS (SELECT video_id, max(end_ms) + 1500 AS duration_ms FROM words GROUP BY ALL)"


def caps(spark, sf, size=3):
    w = words(spark, sf).withColumn("caption_id", F.floor(F.col("word_id") / size))
    item = F.struct(
        "word_id", F.col("word").alias("text"), "start_ms", "end_ms", (F.col("word_id") % 5 == 0).alias("emphasis")
    )
    i = F.col("video_id") * 3 + F.col("caption_id") * 7
    return (
        w.groupBy("video_id", "caption_id")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.transform(
                F.sort_array(F.collect_list(item)),
                lambda x: F.struct(x["text"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["emphasis"].alias("emphasis")),
            ).alias("words"),
        )
        .withColumns(
            {
                "text": F.array_join(F.transform("words", lambda x: x["text"]), " "),
                "treatment": pick(i, TREATS),
                "mood": pick(i, MOODS),
            }
        )
    )


def sql_caps(size=3, name="caps"):
    return f"""{name} AS (SELECT *, {sql_pick('video_id * 3 + caption_id * 7', TREATS)} AS treatment, {sql_pick('video_id * 3 + caption_id * 7', MOODS)} AS mood FROM (
  SELECT video_id, word_id // {size} AS caption_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY word_id) AS text,
    bool_or(word_id % 5 = 0) AS hot, list({{'text': word, 's': start_ms, 'e': end_ms, 'm': word_id % 5 = 0}} ORDER BY word_id) AS ws FROM words GROUP BY ALL))"""


CAPS = f"{WORDS}, {sql_caps()}, {DUR}"


def sql_greedy(name, src, gap, ident, order=None, time="start_ms", budget=None):
    """Recursive twin of the signed gap gate: (video_id, id) of the accepted rows in `name`."""
    take = f"n.{time} - g.last >= {gap}" + (f" AND g.picked < n.{budget}" if budget else "")
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {order or time + ', ' + ident}) AS k FROM {src}),
{name}_g AS (SELECT video_id, k, {ident} AS id, {time} AS last, 1 AS picked, true AS ok FROM {name}_n WHERE k = 1
  UNION ALL SELECT n.video_id, n.k, n.{ident}, CASE WHEN {take} THEN n.{time} ELSE g.last END, g.picked + CASE WHEN {take} THEN 1 ELSE 0 END, {take}
  FROM {name}_g g JOIN {name}_n n ON n.video_id = g.video_id AND n.k = g.k + 1),
{name} AS (SELECT video_id, id FROM {name}_g WHERE ok)"""


def flat_words(caps_df, keep=("video_id", "caption_id", "start_ms", "end_ms")):
    return once(caps_df).select(*keep, F.posexplode("words").alias("i", "w")).select(
        *keep, "i", F.col("w.text").alias("word"), F.col("w.start_ms").alias("word_start"), F.col("w.end_ms").alias("word_end")
    )


query(
    "gate_pace_treatment",
    f"""WITH RECURSIVE {CAPS}, sp AS (SELECT * FROM caps WHERE treatment IN ('oval', 'blob', 'underline')), {sql_greedy('kept', 'sp', 10000, 'caption_id')}
SELECT video_id, caption_id, CASE WHEN treatment IN ('oval', 'blob', 'underline') AND id IS NULL THEN 'serif' WHEN treatment = 'plain' AND hot THEN 'mix' ELSE treatment END AS treatment
FROM caps LEFT JOIN kept USING (video_id) WHERE false UNION ALL
SELECT c.video_id, c.caption_id, CASE WHEN treatment IN ('oval', 'blob', 'underline') AND k.id IS NULL THEN 'serif' WHEN treatment = 'plain' AND hot THEN 'mix' ELSE treatment END
FROM caps c LEFT JOIN kept k ON k.video_id = c.video_id AND k.id = c.caption_id""",
)(lambda spark, sf: G.pace_treatments(caps(spark, sf), hot_videos(spark, sf)).select("video_id", "caption_id", "treatment"))
_stem = """lower(trim(w.text, '.,!?;:"''“”'))"""
query(
    "gate_decorate",
    f"""WITH RECURSIVE {CAPS},
d AS (SELECT *, len(list_filter(ws, lambda w: (w.m OR list_contains({sql_list(G.EMPHASIS_WORDS)}, {_stem})) AND NOT list_contains({sql_list(G.CAPTION_FILLER)}, {_stem}))) AS hots,
  len(list_filter({sql_list(G.OVAL_TERMS)}, lambda t: contains(lower(text), t))) > 0 AS term FROM caps),
tm AS (SELECT * FROM d WHERE term), {sql_greedy('kept', 'tm', 10000, 'caption_id')}
SELECT d.video_id, d.caption_id, hots, CASE WHEN k.id IS NOT NULL THEN 'oval' WHEN term THEN CASE WHEN treatment IN ('plain', 'mix') THEN 'serif' ELSE treatment END
  WHEN treatment IN ('mix', 'serif') AND hots = 0 THEN 'plain' WHEN treatment = 'plain' AND hots > 0 THEN 'mix' ELSE treatment END AS treatment
FROM d LEFT JOIN kept k ON k.video_id = d.video_id AND k.id = d.caption_id""",
)(
    lambda spark, sf: G.decorate(caps(spark, sf), hot_videos(spark, sf)).select(
        "video_id", "caption_id", F.size(F.filter("words", lambda w: w["emphasis"])).cast("bigint").alias("hots"), "treatment"
    )
)

# --- loudness: events read as a level track of the video with the user's number ----------------

def loudness(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("user_id") % 100).alias("video_id"),
        (F.col("event_id") * 997 % 180_000).alias("t_ms"),
        F.col("event_id").alias("ord"),
        F.round(F.col("value") * 1000).cast("bigint").alias("mdb"),
    )


LOUD = "loudness AS (SELECT user_id % 100 AS video_id, event_id * 997 % 180000 AS t_ms, event_id AS ord, round(value * 1000)::BIGINT AS mdb FROM events)"


def s_span_means(values, name, track, closed=False):
    upper = "t.t_ms <= c.end_ms" if closed else "t.t_ms < greatest(c.end_ms, c.start_ms + 1)"
    mean = lambda v: f"(2 * sum(t.{v}) + count(*)) // (2 * count(*)) AS {v}"
    return f"""{name}_in AS (SELECT c.video_id, c.caption_id, {', '.join(mean(v) for v in values)} FROM caps c JOIN {track} t ON t.video_id = c.video_id AND t.t_ms >= c.start_ms AND {upper} GROUP BY ALL),
{name}_out AS (SELECT c.video_id, c.caption_id, c.start_ms FROM caps c ANTI JOIN {name}_in i USING (video_id, caption_id)),
{name}_near AS (SELECT o.video_id, o.caption_id, {', '.join(f"arg_min(t.{v}, {{'d': abs(t.t_ms - o.start_ms), 't': t.t_ms, 'o': t.ord}}) AS {v}" for v in values)} FROM {name}_out o JOIN {track} t USING (video_id) GROUP BY ALL),
{name} AS (SELECT video_id, caption_id, {', '.join(values)} FROM {name}_in UNION ALL SELECT video_id, caption_id, {', '.join(values)} FROM {name}_near
  UNION ALL SELECT video_id, caption_id, {', '.join('NULL' for v in values)} FROM {name}_out WHERE video_id NOT IN (SELECT video_id FROM {track}))"""


LEVELS = f"{CAPS}, {LOUD}, {s_span_means(['mdb'], 'levels', 'loudness')}"


def levels(spark, sf):
    return A.span_means(caps(spark, sf), loudness(spark, sf), "caption_id", ["mdb"])


def loud_lines(spark, sf):
    return levels(spark, sf).filter("mdb IS NOT NULL").join(
        caps(spark, sf).select("video_id", "caption_id", "start_ms"), ["video_id", "caption_id"]
    )


query("join_span_loudness", f"WITH {LEVELS} SELECT video_id, caption_id, mdb FROM levels")(levels)
THRESHOLD = f"""{LEVELS}, th AS (SELECT video_id, count(*) AS n, quantile_cont(mdb::DOUBLE, 0.5) + greatest(1200.0, 0.4 *
   CASE WHEN quantile_cont(mdb::DOUBLE, 0.75) = quantile_cont(mdb::DOUBLE, 0.25) THEN 1000.0 ELSE quantile_cont(mdb::DOUBLE, 0.75) - quantile_cont(mdb::DOUBLE, 0.25) END) AS threshold
   FROM levels WHERE mdb IS NOT NULL GROUP BY video_id)"""
query("agg_emphasis_threshold", f"WITH {THRESHOLD} SELECT video_id, n, round(threshold, 4) AS threshold FROM th")(
    lambda spark, sf: A.emphasis_threshold(levels(spark, sf).filter("mdb IS NOT NULL")).select("video_id", "n", F.round("threshold", 4).alias("threshold"))
)
LOUDEST = f"""{THRESHOLD}, el AS (SELECT l.video_id, l.caption_id, c.start_ms, mdb, greatest(1, round_even(n * 0.18, 0))::BIGINT AS budget FROM levels l JOIN th USING (video_id)
  JOIN caps c ON c.video_id = l.video_id AND c.caption_id = l.caption_id WHERE mdb >= threshold), {sql_greedy('loudest', 'el', 5000, 'caption_id', '-mdb, start_ms, caption_id', budget='budget')}"""
query("gate_vocal_emphasis", f"WITH RECURSIVE {LOUDEST} SELECT video_id, id AS caption_id FROM loudest")(
    lambda spark, sf: A.vocal_emphasis(loud_lines(spark, sf), "caption_id", hot_videos(spark, sf))
)
query(
    "join_loudness_lines",
    f"""WITH RECURSIVE {LOUDEST}, ln AS (SELECT video_id, line_no, line_no * 6 AS first, least(line_no * 6 + 5, m) AS last FROM (SELECT video_id, max(word_id) AS m, unnest(range(max(word_id) // 6 + 1)) AS line_no FROM words GROUP BY video_id))
SELECT l.video_id, l.line_no, a.start_ms, b.end_ms, bool_or(q.id IS NOT NULL) AS loud FROM ln l JOIN words a ON a.video_id = l.video_id AND a.word_id = l.first JOIN words b ON b.video_id = l.video_id AND b.word_id = l.last
LEFT JOIN loudest q ON q.video_id = l.video_id AND q.id // 2 = l.line_no GROUP BY ALL""",
)(lambda spark, sf: loudness_lines(spark, sf))


def loudness_lines(spark, sf):
    """Lines of six words by their first and last word id; loud when a loud caption lies in them."""
    w = words(spark, sf)
    ranges = w.groupBy("video_id", F.floor(F.col("word_id") / 6).alias("line_no")).agg(F.min("word_id").alias("first"), F.max("word_id").alias("last"))
    starts = w.select("video_id", F.col("word_id").alias("first"), "start_ms")
    ends = w.select("video_id", F.col("word_id").alias("last"), "end_ms")
    loud = A.vocal_emphasis(loud_lines(spark, sf), "caption_id", hot_videos(spark, sf)).select(
        "video_id", F.floor(F.col("caption_id") / 2).alias("line_no"), F.lit(True).alias("loud")
    ).distinct()
    return (
        ranges.join(starts, ["video_id", "first"]).join(ends, ["video_id", "last"]).join(loud, ["video_id", "line_no"], "left")
        .select("video_id", "line_no", "start_ms", "end_ms", F.coalesce("loud", F.lit(False)).alias("loud"))
    )


# --- colour: line items read as pixels of the frames of a video ---------------------------------

def pixels(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 100).alias("video_id"),
        (F.col("l_partkey") % 400).alias("frame"),
        (F.col("l_orderkey") % 256).alias("r"),
        (F.col("l_quantity").cast("bigint") * 5).alias("g"),
        (F.col("l_linenumber").cast("bigint") * 36).alias("b"),
    )


COLOR = """pixels AS (SELECT l_suppkey % 100 AS video_id, l_partkey % 400 AS frame, l_orderkey % 256 AS r, l_quantity::BIGINT * 5 AS g, l_linenumber::BIGINT * 36 AS b FROM lineitem),
track0 AS (SELECT video_id, frame, (200 * sum(r) + count(*)) // (2 * count(*)) AS r, (200 * sum(g) + count(*)) // (2 * count(*)) AS g, (200 * sum(b) + count(*)) // (2 * count(*)) AS b FROM pixels GROUP BY ALL),
track AS (SELECT video_id, frame, r, g, b, (2 * (299 * r + 587 * g + 114 * b) + 1000) // 2000 AS luma, frame * 500 AS t_ms, frame AS ord FROM track0)"""


def colors(spark, sf):
    return A.color_track(pixels(spark, sf)).withColumns({"t_ms": F.col("frame") * 500, "ord": F.col("frame")})


RGB = ["luma", "r", "g", "b"]
query("agg_color_track", f"WITH {COLOR} SELECT video_id, frame, r, g, b, luma FROM track")(lambda spark, sf: A.color_track(pixels(spark, sf)))
query(
    "agg_bright_vote",
    f"WITH {COLOR} SELECT video_id, round(avg(CASE WHEN luma > 15000 THEN 1 ELSE 0 END), 6) AS bright_share FROM track GROUP BY video_id",
)(
    lambda spark, sf: A.color_track(pixels(spark, sf)).groupBy("video_id").agg(F.round(F.avg(A.is_bright(F.col("luma")).cast("int")), 6).alias("bright_share"))
)
query(
    "join_span_color",
    f"WITH {CAPS}, {COLOR}, {s_span_means(RGB, 'col', 'track', True)} SELECT video_id, caption_id, luma, r, g, b, COALESCE(luma > 15000, false) AS bright FROM col",
)(
    lambda spark, sf: A.span_means(caps(spark, sf), colors(spark, sf), "caption_id", RGB, closed=True).withColumn("bright", A.is_bright(F.col("luma")))
)
def s_tint(sat, value):
    """SQL for a tint of the row's hue: sector of the colour wheel, then the three mixed channels."""
    sat = f"least(1.0, greatest(0.0, {sat}))"
    f, p = "(hue * 6 - floor(hue * 6))", f"{value} * (1 - {sat})"
    q, t = f"{value} * (1 - {sat} * {f})", f"{value} * (1 - {sat} * (1 - {f}))"
    rows = [(value, t, p), (q, value, p), (p, value, t), (p, q, value), (t, p, value), (value, p, q)]
    text = ["concat_ws(',', " + ", ".join(f"CAST(floor(({c}) * 255) AS BIGINT)" for c in row) + ")" for row in rows]
    return "CASE CAST(floor(hue * 6) AS BIGINT) % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(text)) + " END"


_d = lambda c: f"CAST({c} AS DOUBLE)"
query(
    "lab_palette",
    f"""WITH {COLOR}, c AS (SELECT video_id, frame, COALESCE(luma > 15000, false) AS bright, {_d('r // 100')} AS r, {_d('g // 100')} AS g, {_d('b // 100')} AS b FROM track),
h AS (SELECT *, greatest(r, g, b) / 255 AS hi, greatest(r, g, b) / 255 - least(r, g, b) / 255 AS span FROM c),
w AS (SELECT *, CASE WHEN span = 0 THEN 0.0 WHEN r / 255 = hi THEN (g - b) / 255 / span + CASE WHEN g < b THEN 6 ELSE 0 END WHEN g / 255 = hi THEN (b - r) / 255 / span + 2 ELSE (r - g) / 255 / span + 4 END / {_d('6')} AS hue0, CASE WHEN hi > 0 THEN span / hi ELSE 0.0 END AS sat0 FROM h),
x AS (SELECT video_id, frame, bright, CASE WHEN sat0 < 0.08 THEN {_d('0.6')} ELSE hue0 END AS hue, CASE WHEN sat0 < 0.08 THEN {_d('0')} ELSE sat0 END AS sat FROM w)
SELECT video_id, frame, CASE WHEN bright THEN {s_tint(f"({_d('0.55')} + {_d('0.35')} * sat)", _d('0.34'))} END AS outline,
  CASE WHEN bright THEN {s_tint(f"({_d('0.6')} + {_d('0.3')} * sat)", _d('0.2'))} ELSE {s_tint(_d('0.55'), _d('0.1'))} END AS shade,
  CASE WHEN NOT bright THEN {s_tint(f"({_d('0.38')} + {_d('0.25')} * sat)", _d('1'))} END AS glow FROM x""",
)(lambda spark, sf: palette(spark, sf))


def palette(spark, sf):
    c = A.color_track(pixels(spark, sf))
    rgb = c.withColumns({x: F.floor(F.col(x) / 100) for x in ("r", "g", "b")})
    return A.with_palette(rgb, A.is_bright(F.col("luma"))).select("video_id", "frame", "outline", "shade", "glow")


query(
    "agg_head_top",
    f"""WITH {COLOR}, t AS (SELECT video_id, (r // 10 + g // 10) AS top FROM track), s AS (SELECT video_id, list(top ORDER BY top) AS a FROM t GROUP BY ALL)
SELECT video_id, greatest(422, least(a[(len(a) - 1) * 2 // 10 + 1], 1113)) AS head_top FROM s""",
)(lambda spark, sf: head_top(spark, sf))


def head_top(spark, sf):
    """Head position per video: the value at index int(0.2 (n - 1)) of the frame tops, from a value histogram."""
    from pyspark.sql import Window

    tops = A.color_track(pixels(spark, sf)).select("video_id", (F.floor(F.col("r") / 10) + F.floor(F.col("g") / 10)).alias("top"))
    counts = tops.groupBy("video_id", "top").agg(F.count("*").alias("c"))
    by_top = Window.partitionBy("video_id").orderBy("top")
    upto = counts.withColumn("upto", F.sum("c").over(by_top.rowsBetween(Window.unboundedPreceding, 0)))
    totals = counts.groupBy("video_id").agg(F.floor((F.sum("c") - 1) * 2 / 10).alias("at"))
    found = upto.join(totals, "video_id").filter(F.col("upto") > F.col("at")).groupBy("video_id").agg(F.min("top").alias("top"))
    # clamp to 22 % and 58 % of a 1920 px frame
    return found.select("video_id", F.greatest(F.lit(422), F.least("top", F.lit(1113))).alias("head_top"))


# --- lines (drafts) -----------------------------------------------------------------------------
KINDS = ["normal", "concept", "payoff", "term", "drama", "quote", "normal"]


def lines(spark, sf):
    i = F.col("video_id") * 5 + F.col("line_id") * 3
    c = caps(spark, sf, 4).select("video_id", F.col("caption_id").alias("line_id"), "start_ms", F.col("end_ms").alias("spoken_end"), "text", "words")
    return c.withColumns(
        {
            "style": pick(i, STYLES),
            "mood": pick(i, MOODS),
            "icon": pick(i, ICONS),
            "kind": pick(i, KINDS),
            "weight": (i % 4).cast("int"),
            "loud": F.col("line_id") % 6 == 0,
            "stacked": F.col("line_id") == 0,
            "cta": i % 29 == 0,
            "emphasis": F.when(pick(i, STYLES) == "mix", F.get("words", F.lit(0))["text"]).otherwise(F.lit("")),
        }
    )


_li = "video_id * 5 + line_id * 3"
LINES = f"""{WORDS}, {sql_caps(4, 'caps4')}, {DUR}, lines AS (SELECT video_id, line_id, start_ms, spoken_end, text, {sql_pick(_li, STYLES)} AS style, {sql_pick(_li, MOODS)} AS mood, {sql_pick(_li, ICONS)} AS icon,
  {sql_pick(_li, KINDS)} AS kind, (({_li}) % 4)::INT AS weight, line_id % 6 = 0 AS loud, line_id = 0 AS stacked, ({_li}) % 29 = 0 AS cta,
  CASE WHEN {sql_pick(_li, STYLES)} = 'mix' THEN w0 ELSE '' END AS emphasis
  FROM (SELECT video_id, caption_id AS line_id, start_ms, end_ms AS spoken_end, text, ws[1].text AS w0 FROM caps4))"""
_content = f"len(list_filter({sql_tokens('text')}, lambda t: length({sql_norm('t')}) >= 3 AND NOT list_contains({sql_list(rules.FILLER + rules.GREETINGS)}, {sql_norm('t')}))) > 0"
query(
    "gate_hook_index",
    f"""WITH {LINES}, o AS (SELECT *, min(start_ms) OVER (PARTITION BY video_id) AS t0 FROM lines WHERE line_id < 3)
SELECT video_id, arg_min(line_id, {{'a': CASE WHEN style IN ('serif', 'stack', 'quote', 'oval', 'tape') THEN 0 WHEN {_content} THEN 1 ELSE 2 END, 'b': line_id}}) AS hook_line FROM o WHERE start_ms - t0 <= 2500 GROUP BY video_id""",
)(lambda spark, sf: G.hook_line(lines(spark, sf)))
query(
    "gate_pop",
    f"""WITH RECURSIVE {LINES}, w AS (SELECT * FROM lines WHERE (mood IN ('surprise', 'excited') OR (loud AND weight >= 1)) AND style <> 'plain' AND NOT stacked),
{sql_greedy('pop', 'w', 7000, 'line_id', '-weight, start_ms, line_id')}
SELECT l.video_id, line_id, CASE WHEN id IS NULL THEN 'neutral' WHEN mood IN ('surprise', 'excited') THEN mood ELSE 'excited' END AS shown_mood FROM lines l LEFT JOIN pop p ON p.video_id = l.video_id AND p.id = l.line_id""",
)(lambda spark, sf: G.mood_pops(lines(spark, sf), hot_videos(spark, sf)).select("video_id", "line_id", "shown_mood"))
query(
    "gate_icon",
    f"""WITH RECURSIVE {LINES}, w AS (SELECT * FROM lines WHERE icon NOT IN ('none', 'bogus') AND NOT stacked AND style <> 'chip'), w2 AS (SELECT * FROM w WHERE weight >= 2),
{sql_greedy('ic', 'w2', 13000, 'line_id', '-weight, start_ms, line_id')},
opening AS (SELECT l.video_id, l.line_id, l.start_ms, i.id IS NOT NULL AS got FROM (SELECT *, (SELECT min(start_ms) FROM lines x WHERE x.video_id = w.video_id) AS t0 FROM w) l LEFT JOIN ic i ON i.video_id = l.video_id AND i.id = l.line_id
  WHERE l.weight >= 1 AND l.start_ms - l.t0 < 30000),
fb AS (SELECT video_id, arg_min(line_id, {{'a': start_ms, 'b': line_id}}) AS id FROM opening GROUP BY video_id HAVING NOT bool_or(got)),
al AS (SELECT * FROM ic UNION ALL SELECT * FROM fb)
SELECT l.video_id, line_id, CASE WHEN id IS NULL THEN 'none' ELSE icon END AS shown_icon FROM lines l LEFT JOIN al p ON p.video_id = l.video_id AND p.id = l.line_id""",
)(lambda spark, sf: G.icon_badges(lines(spark, sf), hot_videos(spark, sf)).select("video_id", "line_id", "shown_icon"))
# run of plain lines as (lengths of up to three waiting lines); the fourth decides
query(
    "gate_plain_runs",
    f"""WITH RECURSIVE {LINES}, b AS (SELECT video_id, line_id, style = 'plain' AS plain, text, {sql_tokens('text')} AS ts FROM lines),
sized AS (SELECT video_id, line_id, plain, length({sql_norm(sql_content_word('ts'))}) AS n FROM b),
walk AS (SELECT video_id, line_id, CASE WHEN plain THEN [{{'i': line_id, 'n': n}}] ELSE [] END AS run, NULL::BIGINT AS lifted FROM sized WHERE line_id = 0
  UNION ALL SELECT s.video_id, s.line_id, CASE WHEN NOT s.plain THEN [] WHEN len(w.run) < 3 THEN list_append(w.run, {{'i': s.line_id, 'n': s.n}})
     ELSE (SELECT CASE WHEN m.n >= 4 THEN list_filter(r, lambda x: x.i > m.i) ELSE [] END FROM (SELECT list_append(w.run, {{'i': s.line_id, 'n': s.n}}) AS r) q, (SELECT list_sort(list_transform(list_append(w.run, {{'i': s.line_id, 'n': s.n}}), lambda x: {{'d': -x.n, 'i': x.i, 'n': x.n}}))[1] AS m) z) END,
     CASE WHEN s.plain AND len(w.run) = 3 THEN (SELECT CASE WHEN m.n >= 4 THEN m.i END FROM (SELECT list_sort(list_transform(list_append(w.run, {{'i': s.line_id, 'n': s.n}}), lambda x: {{'d': -x.n, 'i': x.i, 'n': x.n}}))[1] AS m) z) END
  FROM walk w JOIN sized s ON s.video_id = w.video_id AND s.line_id = w.line_id + 1)
SELECT video_id, lifted AS line_id FROM walk WHERE lifted IS NOT NULL""",
)(
    lambda spark, sf: G.lift_plain_runs(lines(spark, sf).withColumn("_was", F.col("style")), hot_videos(spark, sf))
    .filter((F.col("style") == "mix") & (F.col("_was") == "plain"))
    .select("video_id", "line_id")
)
query(
    "topk_weakest_mix",
    f"""WITH {LINES}, m AS (SELECT *, CASE WHEN line_id % 2 = 0 THEN 'mix' ELSE style END AS st, {sql_tokens('text')}[1] AS em FROM lines),
c AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE st = 'mix') AS k FROM m GROUP BY ALL),
r AS (SELECT video_id, line_id, row_number() OVER (PARTITION BY video_id ORDER BY weight, length({sql_norm('em')}), line_id) AS p FROM m WHERE st = 'mix')
SELECT r.video_id, r.line_id FROM r JOIN c USING (video_id) WHERE p <= k - (n * 45 // 100)""",
)(
    lambda spark, sf: G.weakest_mix(
        lines(spark, sf).withColumns(
            {
                "style": F.when(F.col("line_id") % 2 == 0, F.lit("mix")).otherwise(F.col("style")),
                "emphasis": F.get(X.tokens(F.col("text")), F.lit(0)),
            }
        ).withColumn("_was", F.col("style")),
        hot_videos(spark, sf),
    )
    .filter((F.col("style") == "plain") & (F.col("_was") == "mix"))
    .select("video_id", "line_id")
)
query(
    "gate_variety",
    f"""WITH RECURSIVE {CAPS}, s AS (SELECT video_id, caption_id, start_ms, treatment IN ('plain', 'mix', 'serif') AND len({sql_tokens('text')}) BETWEEN 1 AND 4 AS short FROM caps),
w AS (SELECT video_id, caption_id, -1000000 AS marker, -1000000 AS chest, 'default' AS font_variant, 'head' AS screen_area FROM s WHERE caption_id = 0
 UNION ALL SELECT s.video_id, s.caption_id, CASE WHEN s.short AND s.start_ms - w.marker >= 15000 THEN s.start_ms ELSE w.marker END,
  CASE WHEN NOT (s.short AND s.start_ms - w.marker >= 15000) AND s.start_ms - w.chest >= 9000 THEN s.start_ms ELSE w.chest END,
  CASE WHEN s.short AND s.start_ms - w.marker >= 15000 THEN 'marker' ELSE 'default' END,
  CASE WHEN NOT (s.short AND s.start_ms - w.marker >= 15000) AND s.start_ms - w.chest >= 9000 THEN 'chest' ELSE 'head' END
  FROM w JOIN s ON s.video_id = w.video_id AND s.caption_id = w.caption_id + 1)
SELECT video_id, caption_id, font_variant, screen_area FROM w""",
)(lambda spark, sf: G.variety(caps(spark, sf), True, hot_videos(spark, sf)))

# --- cues ---------------------------------------------------------------------------------------

def raw_cues(spark, sf):
    i = F.col("video_id") * 3 + F.col("caption_id") * 7
    return caps(spark, sf).join(durations(spark, sf), "video_id").select(
        "video_id", F.col("caption_id").alias("ord"), (F.col("start_ms") - F.col("caption_id") % 3 * 400).alias("at_ms"),
        pick(i, ["whoosh", "hit", "swoosh", "riser", "impact"]).alias("kind"), F.lit(0.2).alias("gain"), F.col("treatment").alias("reason"), "duration_ms",
    )


def s_gate_cues(src, name, gap, cap):
    """Recursive twin: `held` is the cue that may still be replaced, `n` how many are kept."""
    near = f"c.at_ms - w.at_ms < {gap} AND w.n < {cap}"
    return f"""{name}_r AS (SELECT *, CASE kind WHEN 'whoosh' THEN 1 WHEN 'swoosh' THEN 2 WHEN 'hit' THEN 3 WHEN 'impact' THEN 4 ELSE 0 END AS rnk FROM {src} WHERE duration_ms <= 200 OR at_ms < duration_ms - 120),
{name}_c AS MATERIALIZED (SELECT video_id, greatest(40, at_ms) AS at_ms, kind, gain, reason, rnk, row_number() OVER (PARTITION BY video_id ORDER BY at_ms, -rnk, ord) AS k FROM {name}_r),
{name}_w AS (SELECT video_id, k, at_ms, kind, gain, reason, rnk, 1 AS n FROM {name}_c WHERE k = 1
  UNION ALL SELECT c.video_id, c.k, {', '.join(f"CASE WHEN ({near} AND c.rnk > w.rnk) OR (NOT ({near}) AND w.n < {cap}) THEN c.{x} ELSE w.{x} END" for x in ('at_ms', 'kind', 'gain', 'reason', 'rnk'))},
   w.n + CASE WHEN NOT ({near}) AND w.n < {cap} THEN 1 ELSE 0 END FROM {name}_w w JOIN {name}_c c ON c.video_id = w.video_id AND c.k = w.k + 1),
{name} AS (SELECT video_id, at_ms, kind, gain, reason FROM {name}_w QUALIFY row_number() OVER (PARTITION BY video_id, n ORDER BY k DESC) = 1)"""


_raw = f"rawc AS (SELECT video_id, caption_id AS ord, start_ms - caption_id % 3 * 400 AS at_ms, {sql_pick('video_id * 3 + caption_id * 7', ['whoosh', 'hit', 'swoosh', 'riser', 'impact'])} AS kind, 0.2::DOUBLE AS gain, treatment AS reason, duration_ms FROM caps JOIN durations USING (video_id))"
query("gate_cues", f"WITH RECURSIVE {CAPS}, {_raw}, {s_gate_cues('rawc', 'cued', 1650, 14)} SELECT * FROM cued")(
    lambda spark, sf: G.gate_cues(raw_cues(spark, sf), hot=hot_videos(spark, sf))
)
query(
    "plan_overlay_cues",
    f"""WITH RECURSIVE {CAPS}, sp AS (SELECT video_id, caption_id AS ord, start_ms AS at_ms, CASE WHEN treatment = 'blob' THEN 'hit' ELSE 'whoosh' END AS kind, 0.16::DOUBLE AS gain, treatment AS reason FROM caps WHERE treatment IN ('oval', 'blob', 'quote', 'underline')),
op AS (SELECT video_id, 0 AS ord, arg_min(start_ms, caption_id) AS at_ms, 'whoosh' AS kind, 0.12::DOUBLE AS gain, 'open' AS reason FROM caps ANTI JOIN sp USING (video_id) GROUP BY video_id),
u AS (SELECT x.*, duration_ms FROM (SELECT * FROM sp UNION ALL SELECT * FROM op) x JOIN durations USING (video_id)), {s_gate_cues('u', 'cued', 8000, 6)} SELECT * FROM cued""",
)(lambda spark, sf: C.plan_overlay_cues(caps(spark, sf), durations(spark, sf), hot_videos(spark, sf)))
ACCENTS = f"""{CAPS}, a0 AS (SELECT c.*, start_ms + CASE WHEN treatment IN ('oval', 'bubble') THEN 300 ELSE 200 END AS at_ms, duration_ms, greatest(10, duration_ms // 25000) - 1 AS budget FROM caps c JOIN durations USING (video_id)),
a1 AS (SELECT * FROM a0 WHERE caption_id > 0 AND treatment IN ('oval', 'underline', 'tape', 'bubble') AND at_ms <= duration_ms - 500), {sql_greedy('acc', 'a1', 12000, 'caption_id', 'caption_id', 'at_ms', 'budget')},
accents AS (SELECT a.video_id, at_ms, CASE treatment WHEN 'tape' THEN 'swoosh' WHEN 'bubble' THEN 'pop' ELSE 'shimmer' END AS kind,
  CASE treatment WHEN 'oval' THEN 0.13 WHEN 'underline' THEN 0.09 WHEN 'tape' THEN 0.10 ELSE 0.16 END::DOUBLE AS gain, treatment AS reason FROM a1 a JOIN acc k ON k.video_id = a.video_id AND k.id = a.caption_id
  UNION ALL SELECT video_id, greatest(0, start_ms), 'riser', 0.14::DOUBLE, 'hook' FROM a0 WHERE caption_id = 0)"""
query("plan_accents", f"WITH RECURSIVE {ACCENTS} SELECT * FROM accents")(
    lambda spark, sf: C.plan_accents(caps(spark, sf), durations(spark, sf), hot=hot_videos(spark, sf))
)
_clips = [("swoosh", "swoosh.mp3", 480, 0.24), ("shimmer", "shimmer.mp3", 400, 0.2), ("riser", "riser.mp3", 860, 0.16)]


def clip_library(spark):
    return spark.createDataFrame(_clips, "kind string, file_name string, trim_ms int, gain double")


query(
    "join_cue_clips",
    f"""WITH RECURSIVE {ACCENTS}, lib AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{f}', {t}, {g}::DOUBLE)" for k, f, t, g in _clips)}) t(kind, file_name, trim_ms, g))
SELECT video_id, at_ms, kind, COALESCE(nullif(CASE WHEN reason = 'tape' THEN 0.0 ELSE gain END, 0.0), g)::DOUBLE AS gain, reason, file_name, trim_ms FROM accents JOIN lib USING (kind)""",
)(
    lambda spark, sf: C.cue_clips(
        C.plan_accents(caps(spark, sf), durations(spark, sf), hot=hot_videos(spark, sf)).withColumn(
            "gain", F.when(F.col("reason") == "tape", 0.0).otherwise(F.col("gain"))
        ),
        clip_library(spark),
    )
)
_moods_sql = "[" + ", ".join(f"{{'mood': '{m}', 'keys': {sql_list(ks)}}}" for m, ks in C.TRACK_KEYWORDS.items()) + "]"
_tags = ["lofi focus", "dark drama", "soft piano", "happy pop bright", "warm hope", "untitled"]
query(
    "join_track_mood",
    f"""WITH t AS (SELECT p_name || ' ' || {sql_pick('p_partkey', _tags)} AS track FROM part), m AS (SELECT unnest({_moods_sql}) AS m), s AS (SELECT m.mood AS mood, track, len(list_filter(m.keys, lambda k: contains(lower(track), k))) AS hits FROM t, m)
SELECT mood, arg_min(track, {{'a': -hits, 'b': track}}) AS track, max(hits)::INT AS hits FROM s GROUP BY mood""",
)(
    lambda spark, sf: C.track_for_mood(
        table(spark, sf, "part").select(F.concat_ws(" ", "p_name", pick(F.col("p_partkey"), _tags)).alias("track"))
    )
)

# --- intervals ----------------------------------------------------------------------------------
SQUEEZED = f"""{CAPS}, sq AS (SELECT video_id, caption_id, start_ms // 2 AS start_ms, start_ms // 2 + 150 + caption_id % 5 * 300 AS end_ms, list_transform(ws, lambda w: {{'text': w.text, 's': w.s // 2, 'e': w.e // 2}}) AS ws FROM caps)"""


def squeezed(spark, sf):
    """Captions at double speed with uneven lengths, so that they overlap."""
    c = caps(spark, sf)
    half = F.transform(
        "words",
        lambda w: F.struct(w["text"].alias("text"), F.floor(w["start_ms"] / 2).alias("start_ms"), F.floor(w["end_ms"] / 2).alias("end_ms"), w["emphasis"].alias("emphasis")),
    )
    start = F.floor(F.col("start_ms") / 2)
    return c.withColumns({"words": half, "end_ms": start + 150 + F.col("caption_id") % 5 * 300, "start_ms": start})


query(
    "ivl_dedupe_overlap",
    f"""WITH RECURSIVE {SQUEEZED}, w AS (SELECT video_id, caption_id, start_ms, greatest(end_ms, start_ms + 220) AS end_ms FROM sq WHERE caption_id = 0
 UNION ALL SELECT s.video_id, s.caption_id, greatest(s.start_ms, w.end_ms + 40), greatest(s.end_ms, greatest(s.start_ms, w.end_ms + 40) + 220) FROM w JOIN sq s ON s.video_id = w.video_id AND s.caption_id = w.caption_id + 1),
x AS (SELECT w.*, unnest(range(len(ws))) AS i, unnest(ws) AS u FROM w JOIN sq USING (video_id, caption_id))
SELECT video_id, caption_id, start_ms, end_ms, i, u.text AS word, greatest(u.s, start_ms) AS word_start, least(greatest(u.e, greatest(u.s, start_ms) + 50), end_ms) AS word_end FROM x""",
)(lambda spark, sf: flat_words(I.dedupe_overlaps(squeezed(spark, sf), hot=hot_videos(spark, sf))))
query(
    "ivl_clamp_holds",
    f"""WITH {SQUEEZED}, n AS (SELECT s.*, lead(start_ms) OVER (PARTITION BY video_id ORDER BY caption_id) AS nx, list_max(list_transform(ws, lambda w: w.e)) AS spoken, duration_ms // 2 AS dur FROM sq s JOIN durations USING (video_id)),
h AS (SELECT *, least(greatest(least(greatest(end_ms, spoken + 120), spoken + 850, COALESCE(nx, spoken + 850) - 30, dur), start_ms + 220), dur) AS e1 FROM n),
g AS (SELECT *, CASE WHEN e1 <= start_ms THEN least(start_ms + 220, dur) ELSE e1 END AS e2 FROM h),
x AS (SELECT video_id, caption_id, start_ms, e2, unnest(range(len(ws))) AS i, unnest(ws) AS u FROM g)
SELECT video_id, caption_id, start_ms, e2 AS end_ms, i, u.text AS word, least(greatest(u.s, start_ms), least(u.e, e2) - 50) AS word_start, least(u.e, e2) AS word_end FROM x""",
)(
    lambda spark, sf: flat_words(
        I.clamp_holds(squeezed(spark, sf).join(durations(spark, sf).withColumn("duration_ms", F.floor(F.col("duration_ms") / 2)), "video_id"), hot=hot_videos(spark, sf))
    )
)


def raw_beats(spark, sf):
    i = F.col("caption_id")
    return (
        caps(spark, sf)
        .join(durations(spark, sf), "video_id")
        .select("video_id", i.alias("beat_id"), "start_ms", (F.col("start_ms") + 2000 + i % 9 * 1000).alias("end_ms"), (0.5 + (i % 5) / 10).alias("confidence"), "duration_ms")
    )


BEATS = f"{CAPS}, beats AS (SELECT video_id, caption_id AS beat_id, start_ms, start_ms + 2000 + caption_id % 9 * 1000 AS end_ms, 0.5 + (caption_id % 5) / 10 AS confidence, duration_ms FROM caps JOIN durations USING (video_id))"


def s_no_overlap(src, name, gap, shortest, longest):
    start = f"greatest(b.start_ms, w.last + {gap})"
    end = f"least(b.end_ms, {start} + {longest})" if longest else "b.end_ms"
    fits = f"b.end_ms - {start} >= {shortest}"
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, -confidence, beat_id) AS k FROM {src}),
{name}_w AS (SELECT DISTINCT video_id, 0::BIGINT AS k, -1000000::BIGINT AS last, NULL::BIGINT AS beat_id, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms FROM {name}_n
 UNION ALL SELECT b.video_id, b.k, CASE WHEN {fits} THEN {end} ELSE w.last END, CASE WHEN {fits} THEN b.beat_id END, {start}, {end} FROM {name}_w w JOIN {name}_n b ON b.video_id = w.video_id AND b.k = w.k + 1),
{name} AS (SELECT video_id, beat_id, start_ms, end_ms FROM {name}_w WHERE beat_id IS NOT NULL)"""


query(
    "ivl_no_overlap_beats",
    f"""WITH RECURSIVE {BEATS}, {s_no_overlap('beats', 'c', 140, 2604, 7400)}, {s_no_overlap('beats', 's', 100, 2600, 9500)}, {s_no_overlap('beats', 'm', 120, 1400, None)}
SELECT 'cards' AS rule, * FROM c UNION ALL SELECT 'scenes', * FROM s UNION ALL SELECT 'model', * FROM m""",
)(
    lambda spark, sf: I.no_overlap(raw_beats(spark, sf), I.CARDS, hot_videos(spark, sf)).select(F.lit("cards").alias("rule"), "video_id", "beat_id", "start_ms", "end_ms")
    .unionByName(I.no_overlap(raw_beats(spark, sf), I.SCENES, hot_videos(spark, sf)).select(F.lit("scenes").alias("rule"), "video_id", "beat_id", "start_ms", "end_ms"))
    .unionByName(I.no_overlap(raw_beats(spark, sf), I.MODEL_CARDS, hot_videos(spark, sf)).select(F.lit("model").alias("rule"), "video_id", "beat_id", "start_ms", "end_ms"))
)
query(
    "ivl_cover_duration",
    f"""WITH {BEATS}, n AS (SELECT *, lag(start_ms) OVER v AS p, lead(start_ms) OVER v AS nx FROM beats WINDOW v AS (PARTITION BY video_id ORDER BY beat_id)),
t AS (SELECT video_id, beat_id, CASE WHEN p IS NULL THEN 0 ELSE start_ms END AS start_ms, COALESCE(nx, duration_ms) AS end_ms FROM n) SELECT * FROM t WHERE end_ms - start_ms >= 500""",
)(lambda spark, sf: I.cover_duration(raw_beats(spark, sf), "beat_id", hot=hot_videos(spark, sf)).select("video_id", "beat_id", "start_ms", "end_ms"))
query(
    "ivl_clamp_duration",
    f"WITH {BEATS} SELECT video_id, beat_id, start_ms, least(end_ms, duration_ms) AS end_ms FROM beats WHERE least(end_ms, duration_ms) - start_ms >= 900",
)(lambda spark, sf: I.clamp_duration(raw_beats(spark, sf)).select("video_id", "beat_id", "start_ms", "end_ms"))


def spans(spark, sf):
    rushed = lines(spark, sf).select(
        "video_id", "line_id", F.floor(F.col("start_ms") / 3).alias("spoken_start"), F.floor(F.col("spoken_end") / 3).alias("spoken_end")
    )
    return I.caption_spans(
        rushed.join(durations(spark, sf).withColumn("duration_ms", F.floor(F.col("duration_ms") / 3)), "video_id"), hot_videos(spark, sf)
    )


query("ivl_caption_spans")(spans)
query(
    "ivl_reveal_times",
    f"""WITH {CAPS}, r AS (SELECT video_id, caption_id, start_ms, end_ms + caption_id % 4 * 100 AS end_ms, ws FROM caps),
q AS (SELECT *, least(450.0, 0.5 * (end_ms - start_ms)) AS win, greatest(ws[len(ws)].s - start_ms, 0.001) AS lastt, greatest(start_ms, end_ms - 180) AS ceil FROM r),
t AS (SELECT *, list_transform(ws, lambda w: CASE WHEN lastt > win THEN start_ms + (w.s - start_ms) * win / lastt ELSE w.s::DOUBLE END) AS ts FROM q),
x AS (SELECT *, unnest(range(len(ws))) AS i FROM t),
y AS (SELECT *, least(greatest(ts[i + 1], start_ms), ceil) AS w0 FROM x),
z AS (SELECT *, greatest(CASE WHEN i + 1 < len(ws) THEN least(ts[i + 2], end_ms) ELSE end_ms END, w0 + 10) AS e0 FROM y)
SELECT video_id, caption_id, i, ws[i + 1].text AS word, round_even(CASE WHEN e0 > end_ms THEN least(w0, end_ms - 10) ELSE w0 END, 0)::BIGINT AS word_start, round_even(CASE WHEN e0 > end_ms THEN end_ms ELSE e0 END, 0)::BIGINT AS word_end FROM z""",
)(
    lambda spark, sf: flat_words(
        I.reveal_times(
            caps(spark, sf).withColumns(
                {
                    "end_ms": F.col("end_ms") + F.col("caption_id") % 4 * 100,
                    "tokens": F.transform("words", lambda w: w["text"]),
                    "flags": F.transform("words", lambda w: w["emphasis"]),
                    "token_ms": F.transform("words", lambda w: w["start_ms"]),
                }
            )
        ),
        ("video_id", "caption_id"),
    )
)

# --- zoom, cards, scenes, cues from sentences ----------------------------------------------------

def zoom_plan(spark, sf):
    return plan_zoom(scored(spark, sf), durations(spark, sf), hot=hot_videos(spark, sf))


_room = "least(4800, duration_ms - at_ms, greatest(1050, end_ms - at_ms + 450))"
ZOOM = f"""{SCORES}, {DUR}, p0 AS (SELECT s.*, duration_ms, greatest(0, start_ms + delay_ms) AS at_ms FROM scored s JOIN durations USING (video_id)),
p1 AS (SELECT *, {_room} AS room, greatest(ease_in_ms, 450) AS i, greatest(ease_out_ms, 380) AS o, greatest(hold_ms, 220) AS h, CASE WHEN intensity <= 0.02 THEN 1.0 ELSE round_even(1.0 + 0.25 * intensity, 3) END::DOUBLE AS target_scale FROM p0),
p2 AS (SELECT *, greatest(h - greatest(i + h + o - room, 0), 220) AS h2 FROM p1), p3 AS (SELECT *, greatest(o - greatest(i + h2 + o - room, 0), 380) AS o2 FROM p2),
p4 AS (SELECT *, greatest(i - greatest(i + h2 + o2 - room, 0), 450) AS i2 FROM p3),
p5 AS (SELECT *, at_ms + i2 + h2 + o2 AS until_ms, CASE WHEN NOT apply THEN 'motion.apply=false' WHEN role IN ('cta', 'generic', 'assumption') THEN 'role=' || role WHEN target_scale <= 1.001 THEN 'intensity maps to no zoom'
  WHEN duration_ms - at_ms < 1050 THEN 'not enough room to ease' WHEN i2 + h2 + o2 > room + 1 THEN 'cannot ease within duration cap' END AS why,
  final_score >= 0.88 AND role IN ('reveal', 'story_climax', 'warning', 'hook', 'strong_opinion') AS close_ok FROM p4),
pn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, sentence_id) AS k FROM p5 WHERE why IS NULL),
pw AS (SELECT DISTINCT video_id, 0::BIGINT AS k, -10000::BIGINT AS last, 0 AS n, NULL::BIGINT AS sentence_id, NULL::VARCHAR AS told, NULL::BIGINT AS dist FROM pn
  UNION ALL SELECT b.video_id, b.k, CASE WHEN w.n > 0 AND ((b.at_ms - w.last < 1600 AND NOT b.close_ok) OR b.at_ms - w.last < -20) THEN w.last ELSE b.until_ms END,
   w.n + CASE WHEN w.n > 0 AND ((b.at_ms - w.last < 1600 AND NOT b.close_ok) OR b.at_ms - w.last < -20) THEN 0 ELSE 1 END, b.sentence_id,
   CASE WHEN w.n > 0 AND b.at_ms - w.last < 1600 AND NOT b.close_ok THEN 'too soon after previous zoom (' || printf('%.2f', (b.at_ms - w.last) / 1000) || 's)' WHEN w.n > 0 AND b.at_ms - w.last < -20 THEN 'overlaps previous ease-out' ELSE 'planned' END,
   greatest(0, b.at_ms - w.last) FROM pw w JOIN pn b ON b.video_id = w.video_id AND b.k = w.k + 1),
zoomed AS (SELECT p.video_id, p.sentence_id, role, final_score, CASE WHEN told = 'planned' THEN 'apply' ELSE 'skip' END AS action, COALESCE(why, told) AS reason, dist AS distance_ms,
  CASE WHEN told = 'planned' THEN at_ms END AS start_ms, CASE WHEN told = 'planned' THEN at_ms + i2 + h2 END AS end_ms, CASE WHEN told = 'planned' THEN until_ms END AS span_end_ms,
  CASE WHEN told = 'planned' THEN i2 END AS ease_in_ms, CASE WHEN told = 'planned' THEN h2 END AS hold_ms, CASE WHEN told = 'planned' THEN o2 END AS ease_out_ms, CASE WHEN told = 'planned' THEN target_scale END AS target_scale,
  CASE WHEN told = 'planned' THEN CASE WHEN h2 >= 750 AND intensity >= 0.6 THEN 'hold' WHEN i2 >= 550 THEN 'slow_punch' ELSE 'fast_punch' END END AS style
  FROM p5 p LEFT JOIN pw w ON w.video_id = p.video_id AND w.sentence_id = p.sentence_id)"""
query("plan_zoom", f"WITH RECURSIVE {ZOOM} SELECT * FROM zoomed")(zoom_plan)


def keyframes(spark, sf):
    p = zoom_plan(spark, sf).filter("action = 'apply'").select(
        "video_id", F.col("sentence_id").alias("zoom_no"), "start_ms", "ease_in_ms", "hold_ms", "ease_out_ms", "target_scale",
        F.lit(0.5).alias("anchor_x"), F.lit(0.41).alias("anchor_y"),
    )
    return I.zoom_keyframes(p, hot_videos(spark, sf))


def _s_ramp(slot0, n, s0, s1):
    rows = []
    for j in range(n):
        t = (j + 1) / n
        eased = 4.0 * t**3 if t < 0.5 else 1.0 - ((-2.0 * t + 2.0) ** 3) / 2.0
        rows.append(f"({slot0 + j}, {j}, {n}, {eased!r}::DOUBLE)")
    return ", ".join(rows)


query(
    "ivl_zoom_keyframes",
    f"""WITH RECURSIVE {ZOOM}, a0 AS (SELECT video_id, sentence_id AS zoom_no, start_ms, ease_in_ms AS i, hold_ms AS h, ease_out_ms AS o, target_scale AS ts FROM zoomed WHERE action = 'apply'),
a1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, zoom_no) AS k, count(*) OVER (PARTITION BY video_id) AS total FROM a0),
cu AS (SELECT video_id, zoom_no, k, total, i, h, o, ts, 0::BIGINT AS cursor, start_ms AS s FROM a1 WHERE k = 1
 UNION ALL SELECT a.video_id, a.zoom_no, a.k, a.total, a.i, a.h, a.o, a.ts, c.s + c.i + c.h + c.o, greatest(a.start_ms, c.s + c.i + c.h + c.o) FROM cu c JOIN a1 a ON a.video_id = c.video_id AND a.k = c.k + 1),
rin AS (SELECT * FROM (VALUES {_s_ramp(1, 8, 0, 1)}) t(slot, j, n, eased)), rout AS (SELECT * FROM (VALUES {_s_ramp(10, 6, 0, 1)}) t(slot, j, n, eased)),
pc AS (SELECT video_id, zoom_no * 32 AS ord, cursor::DOUBLE AS a, s::DOUBLE AS b, 1.0::DOUBLE AS scale, 0.5 AS ax, 0.5 AS ay FROM cu WHERE s > cursor + 40
 UNION ALL SELECT video_id, zoom_no * 32 + slot, s + i * j / n, s + i * (j + 1) / n, round(1.0 + (ts - 1.0) * eased, 3), 0.5, 0.41 FROM cu, rin
 UNION ALL SELECT video_id, zoom_no * 32 + 9, s + i, s + i + h, ts, 0.5, 0.41 FROM cu
 UNION ALL SELECT video_id, zoom_no * 32 + slot, s + i + h + o * j / n, s + i + h + o * (j + 1) / n, round(ts + (1.0 - ts) * eased, 3), 0.5, 0.41 FROM cu, rout
 UNION ALL SELECT video_id, zoom_no * 32 + 16, s + i + h + o, -1, 1.0, 0.5, 0.5 FROM cu WHERE k = total),
lg AS (SELECT *, CASE WHEN lag(scale) OVER v = scale AND abs(lag(ax) OVER v - ax) < 0.02 AND abs(lag(ay) OVER v - ay) < 0.02 AND lag(b) OVER v >= 0 AND a - lag(b) OVER v < 20 THEN 0 ELSE 1 END AS fresh FROM pc WINDOW v AS (PARTITION BY video_id ORDER BY ord)),
il AS (SELECT *, (sum(fresh) OVER (PARTITION BY video_id ORDER BY ord) - 1)::BIGINT AS piece_no FROM lg)
SELECT video_id, piece_no, round(min(a), 3) AS start_ms, round(arg_max(b, ord), 3) AS end_ms, arg_max(scale, ord) AS scale, arg_max(ax, ord)::DOUBLE AS anchor_x, arg_max(ay, ord)::DOUBLE AS anchor_y FROM il GROUP BY ALL""",
)(keyframes)
_copy = [
    ("compare", "", "Side by side", None, None, None, [("📄", "fresh texts"), ("🧠", "new weights"), ("💡", "it depends"), ("✨", "never shown")]),
    ("concept", "RAG", "Look it up first", None, "read, then answer", None, None),
    ("concept", "Documents", "The source", "SOURCE", None, None, None),
    ("adapters", "", "A small part", None, None, None, [("🧩", "a small layer")]),
    ("retrieval_steps", "", None, None, None, ["Look up", "Read", "Answer"], None),
]


def copy_table(spark):
    return spark.createDataFrame(_copy, "rule string, term string, title string, kicker string, subtitle string, chips array<string>, bullets array<struct<icon:string,text:string>>")


def _sql_or_null(value):
    return "NULL" if value is None else lit(value)


def _sql_copy():
    """The copy table with chips and bullets as text: icon/text, joined."""
    rows = [(*r[:5], None if r[5] is None else "|".join(r[5]), None if r[6] is None else "|".join(f"{i}/{t}" for i, t in r[6])) for r in _copy]
    return "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_sql_or_null, r))})" for r in rows) + ") t(rule, term, ctitle, ckick, csub, cchips, cbullets)"


def _sql_rule(field):
    """A field of the rule table as CASE; texts with facts are written out by the caller."""
    return "CASE rule " + " ".join(f"WHEN {lit(c.rule)} THEN {lit(getattr(c, field))}" for c in K.CARD_RULES) + " END"


def _sql_map(key, values, other):
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {other} END"


_fig = "nullif(trim(regexp_extract(t, '(?i)(?:^|[^\\p{L}\\p{N}_])([0-9]+(?:\\.[0-9]+)?(?:\\s*(?:x|k|million)(?:$|[^\\p{L}\\p{N}_])|\\s*%[\\p{L}\\p{N}_]|(?:$|[^\\p{L}\\p{N}_])))', 1)), '')"
CARDS = f"""{LABELS}, {DUR}, k0 AS (SELECT *, {sql_fix_asr('text')} AS t FROM labelled),
k1 AS (SELECT *, {sql_terms('t')} AS hits, list_transform({sql_terms('t')}, lambda x: string_split(x, '=')[1]) AS names, {_fig} IS NOT NULL AS fig, CASE WHEN regexp_matches({_fig}, '%.$') THEN regexp_replace({_fig}, '.$', '') ELSE regexp_replace({_fig}, '[^0-9A-Za-z]+$', '') END AS figure, {sql_matches('t', rules.PROCESS)} AS steps, contains(lower(t), 'cost') AS cost,
  role IN ('contrast', 'contradiction') OR {sql_matches('t', rules.COMPARISON)} AS vs FROM k0),
k2 AS (SELECT *, list_contains(names, 'RAG') AS rag, list_contains(names, 'Fine-tuning') AS ft, len(names) > 0 AS told FROM k1),
k3 AS (SELECT *, CASE WHEN role IN ('cta', 'generic') AND NOT told THEN NULL WHEN vs OR (rag AND ft) THEN 'compare' WHEN role = 'important_number' AND fig THEN 'figure' WHEN list_contains(names, 'LoRA') OR list_contains(names, 'PEFT') THEN 'adapters'
  WHEN rag AND steps THEN 'retrieval_steps' WHEN ft AND steps THEN 'tuning_steps' WHEN rag AND cost THEN 'retrieval_cost' WHEN ft AND cost THEN 'tuning_cost' WHEN told THEN 'concept' WHEN role IN ('hook', 'key_insight', 'reveal', 'strong_opinion') THEN 'take' END AS rule FROM k2),
cards0 AS (SELECT video_id, sentence_id AS beat_id, start_ms, least(greatest(end_ms, start_ms + 4200), start_ms + 7400) AS end_ms, rule, {_sql_rule('kind')} AS kind, {_sql_rule('motion')} AS motion,
  CASE rule WHEN 'compare' THEN 0.86 WHEN 'retrieval_steps' THEN 0.82 WHEN 'concept' THEN 0.74 WHEN 'take' THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence,
  CASE WHEN rule = 'concept' THEN names[1] ELSE '' END AS term, names[1] AS name1, string_split(hits[1], '=')[2] AS note, names[2:3] AS others, t, role, figure,
  CASE WHEN length(trim(t)) > 48 THEN regexp_replace(trim(t)[1:45], ' [^ ]*$', '') || '…' ELSE trim(t) END AS snippet FROM k3 WHERE rule IS NOT NULL),
cards1 AS (SELECT *, CASE rule WHEN 'figure' THEN figure WHEN 'take' THEN snippet WHEN 'concept' THEN name1 ELSE rule END AS own_title,
  CASE rule WHEN 'figure' THEN COALESCE(name1, {lit(K.FIGURE_NAME)}) WHEN 'concept' THEN note ELSE '' END AS own_sub,
  CASE WHEN rule = 'concept' THEN {_sql_map('role', K.CONCEPT_KICKERS, lit('CONCEPT'))} ELSE {_sql_rule('kicker')} END AS own_kick,
  CASE WHEN rule = 'concept' THEN {_sql_map('name1', K.CONCEPT_ICONS, lit('✨'))} ELSE {_sql_rule('icon')} END AS icon,
  CASE WHEN rule = 'compare' THEN 'RAG' ELSE '' END AS "left", CASE WHEN rule = 'compare' THEN 'Fine-tuning' ELSE '' END AS "right",
  CASE WHEN rule = 'concept' THEN array_to_string(others, '|') ELSE '' END AS own_chips FROM cards0),
cards2 AS (SELECT *, CASE rule WHEN 'concept' THEN list_filter([icon || '/' || note, CASE WHEN len(others) > 0 THEN '✨/with ' || array_to_string(others, ' · ') END, CASE WHEN role = 'question' THEN {lit('🎯/' + K.ASK)} END], lambda x: x IS NOT NULL)
  WHEN 'take' THEN ['💡/' || snippet] ELSE [] END AS own_bullets FROM cards1),
copy AS ({_sql_copy()}),
cards AS MATERIALIZED (SELECT c.video_id, c.beat_id, c.start_ms, c.end_ms, c.rule, c.kind, c.motion, c.confidence, c.term, COALESCE(ctitle, own_title) AS title, COALESCE(csub, own_sub) AS subtitle, COALESCE(ckick, own_kick) AS kicker,
  c.icon, c."left", c."right", COALESCE(cchips, own_chips) AS chips, COALESCE(string_split(cbullets, '|'), own_bullets)[1:3] AS bl,
  array_to_string(list_transform(COALESCE(string_split(cbullets, '|'), own_bullets)[1:3], lambda x, i: x || '/' || ((i - 1) * 480)), '|') AS bullets FROM cards2 c LEFT JOIN copy USING (rule, term))"""
_card_cols = ["video_id", "beat_id", "start_ms", "end_ms", "rule", "kind", "motion", "confidence", "term", "kicker", "title", "subtitle", "icon", "left", "right", "chips", "bullets"]


def flat_cards(df):
    shown = lambda b: F.concat_ws("/", b["icon"], b["text"], b["delay_ms"].cast("string"))
    return df.withColumns({"chips": F.array_join("chips", "|"), "bullets": F.array_join(F.transform("bullets", shown), "|")})


def card_rows(spark, sf):
    return K.card_rows(labelled(spark, sf), copy_table(spark))


def cue_plan(spark, sf):
    """Sentences give cards and cues: what both need of them is stored once."""
    said = cut_lineage(labelled(spark, sf).select("video_id", "sentence_id", "start_ms", "end_ms", "text", "role"))
    return C.plan_cues(said, K.card_rows(said, copy_table(spark)), durations(spark, sf), hot_videos(spark, sf))


_sql_card_cols = ", ".join(f'"{c}"' for c in _card_cols)
query("lab_beat_rules", f"WITH RECURSIVE {CARDS} SELECT {_sql_card_cols} FROM cards")(
    lambda spark, sf: flat_cards(card_rows(spark, sf)).select(*_card_cols)
)
PLANNED = f"""{CARDS}, {s_no_overlap('cards', 'pl', 140, 2604, 7400)},
pt AS MATERIALIZED (SELECT p.video_id, p.beat_id, p.start_ms, p.end_ms, c.kind, c.title AS title, c.kicker, c.subtitle, c.icon, row_number() OVER (PARTITION BY p.video_id ORDER BY p.start_ms, p.beat_id) AS k FROM pl p JOIN cards c USING (video_id, beat_id)),
dw AS (SELECT DISTINCT video_id, 0::BIGINT AS k, '' AS title, -99000::BIGINT AS last, NULL::BIGINT AS beat_id FROM pt
 UNION ALL SELECT b.video_id, b.k, CASE WHEN b.kind NOT IN ('vs_split', 'process', 'stat') AND b.title = w.title AND b.start_ms - w.last < 9000 THEN w.title ELSE b.title END,
  CASE WHEN b.kind NOT IN ('vs_split', 'process', 'stat') AND b.title = w.title AND b.start_ms - w.last < 9000 THEN w.last ELSE b.start_ms END,
  CASE WHEN b.kind NOT IN ('vs_split', 'process', 'stat') AND b.title = w.title AND b.start_ms - w.last < 9000 THEN NULL ELSE b.beat_id END FROM dw w JOIN pt b ON b.video_id = w.video_id AND b.k = w.k + 1),
d1 AS (SELECT p.video_id, p.beat_id, p.start_ms, least(p.end_ms, duration_ms) AS end_ms, kind, p.title, kicker, subtitle, icon, duration_ms FROM pt p JOIN dw USING (video_id, beat_id) JOIN durations USING (video_id) WHERE least(p.end_ms, duration_ms) - p.start_ms >= 900),
c1 AS (SELECT video_id, beat_id, kind, title, kicker, subtitle, icon, duration_ms, CASE WHEN lag(start_ms) OVER v IS NULL THEN 0 ELSE start_ms END AS start_ms, COALESCE(lead(start_ms) OVER v, duration_ms) AS end_ms FROM d1 WINDOW v AS (PARTITION BY video_id ORDER BY beat_id)),
c2 AS (SELECT * FROM c1 WHERE end_ms - start_ms >= 900),
c3 AS (SELECT video_id, beat_id, kind, title, kicker, subtitle, icon, CASE WHEN lag(start_ms) OVER v IS NULL THEN 0 ELSE start_ms END AS start_ms, COALESCE(lead(start_ms) OVER v, duration_ms) AS end_ms FROM c2 WINDOW v AS (PARTITION BY video_id ORDER BY beat_id)),
planned AS (SELECT video_id, beat_id, kind, title, kicker, subtitle, icon, start_ms, end_ms FROM c3 WHERE end_ms - start_ms >= 500
 UNION ALL SELECT video_id, 0, 'topic', 'topic', 'TOPIC', '', '', 0, duration_ms FROM durations WHERE video_id NOT IN (SELECT video_id FROM c1 WHERE end_ms - start_ms >= 500))"""


def cards(spark, sf):
    return K.plan_cards(labelled(spark, sf), durations(spark, sf), copy_table(spark), hot=hot_videos(spark, sf))


_planned_cols = ["video_id", "beat_id", "kind", "title", "kicker", "subtitle", "icon", "start_ms", "end_ms"]
query("plan_cards", f"WITH RECURSIVE {PLANNED} SELECT {', '.join(_planned_cols)} FROM planned")(
    lambda spark, sf: cards(spark, sf).select(*_planned_cols)
)
query(
    "plan_cues",
    f"""WITH RECURSIVE {CARDS}, hk AS (SELECT video_id, arg_min(start_ms, sentence_id) AS at_ms, 'hook' AS reason FROM labelled WHERE role = 'hook' GROUP BY video_id),
op AS (SELECT * FROM hk UNION ALL SELECT video_id, arg_min(start_ms, beat_id), 'open' FROM cards ANTI JOIN hk USING (video_id) GROUP BY video_id),
pr AS (SELECT video_id, 0::BIGINT AS ord, at_ms, 'impact' AS kind, 0.32 AS gain, reason FROM op
 UNION ALL SELECT video_id, beat_id + {C.CARD}, start_ms + CASE kind WHEN 'vs_split' THEN 60 WHEN 'stat' THEN 80 WHEN 'process' THEN 50 ELSE 0 END, CASE kind WHEN 'vs_split' THEN 'swoosh' WHEN 'stat' THEN 'hit' WHEN 'process' THEN 'whoosh' ELSE 'impact' END,
   CASE kind WHEN 'vs_split' THEN 0.24 WHEN 'stat' THEN 0.26 WHEN 'process' THEN 0.22 ELSE 0.30 END, CASE kind WHEN 'vs_split' THEN 'compare' WHEN 'stat' THEN 'number' WHEN 'process' THEN 'steps' ELSE lower(kicker) END FROM cards WHERE kind IN ('vs_split', 'stat', 'process') OR upper(kicker) IN ('HOOK', 'REVEAL')
 UNION ALL SELECT video_id, sentence_id + {C.SENTENCE}, start_ms, CASE role WHEN 'contrast' THEN 'swoosh' WHEN 'cta' THEN 'whoosh' ELSE 'hit' END, CASE WHEN role IN ('contrast', 'cta') THEN 0.22 ELSE 0.26 END,
   CASE role WHEN 'important_number' THEN 'number' ELSE role END FROM labelled WHERE role IN ('reveal', 'answer', 'contrast', 'important_number', 'cta')),
u AS (SELECT pr.*, duration_ms FROM pr JOIN durations USING (video_id)), {s_gate_cues('u', 'cued', 1650, 14)} SELECT video_id, at_ms, kind, gain::DOUBLE AS gain, reason FROM cued""",
)(cue_plan)


def flat_scene(df):
    return df.withColumns(
        {
            "nodes": F.array_join(F.transform("nodes", lambda n: F.concat(n["label"], F.lit("/"), n["sub"])), "|"),
            "chips": F.array_join("chips", "|"),
            "bullets": F.array_join("bullets", "|"),
        }
    )


query("lab_scene_rules")(
    lambda spark, sf: flat_scene(K.scene_rows(labelled(spark, sf).withColumn("is_first", F.col("sentence_id") == 0))).drop("is_first")
)
query("plan_scenes")(lambda spark, sf: flat_scene(K.plan_scenes(labelled(spark, sf), durations(spark, sf), hot_videos(spark, sf))))
