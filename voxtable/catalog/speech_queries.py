"""Segmentation, labels and scores over the conversation transcripts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from voxtable.catalog.base import SEGMENTS, WORDS, pick, lit, segments, sql_list, sql_matches, sql_pick, table, words
from voxtable.catalog.registry import query
from voxtable.catalog.text_queries import sql_tokens
from voxtable.functions import text as X
from voxtable.operators import labels as L
from voxtable.operators import media as M
from voxtable.operators import segment as S
from voxtable.operators.ordered import find_hot


@lru_cache
def hot_videos(spark, sf):
    """Videos too long for one task, found once on the words; everything else is cut from them."""
    return find_hot(segments(spark, sf), ["video_id"], rows=F.size(X.tokens(F.col("txt"))))


# Islands between hard breaks run side by side; the two length limits recurse inside an island.
SENTENCES = f"""{WORDS},
brk AS (SELECT *, CASE WHEN lag(word_id) OVER v IS NULL OR lag(segment_id) OVER v <> segment_id OR start_ms - lag(end_ms) OVER v >= 450
   OR regexp_matches(lag(word) OVER v, '[.?!…]+$') THEN 1 ELSE 0 END AS hard FROM words WINDOW v AS (PARTITION BY video_id ORDER BY word_id)),
isl AS (SELECT *, sum(hard) OVER (PARTITION BY video_id ORDER BY word_id) AS island FROM brk),
pos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id, island ORDER BY word_id) AS k FROM isl),
walk AS (SELECT video_id, island, k, word_id, start_ms AS since, 1 AS n, 1 AS fresh FROM pos WHERE k = 1
  UNION ALL SELECT p.video_id, p.island, p.k, p.word_id,
    CASE WHEN w.n >= 16 OR (p.start_ms - w.since >= 4500 AND w.n >= 4) THEN p.start_ms ELSE w.since END,
    CASE WHEN w.n >= 16 OR (p.start_ms - w.since >= 4500 AND w.n >= 4) THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= 16 OR (p.start_ms - w.since >= 4500 AND w.n >= 4) THEN 1 ELSE 0 END
  FROM walk w JOIN pos p ON p.video_id = w.video_id AND p.island = w.island AND p.k = w.k + 1),
inw AS (SELECT p.*, (sum(w.fresh) OVER (PARTITION BY p.video_id ORDER BY p.word_id))::BIGINT - 1 AS sentence_id
  FROM walk w JOIN pos p USING (video_id, word_id)),
sent0 AS (SELECT video_id, sentence_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, min(word_id) AS first_word, max(word_id) AS last_word,
   arg_max(word, word_id) AS last_token, any_value(speaker) AS speaker,
   regexp_replace(regexp_replace(string_agg(word, ' ' ORDER BY word_id), '([^\\s]) ''', '\\1''', 'g'), '\\s+([,.;:?!])', '\\1', 'g') AS text FROM inw GROUP BY ALL),
sent AS (SELECT * EXCLUDE (last_token, speaker), lag(text) OVER v AS previous, lead(text) OVER v AS next,
   round_even(n_words * 1000 / greatest(end_ms - start_ms, 80)::DOUBLE, 3) AS speaking_rate,
   greatest(start_ms - lag(end_ms) OVER v, CASE WHEN lag(end_ms) OVER v IS NOT NULL THEN 0 END) AS pause_before_ms,
   greatest(lead(start_ms) OVER v - end_ms, CASE WHEN lead(start_ms) OVER v IS NOT NULL THEN 0 END) AS pause_after_ms,
   CASE WHEN lead(start_ms) OVER v - end_ms >= 350 THEN last_token END AS stressed_word
   FROM sent0 WINDOW v AS (PARTITION BY video_id ORDER BY sentence_id))"""


def in_sentences(spark, sf):
    return S.sentence_words(words(spark, sf), hot_videos(spark, sf))


def sentences(spark, sf):
    return S.sentence_table(in_sentences(spark, sf), hot_videos(spark, sf))


query("seg_sentences", f"WITH RECURSIVE {SENTENCES} SELECT video_id, word_id, sentence_id FROM inw")(
    lambda spark, sf: in_sentences(spark, sf).select("video_id", "word_id", "sentence_id")
)
query("seg_prosody", f"WITH RECURSIVE {SENTENCES} SELECT video_id, sentence_id, start_ms, end_ms, n_words, speaking_rate, pause_before_ms, pause_after_ms, stressed_word FROM sent")(
    lambda spark, sf: sentences(spark, sf).select(
        "video_id", "sentence_id", "start_ms", "end_ms", "n_words", "speaking_rate", "pause_before_ms", "pause_after_ms", "stressed_word"
    )
)
query("seg_context", f"WITH RECURSIVE {SENTENCES} SELECT video_id, sentence_id, previous, text, next FROM sent")(
    lambda spark, sf: sentences(spark, sf).select("video_id", "sentence_id", "previous", "text", "next")
)
query(
    "speaker_pace",
    f"""WITH RECURSIVE {SENTENCES}, who AS (SELECT DISTINCT video_id, segment_id, speaker FROM words)
SELECT w.speaker, count(*) AS sentences, round(avg(s.speaking_rate), 6) AS mean_rate, round(avg(s.pause_before_ms), 6) AS mean_pause_ms
FROM sent s JOIN words w ON w.video_id = s.video_id AND w.word_id = s.first_word GROUP BY w.speaker""",
)(
    lambda spark, sf: sentences(spark, sf)
    .join(words(spark, sf).select("video_id", F.col("word_id").alias("first_word"), "speaker"), ["video_id", "first_word"])
    .groupBy("speaker")
    .agg(
        F.count("*").alias("sentences"),
        F.round(F.avg("speaking_rate"), 6).alias("mean_rate"),
        F.round(F.avg("pause_before_ms"), 6).alias("mean_pause_ms"),
    )
)

# --- flattening and timing ---------------------------------------------------------------------

def raw_words(spark, sf):
    i = F.col("word_id")
    return words(spark, sf).select(
        "video_id", "segment_id", i.alias("position"),
        F.when(i % 13 == 5, F.lit("  ")).when(i % 7 == 0, F.concat(F.lit(" "), "word", F.lit(" "))).otherwise(F.col("word")).alias("word"),
        "start_ms",
        F.when(i % 11 == 3, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
    )


FLAT = f"""{WORDS}, raw AS (SELECT video_id, segment_id, word_id AS position, CASE WHEN word_id % 13 = 5 THEN '  ' WHEN word_id % 7 = 0 THEN ' ' || word || ' ' ELSE word END AS word,
  start_ms, CASE WHEN word_id % 11 = 3 THEN start_ms ELSE end_ms END AS end_ms FROM words),
flat AS (SELECT video_id, segment_id, position, trim(word) AS word, start_ms, CASE WHEN end_ms > start_ms THEN end_ms ELSE start_ms + 80 END AS end_ms,
  row_number() OVER (PARTITION BY video_id ORDER BY position) - 1 AS word_id FROM raw WHERE trim(word) <> '')"""
query("seg_flatten_words", f"WITH {FLAT} SELECT * FROM flat")(lambda spark, sf: S.flatten_words(raw_words(spark, sf), hot_videos(spark, sf)))
query(
    "seg_word_ranges",
    f"WITH {FLAT}, r AS (SELECT video_id, segment_id, min(word_id) AS lo, max(word_id) + 1 AS hi FROM flat GROUP BY ALL) SELECT video_id, segment_id, lo, hi FROM segments LEFT JOIN r USING (video_id, segment_id)",
)(
    lambda spark, sf: S.segment_ranges(
        segments(spark, sf).select("video_id", "segment_id"), S.flatten_words(raw_words(spark, sf), hot_videos(spark, sf))
    )
)


def timed_segments(spark, sf):
    return words(spark, sf).groupBy("video_id", "segment_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


TIMED = f"{WORDS}, timed AS (SELECT video_id, segment_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words GROUP BY ALL)"
query(
    "seg_uniform_timing",
    f"""WITH {TIMED}, t AS (SELECT video_id, segment_id, {sql_tokens('txt')} AS ts FROM segments),
u AS (SELECT *, len(ts) AS n, greatest((end_ms - start_ms) // 4, 120 * len(ts)) AS span FROM timed JOIN t USING (video_id, segment_id)),
e AS (SELECT video_id, segment_id, start_ms, n, span, unnest(range(n)) AS i, unnest(ts) AS word FROM u)
SELECT video_id, segment_id, i AS pos, word, round_even(start_ms + span * i / n, 0)::BIGINT AS start_ms,
  round_even(greatest(start_ms + span * (i + 1) / n, start_ms + span * i / n + 60), 0)::BIGINT AS end_ms FROM e""",
)(
    lambda spark, sf: timed_segments(spark, sf)
    .join(segments(spark, sf).select("video_id", "segment_id", X.tokens(F.col("txt")).alias("ts")), ["video_id", "segment_id"])
    .select(
        "video_id",
        "segment_id",
        F.posexplode(
            F.arrays_zip(
                F.col("ts"),
                S.uniform_spans(
                    F.size("ts"), F.col("start_ms"), F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 4), 120, 60
                ).alias("at"),
            )
        ).alias("pos", "w"),
    )
    .select("video_id", "segment_id", "pos", F.col("w.ts").alias("word"), "w.at.start_ms", "w.at.end_ms")
)
def _sql_walk(src, key, ordinal, test, since="start_ms"):
    """Recursive walk over rows in order: a new chunk whenever `test` holds against the chunk start."""
    return f"""
n_{src} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ordinal}) AS k FROM {src}),
w_{src} AS (SELECT {key}, k, {ordinal} AS ord, {since} AS since, 0 AS chunk_id FROM n_{src} WHERE k = 1
  UNION ALL SELECT n.{key}, n.k, n.{ordinal}, CASE WHEN {test} THEN n.{since} ELSE w.since END, w.chunk_id + CASE WHEN {test} THEN 1 ELSE 0 END
  FROM w_{src} w JOIN n_{src} n ON n.{key} = w.{key} AND n.k = w.k + 1)"""


query(
    "seg_chunk_time",
    f"""WITH RECURSIVE {TIMED}, {_sql_walk('timed', 'video_id', 'segment_id', 'n.end_ms - w.since > 25000')},
{_sql_walk('words', 'video_id', 'word_id', 'n.start_ms - w.since >= 18000')},
talks AS (SELECT video_id, arg_max(end_ms, segment_id) - arg_min(start_ms, segment_id) AS span FROM timed GROUP BY ALL),
long AS (SELECT * FROM timed JOIN talks USING (video_id) WHERE span > 330000),
{_sql_walk('long', 'video_id', 'segment_id', 'n.end_ms - w.since > 240000').strip()}
SELECT 'segments' AS unit, video_id, ord, chunk_id FROM w_timed UNION ALL SELECT 'words', video_id, ord, chunk_id FROM w_words
UNION ALL SELECT 'brief', video_id, ord, chunk_id FROM w_long UNION ALL SELECT 'brief', video_id, segment_id, 0 FROM timed JOIN talks USING (video_id) WHERE span <= 330000""",
)(
    lambda spark, sf: S.chunk_by_time(timed_segments(spark, sf), "segment_id", 25_000, hot=hot_videos(spark, sf))
    .select(F.lit("segments").alias("unit"), "video_id", "ord", "chunk_id")
    .unionByName(
        # "at least 18 s" is "more than 17.999 s" on integer milliseconds
        S.chunk_by_time(words(spark, sf), "word_id", 17_999, "start_ms", hot_videos(spark, sf)).select(
            F.lit("words").alias("unit"), "video_id", "ord", "chunk_id"
        )
    )
    .unionByName(
        S.brief_windows(timed_segments(spark, sf).withColumn("n_words", F.lit(1)), hot_videos(spark, sf)).select(
            F.lit("brief").alias("unit"), "video_id", F.col("segment_id").alias("ord"), "chunk_id"
        )
    )
)
query(
    "seg_chunk_count",
    f"""WITH {WORDS}, n AS (SELECT video_id, count(*) AS n FROM words GROUP BY ALL), ks AS (SELECT video_id, word_id, n, unnest([word_id // 10, word_id // 10 - 1]) AS k FROM words JOIN n USING (video_id))
SELECT 12 AS size, video_id, word_id, k AS chunk_id FROM ks WHERE k >= 0 AND word_id BETWEEN 10 * k AND 10 * k + 11 AND (k = 0 OR 10 * (k - 1) + 12 < n)
UNION ALL SELECT 8, video_id, word_id, word_id // 8 FROM words""",
)(
    lambda spark, sf: S.chunk_by_count(words(spark, sf).select("video_id", "word_id"), "word_id", 12, 2)
    .select(F.lit(12).alias("size"), "video_id", "word_id", "chunk_id")
    .unionByName(S.chunk_by_count(words(spark, sf).select(F.lit(8).alias("size"), "video_id", "word_id"), "word_id", 8))
)

# --- labels and scores -------------------------------------------------------------------------


def _sql_roles():
    steps, prev = [], "r_base"
    for n, (role, _sig, score, pat) in enumerate(L.ROLE_RULES):
        hit = f"h{n}"
        wins = f"{hit} AND (role = 'generic' OR (role NOT IN ('assumption', 'cta', 'question', 'contradiction') AND {score} >= interest))"
        steps.append(
            f"r_{n} AS (SELECT * REPLACE (CASE WHEN {wins} THEN '{role}' ELSE role END AS role, CASE WHEN {wins} THEN greatest(interest, {score}::DOUBLE) ELSE interest END AS interest) FROM {prev})"
        )
        prev = f"r_{n}"
    hits = ", ".join(f"{sql_matches('text', p)} AS h{n}" for n, (_r, _s, _c, p) in enumerate(L.ROLE_RULES))

    def signal(name):
        parts = ["0.0"] + [f"CASE WHEN h{n} THEN {sc} ELSE 0.0 END" for n, (_r, g, sc, _p) in enumerate(L.ROLE_RULES) if g == name]
        if name == "emphasis":
            parts += [f"CASE WHEN {c} THEN {v} ELSE 0.0 END" for c, v in (("answers", 0.7), ("figure", 0.72), ("paused", 0.55), ("pausing", 0.5))]
        if name == "question":
            parts.append("CASE WHEN asks THEN 0.86 ELSE 0.0 END")
        if name == "cta":
            return "CASE WHEN is_cta AND NOT is_generic THEN 0.9 ELSE 0.0 END::DOUBLE AS sig_cta"
        return f"(CASE WHEN is_generic OR is_cta THEN 0.0 ELSE greatest({', '.join(parts)}) END)::DOUBLE AS sig_{name}"

    return f"""r_facts AS (SELECT *, rtrim(text) LIKE '%?' AS asks, COALESCE(rtrim(previous), '') LIKE '%?' AND NOT rtrim(text) LIKE '%?' AS answers,
  {sql_matches('text', L.NUMBER)} OR {sql_matches('text', L.MONEY)} AS figure, COALESCE(pause_before_ms >= 500, false) AS paused, COALESCE(pause_after_ms >= 400, false) AS pausing,
  {sql_matches('text', L.GENERIC)} AS is_generic, {sql_matches('text', L.CTA)} AS is_cta, {hits} FROM sent),
r_base AS (SELECT *, CASE WHEN answers THEN 'answer' WHEN asks THEN 'question' ELSE 'generic' END AS role,
  CASE WHEN answers THEN 0.78 WHEN asks THEN 0.45 ELSE 0.2 END::DOUBLE AS interest FROM r_facts),
{', '.join(steps)},
labelled AS MATERIALIZED (SELECT video_id, sentence_id, start_ms, end_ms, text, n_words, first_word, last_word, speaking_rate, pause_before_ms, pause_after_ms,
  CASE WHEN is_generic THEN 'generic' WHEN is_cta THEN 'cta' WHEN role = 'generic' AND figure THEN 'important_number' ELSE role END AS role,
  CASE WHEN is_generic THEN 0.05 WHEN is_cta THEN 0.1 ELSE round_even(least(1.0, greatest(interest, CASE WHEN figure THEN 0.8 ELSE 0.0 END) + CASE WHEN paused THEN 0.08 ELSE 0.0 END), 3) END::DOUBLE AS interest,
  {', '.join(signal(n) for n in L.SIGNALS)} FROM {prev})"""


_story = "CASE WHEN role IN ('hook', 'assumption') THEN 'setup' WHEN role IN ('reveal', 'story_climax', 'important_number') THEN 'climax' WHEN role = 'cta' THEN 'resolution' WHEN role = 'generic' THEN 'none' ELSE 'development' END"
LABELS = f"{SENTENCES}, {_sql_roles()}"
_sigs = ", ".join(f"sig_{n}" for n in L.SIGNALS)
_motion = ["intensity", "delay_ms", "ease_in_ms", "hold_ms", "ease_out_ms"]
PRESETS = "presets AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {p[0]}::DOUBLE, {p[1]}, {p[2]}, {p[3]}, {p[4]})" for r, p in L.ZOOM_PRESETS.items()) + f") t(role, {', '.join(_motion)}))"
MOTION = f"""{PRESETS}, moved AS (SELECT l.*, p.role IS NOT NULL AS apply, COALESCE(p.intensity, 0.0::DOUBLE) AS intensity, COALESCE(p.delay_ms, 0) AS delay_ms,
  COALESCE(p.ease_in_ms, 480) AS ease_in_ms, COALESCE(p.hold_ms, 600) AS hold_ms, COALESCE(p.ease_out_ms, 420) AS ease_out_ms FROM labelled l LEFT JOIN presets p USING (role))"""


def labelled(spark, sf):
    return L.analyze(sentences(spark, sf))


query("lab_role_signals", f"WITH RECURSIVE {LABELS} SELECT video_id, sentence_id, role, interest, {_sigs} FROM labelled")(
    lambda spark, sf: labelled(spark, sf).select("video_id", "sentence_id", "role", "interest", *[f"sig_{n}" for n in L.SIGNALS])
)
query(
    "lab_analyze",
    f"WITH RECURSIVE {LABELS} SELECT video_id, sentence_id, start_ms, end_ms, text, role, interest, {_story} AS story_position, CASE WHEN role = 'generic' THEN 0.45 ELSE 0.62 END::DOUBLE AS confidence FROM labelled",
)(
    lambda spark, sf: labelled(spark, sf).select(
        "video_id", "sentence_id", "start_ms", "end_ms", "text", "role", "interest", "story_position", "confidence"
    )
)
query("lab_zoom_preset", f"WITH RECURSIVE {LABELS}, {MOTION} SELECT video_id, sentence_id, apply, {', '.join(_motion)} FROM moved")(
    lambda spark, sf: labelled(spark, sf).select("video_id", "sentence_id", "zoom.*")
)
query(
    "lab_story_patterns",
    f"""WITH RECURSIVE {LABELS}, n AS (SELECT video_id, sentence_id, role, lead(role) OVER v AS r1, lead(role, 2) OVER v AS r2 FROM labelled WINDOW v AS (PARTITION BY video_id ORDER BY sentence_id)),
t AS (SELECT video_id, sentence_id, 3 AS span, 'setup → reversal → reveal' AS pattern, 0.82::DOUBLE AS confidence FROM n WHERE role IN ('assumption', 'generic', 'emphasis')
   AND r1 IN ('contradiction', 'contrast', 'surprise', 'emotional_peak') AND r2 IN ('reveal', 'important_number', 'key_insight', 'story_climax')),
a AS (SELECT video_id, sentence_id, 2 AS span, 'question → answer' AS pattern, 0.8::DOUBLE AS confidence FROM n WHERE role = 'question' AND r2 IS NOT NULL AND r1 IN ('answer', 'reveal', 'key_insight')),
b AS (SELECT video_id, sentence_id, 2 AS span, 'question → answer' AS pattern, 0.78::DOUBLE AS confidence FROM n WHERE role = 'question' AND r1 IN ('answer', 'reveal', 'key_insight', 'important_number'))
SELECT * FROM t UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (video_id, sentence_id)""",
)(lambda spark, sf: L.story_patterns(labelled(spark, sf), hot_videos(spark, sf)))

_roles = ["reveal", "generic", "question", "warning", "story_climax"]


def annotations(spark, sf):
    """Model annotations from the labels table; doc_id names a sentence, and even ones come twice."""
    i = F.col("doc_id")
    base = table(spark, sf, "labels").select(
        (i % 100).alias("video_id"),
        F.floor(i / 100).alias("sentence_id"),
        F.explode(F.when(i % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("chunk_no"),
        pick(i, _roles).alias("role"),
        "quality",
        i.alias("i"),
    )
    return base.select(
        "video_id", "sentence_id", "chunk_no",
        F.when(F.col("chunk_no") == 1, F.lit("cta")).otherwise(F.col("role")).alias("role"),
        ((F.col("i") % 10) / 10).alias("interest"),
        F.lit("development").alias("story_position"),
        F.lit(0.9).alias("confidence"),
        F.when(F.col("quality") == 1, L.zoom_preset(F.lit("hook"))).alias("zoom"),
    )


query(
    "join_annotations",
    f"""WITH RECURSIVE {LABELS}, {MOTION},
a AS (SELECT doc_id % 100 AS video_id, doc_id // 100 AS sentence_id, {sql_pick('doc_id', _roles)} AS role, (doc_id % 10) / 10 AS interest, quality FROM labels)
SELECT m.video_id, m.sentence_id, m.start_ms, COALESCE(a.role, m.role) AS role, CASE WHEN a.role IS NULL THEN m.interest ELSE a.interest END AS interest,
 CASE WHEN a.role IS NULL THEN CASE WHEN m.role = 'generic' THEN 0.45 ELSE 0.62 END ELSE 0.9 END::DOUBLE AS confidence,
 CASE WHEN a.quality = 1 THEN 0.62 ELSE m.intensity END::DOUBLE AS intensity, a.role IS NOT NULL AS from_model FROM moved m LEFT JOIN a USING (video_id, sentence_id)""",
)(
    lambda spark, sf: L.merge_annotations(labelled(spark, sf), annotations(spark, sf)).select(
        "video_id", "sentence_id", "start_ms", "role", "interest", "confidence", "zoom.intensity", "from_model"
    )
)
_weights = "MAP {" + ", ".join(f"'{r}': {w}" for r, w in L.ROLE_WEIGHT.items()) + "}"
SCORES = f"""{LABELS}, {MOTION},
z0 AS (SELECT *, least(420 * ({_weights})[role] + 33 * round(interest * 1000)::BIGINT + 250 * round(greatest({_sigs}) * 100)::BIGINT, 100000) AS s,
  35 + CASE WHEN pause_before_ms >= 450 THEN 22 ELSE 0 END + CASE WHEN pause_after_ms >= 350 THEN 18 ELSE 0 END + CASE WHEN speaking_rate <= 2.2 THEN 12 ELSE 0 END AS p FROM moved),
z1 AS (SELECT *, least(55 * s + 25000 * 78 + 20000 * p, 10000000) AS b FROM z0),
scored AS (SELECT *, round_even(s / 100, 0) / 1000 AS semantic_score, 0.78::DOUBLE AS visual_score, p / 100 AS prosody_score, round_even(b / 10000, 0) / 1000 AS final_score,
  CASE WHEN NOT apply THEN 'motion.apply=false' WHEN role IN ('cta', 'generic', 'assumption') THEN 'role=' || role
   WHEN b < 4200000 AND role NOT IN ('reveal', 'story_climax', 'warning', 'hook', 'strong_opinion') THEN 'score ' || printf('%.2f', b / 10000000) || ' < 0.42'
   WHEN b < 3570000 THEN 'score ' || printf('%.2f', b / 10000000) || ' below priority floor' ELSE 'pass' END AS reason FROM z1)"""


def scored(spark, sf):
    return L.zoom_scores(labelled(spark, sf))


query(
    "score_zoom",
    f"WITH RECURSIVE {SCORES} SELECT video_id, sentence_id, semantic_score, visual_score, prosody_score, final_score, reason, CASE WHEN reason = 'pass' THEN 'apply' ELSE 'skip' END AS action FROM scored",
)(
    lambda spark, sf: scored(spark, sf).select(
        "video_id", "sentence_id", "semantic_score", "visual_score", "prosody_score", "final_score", "reason", "action"
    )
)
query(
    "score_safe_scale",
    """WITH b AS (SELECT l_orderkey, l_linenumber, 0.05 + l_discount * 9 AS w, 0.05 + l_tax * 11 AS h, l_quantity / 50 AS i FROM lineitem),
s AS (SELECT *, round_even(least(0.8 / greatest(w, 0.25), 0.8 / greatest(h, 0.25), 1.35), 3) AS max_safe FROM (SELECT l_orderkey, l_linenumber, w::DOUBLE AS w, h::DOUBLE AS h, i::DOUBLE AS i FROM b))
SELECT l_orderkey, l_linenumber, max_safe, CASE WHEN i <= 0.02 THEN 1.0 ELSE round_even(1.0 + greatest(0.0, max_safe - 1.0) * i, 3) END::DOUBLE AS scale FROM s""",
)(
    lambda spark, sf: table(spark, sf, "lineitem")
    .select(
        "l_orderkey",
        "l_linenumber",
        L.max_safe_scale((0.05 + F.col("l_discount") * 9).cast("double"), (0.05 + F.col("l_tax") * 11).cast("double")).alias("max_safe"),
        (F.col("l_quantity") / 50).cast("double").alias("i"),
    )
    .select("l_orderkey", "l_linenumber", "max_safe", L.scale_from_intensity(F.col("i"), F.col("max_safe")).alias("scale"))
)
query(
    "lab_fallback_query",
    f"""WITH {SEGMENTS}, f AS (SELECT video_id, segment_id, txt, list_filter(regexp_extract_all(txt, '[A-Za-z][A-Za-z0-9.+-]{{2,}}'), lambda w: NOT list_contains({sql_list(M.QUERY_STOPWORDS)}, lower(w))) AS ws FROM segments),
d AS (SELECT video_id, segment_id, txt, list_filter(list_transform(ws, lambda w, i: CASE WHEN list_position(list_transform(ws, lambda x: lower(x)), lower(w)) = i THEN w END), lambda w: w IS NOT NULL)[1:6] AS ks FROM f),
c AS (SELECT video_id, segment_id, CASE WHEN len(ks) > 0 THEN array_to_string(ks, ' ') ELSE trim(txt)[1:80] END AS core FROM d)
SELECT video_id, segment_id, core || unnest([' 2025', ' news', ' Wikimedia Commons']) AS query FROM c""",
)(
    lambda spark, sf: segments(spark, sf).select(
        "video_id", "segment_id", F.explode(M.fallback_queries(F.col("txt"), 2025, 3)).alias("query")
    )
)
