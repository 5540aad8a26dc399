"""Sources, sinks, model answers, audio hops and streams, on documents derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxtable.catalog.base import SEGMENTS, WORDS, lit, pick, segments, sql_list, sql_pick, table, words
from voxtable.catalog.caption_queries import ACCENTS, CAPS, DUR, LINES, caps, durations, lines, raw_beats
from voxtable.catalog.check_queries import notes, seg_words
from voxtable.catalog.media_queries import REVIEWED, reviewed
from voxtable.catalog.registry import query
from voxtable.catalog.speech_queries import TIMED, hot_videos, timed_segments
from voxtable.catalog.text_queries import sql_clip, sql_stabilize_cte, sql_tokens
from voxtable.functions import text as X
from voxtable.operators import acoustics as A
from voxtable.operators import gates as G
from voxtable.plans import cues as C
from voxtable.sources import files, model_json as MJ, sinks, transcripts as TR
from voxtable.session import shared_folder
from voxtable.streaming import live


# --- transcripts ----------------------------------------------------------------------------------

def json_docs(spark, sf):
    """One JSON transcript per video, written by Spark from the words and read back with the schema."""
    w = seg_words(spark, sf)
    seg = F.struct(
        F.col("segment_id"),
        (F.get("words", F.lit(0))["start_ms"] / 1000).alias("start"),
        (F.element_at("words", -1)["end_ms"] / 1000).alias("end"),
        F.col("text"),
        F.transform("words", lambda x: F.struct(x["text"].alias("word"), (x["start_ms"] / 1000).alias("start"), (x["end_ms"] / 1000).alias("end"))).alias("words"),
    )
    docs = w.groupBy("video_id").agg(F.to_json(F.struct(F.lit("fr").alias("language"), F.array_sort(F.collect_list(seg)).alias("segments"))).alias("body"))
    return docs.select("video_id", F.from_json("body", TR.SCHEMA).alias("d")).select("video_id", "d.*")


query(
    "src_transcript_json",
    f"WITH {WORDS} SELECT video_id, segment_id, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY word_id) - 1 AS position, word, start_ms, end_ms, 0.0::DOUBLE AS probability FROM words",
)(lambda spark, sf: TR.json_words(json_docs(spark, sf), "video_id"))


def markdown_docs(spark, sf):
    """Turns as timestamped blocks; the bare first range, prefaces and empty blocks all occur."""
    s = timed_segments(spark, sf).join(segments(spark, sf), ["video_id", "segment_id"])
    clock = lambda ms: F.format_string("%02d:%02d", F.floor(F.floor(ms / 1000) / 60) % 60, F.floor(ms / 1000) % 60)
    span = F.concat(clock(F.col("start_ms")), F.lit(" - "), clock(F.col("end_ms")))
    head = F.when((F.col("segment_id") == 0) & (F.col("video_id") % 2 == 0), span).otherwise(F.concat(F.lit("**"), span, F.lit("**")))
    body = F.when((F.col("video_id") + F.col("segment_id")) % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Here is the timestamped text\n  "), F.replace("txt", F.lit("*"), F.lit("")), F.lit("\n05:00 - 06:00")))
    block = F.concat(head, F.lit("\n"), body, F.lit("\n"))
    return s.groupBy("video_id").agg(
        F.concat(F.lit("intro\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", block.alias("b")))), lambda x: x["b"]), "\n")).alias("text")
    )


_sec = lambda c: f"({c} // 1000) % 3600 * 1000"
query(
    "src_transcript_markdown",
    f"""WITH {TIMED}, s AS (SELECT video_id, segment_id, start_ms, end_ms, replace(txt, '*', '') AS txt FROM timed JOIN segments USING (video_id, segment_id)),
l AS (SELECT video_id, segment_id, start_ms, end_ms, unnest(string_split(txt, chr(10))) AS line, unnest(range(len(string_split(txt, chr(10))))) AS n FROM s WHERE (video_id + segment_id) % 9 <> 0),
b AS (SELECT video_id, segment_id, {_sec('start_ms')} AS start_ms, greatest({_sec('end_ms')}, {_sec('start_ms')} + 200) AS end_ms, string_agg(trim(line), ' ' ORDER BY n) FILTER (WHERE trim(line) <> '') || ' 05:00 - 06:00' AS text FROM l GROUP BY ALL)
SELECT video_id, segment_id AS block, start_ms, greatest(end_ms, start_ms + 120 * len(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda t: trim(t, '.,;:!?"“”()[]{{}}')), lambda t: t NOT IN ('', '—', '–', '-')))) AS end_ms, text FROM b""",
)(lambda spark, sf: TR.markdown_segments(markdown_docs(spark, sf), "video_id"))
query(
    "src_markdown_words",
    f"""WITH {TIMED}, s AS (SELECT video_id, segment_id, start_ms, end_ms, replace(txt, '*', '') AS txt FROM timed JOIN segments USING (video_id, segment_id)),
l AS (SELECT video_id, segment_id, start_ms, end_ms, unnest(string_split(txt, chr(10))) AS line, unnest(range(len(string_split(txt, chr(10))))) AS n FROM s WHERE (video_id + segment_id) % 9 <> 0),
b AS (SELECT video_id, segment_id, {_sec('start_ms')} AS start_ms, greatest({_sec('end_ms')}, {_sec('start_ms')} + 200) AS end_ms, string_agg(trim(line), ' ' ORDER BY n) FILTER (WHERE trim(line) <> '') || ' 05:00 - 06:00' AS text FROM l GROUP BY ALL),
t AS (SELECT video_id, segment_id AS block, start_ms, end_ms AS range_end, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda t: trim(t, '.,;:!?"“”()[]{{}}')), lambda t: t NOT IN ('', '—', '–', '-')) AS toks FROM b),
n AS (SELECT *, len(toks) AS n, greatest(range_end, start_ms + 120 * len(toks)) AS end_ms FROM t),
u AS (SELECT video_id, block, start_ms, end_ms, n, greatest(end_ms - start_ms, 120 * n) AS span, unnest(toks) AS word, unnest(range(n)) AS position FROM n)
SELECT video_id, block, position, word, CAST(round_even(start_ms + span * position / n, 0) AS BIGINT) AS start_ms,
  greatest(CAST(round_even(greatest(start_ms + span * (position + 1) / n, start_ms + span * position / n + 60), 0) AS BIGINT), CASE WHEN position = n - 1 THEN end_ms ELSE 0 END) AS end_ms FROM u""",
)(lambda spark, sf: TR.markdown_words(TR.markdown_segments(markdown_docs(spark, sf), "video_id"), "video_id"))

query(
    "src_markdown_rejects",
    f"WITH {SEGMENTS} SELECT video_id FROM segments GROUP BY video_id HAVING count(*) FILTER (WHERE (video_id + segment_id) % 9 <> 0) = 0 OR video_id % 5 = 1",
)(
    lambda spark, sf: TR.markdown_rejects(markdown_docs(spark, sf).withColumn("text", F.when(F.col("video_id") % 5 == 1, F.replace("text", F.lit(":"), F.lit("."))).otherwise(F.col("text"))), "video_id")
)

# --- binary files ---------------------------------------------------------------------------------

def _le(n, size):
    """Little-endian bytes of a number."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.floor(n / 256**k).cast("bigint") % 256), 2, "0")) for k in range(size)])


def wav_files(spark, sf):
    """Page bytes wrapped as 1 kHz PCM; every tenth is 8-bit and every eleventh is cut off, to be rejected."""
    body = F.col("html").cast("binary")
    body = F.substring(body, F.lit(1), (F.floor(F.octet_length(body) / 2) * 2).cast("int"))
    n, width, rate = F.octet_length(body), F.when(F.col("page_id") % 10 == 3, 1).otherwise(2), F.lit(1000)
    head = F.concat(
        F.unhex(F.lit("52494646")), _le(36 + n, 4), F.unhex(F.lit("57415645666D7420")), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(F.lit(1), 2),
        _le(rate, 4), _le(rate * width, 4), _le(width, 2), _le(width * 8, 2), F.unhex(F.lit("64617461")), _le(n, 4),
    )
    whole = F.concat(head, body)
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("video_id"), F.when(F.col("page_id") % 11 == 5, F.substring(whole, 1, 20)).otherwise(whole).alias("content")
    )


query("src_pcm_wav")(
    lambda spark, sf: A.loudness_hops(files.pcm_chunks(wav_files(spark, sf), "video_id").filter("problem IS NULL"))
)
query("src_pcm_rejects", "SELECT page_id AS video_id FROM pages WHERE page_id % 10 = 3 OR page_id % 11 = 5")(
    lambda spark, sf: files.pcm_chunks(wav_files(spark, sf), "video_id").filter("problem IS NOT NULL").select("video_id")
)
_heads = ["FFD8FFE0", "89504E470D0A", "474946383961", "524946460000000057454250", "000000186674797069736F6D", "1A45DFA3", "", "3C7376673E", "00112233"]
_types = ["image/jpeg", "image/png", "image/gif", "image/webp", "video/mp4", "video/webm", "text/html", "image/svg+xml", None]
query(
    "src_file_probe",
    f"SELECT page_id, COALESCE({sql_pick('page_id', [t or '' for t in _types])}, '') AS m, octet_length(encode(html)) AS bytes FROM pages WHERE page_id % 9 <> 8 UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'video/quicktime' ELSE 'application/octet-stream' END, octet_length(encode(html)) FROM pages WHERE page_id % 9 = 8",
)(
    lambda spark, sf: table(spark, sf, "pages").select(
        "page_id",
        files.sniff_mime(
            F.concat(F.unhex(pick(F.col("page_id"), _heads)), F.col("html").cast("binary")),
            F.when(F.col("page_id") % 2 == 0, F.lit("/x/a.MOV")).otherwise(F.lit("/x/a.bin")),
        ).alias("m"),
        F.octet_length("html").cast("bigint").alias("bytes"),
    )
)
_states = ["uploaded", "rendering", "bogus", "failed"]


def job_docs(spark, sf):
    i = F.col("event_id")
    body = F.to_json(
        F.struct(
            F.when(i % 13 != 0, F.concat(F.lit("job"), i.cast("string"))).alias("job_id"),
            F.when(i % 3 != 0, pick(i, _states)).alias("status"),
            F.when(i % 5 == 0, F.lit(33)).alias("progress"),
            F.col("event_type").alias("theme"),
            F.create_map(F.lit("total_ms"), F.col("user_id").cast("string")).alias("metrics"),
        )
    )
    docs = table(spark, sf, "events").select(F.when(i % 17 == 0, F.lit("{broken")).otherwise(body).alias("body"))
    return docs.select(F.from_json("body", files.JOB_SCHEMA, {"mode": "PERMISSIVE"}).alias("j")).select("j.*")


query(
    "src_job_manifests",
    f"""WITH j AS (SELECT 'job' || event_id AS job_id, CASE WHEN event_id % 3 <> 0 THEN {sql_pick('event_id', _states)} ELSE 'uploaded' END AS status, event_id, event_type, user_id FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)
SELECT job_id, status, status AS stage, CASE WHEN event_id % 5 = 0 THEN 33 WHEN status = 'uploaded' THEN 5 WHEN status = 'rendering' THEN 90 ELSE 100 END AS progress, event_type AS theme, 'video' AS kind, user_id::VARCHAR AS total_ms FROM j WHERE status <> 'bogus'""",
)(
    lambda spark, sf: files.complete_jobs(job_docs(spark, sf)).select(
        "job_id", "status", "stage", "progress", "theme", "kind", F.col("metrics")["total_ms"].alias("total_ms")
    )
)

# --- model answers --------------------------------------------------------------------------------

def answers(spark, sf):
    """Model texts around JSON: bare, fenced, buried in prose, or broken."""
    i = F.col("video_id") * 3 + F.col("segment_id")
    title = F.regexp_replace("txt", r'[\\"\n]', " ")
    body = F.concat(
        F.lit('{"graphics":[{"kind":"'), pick(i, ["stat", "process", "weird", "vs_split"]), F.lit('","start":'), (i % 40).cast("string"), F.lit(',"end":'), (i % 40 + i % 7).cast("string"),
        F.lit(',"title":"'), title, F.lit('","icon":"🧠","bullets":["one bullet here","'), title, F.lit('","three"],"chips":["chip one"," "]},{"title":" "}],'),
        F.lit('"sfx":[{"at":1.5,"kind":"hit","reason":"why"},{"at":2,"kind":"beep"}],"segments":[{"id":'), (F.col("segment_id") - 1).cast("string"),
        F.lit(',"text":" fixed ","lines":["first line",{"text":"second"},""]}],"topics":[{"event":" ","queries":[" q1 ","","q2"]},{"event":"ev","media_need":" logo "},{"event":""}]}'),
    )
    raw = (
        F.when(i % 4 == 0, body)
        .when(i % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(i % 4 == 2, F.concat(F.lit("Sure! "), body, F.lit(" Done.")))
        .otherwise(F.concat(F.lit("no json "), F.col("speaker")))
    )
    return segments(spark, sf).select(
        "video_id", F.col("segment_id").alias("answer_no"), raw.alias("raw"), F.lit(30_000).cast("bigint").alias("duration_ms"), F.lit(4).alias("n_segments")
    )


_ai = "(video_id * 3 + segment_id)"
ANSWERS = f"{SEGMENTS}, ok AS (SELECT *, {_ai} AS i FROM segments WHERE {_ai} % 4 <> 3)"
query(
    "src_llm_json",
    f"WITH {SEGMENTS} SELECT video_id, segment_id AS answer_no, {_ai} % 4 <> 3 AS found, CASE WHEN {_ai} % 4 <> 3 THEN {sql_pick(_ai, ['stat', 'process', 'weird', 'vs_split'])} END AS kind FROM segments",
)(
    lambda spark, sf: answers(spark, sf).select(
        "video_id", "answer_no", MJ.json_text(F.col("raw")).isNotNull().alias("found"), F.get_json_object(MJ.json_text(F.col("raw")), "$.graphics[0].kind").alias("kind")
    )
)
query(
    "lab_payload_beats",
    f"""WITH {ANSWERS}, t AS (SELECT video_id, segment_id, i, regexp_replace(txt, '[\\\\"\\n]', ' ', 'g') AS txt, {sql_pick('i', ['stat', 'process', 'bullets', 'vs_split'])} AS kind, (i % 40) * 1000 AS s, least(CASE WHEN i % 40 + i % 7 = 0 THEN (i % 40 + 6) * 1000 ELSE (i % 40 + i % 7) * 1000 END, 30000) AS e FROM ok),
{sql_stabilize_cte('t', 'ts', 'txt', 'video_id, segment_id, i, kind, s, e')}
SELECT video_id, segment_id AS answer_no, s AS start_ms, e AS end_ms, kind, {sql_clip('st', 40)} AS title, 'brain' AS glyph, CASE kind WHEN 'stat' THEN 'scale_in' ELSE 'slide_up' END AS motion, 'chip one' AS chips,
 CASE kind WHEN 'vs_split' THEN '' WHEN 'bullets' THEN 'one bullet here|' || {sql_clip('st', 32)} ELSE 'one bullet here' END AS bullets FROM ts WHERE e - s >= 1200""",
)(
    lambda spark, sf: MJ.card_beats(answers(spark, sf)).select(
        "video_id", "answer_no", "start_ms", "end_ms", "kind", "title", "glyph", "motion", F.array_join("chips", "|").alias("chips"), F.array_join("bullets", "|").alias("bullets")
    )
)
query(
    "lab_payload_small",
    f"""WITH {ANSWERS} SELECT 'cue' AS what, video_id, segment_id AS answer_no, 'hit 1500 why' AS got FROM ok
UNION ALL SELECT 'repair', video_id, segment_id - 1, 'fixed' FROM ok WHERE segment_id BETWEEN 1 AND 4
UNION ALL SELECT 'line', video_id, segment_id, unnest(['first line', 'second']) FROM ok
UNION ALL SELECT 'topic', video_id, segment_id, unnest(['q1/q1,q2/', 'ev//logo']) FROM ok""",
)(lambda spark, sf: small_payloads(spark, sf))


def small_payloads(spark, sf):
    a = answers(spark, sf)
    cues = MJ.cue_rows(a).select(F.lit("cue").alias("what"), "video_id", F.shiftright("ord", 32).alias("answer_no"), F.concat_ws(" ", "kind", F.col("at_ms").cast("string"), "reason").alias("got"))
    reps = MJ.repair_rows(a).select(F.lit("repair").alias("what"), "video_id", F.col("segment_id").alias("answer_no"), F.col("text").alias("got"))
    rows = MJ.script_line_rows(a).select(F.lit("line").alias("what"), "video_id", "answer_no", F.col("text").alias("got"))
    tops = MJ.topic_rows(a, 4).select(F.lit("topic").alias("what"), "video_id", "answer_no", F.concat_ws("/", "event", F.array_join("queries", ","), "media_need").alias("got"))
    return cues.unionByName(reps).unionByName(rows).unionByName(tops)


# --- audio hops -----------------------------------------------------------------------------------
query(
    "agg_loudness_hops",
    """WITH h AS (SELECT l_orderkey % 100 AS video_id, l_orderkey AS hop_id, sum(l_quantity::BIGINT * l_quantity::BIGINT)::DOUBLE AS s, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT video_id, hop_id, hop_id * 200 AS t_ms, round(20000 * log10(sqrt(s / n + 1e-12) + 1e-9))::BIGINT AS mdb FROM h WHERE n = 4
UNION ALL SELECT video_id, 0, 0, -60000 FROM h GROUP BY video_id HAVING count(*) FILTER (WHERE n = 4) = 0""",
)(
    lambda spark, sf: A.loudness_hops(
        table(spark, sf, "lineitem").select(
            (F.col("l_orderkey") % 100).alias("video_id"), F.col("l_orderkey").alias("hop_id"),
            (F.col("l_quantity").cast("bigint") * F.col("l_quantity").cast("bigint")).alias("sum_sq"), F.lit(1).alias("n"), F.lit(4).alias("hop_size"),
        )
    )
)

# --- sinks ----------------------------------------------------------------------------------------

def plans(spark, sf):
    moods = durations(spark, sf).select("video_id", pick(F.col("video_id"), ["focused_tech", "calm_reflective"]).alias("music_mood")).filter("video_id % 3 <> 0")
    beats = raw_beats(spark, sf).withColumn("kind", F.lit("bullets"))
    return sinks.edit_plans(caps(spark, sf), beats, C.plan_accents(caps(spark, sf), durations(spark, sf), hot=hot_videos(spark, sf)), moods)


query(
    "sink_edit_plan",
    f"""WITH RECURSIVE {ACCENTS} SELECT c.video_id, c.n_captions, c.texts, c.starts, b.n_graphics, b.cards, s.n_sfx, s.sounds,
  CASE WHEN c.video_id % 3 = 0 THEN 'warm_inspiring' ELSE {sql_pick('c.video_id', ['focused_tech', 'calm_reflective'])} END AS music_mood
FROM (SELECT video_id, count(*) AS n_captions, sha256(string_agg(text, chr(10) ORDER BY start_ms, end_ms, text)) AS texts, string_agg(start_ms, ',' ORDER BY start_ms, end_ms, text) AS starts FROM caps GROUP BY ALL) c
LEFT JOIN (SELECT video_id, count(*) AS n_graphics, string_agg(start_ms, ',' ORDER BY start_ms) AS cards FROM caps GROUP BY ALL) b USING (video_id)
LEFT JOIN (SELECT video_id, count(*) AS n_sfx, string_agg(at_ms || kind, ',' ORDER BY at_ms, kind) AS sounds FROM accents GROUP BY ALL) s USING (video_id)""",
)(
    lambda spark, sf: plans(spark, sf).select(
        "video_id", F.size("captions").cast("bigint").alias("n_captions"), F.sha2(F.array_join(F.transform("captions", lambda c: c["text"]), "\n").cast("binary"), 256).alias("texts"),
        F.array_join(F.transform("captions", lambda c: c["start_ms"].cast("string")), ",").alias("starts"), F.size("graphics").cast("bigint").alias("n_graphics"),
        F.array_join(F.transform("graphics", lambda c: c["start_ms"].cast("string")), ",").alias("cards"), F.size("sfx").cast("bigint").alias("n_sfx"),
        F.array_join(F.transform("sfx", lambda c: F.concat(c["at_ms"].cast("string"), c["kind"])), ",").alias("sounds"), "music_mood",
    )
)
query(
    "sink_design_rows",
    f"""WITH {LINES}, n AS (SELECT doc_id % 100 AS video_id, doc_id // 100 AS line_id, quality * 5 - 1 AS w, {sql_pick('doc_id', ['Payoff', 'term', 'bogus'])} AS k FROM labels)
SELECT l.video_id, l.line_id, text, style, CASE WHEN w IS NULL THEN '' ELSE ' key ' END AS key, COALESCE(w, 1) AS weight, COALESCE(k, 'normal') AS kind FROM lines l LEFT JOIN n USING (video_id, line_id)""",
)(
    lambda spark, sf: sinks.design_rows(lines(spark, sf).select("video_id", "line_id", "text", "style"), notes(spark, sf)).select(
        "video_id", "line_id", "text", "style", "key", "weight", "kind"
    )
)
query(
    "sink_manifest",
    f"""WITH {REVIEWED}, b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ordinal) AS p FROM reviewed WHERE action = 'blocked')
SELECT 'accepted' AS section, job_id, ordinal, title, kind, url FROM reviewed WHERE action = 'accepted' UNION ALL SELECT 'blocked_copyrighted', job_id, ordinal, title, kind, url FROM b WHERE p <= 40
UNION ALL SELECT 'copyrighted_not_downloaded', job_id, ordinal, title, kind, url FROM b WHERE p <= 30""",
)(lambda spark, sf: sinks.manifest_rows(reviewed(spark, sf)))

# --- streams --------------------------------------------------------------------------------------

def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _landed(spark, stream, reduce):
    home = f"{shared_folder(spark)}/voxtable-{uuid.uuid4().hex}"
    return live.land(stream, reduce, f"{home}/out", f"{home}/state")


STAMPED = "SELECT user_id % 100 AS video_id, event_id, value, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events"
query(
    "stream_loudness",
    f"""WITH e AS ({STAMPED}) SELECT video_id, make_timestamp(us - us % 200000) AS ts, count(*) AS n,
  CAST(round(20000 * log10(sqrt(sum(value * value) / count(*) + 1e-12) + 1e-9)) AS BIGINT) AS mdb FROM e GROUP BY 1, 2""",
)(
    lambda spark, sf: live.loudness(
        _landed(spark, event_stream(spark, sf).select((F.col("user_id") % 100).alias("video_id"), "ts", (F.col("value") * F.col("value")).alias("sq")), live.hop_sums)
    )
)
query(
    "stream_pause_sessions",
    f"""WITH e AS ({STAMPED}), o AS (SELECT *, CASE WHEN us - max(us + 300000000) OVER (PARTITION BY video_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 450000 THEN 0 ELSE 1 END AS opens FROM e),
r AS (SELECT video_id, us, sum(CASE WHEN first THEN opens ELSE 0 END) OVER (PARTITION BY video_id ORDER BY us) AS run FROM (SELECT *, row_number() OVER (PARTITION BY video_id, us) = 1 AS first FROM o))
SELECT video_id, count(*) AS n_words, make_timestamp(min(us)) AS first_ts, make_timestamp(max(us)) AS last_ts FROM r GROUP BY video_id, run""",
)(
    lambda spark, sf: live.pause_sessions(
        _landed(spark, event_stream(spark, sf).select((F.col("user_id") % 100).alias("video_id"), "ts", F.lit(300_000).cast("bigint").alias("dur_ms")), live.word_runs)
    )
)
query(
    "stream_gap_gate",
    f"""WITH RECURSIVE e AS (SELECT video_id, us // 1000 AS ms, min(event_id) AS caption_id, arg_min(us, event_id) AS us FROM ({STAMPED}) GROUP BY 1, 2),
n AS (SELECT e.video_id, e.ms, min(f.ms) AS later FROM e JOIN e f ON e.video_id = f.video_id AND e.ms + 600000 <= f.ms GROUP BY 1, 2),
p AS (SELECT video_id, min(ms) AS ms FROM e GROUP BY 1 UNION ALL SELECT n.video_id, n.later FROM p JOIN n ON p.video_id = n.video_id AND p.ms = n.ms)
SELECT e.video_id, caption_id, make_timestamp(us) AS ts FROM p JOIN e ON p.video_id = e.video_id AND p.ms = e.ms""",
)(
    lambda spark, sf: live.gap_gate(
        _landed(spark, event_stream(spark, sf).select((F.col("user_id") % 100).alias("video_id"), F.col("event_id").alias("caption_id"), "ts"), live.gate_rows), 600_000
    )
)
