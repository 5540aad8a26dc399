"""Caption groups, merges, splits, design rules and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.catalog.base import SEGMENTS, WORDS, lit, pick, placed_turns, segments, sql_list, sql_pick, table, word_start, words
from voxtable.catalog.caption_queries import CAPS, LINES, TREATS, caps, flat_words, lines, sql_caps, durations
from voxtable.catalog.check_queries import scripts, seg_words
from voxtable.catalog.registry import query
from voxtable.catalog.speech_queries import hot_videos
from voxtable.catalog.text_queries import sql_tokens
from voxtable.functions import text as X
from voxtable.operators import align as A
from voxtable.operators import lines as N
from voxtable.operators import segment as S
from voxtable.operators import styles as Y
from voxtable.session import once

query("seg_caption_groups")(lambda spark, sf: S.caption_groups(words(spark, sf), hot=hot_videos(spark, sf)))
query(
    "seg_time_slice",
    f"""WITH RECURSIVE {WORDS}, g AS (SELECT *, word_id // 40 AS grp, row_number() OVER (PARTITION BY video_id, word_id // 40 ORDER BY word_id) AS k FROM words),
m AS MATERIALIZED (SELECT * FROM g), w AS (SELECT video_id, grp, k, word_id, start_ms AS since, 0::BIGINT AS slice_id FROM m WHERE k = 1
 UNION ALL SELECT m.video_id, m.grp, m.k, m.word_id, CASE WHEN m.end_ms - w.since > 3800 THEN m.start_ms ELSE w.since END, w.slice_id + CASE WHEN m.end_ms - w.since > 3800 THEN 1 ELSE 0 END
 FROM w JOIN m ON m.video_id = w.video_id AND m.grp = w.grp AND m.k = w.k + 1) SELECT video_id, grp, word_id, slice_id FROM w""",
)(
    lambda spark, sf: S.time_slices(words(spark, sf).withColumn("grp", F.floor(F.col("word_id") / 40)), ["video_id", "grp"], hot_videos(spark, sf))
)


def long_caps(spark, sf):
    """Captions of 3 or, every fourth, 24 words."""
    w = words(spark, sf)
    block = F.floor(F.col("word_id") / 24)
    cid = F.when(block % 4 == 0, block * 24).otherwise(F.floor(F.col("word_id") / 3) * 3)
    return w.select("video_id", cid.alias("caption_id"), "word_id", F.col("word").alias("text"), "start_ms", "end_ms", (F.col("word_id") % 5 == 0).alias("emphasis"))


query("seg_explode_captions")(
    lambda spark, sf: flat_words(
        N.explode_long(
            long_caps(spark, sf),
            long_caps(spark, sf).select("video_id", "caption_id").distinct().withColumn("treatment", pick(F.col("caption_id"), TREATS)),
            hot_videos(spark, sf),
        )
    )
)


def tiny_caps(spark, sf):
    return caps(spark, sf, 2)


query(
    "seg_coalesce_short",
    f"""WITH RECURSIVE {WORDS}, {sql_caps(2)}, s AS MATERIALIZED (SELECT *, len({sql_tokens('text')}) AS n FROM caps),
w AS (SELECT video_id, caption_id, caption_id AS head, end_ms, n, treatment FROM s WHERE caption_id = 0
 UNION ALL SELECT s.video_id, s.caption_id, CASE WHEN (w.n <= 2 OR s.n <= 2) AND s.start_ms - w.end_ms <= 550 AND w.n + s.n <= 4 THEN w.head ELSE s.caption_id END,
  CASE WHEN (w.n <= 2 OR s.n <= 2) AND s.start_ms - w.end_ms <= 550 AND w.n + s.n <= 4 THEN greatest(w.end_ms, s.end_ms) ELSE s.end_ms END,
  CASE WHEN (w.n <= 2 OR s.n <= 2) AND s.start_ms - w.end_ms <= 550 AND w.n + s.n <= 4 THEN w.n + s.n ELSE s.n END,
  CASE WHEN (w.n <= 2 OR s.n <= 2) AND s.start_ms - w.end_ms <= 550 AND w.n + s.n <= 4 THEN CASE WHEN s.treatment IN ('oval', 'blob', 'underline') OR (s.treatment = 'mix' AND w.treatment = 'plain') THEN s.treatment ELSE w.treatment END ELSE s.treatment END
 FROM w JOIN s ON s.video_id = w.video_id AND s.caption_id = w.caption_id + 1)
SELECT w.video_id, head AS caption_id, min(s.start_ms) AS start_ms, max(s.end_ms) AS end_ms, string_agg(s.text, ' ' ORDER BY w.caption_id) AS text, arg_max(w.treatment, w.caption_id) AS treatment
FROM w JOIN s ON s.video_id = w.video_id AND s.caption_id = w.caption_id GROUP BY ALL""",
)(
    lambda spark, sf: N.coalesce_short(tiny_caps(spark, sf), hot_videos(spark, sf)).select(
        "video_id", "caption_id", "start_ms", "end_ms", "text", "treatment"
    )
)
query("plan_captions_rules")(
    lambda spark, sf: N.plan_captions(words(spark, sf), hot_videos(spark, sf)).select("video_id", "caption_id", "start_ms", "end_ms", "text", "treatment")
)
query(
    "seg_wrap_lines",
    f"""WITH RECURSIVE {WORDS}, {sql_caps(8)}, t AS MATERIALIZED (SELECT video_id, caption_id, width, {sql_tokens('text')} AS ts FROM caps, (SELECT unnest(range(10, 27, 2)) AS width)),
w AS (SELECT video_id, caption_id, width, ts, 1 AS k, length(ts[1]) AS used, 0 AS line FROM t
 UNION ALL SELECT video_id, caption_id, width, ts, k + 1, CASE WHEN used + 1 + length(ts[k + 1]) > width THEN length(ts[k + 1]) ELSE used + 1 + length(ts[k + 1]) END,
  line + CASE WHEN used + 1 + length(ts[k + 1]) > width THEN 1 ELSE 0 END FROM w WHERE k < len(ts)),
s AS (SELECT video_id, caption_id, width, max(line) AS top, list(line ORDER BY k) AS spots FROM w GROUP BY ALL)
SELECT video_id, caption_id, array_to_string(COALESCE(arg_min(spots, width) FILTER (WHERE top < 3), arg_max(spots, width)), ',') AS wrapped FROM s GROUP BY ALL""",
)(
    lambda spark, sf: caps(spark, sf, 8).select(
        "video_id", "caption_id", F.array_join(F.transform(N.wrap_lines(F.col("text"), 10), lambda x: x.cast("string")), ",").alias("wrapped")
    )
)


def messy_ranges(spark, sf):
    """Word ranges with overlaps and gaps."""
    i = F.col("line_id")
    return lines(spark, sf).select("video_id", "line_id", (i * 4 + i % 3 - 1).alias("first"), (i * 4 + i % 3 - 1 + i % 5).alias("last"))


def word_counts(spark, sf):
    return words(spark, sf).groupBy("video_id").agg((F.max("word_id") + 1).alias("n_words"))


query(
    "seg_cover_ranges",
    f"""WITH RECURSIVE {LINES}, nw AS (SELECT video_id, max(word_id) + 1 AS n_words FROM words GROUP BY ALL),
r AS MATERIALIZED (SELECT video_id, line_id, line_id * 4 + line_id % 3 - 1 AS first, line_id * 4 + line_id % 3 - 1 + line_id % 5 AS last, n_words, row_number() OVER (PARTITION BY video_id ORDER BY line_id * 4 + line_id % 3 - 1, line_id * 4 + line_id % 3 - 1 + line_id % 5, line_id) AS k FROM lines JOIN nw USING (video_id)),
w AS (SELECT DISTINCT video_id, 0::BIGINT AS k, 0::BIGINT AS cursor, NULL::BIGINT AS line_id, NULL::BIGINT AS f, n_words FROM r
 UNION ALL SELECT r.video_id, r.k, CASE WHEN greatest(r.first, w.cursor) > r.n_words - 1 THEN w.cursor ELSE least(greatest(r.last, greatest(r.first, w.cursor)), r.n_words - 1) + 1 END,
  CASE WHEN greatest(r.first, w.cursor) > r.n_words - 1 THEN NULL ELSE r.line_id END, greatest(r.first, w.cursor), r.n_words FROM w JOIN r ON r.video_id = w.video_id AND r.k = w.k + 1),
ok AS (SELECT * FROM w WHERE line_id IS NOT NULL)
SELECT video_id, line_id, CASE WHEN lag(f) OVER v IS NULL THEN 0 ELSE f END AS first, COALESCE(lead(f) OVER v, n_words) - 1 AS last FROM ok WINDOW v AS (PARTITION BY video_id ORDER BY k)""",
)(lambda spark, sf: S.cover_ranges(messy_ranges(spark, sf), word_counts(spark, sf), hot_videos(spark, sf)))
query(
    "seg_allocate_counts",
    f"""WITH {CAPS}, b AS (SELECT video_id, caption_id // 5 AS grp, caption_id, len(ws) AS w, (caption_id // 5 * 7 + video_id) % 23 AS total FROM caps),
s AS (SELECT *, sum(w) OVER (PARTITION BY video_id, grp) AS sw FROM b), f AS (SELECT *, total * w // sw AS fl, total * w % sw AS rest FROM s),
l AS (SELECT *, total - sum(fl) OVER (PARTITION BY video_id, grp) AS lft, row_number() OVER (PARTITION BY video_id, grp ORDER BY rest DESC, caption_id) AS p FROM f)
SELECT video_id, grp, caption_id, fl + CASE WHEN p <= lft THEN 1 ELSE 0 END AS share FROM l""",
)(
    lambda spark, sf: S.allocate_counts(
        caps(spark, sf).select(
            "video_id", F.floor(F.col("caption_id") / 5).alias("grp"), "caption_id", F.size("words").alias("w"),
            ((F.floor(F.col("caption_id") / 5) * 7 + F.col("video_id")) % 23).alias("total"),
        ),
        ["video_id", "grp"], "caption_id", "total", "w",
    ).select("video_id", "grp", "caption_id", "share")
)


def model_groups(spark, sf):
    i = F.col("line_id")
    return lines(spark, sf).select(
        "video_id", (i * 2 + i % 2).alias("group_no"), (i * 4 + i % 6).alias("hi"),
        F.when(i % 3 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"), F.col("style").alias("treatment"),
    )


query(
    "seg_id_ranges",
    f"""WITH RECURSIVE {LINES}, g AS MATERIALIZED (SELECT video_id, line_id, line_id * 2 + line_id % 2 AS group_no, line_id * 4 + line_id % 6 AS hi FROM lines),
w AS (SELECT video_id, line_id, group_no, 0::BIGINT AS lo, hi FROM g WHERE line_id = 0 UNION ALL SELECT g.video_id, g.line_id, g.group_no, w.hi + 1, greatest(g.hi, w.hi + 1) FROM w JOIN g ON g.video_id = w.video_id AND g.line_id = w.line_id + 1) SELECT video_id, group_no, lo, hi FROM w""",
)(lambda spark, sf: N.cover_groups(model_groups(spark, sf), hot_videos(spark, sf)).select("video_id", "group_no", "lo", "hi"))
query("seg_ids_to_captions")(lambda spark, sf: N.group_captions(model_groups(spark, sf), words(spark, sf), hot_videos(spark, sf)))


def packs(spark, sf):
    c = caps(spark, sf)
    i = F.floor(F.col("caption_id") / 4)
    return c.select(
        "video_id", i.alias("group_no"), F.col("caption_id").alias("pack_no"), F.size("words").alias("n"), F.col("text").alias("spoken"),
        F.when(i % 5 == 0, F.lit("short")).otherwise(F.lit("a translated line of exactly nine words for packs")).alias("text"), pick(i, TREATS).alias("treatment"),
    )


def told(spark, sf):
    """One text per group of packs."""
    return packs(spark, sf).groupBy("video_id", "group_no").agg(F.first("text").alias("text"), F.min_by("treatment", "pack_no").alias("treatment"))


query("seg_pack_text")(lambda spark, sf: N.pack_texts(packs(spark, sf).drop("text", "treatment"), told(spark, sf), hot_videos(spark, sf)))


def drafts(spark, sf, size=6):
    """Lines of six words with the times of every word they cover."""
    w = words(spark, sf).withColumn("line_id", F.floor(F.col("word_id") / size))
    i = F.col("video_id") * 5 + F.col("line_id") * 3
    item = F.struct("word_id", "word", "start_ms", "end_ms")
    made = w.groupBy("video_id", "line_id").agg(F.sort_array(F.collect_list(item)).alias("_w"))
    return made.select(
        "video_id", "line_id", F.get("_w", F.lit(0))["word_id"].alias("first"),
        F.transform("_w", lambda x: x["start_ms"]).alias("starts"), F.transform("_w", lambda x: x["end_ms"]).alias("ends"),
        F.array_join(F.transform("_w", lambda x: x["word"]), " ").alias("text"), F.lit("").alias("sub"),
        pick(i, ["plain", "oval", "mix", "serif", "plain", "underline", "chip", "quote", "tape", "bubble"]).alias("style"),
        F.get("_w", F.lit(1))["word"].alias("emphasis"), pick(i, ["neutral", "surprise", "happy"]).alias("mood"), pick(i, ["none", "star"]).alias("icon"), (i % 9 == 0).alias("cta"),
    ).withColumn("emphasis", F.coalesce("emphasis", F.lit("")))


query("seg_split_long")(lambda spark, sf: N.split_long(drafts(spark, sf)))
query("seg_merge_flashes")(lambda spark, sf: N.merge_flashes(N.split_long(drafts(spark, sf, 2)), hot_videos(spark, sf)))
def loose_drafts(spark, sf):
    """Drafts as a model gives them: some claim words of the line in front, some leave words to nobody."""
    i = F.col("video_id") + F.col("line_id")
    kept = F.when(i % 5 == 0, F.slice("starts", 1, 4)).otherwise(F.col("starts"))
    return drafts(spark, sf).withColumns({"first": F.greatest(F.lit(0), F.col("first") - i % 3), "starts": kept})


query("gate_design_rules")(lambda spark, sf: N.design_rules(N.clean_drafts(loose_drafts(spark, sf)), hot_videos(spark, sf), words(spark, sf)))
query("align_sequences")(
    lambda spark, sf: scripts(spark, sf)
    .filter(F.size("lines") > 0)
    .join(seg_words(spark, sf).select("video_id", "segment_id", F.transform("words", lambda w: w["text"]).alias("said")), ["video_id", "segment_id"])
    .select("video_id", "segment_id", F.posexplode(A.align_phrases(F.col("lines"), F.col("said"))).alias("line_no", "r"))
    .select("video_id", "segment_id", "line_no", "r.first", "r.last")
)


def spoken(spark, sf, size):
    """Words of `caps` with their times, from the parts of a caption that lie in one turn: a row for each part, not for each word."""
    base, n = F.col("base"), F.size("toks")

    def part(c):
        at, to = F.greatest(c * size, base), F.least((c + 1) * size, base + n)
        return F.struct(c.alias("caption_id"), F.struct(at.alias("at"), "segment_id", F.slice("toks", (at - base + 1).cast("int"), (to - at).cast("int")).alias("said")).alias("part"))

    def starts(p):
        return F.transform(F.sequence(p["at"], p["at"] + F.size(p["said"]) - 1), lambda w: word_start(w, p["segment_id"]))

    cut = F.transform(F.sequence(F.floor(base / size), F.floor((base + n - 1) / size)), part)
    parts = placed_turns(spark, sf).filter(F.size("toks") > 0).select("video_id", F.explode(cut).alias("c")).select("video_id", "c.*")
    made = parts.groupBy("video_id", "caption_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    timed = made.select("video_id", "caption_id", F.flatten("parts.said").alias("said"), F.flatten(F.transform("parts", starts)).alias("starts"))
    return timed.withColumn("end_ms", F.array_max("starts") + 300)


def shown(spark, sf):
    """Captions of six words with their tokens as shown, worked out as a column: Spark leaves a UDF in place whose arguments hold some nested lambdas, and then fails."""
    return once(spoken(spark, sf, 6).withColumn("tokens", X.tokens(X.clean_copy(F.array_join("said", " ")))))


query("align_token_times")(
    lambda spark, sf: shown(spark, sf)
    .select("video_id", "caption_id", F.posexplode(A.align_token_times(F.col("tokens"), F.col("said"), F.col("starts"), F.col("end_ms"))).alias("i", "t"))
    .select("video_id", "caption_id", "i", F.bround("t").cast("bigint").alias("t_ms"))
)


def judged(spark, sf):
    key = F.coalesce(F.get(X.tokens(F.col("text")), (F.col("line_id") % 3).cast("int")), F.lit(""))
    return lines(spark, sf).select("video_id", "line_id", "start_ms", "text", "weight", "kind", key.alias("key_note"), "mood", "icon", "cta", "loud")


query("alloc_styles")(
    lambda spark, sf: Y.allocate_styles(judged(spark, sf), "premium", hot_videos(spark, sf)).select(
        "video_id", "line_id", "style", "emphasis", "shown_mood", "shown_icon"
    )
)
query("alloc_stack_absorb")(
    lambda spark, sf: Y.absorb_stacks(Y.allocate_styles(judged(spark, sf), "classic", hot_videos(spark, sf)), hot_videos(spark, sf)).select(
        "video_id", "line_id", "text", "sub", "style"
    )
)
