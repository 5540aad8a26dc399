"""Left joins of transcripts with model answers; whatever is missing or unsafe falls back to the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtable.functions import text as X
from voxtable.operators.gates import ICONS, LINE_KINDS, MOODS
from voxtable.operators.ordered import HotKeys, first_per, neighbours
from voxtable.operators.segment import uniform_spans

SEG = ["video_id", "segment_id"]
VIDEO = ["video_id"]


def apply_repairs(segments: DataFrame, repairs: DataFrame) -> DataFrame:
    """Segments (text, words array) with repaired text where there is one.

    Same token count keeps the word timings, another count spreads the tokens evenly;
    without a repair the words are only corrected by rule.
    """
    j = segments.join(first_per(repairs, SEG, "ord").select(*SEG, F.col("text").alias("_new")), SEG, "left")
    told = F.coalesce(F.trim("_new"), F.lit("")) != ""
    j = j.withColumn("_told", told).withColumn(
        "_toks", F.when(F.col("_told"), X.tokens(X.stabilize(F.col("_new")))).otherwise(F.array().cast("array<string>"))
    )
    words, toks = F.col("words"), F.col("_toks")

    def row(text, start, end, p):
        return F.struct(text.alias("text"), start.alias("start_ms"), end.alias("end_ms"), p.cast("double").alias("probability"))

    kept = F.transform(words, lambda w: row(X.fix_asr(w["text"]), w["start_ms"], w["end_ms"], w["probability"]))
    same = F.zip_with(toks, words, lambda t, w: row(t, w["start_ms"], w["end_ms"], w["probability"]))
    spans = uniform_spans(F.size(toks), F.element_at(words, 1)["start_ms"], F.element_at(words, -1)["end_ms"], 80)
    spread = F.zip_with(toks, spans, lambda t, s: row(t, s["start_ms"], s["end_ms"], F.lit(0.7)))
    out = F.when(~F.col("_told") | (F.size(toks) == 0), kept).when(F.size(toks) == F.size(words), same).otherwise(spread)
    j = j.withColumn("words", out)
    joined = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    clean = X.stabilize(F.col("text"))
    return j.withColumn("text", F.when(F.col("_told"), joined).when(clean != "", clean).otherwise(joined)).drop("_new", "_told", "_toks")


def line_notes(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Lines with sanitised notes; the last note of a line wins, missing ones get defaults."""
    last = first_per(notes, ["video_id", "line_id"], F.desc("ord")).drop("ord")
    j = lines.join(last, ["video_id", "line_id"], "left")

    def known(c, values, default):
        v = F.lower(F.trim(F.coalesce(c, F.lit(default))))
        return F.when(X.one_of(v, values), v).otherwise(F.lit(default))

    return j.withColumns(
        {
            "key": F.trim(F.coalesce("key", F.lit(""))),
            "weight": F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce("weight", F.lit(1)))),
            "kind": known(F.col("kind"), LINE_KINDS, "normal"),
            "mood": known(F.col("mood"), MOODS, "neutral"),
            "icon": known(F.col("icon"), ICONS, "none"),
            "cta": F.coalesce("cta", F.lit(False)),
        }
    )


def review_edits(lines: DataFrame, edits: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Apply an edit only if it stays short and brings no content word of a neighbouring original line."""
    near = neighbours(lines, ["video_id"], "line_id", lag={"_before": "text"}, lead={"_behind": "text"}, hot=hot)
    j = near.join(first_per(edits, ["video_id", "line_id"], "ord").select("video_id", "line_id", F.trim("edit").alias("_e")), ["video_id", "line_id"], "left")
    new = F.array_except(X.content_tokens(F.col("_e")), X.content_tokens(F.col("text")))

    def clear(other):
        return ~F.arrays_overlap(F.col("_fresh"), X.content_tokens(F.coalesce(other, F.lit(""))))

    j = j.withColumn("_fresh", new)
    n, was = X.token_count(F.col("_e")), X.token_count(F.col("text"))
    safe = (
        (F.col("_e") != "")
        & (F.col("_e") != F.col("text"))
        & (n <= 5)
        & (n <= was + 2)
        & clear(F.col("_before"))
        & clear(F.col("_behind"))
    )
    done = F.coalesce(safe, F.lit(False))
    return j.select("video_id", "line_id", F.when(done, F.col("_e")).otherwise(F.col("text")).alias("text"), done.alias("edited"))


def brief_segments(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """Corrected text per segment over all windows: the last window that names it wins, else the rule text."""
    last = first_per(parts, SEG, F.desc("window_no")).select(*SEG, F.trim("text").alias("_t"))
    j = segments.join(last, SEG, "left")
    return j.withColumn("text", F.when(F.coalesce("_t", F.lit("")) != "", F.col("_t")).otherwise(X.stabilize(F.col("text")))).drop("_t")


def distinct_in_order(rows: DataFrame, keys: list[str], value: list[str], ordinal: str, limit: int) -> DataFrame:
    """First-seen distinct values per key, at most `limit` (the feature's own cap), numbered in order."""
    from voxtable.operators.ordered import top_per

    seen = rows.groupBy(*keys, *value).agg(F.min(ordinal).alias(ordinal))
    return top_per(seen, keys, limit, ordinal, rank="place")


# Moods that a brief may name, and the limits of its lists.
BRIEF_MOODS = ["warm_inspiring", "focused_tech", "calm_reflective", "confident_upbeat", "serious_story"]
GLOSSARY_LIMIT, IDEAS_LIMIT = 30, 8


def brief_heads(windows: DataFrame) -> DataFrame:
    """(video_id, topic, hook, music_mood, glossary, key_ideas) from window results, stitched.

    `windows` has video_id, window_no, topic, hook, music_mood, glossary (array of
    heard, correct) and key_ideas (array). The first window speaks for the video; terms
    and ideas are the first distinct ones of all windows, at most 30 and 8.
    """
    head = first_per(windows.select("video_id", "window_no", "topic", "hook", "music_mood"), VIDEO, "window_no").drop("window_no")
    mood = F.trim(F.coalesce("music_mood", F.lit("")))
    head = head.withColumns({"topic": F.coalesce("topic", F.lit("")), "hook": F.coalesce("hook", F.lit("")), "music_mood": F.when(mood.isin(BRIEF_MOODS), mood).otherwise(F.lit(BRIEF_MOODS[0]))})

    def listed(column, keep, limit):
        each = windows.select("video_id", "window_no", F.posexplode(column).alias("_at", "_v")).filter(keep)
        each = each.withColumn("_o", F.struct("window_no", "_at"))
        places = distinct_in_order(each, VIDEO, ["_v"], "_o", limit)
        in_order = F.array_sort(F.collect_list(F.struct("place", "_v")))
        return places.groupBy("video_id").agg(F.transform(in_order, lambda x: x["_v"]).alias(column))

    terms = listed("glossary", F.lit(True), GLOSSARY_LIMIT)
    ideas = listed("key_ideas", F.trim("_v") != "", IDEAS_LIMIT)
    return head.join(terms, "video_id", "left").join(ideas, "video_id", "left")


def fold_shared_lines(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Lines of a segment that got the same first word as the line before are folded into it."""
    near = neighbours(lines, ["video_id"], "line_id", lag={"_f": "first", "_s": "segment_id"}, hot=hot)
    fresh = ~(F.col("_f").eqNullSafe(F.col("first")) & F.col("_s").eqNullSafe(F.col("segment_id")))
    flagged = near.withColumn("_new", fresh.cast("int"))
    isl = neighbours(flagged, ["video_id"], "line_id", total_before={"_isl": "_new"}, hot=hot)
    # Lines in one island share a single spoken word, so an island is one segment's surplus lines.
    return (
        isl.withColumn("draft_id", F.col("_isl") + F.col("_new") - 1)
        .groupBy("video_id", "draft_id")
        .agg(
            F.min("first").alias("first"),
            F.max_by("last", "line_id").alias("last"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda s: s["text"]), " ").alias("text"),
        )
    )
