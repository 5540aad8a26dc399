"""Model answers: JSON recovered from text, and the rows inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import text as X
from voxtable.functions.text import one_of


def json_text(raw: Column) -> Column:
    """The JSON object in a model's text: code fence off, else the outermost braces; null when there is none."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.when(
        t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```\z", "")
    ).otherwise(t)
    whole = F.get_json_object(bare, "$")
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    inner = F.get_json_object(F.when(braces != "", braces), "$")
    return F.when(whole.startswith("{"), whole).when(inner.startswith("{"), inner)


def parse(raw: Column, schema: str) -> Column:
    return F.from_json(json_text(raw), schema, {"mode": "PERMISSIVE"})


# Card kinds, motions and bullet caps of the split canvas.
CARD_KINDS = ["term_card", "vs_split", "stat", "chip_row", "process", "diagram", "quote", "topic", "bullets"]
MOTIONS = ["fade", "slide_up", "scale_in"]
CARD_SCHEMA = (
    "graphics array<struct<kind:string,start:double,end:double,title:string,subtitle:string,kicker:string,icon:string,"
    "glyph:string,motion:string,chips:array<string>,bullets:array<string>>>"
)


def card_beats(answers: DataFrame, full: bool = False) -> DataFrame:
    """Answers (video_id, answer_no, raw, duration_ms) to beats: defaults, caps, clips; short or untitled ones go."""
    b = answers.select(
        "video_id", "answer_no", "duration_ms", F.posexplode(parse(F.col("raw"), CARD_SCHEMA)["graphics"]).alias("item_no", "c")
    )
    c = F.col("c")
    start = F.bround(F.coalesce(c["start"], F.lit(0.0)) * 1000).cast("bigint")
    end = F.bround(F.coalesce(F.nullif(c["end"], F.lit(0.0)), F.coalesce(c["start"], F.lit(0.0)) + 6) * 1000).cast("bigint")
    kind = F.when(one_of(c["kind"], CARD_KINDS), c["kind"]).otherwise(F.lit("bullets"))
    b = b.withColumns({"start_ms": start, "end_ms": F.least(end, "duration_ms"), "kind": kind})
    top = F.when(F.lit(full), 5).when(F.col("kind") == "vs_split", 0).when(one_of(F.col("kind"), ["process", "diagram", "stat"]), 1).otherwise(2)
    none = F.array().cast("array<string>")

    def clip(v, split_n, full_n):
        return X.clip_words(F.coalesce(v, F.lit("")), full_n if full else split_n)

    bullets = F.filter(
        F.transform(F.slice(F.coalesce(c["bullets"], none), F.lit(1), top), lambda x: clip(x, 32, 44)), lambda x: x != ""
    )
    chips = F.transform(
        F.filter(F.slice(F.coalesce(c["chips"], none), 1, 6 if full else 3), lambda x: F.trim(x) != ""), lambda x: clip(x, 12, 18)
    )
    motion = F.when(one_of(c["motion"], MOTIONS), c["motion"]).when(F.col("kind") == "stat", F.lit("scale_in")).otherwise(F.lit("slide_up"))
    return b.select(
        "video_id",
        "answer_no",
        "item_no",
        "start_ms",
        "end_ms",
        "kind",
        clip(F.trim(c["title"]), 40, 44).alias("title"),
        clip(c["subtitle"], 28, 42).alias("subtitle"),
        X.clip_words(F.upper(F.coalesce(c["kicker"], F.lit(""))), 14).alias("kicker"),
        X.glyph_name(c["icon"], F.col("kind"), c["glyph"]).alias("glyph"),
        motion.alias("motion"),
        chips.alias("chips"),
        bullets.alias("bullets"),
        F.lit(0.82).alias("confidence"),
    ).filter((F.col("end_ms") - F.col("start_ms") >= 1200) & (F.col("title") != ""))


def cue_rows(answers: DataFrame) -> DataFrame:
    """Cue proposals of the four known kinds, with clipped reasons."""
    items = answers.select("*", F.posexplode(parse(F.col("raw"), "sfx array<struct<at:double,kind:string,reason:string>>")["sfx"]).alias("item_no", "i"))
    return items.filter(one_of(F.col("i.kind"), ["whoosh", "swoosh", "impact", "hit"])).select(
        "video_id",
        (F.shiftleft(F.col("answer_no").cast("bigint"), 32) + F.col("item_no")).alias("ord"),
        F.bround(F.coalesce("i.at", F.lit(0.0)) * 1000).cast("bigint").alias("at_ms"),
        "i.kind",
        F.substring(F.coalesce("i.reason", F.lit("")), 1, 40).alias("reason"),
        "duration_ms",
    )


def repair_rows(answers: DataFrame) -> DataFrame:
    """Repairs with an id inside the transcript (`n_segments`) and text."""
    items = answers.select("*", F.posexplode(parse(F.col("raw"), "segments array<struct<id:int,text:string>>")["segments"]).alias("item_no", "i"))
    text = F.trim(F.coalesce("i.text", F.lit("")))
    return items.filter((F.col("i.id") >= 0) & (F.col("i.id") < F.col("n_segments")) & (text != "")).select(
        "video_id", F.col("i.id").cast("bigint").alias("segment_id"), "item_no", text.alias("text")
    )


def topic_rows(answers: DataFrame, max_queries: int) -> DataFrame:
    """Topics with an event or queries, at most `max_queries` of either (the request's own limit)."""
    parsed = parse(F.col("raw"), "topics array<struct<event:string,queries:array<string>,media_need:string>>")["topics"]
    none = F.array().cast("array<string>")

    def clean(t):
        queries = F.filter(F.transform(F.coalesce(t["queries"], none), lambda q: F.trim(q)), lambda q: q != "")
        event = F.trim(F.coalesce(t["event"], F.lit("")))
        return F.struct(
            F.when(event == "", F.coalesce(F.get(queries, F.lit(0)), F.lit(""))).otherwise(event).alias("event"),
            F.slice(queries, 1, max_queries).alias("queries"),
            F.trim(F.coalesce(t["media_need"], F.lit(""))).alias("media_need"),
        )

    kept = F.slice(F.filter(F.transform(parsed, clean), lambda t: t["event"] != ""), 1, max_queries)
    return answers.select("video_id", "answer_no", F.posexplode(kept).alias("topic_no", "t")).select(
        "video_id", "answer_no", "topic_no", "t.*"
    )


def script_line_rows(answers: DataFrame) -> DataFrame:
    """Caption lines per segment; a line is a string or an object with `text`."""
    parsed = parse(F.col("raw"), "segments array<struct<id:int,lines:array<string>>>")["segments"]
    items = answers.select("video_id", "answer_no", F.explode(parsed).alias("i"))
    line = F.when(F.col("l").startswith("{"), F.get_json_object("l", "$.text")).otherwise(F.col("l"))
    rows = items.select("video_id", "answer_no", F.col("i.id").alias("segment_id"), F.posexplode("i.lines").alias("line_no", "l"))
    return rows.withColumn("text", F.trim(line)).filter("text <> ''").select("video_id", "answer_no", "segment_id", "line_no", "text")
