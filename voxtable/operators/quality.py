"""Checks that turn rows into violation rows instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import text as X
from voxtable.operators.ordered import HotKeys, neighbours


def violations(rows: DataFrame, ids: list[str], rules: dict[str, Column]) -> DataFrame:
    """(ids, rule) for every rule whose condition holds; one narrow pass, all rules at once."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.select(*ids, F.explode(broken).alias("rule"))


def caption_rows(caps: DataFrame) -> DataFrame:
    """Captions (text, start_ms, end_ms, words, duration_ms)."""
    start, end = F.col("start_ms"), F.col("end_ms")
    words = F.col("words")
    return violations(
        caps,
        ["video_id", "caption_id"],
        {
            "empty text": F.trim("text") == "",
            "start below zero": start < 0,
            "end not after start": end <= start,
            "word starts before caption": F.exists(words, lambda w: w["start_ms"] < start - 1),
            "word ends after caption": F.exists(words, lambda w: w["end_ms"] > end + 1),
            "word end not after start": F.exists(words, lambda w: w["end_ms"] <= w["start_ms"]),
            "past the video": end > F.col("duration_ms") + 50,
            "too short": end - start < 120,
        },
    )


def zoom_overlaps(zooms: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Zooms (zoom_no in time order, start_ms, end_ms, span_end_ms, target_scale, duration_ms)."""
    near = neighbours(zooms, ["video_id"], "zoom_no", max_before={"_reach": "span_end_ms"}, hot=hot)
    return violations(
        near,
        ["video_id", "zoom_no"],
        {
            "past the video": F.col("end_ms") > F.col("duration_ms") + 80,
            "scale too large": F.col("target_scale") > 1.35,
            "overlaps previous": F.col("start_ms") < F.coalesce("_reach", F.lit(-1000)) - 50,
        },
    )


def card_overlaps(beats: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    near = neighbours(beats, ["video_id"], "beat_id", lag={"_prev": "end_ms"}, hot=hot)
    return violations(
        near,
        ["video_id", "beat_id"],
        {
            "past the video": F.col("end_ms") > F.col("duration_ms") + 120,
            "overlaps previous": F.col("start_ms") < F.coalesce("_prev", F.lit(-1000)) - 20,
        },
    )


# Allowed ranges of numeric fields, by entity.
RANGES = {
    "signals": {f"sig_{n}": (0.0, 1.0) for n in ("emphasis", "surprise", "contrast", "emotion", "humor", "question", "reveal", "warning", "cta")},
    "motion": {"intensity": (0.0, 1.0), "delay_ms": (0, 1200), "ease_in_ms": (0, 2000), "hold_ms": (0, 2500), "ease_out_ms": (0, 2000)},
    "box": {"x": (0.0, 1.0), "y": (0.0, 1.0), "w": (0.05, 1.0), "h": (0.05, 1.0)},
    "decision": {"target_scale": (1.0, 1.4), "ease_in_ms": (0, 2500), "hold_ms": (0, 3000), "ease_out_ms": (0, 2500), "confidence": (0.0, 1.0), "score": (0.0, 1.0)},
    "cue": {"at_ms": (0, None), "gain": (0.05, 0.8)},
    "request": {
        "max_queries": (1, 8), "max_results_per_query": (1, 12), "max_pages_to_open": (0, 15), "max_downloads": (1, 20),
    },
}


def _outside(c: str, lo, hi) -> Column:
    return F.col(c) < lo if hi is None else (F.col(c) < lo) | (F.col(c) > hi)


def out_of_range(rows: DataFrame, ids: list[str], entity: str) -> DataFrame:
    """Fields of an entity outside their range, for the fields the table has."""
    return violations(rows, ids, {c: _outside(c, *r) for c, r in RANGES[entity].items() if c in rows.columns})


def out_of_ranges(rows: DataFrame, ids: list[str], entities: list[str]) -> DataFrame:
    """(entity, ids, rule): as out_of_range for several entities whose fields stand in one row, in one pass."""
    broken = [
        F.when(_outside(c, *r), F.struct(F.lit(e).alias("entity"), F.lit(c).alias("rule"))) for e in entities for c, r in RANGES[e].items() if c in rows.columns
    ]
    each = rows.select(*ids, F.explode(F.array_compact(F.array(*broken))).alias("_b"))
    return each.select("_b.entity", *ids, "_b.rule")


def script_rows(segments: DataFrame) -> DataFrame:
    """Segments (text, heard, seconds_ms, n_words, lines array): caption lines against what was said."""
    lines, n_lines = F.col("lines"), F.size("lines")
    wanted = F.greatest(F.lit(1), F.bround(F.col("seconds_ms") / 1450).cast("int"))
    shown = F.array_distinct(X.content_stems(F.array_join(lines, " ")))
    source = F.array_distinct(X.content_stems(F.col("text")))
    said = F.array_distinct(X.content_stems(F.concat_ws(" ", "text", "heard")))
    base = segments.withColumns({"_shown": shown, "_source": source, "_said": said}).withColumns(
        {"_dropped": F.array_except("_source", "_shown"), "_invented": F.array_except("_shown", "_said")}
    )
    return violations(
        base,
        ["video_id", "segment_id"],
        {
            "no lines": n_lines == 0,
            "too few lines": (n_lines > 0) & (F.col("n_words") >= 4) & (n_lines < F.greatest(F.lit(1), F.floor(wanted * 7 / 10))),
            "drops spoken words": (n_lines > 0) & (F.size("_dropped") > F.greatest(F.lit(2), F.floor(F.size("_source") * 3 / 10))),
            "adds words": (n_lines > 0)
            & (
                (F.size("_invented") > F.greatest(F.lit(1), F.floor(F.size("_shown") / 5)))
                | F.exists("_invented", lambda t: F.length(t) >= 7)
            ),
            "long line": F.exists(lines, lambda s: X.token_count(s) > 5),
        },
    )


def annotation_rows(lines: DataFrame) -> DataFrame:
    """Per video: lines with notes against the budgets for weight, mood, icon and call to action."""
    noted = F.col("weight").isNotNull()
    per = lines.groupBy("video_id").agg(
        F.count("*").alias("n"),
        F.count_if(~noted).alias("missing"),
        F.count_if(noted & (F.col("key") != "") & ~X.norm(F.col("text")).contains(X.norm(F.col("key")))).alias("keys"),
        F.count_if(F.col("weight") >= 3).alias("heavy"),
        F.count_if(F.col("mood").isin("surprise", "excited")).alias("popped"),
        F.count_if(F.coalesce("icon", F.lit("none")) != "none").alias("iconed"),
        F.count_if("cta").alias("asks"),
    )
    n = F.col("n")

    def over(c, least, share):
        return F.col(c) > F.greatest(F.lit(least), F.floor(n / share))

    return violations(
        per,
        ["video_id"],
        {
            "missing": F.col("missing") > F.floor(n / 10),
            "key not in line": F.col("keys") > 0,
            "too many heavy": over("heavy", 2, 6),
            "too many moods": over("popped", 4, 5),
            "no mood": (n >= 15) & (F.col("popped") == 0),
            "too many icons": over("iconed", 6, 4),
            "no icon": (n >= 15) & (F.col("iconed") == 0),
            "too many asks": over("asks", 2, 15),
        },
    )


def file_rows(probes: DataFrame) -> DataFrame:
    """Probe rows (file_id, present, bytes, mime, width, duration_ms): the first reason a file is unusable."""
    image, video = F.col("mime").startswith("image/"), F.col("mime").startswith("video/")
    reason = (
        F.when(~F.col("present"), F.lit("file missing"))
        .when(F.col("bytes") < 512, F.lit("file too small"))
        .when(F.col("mime") == "text/html", F.lit("downloaded HTML, not media"))
        .when(F.col("mime") == "empty", F.lit("empty file"))
        .when(image & (F.col("mime") != "image/svg+xml") & F.col("width").between(1, 79), F.lit("image too small"))
        .when(video & F.col("duration_ms").between(1, 199), F.lit("video duration too short"))
    )
    return probes.withColumn("rule", reason).filter("rule IS NOT NULL")


def source_media(probes: DataFrame, max_ms: int = 0) -> DataFrame:
    """Source clips (width, height, rotation, duration_ms, has_audio): display size and what is wrong."""
    turned = F.bround(F.abs(F.col("rotation"))).cast("int") % 360
    swap = turned.isin(90, 270)
    even = lambda c: (c - c % 2)
    dur = F.col("duration_ms")
    rule = (
        F.when(dur <= 0, F.lit("no duration"))
        .when(F.lit(max_ms > 0) & (dur > max_ms), F.lit("too long"))
        .when(~F.col("has_audio"), F.lit("no audio"))
        .otherwise(F.lit("ok"))
    )
    return probes.withColumns(
        {
            "show_width": even(F.when(swap, F.col("height")).otherwise(F.col("width"))),
            "show_height": even(F.when(swap, F.col("width")).otherwise(F.col("height"))),
            "rule": rule,
        }
    )
