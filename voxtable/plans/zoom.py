"""Zoom plan: fit each camera move into its room, then keep the ones that are far enough apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions.text import one_of
from voxtable.operators import labels as L
from voxtable.operators.hops import hops
from voxtable.operators.ordered import HotKeys

# Fixed values, ms: shortest ease in, ease out and hold, gap, overlap of close moves, longest move, slack behind the sentence.
MIN_IN, MIN_OUT, MIN_HOLD, GAP, OVERLAP, LONGEST, SLACK = 450, 380, 220, 1600, 20, 4800, 450


def fitted(motion: Column, room: Column) -> dict[str, Column]:
    """Shrink hold, then ease out, then ease in until the move fits; `fits` tells whether it does."""
    i = F.greatest(motion["ease_in_ms"], F.lit(MIN_IN))
    o = F.greatest(motion["ease_out_ms"], F.lit(MIN_OUT))
    h = F.greatest(motion["hold_ms"], F.lit(MIN_HOLD))
    over = F.greatest(i + h + o - room, F.lit(0))
    h2 = F.greatest(h - over, F.lit(MIN_HOLD))
    over2 = F.greatest(i + h2 + o - room, F.lit(0))
    o2 = F.greatest(o - over2, F.lit(MIN_OUT))
    over3 = F.greatest(i + h2 + o2 - room, F.lit(0))
    i2 = F.greatest(i - over3, F.lit(MIN_IN))
    return {"ease_in_ms": i2, "hold_ms": h2, "ease_out_ms": o2, "fits": i2 + h2 + o2 <= room + 1}


def shown_seconds(ms: Column) -> Column:
    """Seconds with two decimals, rounded as the binary number that stands for them (its distance from the tie is exact by splitting it)."""
    whole = F.abs(ms)
    binary = whole / F.lit(1000.0)
    scaled = binary * F.lit(134217729.0)
    high = scaled - (scaled - binary)
    off = (high * 1000 - whole) + (binary - high) * 1000
    cents, rest = F.floor(whole / 10), whole % 10
    up = F.when(rest != 5, (rest > 5).cast("long")).when(off != 0, (off > 0).cast("long")).otherwise(cents % 2)
    shown = cents + up
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.floor(shown / 100).cast("string"), F.lit("."), F.lpad((shown % 100).cast("string"), 2, "0"))


def plan_zoom(
    scored: DataFrame, durations: DataFrame, *, tightness: float = 0.64, max_safe: float = 1.25, hot: HotKeys | None = None
) -> DataFrame:
    """Every scored sentence with action, reason and, where applied, the planned move."""
    m, role = F.col("zoom"), F.col("role")
    base = scored.join(durations, "video_id")
    start = F.greatest(F.lit(0), F.col("start_ms") + F.greatest(F.lit(0), m["delay_ms"]))
    floor = MIN_IN + MIN_OUT + MIN_HOLD
    base = base.withColumn("at_ms", start).withColumn("_left", F.col("duration_ms") - F.col("at_ms"))
    room = F.least(F.lit(LONGEST), F.col("_left"), F.greatest(F.lit(floor), F.col("end_ms") - F.col("at_ms") + SLACK))
    fit = fitted(m, room)
    scale = F.least(L.scale_from_intensity(m["intensity"], F.lit(max_safe)), F.lit(L.MAX_SCALE))
    why = (
        F.when(F.lit(max_safe <= 1.04), F.lit("subject bbox too tight to zoom"))
        .when(~m["apply"], F.lit("motion.apply=false"))
        .when(one_of(role, L.SKIP_ROLES), F.concat(F.lit("role="), role))
        .when(F.lit(tightness >= 0.88), F.lit("framing too tight"))
        .when(scale <= 1.001, F.lit("intensity maps to no zoom"))
        .when(F.col("_left") < floor, F.lit("not enough room to ease"))
        .when(~fit["fits"], F.lit("cannot ease within duration cap"))
    )
    base = base.withColumns(
        {
            "in_ms": fit["ease_in_ms"],
            "held_ms": fit["hold_ms"],
            "out_ms": fit["ease_out_ms"],
            "target_scale": scale,
            "why": why,
            "close_ok": (F.col("final_score") >= 0.88) & one_of(role, L.PRIORITY_ROLES),
        }
    ).withColumn("until_ms", F.col("at_ms") + F.col("in_ms") + F.col("held_ms") + F.col("out_ms"))
    style = (
        F.when((F.col("held_ms") >= 750) & (m["intensity"] >= 0.6), F.lit("hold"))
        .when(F.col("in_ms") >= 550, F.lit("slow_punch"))
        .otherwise(F.lit("fast_punch"))
    )
    moves = base.select(
        "video_id", "sentence_id", "role", "final_score", "start_ms", "at_ms", "until_ms", "in_ms", "held_ms", "out_ms", "target_scale",
        "close_ok", "why", style.alias("style"),
    )
    # Only moves that could be made take part in the scan, with the columns that it looks at.
    open_moves = moves.filter("why IS NULL").select("video_id", "sentence_id", "start_ms", "at_ms", "until_ms", "close_ok")
    # A close move counts as that much later, so one comparison with the end of the last applied move decides both kinds.
    walked = hops(
        open_moves, ["video_id"], ["start_ms", "sentence_id"], F.col("at_ms") + F.when(F.col("close_ok"), GAP + OVERLAP).otherwise(0), F.col("until_ms") + GAP, hot=hot
    )
    gap = F.col("at_ms") - F.coalesce(F.col("held") - GAP, F.lit(-10_000))
    soon = F.concat(F.lit("too soon after previous zoom ("), shown_seconds(gap), F.lit("s)"))
    skipped = F.when((gap < GAP) & ~F.col("close_ok"), soon).otherwise(F.lit("overlaps previous ease-out"))
    spaced = walked.select(
        "video_id", "sentence_id", F.greatest(F.lit(0), gap).alias("distance_ms"), F.when(F.col("picked"), "apply").otherwise("skip").alias("action"),
        F.when(F.col("picked"), "planned").otherwise(skipped).alias("reason"),
    )
    decided = moves.join(spaced, ["video_id", "sentence_id"], "left").withColumns(
        {"action": F.coalesce("action", F.lit("skip")), "reason": F.coalesce("reason", "why")}
    )
    applied = F.col("action") == "apply"
    return decided.select(
        "video_id",
        "sentence_id",
        "role",
        "final_score",
        "action",
        "reason",
        "distance_ms",
        *[
            F.when(applied, c).alias(n)
            for n, c in {
                "start_ms": F.col("at_ms"),
                "end_ms": F.col("at_ms") + F.col("in_ms") + F.col("held_ms"),
                "span_end_ms": F.col("until_ms"),
                "ease_in_ms": F.col("in_ms"),
                "hold_ms": F.col("held_ms"),
                "ease_out_ms": F.col("out_ms"),
                "target_scale": F.col("target_scale"),
                "style": F.col("style"),
            }.items()
        ],
    )
