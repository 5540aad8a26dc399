"""Sound cues from sentences, cards and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtable.functions.text import one_of
from voxtable.operators.gates import OVERLAY_GAP_MS, OVERLAY_MAX, gate_cues, select_with_gap
from voxtable.operators.ordered import HotKeys
from voxtable.session import cut_lineage

FIELDS = ["video_id", "ord", "at_ms", "kind", "gain", "reason"]
# Source rank of a cue in the order of proposal.
OPEN, CARD, SENTENCE = 0, 1 << 40, 1 << 41


def _cue(rows, ordinal, at, kind, gain, reason):
    return rows.select(
        "video_id", ordinal.cast("bigint").alias("ord"), at.cast("bigint").alias("at_ms"), kind.alias("kind"), gain.cast("double").alias("gain"), reason.alias("reason")
    )


def _first(rows, ident):
    return rows.groupBy("video_id").agg(F.min_by("start_ms", ident).alias("start_ms"))


def propose_cues(sentences: DataFrame, cards: DataFrame) -> DataFrame:
    """Opening impact, one cue per telling card, one per telling sentence."""
    hook = _first(sentences.filter("role = 'hook'"), "sentence_id").withColumn("reason", F.lit("hook"))
    opened = _first(cards, "beat_id").withColumn("reason", F.lit("open")).join(hook, "video_id", "left_anti")
    opening = hook.unionByName(opened)
    kicker, kind = F.upper(F.coalesce("kicker", F.lit(""))), F.col("kind")
    told = cards.withColumn(
        "_c",
        F.when(kind == "vs_split", F.struct(F.lit(60).alias("d"), F.lit("swoosh").alias("k"), F.lit(0.24).alias("g"), F.lit("compare").alias("r")))
        .when(kind == "stat", F.struct(F.lit(80).alias("d"), F.lit("hit").alias("k"), F.lit(0.26).alias("g"), F.lit("number").alias("r")))
        .when(
            one_of(kind, ["process", "diagram", "chip_row"]),
            F.struct(F.lit(50).alias("d"), F.lit("whoosh").alias("k"), F.lit(0.22).alias("g"), F.lit("steps").alias("r")),
        )
        .when(
            one_of(kicker, ["HOOK", "REVEAL"]),
            F.struct(F.lit(0).alias("d"), F.lit("impact").alias("k"), F.lit(0.30).alias("g"), F.lower(kicker).alias("r")),
        ),
    ).filter(F.col("_c").isNotNull())
    role = F.col("role")
    said = sentences.withColumn(
        "_c",
        F.when(one_of(role, ["reveal", "answer"]), F.struct(F.lit("hit").alias("k"), F.lit(0.26).alias("g"), role.alias("r")))
        .when(role == "contrast", F.struct(F.lit("swoosh").alias("k"), F.lit(0.22).alias("g"), F.lit("contrast").alias("r")))
        .when(role == "important_number", F.struct(F.lit("hit").alias("k"), F.lit(0.26).alias("g"), F.lit("number").alias("r")))
        .when(role == "cta", F.struct(F.lit("whoosh").alias("k"), F.lit(0.22).alias("g"), F.lit("cta").alias("r"))),
    ).filter(F.col("_c").isNotNull())
    return (
        _cue(opening, F.lit(OPEN), F.col("start_ms"), F.lit("impact"), F.lit(0.32), F.col("reason"))
        .unionByName(_cue(told, F.col("beat_id") + CARD, F.col("start_ms") + F.col("_c.d"), F.col("_c.k"), F.col("_c.g"), F.col("_c.r")))
        .unionByName(_cue(said, F.col("sentence_id") + SENTENCE, F.col("start_ms"), F.col("_c.k"), F.col("_c.g"), F.col("_c.r")))
    )


def plan_cues(sentences: DataFrame, cards: DataFrame, durations: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    # Both are read twice, for the opening and for the telling ones: what a cue needs of the cards is stored once.
    cards = cut_lineage(cards.select("video_id", "beat_id", "start_ms", "kind", "kicker"))
    return gate_cues(propose_cues(sentences, cards).join(durations, "video_id"), hot=hot)


def plan_overlay_cues(caps: DataFrame, durations: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Cues on decorated captions only; a video without any gets one on its first caption."""
    special = caps.filter(one_of(F.col("treatment"), ["oval", "blob", "quote", "underline"]))
    kind = F.when(F.col("treatment") == "blob", F.lit("hit")).otherwise(F.lit("whoosh"))
    hits = _cue(special, F.col("caption_id"), F.col("start_ms"), kind, F.lit(0.16), F.col("treatment"))
    bare = _first(caps, "caption_id").join(special.select("video_id").distinct(), "video_id", "left_anti")
    opens = _cue(bare, F.lit(0), F.col("start_ms"), F.lit("whoosh"), F.lit(0.12), F.lit("open"))
    return gate_cues(hits.unionByName(opens).join(durations, "video_id"), OVERLAY_GAP_MS, OVERLAY_MAX, hot=hot)


# Accent gains per treatment.
ACCENT_GAIN = {"oval": 0.13, "underline": 0.09, "tape": 0.10, "bubble": 0.16}


def plan_accents(caps: DataFrame, durations: DataFrame, style: str = "classic", hot: HotKeys | None = None) -> DataFrame:
    """Riser on the first caption, then accents at least twelve seconds apart, within a budget by length."""
    voiced = ["bubble"] if style == "editorial" else list(ACCENT_GAIN)
    t = F.col("treatment")
    sounds = one_of(t, voiced)
    pops = F.lit(style == "editorial") & one_of(F.col("mood"), ["surprise", "excited"])
    firsts = caps.groupBy("video_id").agg(F.min("caption_id").alias("_first"))
    base = caps.join(firsts, "video_id").join(durations, "video_id")
    at = F.col("start_ms") + F.when(one_of(t, ["oval", "bubble"]), 300).otherwise(200)
    eligible = (
        base.filter((F.col("caption_id") > F.col("_first")) & (sounds | pops))
        .withColumn("at_ms", at)
        .filter(F.col("at_ms") <= F.col("duration_ms") - 500)
        .withColumn("_budget", F.greatest(F.lit(10), F.floor(F.col("duration_ms") / 25_000)) - 1)
    )
    kept = select_with_gap(
        eligible, ["video_id"], "caption_id", "at_ms", 12_000, first=[F.col("caption_id")], budget="_budget", hot=hot
    )
    chosen = eligible.join(kept, ["video_id", "caption_id"])
    gains = F.create_map(*[F.lit(x) for kv in ACCENT_GAIN.items() for x in kv])
    kind = F.when(t == "tape", F.lit("swoosh")).when(t == "bubble", F.lit("pop")).otherwise(F.lit("shimmer"))
    accents = chosen.select(
        "video_id",
        "at_ms",
        F.when(sounds, kind).otherwise(F.lit("shimmer")).alias("kind"),
        F.when(sounds, F.try_element_at(gains, t)).otherwise(0.10).alias("gain"),
        F.when(sounds, t).otherwise(F.lit("mood-pop")).alias("reason"),
    )
    riser = base.filter(F.col("caption_id") == F.col("_first")).select(
        "video_id", F.greatest(F.lit(0), "start_ms").alias("at_ms"), F.lit("riser").alias("kind"), F.lit(0.14).alias("gain"), F.lit("hook").alias("reason")
    )
    return riser.unionByName(accents)


def cue_clips(cues: DataFrame, library: DataFrame) -> DataFrame:
    """Cues with the clip of their kind; kinds without a clip are dropped, gain falls back to the clip's.

    The library has one row per cue kind; Spark broadcasts it while it is small.
    """
    clips = library.select("kind", "file_name", "trim_ms", F.col("gain").alias("_clip_gain"))
    return cues.join(clips, "kind").withColumn("gain", F.coalesce(F.nullif("gain", F.lit(0.0)), "_clip_gain")).drop("_clip_gain")


# Keywords that suit a mood, the mood's own name first.
TRACK_KEYWORDS = {
    "warm_inspiring": ["warm_inspiring", "warm", "inspir", "uplift", "hope", "motiv"],
    "focused_tech": ["focused_tech", "tech", "focus", "minimal", "future", "corporate", "lofi"],
    "calm_reflective": ["calm_reflective", "calm", "reflect", "ambient", "soft", "piano", "chill"],
    "confident_upbeat": ["confident_upbeat", "upbeat", "confident", "happy", "bright", "energetic", "pop"],
    "serious_story": ["serious_story", "serious", "story", "cinematic", "dark", "drama", "emotional"],
}


def track_for_mood(tracks: DataFrame, moods: dict[str, list[str]] = TRACK_KEYWORDS) -> DataFrame:
    """Best track per mood: most keyword hits in its name, first name on ties, also at zero.

    Each track row scores itself against the keyword lists; the best one per mood is
    found with map-side partial aggregation.
    """
    low = F.lower("track")
    scores = F.array(
        *[
            F.struct(F.lit(m).alias("mood"), F.size(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: low.contains(k))).alias("hits"))
            for m, ks in moods.items()
        ]
    )
    scored = tracks.select("track", F.explode(scores).alias("s")).select("track", "s.*")
    return scored.groupBy("mood").agg(F.min(F.struct((-F.col("hits")).alias("down"), "track")).alias("b")).select(
        "mood", "b.track", (-F.col("b.down")).alias("hits")
    )
