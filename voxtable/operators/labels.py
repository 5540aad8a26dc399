"""Rhetorical roles, interest, story patterns, camera presets and zoom scores for sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions.text import let, matches, one_of
from voxtable.operators.ordered import HotKeys, first_per, neighbours
from voxtable.session import once

# Role patterns.
GENERIC = r"\b(today (we are|we're) going to|welcome back|in this video|let's get started|hey guys)\b"
CTA = (
    r"\b(subscribe|follow me|link in|comment below|if you want to (learn|get)|"
    r"smash that|hit (that )?follow|check out)\b"
)
NUMBER = r"\b\d+(\.\d+)?\s*(%|x|million|billion|k)\b"
MONEY = r"\$\s?\d|\b\d+\s*(million|billion|percent|%)\b"
# Ordered (role, signal, score, pattern).
ROLE_RULES = [
    ("hook", "emphasis", 0.88, r"\b(nobody tells you|most people don't|here's the thing|wait for it|you won't believe|secret|what if i told)\b"),
    ("assumption", "emphasis", 0.4, r"\b(i thought|i used to think|people think|most developers think|everyone assumes|it seemed)\b"),
    ("contradiction", "contrast", 0.82, r"\b(i was (completely )?wrong|that's (actually )?wrong|not true|i was mistaken)\b"),
    ("contrast", "contrast", 0.84, r"^(but|however|instead|except|yet)\b|\b(that's actually wrong|that's not|not the case|on the contrary)\b"),
    ("reveal", "reveal", 0.9, r"\b(actually|turns out|the (real|truth) (reason|is)|in reality|what really happened|the twist)\b"),
    ("warning", "warning", 0.86, r"\b(don't|do not|never|mistake|avoid|stop doing|warning|careful)\b"),
    ("surprise", "surprise", 0.8, r"\b(crazy|insane|shocked|unbelievable|no way|wild|suddenly)\b"),
    ("strong_opinion", "emphasis", 0.84, r"\b(i would never|never do this|hate|always|must)\b"),
    ("key_insight", "emphasis", 0.8, r"\b(the real reason|that's why|the point is|what matters|the bottleneck|the key)\b"),
    ("emotional_peak", "emotion", 0.78, r"\b(shocked|devastated|excited|terrified|proud|heartbroken)\b"),
    ("humor", "humor", 0.7, r"\b(joke|funny|lol|hilarious|kidding)\b"),
    ("transition", "emphasis", 0.5, r"\b(now here's|moving on|next|so anyway|here's the interesting)\b"),
    ("emphasis", "emphasis", 0.76, r"\b(most important|the most|really|critical|essential|pay attention)\b"),
]
SIGNALS = ["emphasis", "surprise", "contrast", "emotion", "humor", "question", "reveal", "warning", "cta"]
LOCKED = ["assumption", "cta", "question", "contradiction"]
# Role -> (intensity, delay, ease in, hold, ease out), milliseconds.
ZOOM_PRESETS = {
    "reveal": (0.88, 180, 560, 720, 500),
    "story_climax": (0.82, 80, 600, 700, 480),
    "warning": (0.80, 40, 500, 600, 440),
    "surprise": (0.75, 20, 480, 520, 430),
    "answer": (0.72, 80, 520, 650, 460),
    "strong_opinion": (0.70, 40, 500, 580, 440),
    "important_number": (0.68, 100, 540, 800, 420),
    "hook": (0.62, 0, 520, 550, 450),
    "key_insight": (0.60, 60, 560, 620, 460),
    "emotional_peak": (0.58, 80, 620, 650, 500),
    "humor": (0.55, 0, 480, 380, 400),
    "contradiction": (0.52, 60, 540, 520, 460),
    "contrast": (0.50, 40, 540, 500, 450),
    "emphasis": (0.48, 40, 520, 480, 430),
    "question": (0.32, 0, 680, 400, 520),
    "transition": (0.28, 0, 640, 400, 500),
}
ZOOM_OFF = (0.0, 0, 480, 600, 420)
# Role weights of the zoom score, in hundredths.
ROLE_WEIGHT = {
    "reveal": 95, "story_climax": 93, "warning": 90, "hook": 88, "strong_opinion": 86, "important_number": 84,
    "surprise": 84, "answer": 82, "key_insight": 80, "emphasis": 78, "emotional_peak": 78, "contrast": 76,
    "humor": 74, "contradiction": 70, "question": 62, "transition": 55, "assumption": 32, "cta": 12, "generic": 5,
}
SKIP_ROLES = ["cta", "generic", "assumption"]
PRIORITY_ROLES = ["reveal", "story_climax", "warning", "hook", "strong_opinion"]
STORY_SETUP = ["hook", "assumption"]
STORY_CLIMAX = ["reveal", "story_climax", "important_number"]


def with_roles(sentences: DataFrame, role_rules=ROLE_RULES) -> DataFrame:
    """Add role, interest and the nine signals. Rules fold in order over the ones that hit."""
    text, prev = F.col("text"), F.coalesce(F.col("previous"), F.lit(""))
    asks = F.rtrim(text).endswith("?")
    answers = F.rtrim(prev).endswith("?") & ~asks
    figure = matches(text, NUMBER) | matches(text, MONEY)
    paused = F.coalesce(F.col("pause_before_ms") >= 500, F.lit(False))
    pausing = F.coalesce(F.col("pause_after_ms") >= 400, F.lit(False))

    hits = F.filter(
        F.array(
            *[
                F.struct(F.lit(r).alias("role"), F.lit(g).alias("signal"), F.lit(sc).alias("score"), matches(text, p).alias("hit"))
                for r, g, sc, p in role_rules
            ]
        ),
        lambda h: h["hit"],
    )
    base = sentences.withColumns({"_hits": hits, "_asks": asks, "_answers": answers, "_figure": figure, "_paused": paused, "_pausing": pausing})
    start = F.struct(
        F.when(F.col("_answers"), F.lit("answer")).when(F.col("_asks"), F.lit("question")).otherwise(F.lit("generic")).alias("role"),
        F.when(F.col("_answers"), F.lit(0.78)).when(F.col("_asks"), F.lit(0.45)).otherwise(F.lit(0.2)).alias("interest"),
    )

    def merge(acc, h):
        wins = (acc["role"] == "generic") | (~one_of(acc["role"], LOCKED) & (h["score"] >= acc["interest"]))
        return F.struct(
            F.when(wins, h["role"]).otherwise(acc["role"]).alias("role"),
            F.when(wins, F.greatest(acc["interest"], h["score"])).otherwise(acc["interest"]).alias("interest"),
        )

    folded = base.withColumn("_f", F.aggregate("_hits", start, merge)).withColumns(
        {"_g": matches(text, GENERIC), "_c": matches(text, CTA)}
    )
    folded = once(folded)
    plain = ~F.col("_g") & ~F.col("_c")
    role = (
        F.when(F.col("_g"), F.lit("generic"))
        .when(F.col("_c"), F.lit("cta"))
        .when((F.col("_f.role") == "generic") & F.col("_figure"), F.lit("important_number"))
        .otherwise(F.col("_f.role"))
    )
    counted = F.greatest(F.col("_f.interest"), F.when(F.col("_figure"), F.lit(0.8)).otherwise(F.lit(0.0)))
    lifted = F.least(F.lit(1.0), counted + F.when(F.col("_paused"), F.lit(0.08)).otherwise(F.lit(0.0)))
    interest = F.when(F.col("_g"), F.lit(0.05)).when(F.col("_c"), F.lit(0.1)).otherwise(F.bround(lifted, 3))

    def signal(name):
        parts = [F.array_max(F.transform(F.filter("_hits", lambda h: h["signal"] == name), lambda h: h["score"])), F.lit(0.0)]
        if name == "emphasis":
            parts += [
                F.when(F.col("_answers"), 0.7),
                F.when(F.col("_figure"), 0.72),
                F.when(F.col("_paused"), 0.55),
                F.when(F.col("_pausing"), 0.5),
            ]
        if name == "question":
            parts.append(F.when(F.col("_asks"), 0.86))
        value = F.when(plain, F.greatest(*parts)).otherwise(F.lit(0.0))
        return F.when(F.col("_c") & ~F.col("_g"), F.lit(0.9)).otherwise(F.lit(0.0)) if name == "cta" else value

    return folded.select(
        *sentences.columns, role.alias("role"), interest.alias("interest"), *[signal(n).alias(f"sig_{n}") for n in SIGNALS]
    )


def story_position(role: Column) -> Column:
    return (
        F.when(one_of(role, STORY_SETUP), F.lit("setup"))
        .when(one_of(role, STORY_CLIMAX), F.lit("climax"))
        .when(role == "cta", F.lit("resolution"))
        .when(role == "generic", F.lit("none"))
        .otherwise(F.lit("development"))
    )


def zoom_preset(role: Column) -> Column:
    """Motion struct of a role; the table is a constant map, so there is no join."""

    def motion(p, on):
        return F.struct(
            F.lit(on).alias("apply"),
            F.lit(p[0]).alias("intensity"),
            *[F.lit(v).alias(n) for n, v in zip(("delay_ms", "ease_in_ms", "hold_ms", "ease_out_ms"), p[1:])],
        )

    table = F.create_map(*[x for r, p in ZOOM_PRESETS.items() for x in (F.lit(r), motion(p, True))])
    return F.coalesce(F.try_element_at(table, role), motion(ZOOM_OFF, False))


def analyze(sentences: DataFrame) -> DataFrame:
    """Full label rows: roles, signals, story position, confidence and camera motion."""
    role = F.col("role")
    return with_roles(sentences).withColumns(
        {
            "story_position": story_position(role),
            "confidence": F.when(role == "generic", F.lit(0.45)).otherwise(F.lit(0.62)),
            "zoom": zoom_preset(role),
        }
    )


def story_patterns(labelled: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """(video_id, sentence_id, span, pattern, confidence) for runs of two or three roles."""
    near = neighbours(labelled.select("video_id", "sentence_id", "role"), ["video_id"], "sentence_id", lead={"r1": "role"}, hot=hot)
    near = neighbours(near, ["video_id"], "sentence_id", lead={"r2": "r1"}, hot=hot)
    third = F.col("r2").isNotNull()
    turn = (
        third
        & one_of(F.col("role"), ["assumption", "generic", "emphasis"])
        & one_of(F.col("r1"), ["contradiction", "contrast", "surprise", "emotional_peak"])
        & one_of(F.col("r2"), ["reveal", "important_number", "key_insight", "story_climax"])
    )
    early = (F.col("role") == "question") & third & one_of(F.col("r1"), ["answer", "reveal", "key_insight"])
    late = (F.col("role") == "question") & one_of(F.col("r1"), ["answer", "reveal", "key_insight", "important_number"]) & ~early

    def row(span, name, conf):
        return F.struct(F.lit(span).alias("span"), F.lit(name).alias("pattern"), F.lit(conf).alias("confidence"))

    found = F.array_compact(
        F.array(
            F.when(turn, row(3, "setup → reversal → reveal", 0.82)),
            F.when(early, row(2, "question → answer", 0.8)),
            F.when(late, row(2, "question → answer", 0.78)),
        )
    )
    return near.select("video_id", "sentence_id", F.explode(found).alias("p")).select("video_id", "sentence_id", "p.*")


def merge_annotations(labelled: DataFrame, annotations: DataFrame) -> DataFrame:
    """Model labels over rule labels: first annotation per sentence wins, motion falls back by itself."""
    keys = ["video_id", "sentence_id"]
    first = first_per(annotations, keys, "chunk_no").select(
        *keys, *[F.col(c).alias(f"a_{c}") for c in ("role", "interest", "story_position", "confidence", "zoom")]
    )
    joined = labelled.join(first, keys, "left")
    told = F.col("a_role").isNotNull()
    return joined.select(
        *[c for c in labelled.columns if c not in ("role", "interest", "story_position", "confidence", "zoom")],
        *[F.when(told, F.col(f"a_{c}")).otherwise(F.col(c)).alias(c) for c in ("role", "interest", "story_position", "confidence")],
        F.coalesce("a_zoom", "zoom").alias("zoom"),
        told.alias("from_model"),
    )


# Framing and zoom settings.
MAX_SCALE, ZOOM_THRESHOLD, MARGIN = 1.35, 0.42, 0.10


def max_safe_scale(w: Column, h: Column) -> Column:
    """Largest zoom that keeps the subject box and a margin in the frame."""
    usable = 1.0 - 2.0 * MARGIN
    fit = F.least(usable / F.greatest(w, F.lit(0.25)), usable / F.greatest(h, F.lit(0.25)), F.lit(MAX_SCALE))
    return F.bround(fit, 3)


def scale_from_intensity(intensity: Column, max_safe: Column) -> Column:
    i = F.greatest(F.lit(0.0), F.least(F.lit(1.0), intensity))
    return F.when(i <= 0.02, F.lit(1.0)).otherwise(F.bround(1.0 + F.greatest(F.lit(0.0), max_safe - 1.0) * i, 3))


def zoom_scores(labelled: DataFrame, tightness: float = 0.64, max_safe: float = 1.22) -> DataFrame:
    """Blend of semantic, visual and prosody scores with the decision and its reason.

    Scores are added in integer units (1e-5, 1e-2, 1e-2), so thresholds are met exactly.
    """
    weights = F.create_map(*[F.lit(x) for kv in ROLE_WEIGHT.items() for x in kv])
    weight = F.coalesce(F.try_element_at(weights, F.col("role")), F.lit(20))
    peak = F.greatest(*[F.round(F.col(f"sig_{n}") * 100) for n in SIGNALS]).cast("bigint")
    semantic = F.least(420 * weight + 33 * F.round(F.col("interest") * 1000).cast("bigint") + 250 * peak, F.lit(100_000))
    prosody = (
        F.lit(35)
        + F.when(F.col("pause_before_ms") >= 450, 22).otherwise(0)
        + F.when(F.col("pause_after_ms") >= 350, 18).otherwise(0)
        + F.when(F.col("speaking_rate") <= 2.2, 12).otherwise(0)
    )
    visual = 22 if max_safe <= 1.05 else 28 if tightness >= 0.88 else 48 if tightness >= 0.75 else 78
    facts = labelled.withColumns({"_s": semantic, "_p": prosody}).withColumn(
        "_b", F.least(55 * F.col("_s") + 25_000 * F.lit(visual) + 20_000 * F.col("_p"), F.lit(10_000_000))
    )
    limit = round(ZOOM_THRESHOLD * 10_000_000)
    shown = F.format_string("%.2f", F.col("_b") / 10_000_000)
    reason = (
        F.when(~F.col("zoom.apply"), F.lit("motion.apply=false"))
        .when(one_of(F.col("role"), SKIP_ROLES), F.concat(F.lit("role="), F.col("role")))
        .when(F.lit(visual < 35), F.lit("framing too tight"))
        .when(
            (F.col("_b") < limit) & ~one_of(F.col("role"), PRIORITY_ROLES),
            F.concat(F.lit("score "), shown, F.lit(f" < {ZOOM_THRESHOLD:.2f}")),
        )
        .when(F.col("_b") < limit * 0.85, F.concat(F.lit("score "), shown, F.lit(" below priority floor")))
        .otherwise(F.lit("pass"))
    )
    return facts.select(
        *labelled.columns,
        (F.bround(F.col("_s") / 100) / 1000).alias("semantic_score"),
        F.lit(visual / 100).alias("visual_score"),
        (F.col("_p") / 100).alias("prosody_score"),
        (F.bround(F.col("_b") / 10_000) / 1000).alias("final_score"),
        reason.alias("reason"),
    ).withColumn("action", F.when(F.col("reason") == "pass", F.lit("apply")).otherwise(F.lit("skip")))
