"""Rate-limited and budgeted selection: the rows that may be decorated, sounded or shown."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtable.functions import text as X
from voxtable.operators.hops import hops
from voxtable.operators.ordered import HotKeys, dense_ids, first_per, ordered_fold, top_per

VIDEO = ["video_id"]


def _all_round(gap):
    def step(state, row):
        times = state
        t, at = row["_t"], bisect_left(times, row["_t"])
        near = times[max(0, at - 1) : at + 1]
        if (row["_cap"] is not None and len(times) >= row["_cap"]) or any(abs(t - x) < gap for x in near):
            return times, []
        insort(times, t)
        return times, [(row["_id"],)]

    return step


def select_with_gap(
    rows: DataFrame,
    keys: Sequence[str],
    ident: str,
    time: str,
    gap_ms: int,
    *,
    first: Sequence[Column] = (),
    budget: str | None = None,
    mode: str = "signed",
    hot: HotKeys | None = None,
) -> DataFrame:
    """(keys, ident) of the accepted rows, scanned by `first`, then time, then `ident`.

    mode 'signed' compares with the last pick only and keeps the sign, so after a
    pick nothing earlier can follow; 'abs_all' keeps every pick `gap_ms` away from
    every other. Filter to the eligible rows first: the scan then only sees those.
    """
    if mode not in ("signed", "abs_all"):
        raise ValueError(f"unknown mode {mode!r}")
    ranks = {f"_o{i}": c for i, c in enumerate(first)}
    scanned = rows.select(
        *keys,
        F.col(ident).cast("bigint").alias("_id"),
        F.col(time).cast("bigint").alias("_t"),
        (F.col(budget).cast("bigint") if budget else F.lit(None).cast("bigint")).alias("_cap"),
        *[c.alias(n) for n, c in ranks.items()],
    )
    order = [*ranks, "_t", "_id"]
    if mode == "signed":  # what may follow a pick depends on that pick alone; a budget keeps the first picks
        walked = hops(scanned, keys, order, F.col("_t"), F.col("_t") + gap_ms, hot=hot)
        picked = walked.filter(F.col("picked") & (F.col("_cap").isNull() | (F.col("pick_no") <= F.col("_cap")))).select(*keys, "_id")
    else:
        picked = ordered_fold(scanned, keys, order, [], _all_round(gap_ms), "_id bigint", hot=hot)
    return picked.withColumnRenamed("_id", ident)


def mark(rows: DataFrame, accepted: DataFrame, keys: Sequence[str], alias: str) -> DataFrame:
    """Left join with a flag column for the accepted rows."""
    return rows.join(accepted.withColumn(alias, F.lit(True)), list(keys), "left").withColumn(
        alias, F.coalesce(alias, F.lit(False))
    )


# Caption treatments and their spacing.
SPECIAL = ["oval", "blob", "underline"]
SPECIAL_GAP_MS = 10_000
EMPHASIS_WORDS = [
    "rag", "raka", "llm", "lora", "peft", "fine-tuning", "tuning", "ai", "engineer", "cost", "documents",
    "gdpr", "creator", "interviews", "interviewing", "strategy",
]
CAPTION_FILLER = [
    "a", "an", "the", "and", "or", "to", "of", "in", "on", "for", "so", "it",
    "is", "my", "just", "when", "into", "from", "as", "at",
    "i", "me", "we", "you", "they", "them", "this", "that", "there", "here",
]
OVAL_TERMS = ["rag", "fine-tuning", "fine tuning", "llm", "ai engineer", "lora", "peft"]


def any_emphasis(words: Column) -> Column:
    return F.exists(words, lambda w: w["emphasis"])


def pace_treatments(caps: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Special treatments at most every ten seconds, serif in between; plain with emphasis becomes mix."""
    special = X.one_of(F.col("treatment"), SPECIAL)
    kept = select_with_gap(caps.filter(special), VIDEO, "caption_id", "start_ms", SPECIAL_GAP_MS, hot=hot)
    marked = mark(caps, kept, ["video_id", "caption_id"], "_kept")
    paced = (
        F.when(special & ~F.col("_kept"), F.lit("serif"))
        .when((F.col("treatment") == "plain") & any_emphasis(F.col("words")), F.lit("mix"))
        .otherwise(F.col("treatment"))
    )
    return marked.withColumn("treatment", paced).drop("_kept")


def mark_unique_words(words: Column) -> Column:
    """Emphasise dictionary words, never filler."""
    def one(w):
        stem = F.lower(X.strip(w["text"], ".,!?;:\"'“”"))
        hot = (w["emphasis"] | X.one_of(stem, EMPHASIS_WORDS)) & ~X.one_of(stem, CAPTION_FILLER)
        return F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), hot.alias("emphasis"))

    return F.transform(words, one)


def decorate(caps: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Captions with a special term become oval every ten seconds, others follow their emphasis."""
    marked = caps.withColumn("words", mark_unique_words(F.col("words"))).withColumn(
        "_term", X.contains_any(F.lower(F.translate("text", "\n", " ")), OVAL_TERMS)
    )
    kept = select_with_gap(marked.filter("_term"), VIDEO, "caption_id", "start_ms", SPECIAL_GAP_MS, hot=hot)
    flagged = mark(marked, kept, ["video_id", "caption_id"], "_kept")
    hot_words, t = any_emphasis(F.col("words")), F.col("treatment")
    new = (
        F.when(F.col("_kept"), F.lit("oval"))
        .when(F.col("_term"), F.when(X.one_of(t, ["plain", "mix"]), F.lit("serif")).otherwise(t))
        .when(X.one_of(t, ["mix", "serif"]) & ~hot_words, F.lit("plain"))
        .when((t == "plain") & hot_words, F.lit("mix"))
        .otherwise(t)
    )
    return flagged.withColumn("treatment", new).drop("_kept", "_term")


HOOK_STYLES = ["serif", "stack", "quote", "oval", "tape"]
HOOK_MS = 2500


def hook_line(lines: DataFrame) -> DataFrame:
    """(video_id, hook_line): designed first, else with content, else first, among three lines in 2.5 s."""
    opening = top_per(lines.select("video_id", "line_id", "start_ms", "style", "text"), VIDEO, 3, "line_id")
    first = first_per(opening.select("video_id", "line_id", "start_ms"), VIDEO, "line_id").select("video_id", F.col("start_ms").alias("_t0"))
    content = F.exists(
        X.norm_tokens(F.col("text")), lambda t: (F.length(t) >= 3) & ~X.one_of(t, X.rules.FILLER + X.rules.GREETINGS)
    )
    order = F.when(X.one_of(F.col("style"), HOOK_STYLES), 0).when(content, 1).otherwise(2)
    near = opening.join(first, "video_id").filter(F.col("start_ms") - F.col("_t0") <= HOOK_MS)
    return near.groupBy("video_id").agg(F.min_by("line_id", F.struct(order, "line_id")).alias("hook_line"))


# Moods, icons and their spacing.
MOODS = ["neutral", "surprise", "excited", "happy", "serious", "urgent"]
POP_MOODS = ["surprise", "excited"]
ICONS = [
    "none", "money", "growth", "idea", "video", "social", "check", "warning", "time", "target", "fire", "heart",
    "star", "lock", "question",
]
LINE_KINDS = ["payoff", "concept", "term", "drama", "quote", "normal"]
POP_GAP_MS, ICON_GAP_MS, HOOK_WINDOW_MS = 7000, 13_000, 30_000


def mood_pops(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Lines (style, mood, loud, weight, stacked) that get a pop; returns all lines with shown_mood."""
    pops = X.one_of(F.col("mood"), POP_MOODS)
    wants = (pops | (F.col("loud") & (F.col("weight") >= 1))) & (F.col("style") != "plain") & ~F.col("stacked")
    kept = select_with_gap(lines.filter(wants), VIDEO, "line_id", "start_ms", POP_GAP_MS, first=[-F.col("weight")], hot=hot)
    flagged = mark(lines, kept, ["video_id", "line_id"], "_pop")
    shown = F.when(F.col("_pop"), F.when(pops, F.col("mood")).otherwise(F.lit("excited"))).otherwise(F.lit("neutral"))
    return flagged.withColumn("shown_mood", shown).drop("_pop")


def icon_badges(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Icons on weight >= 2 lines, spaced; a video without one in its first 30 s gives its earliest candidate one."""
    possible = (
        X.one_of(F.col("icon"), ICONS[1:]) & ~F.col("stacked") & (F.col("style") != "chip")
    )
    kept = select_with_gap(
        lines.filter(possible & (F.col("weight") >= 2)), VIDEO, "line_id", "start_ms", ICON_GAP_MS, first=[-F.col("weight")], hot=hot
    )
    start = lines.groupBy("video_id").agg(F.min_by("start_ms", "line_id").alias("_t0"))
    opening = (
        mark(lines.filter(possible & (F.col("weight") >= 1)), kept, ["video_id", "line_id"], "_icon")
        .join(start, "video_id")
        .filter(F.col("start_ms") - F.col("_t0") < HOOK_WINDOW_MS)
    )
    fallback = (
        opening.groupBy("video_id")
        .agg(F.max("_icon").alias("_any"), F.min_by("line_id", F.struct("start_ms", "line_id")).alias("line_id"))
        .filter(~F.col("_any"))
        .select("video_id", "line_id")
    )
    flagged = mark(lines, kept.unionByName(fallback), ["video_id", "line_id"], "_icon")
    return flagged.withColumn("shown_icon", F.when(F.col("_icon"), F.col("icon")).otherwise(F.lit("none"))).drop("_icon")


def _plain_step(state, row):
    """Runs of plain lines, four at a time: lift the longest content word, go on behind it."""
    run = state
    if not row["plain"]:
        return [], []
    run.append([row["line_id"], row["n"]])
    if len(run) < 4:
        return run, []
    best = max(range(4), key=lambda i: run[i][1])
    if run[best][1] >= 4:
        return run[best + 1 :], [(run[best][0],)]
    return [], []


def lift_plain_runs(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """A run of more than three plain lines gets one mix line per four, on its longest content word."""
    best = X.content_word(X.tokens(F.col("text")))
    sized = lines.withColumn("_best", best)
    lifted = ordered_fold(
        sized.select("video_id", "line_id", (F.col("style") == "plain").alias("plain"), F.length(X.norm(F.col("_best"))).alias("n")),
        VIDEO,
        ["line_id"],
        [],
        _plain_step,
        "line_id bigint",
        hot=hot,
    )
    flagged = mark(sized, lifted, ["video_id", "line_id"], "_lift")
    return flagged.withColumns(
        {
            "style": F.when(F.col("_lift"), F.lit("mix")).otherwise(F.col("style")),
            "emphasis": F.when(F.col("_lift"), F.col("_best")).otherwise(F.col("emphasis")),
        }
    ).drop("_lift", "_best")


def weakest_mix(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Mix lines beyond 45 % of a video's lines, weakest first, go back to plain.

    Ranks come from a running count over the few distinct (weight, key length) values;
    only the tied value at the limit is numbered row by row, in blocks.
    """
    weight, size = F.col("weight"), F.length(X.norm(F.col("emphasis")))
    mixes = lines.filter("style = 'mix'").select("video_id", "line_id", F.struct(weight.alias("w"), size.alias("s")).alias("_v"))
    sizes = lines.groupBy("video_id").agg(F.count("*").alias("_n"), F.count_if(F.col("style") == "mix").alias("_m"))
    surplus = sizes.withColumn("_drop", F.col("_m") - F.floor(F.col("_n") * 45 / 100)).filter("_drop > 0")
    by_value = Window.partitionBy("video_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = (
        mixes.groupBy("video_id", "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_below", F.coalesce(F.sum("_c").over(by_value), F.lit(0)))
        .join(surplus.select("video_id", "_drop"), "video_id")
        .filter(F.col("_below") < F.col("_drop"))
    )
    ranked = mixes.join(below, ["video_id", "_v"])
    whole = ranked.filter(F.col("_below") + F.col("_c") <= F.col("_drop")).select("video_id", "line_id")
    edge = ranked.filter(F.col("_below") + F.col("_c") > F.col("_drop")).withColumn("_take", F.col("_drop") - F.col("_below"))
    tied = dense_ids(edge, VIDEO, "line_id", "_p", hot).filter(F.col("_p") < F.col("_take")).select("video_id", "line_id")
    flagged = mark(lines, whole.unionByName(tied), ["video_id", "line_id"], "_weak")
    return flagged.withColumns(
        {
            "style": F.when(F.col("_weak"), F.lit("plain")).otherwise(F.col("style")),
            "emphasis": F.when(F.col("_weak"), F.lit("")).otherwise(F.col("emphasis")),
        }
    ).drop("_weak")


# Cue ranks and spacing.
CUE_RANK = {"whoosh": 1, "swoosh": 2, "hit": 3, "impact": 4}
CUE_GAP_MS, CUE_MAX = 1650, 14
OVERLAY_GAP_MS, OVERLAY_MAX = 8000, 6


def _cue_step(gap, cap):
    def step(state, row):
        held, kept = state
        hit = [row["at_ms"], row["kind"], row["gain"], row["reason"], row["rank"]]
        if held is None:
            return [hit, 1], []
        if held[0] is not None and hit[0] - held[0] < gap and kept < cap:
            return [hit if hit[4] > held[4] else held, kept], []
        if kept >= cap:
            return state, []
        return [hit, kept + 1], [tuple(held[:4])]

    return step


def gate_cues(cues: DataFrame, gap_ms: int = CUE_GAP_MS, cap: int = CUE_MAX, hot: HotKeys | None = None) -> DataFrame:
    """Cues (video_id, ord, at_ms, kind, gain, reason, duration_ms) thinned: a stronger cue replaces the one it crowds."""
    ranks = F.create_map(*[F.lit(x) for kv in CUE_RANK.items() for x in kv])
    dur = F.col("duration_ms")
    clipped = cues.filter((dur <= 200) | (F.col("at_ms") < dur - 120)).withColumns(
        {"_raw": F.col("at_ms"), "rank": F.coalesce(F.try_element_at(ranks, F.col("kind")), F.lit(0))}
    )
    clipped = clipped.withColumns({"at_ms": F.greatest(F.lit(40), F.col("at_ms")), "_down": -F.col("rank")})
    return ordered_fold(
        clipped.select("video_id", "ord", "_raw", "_down", "at_ms", "kind", "gain", "reason", "rank"),
        VIDEO,
        ["_raw", "_down", "ord"],
        [None, 0],
        _cue_step(gap_ms, cap),
        "at_ms bigint, kind string, gain double, reason string",
        finish=lambda s: [tuple(s[0][:4])] if s[0] else [],
        hot=hot,
    )


def _variety_step(chest):
    def step(state, row):
        marker, last_chest = state
        t = row["start_ms"]
        if row["first"]:
            return state, [(row["caption_id"], "default", "head")]
        if row["short"] and (marker is None or t - marker >= 15_000):
            return [t, last_chest], [(row["caption_id"], "marker", "head")]
        if chest and (last_chest is None or t - last_chest >= 9_000):
            return [marker, t], [(row["caption_id"], "default", "chest")]
        return state, [(row["caption_id"], "default", "head")]

    return step


def variety(caps: DataFrame, chest: bool = True, hot: HotKeys | None = None) -> DataFrame:
    """(video_id, caption_id, font_variant, screen_area): marker font and chest area on two timers."""
    short = X.one_of(F.col("treatment"), ["plain", "mix", "serif"]) & X.token_count(F.col("text")).between(1, 4)
    starts = caps.groupBy("video_id").agg(F.min("caption_id").alias("_first"))
    rows = caps.join(starts, "video_id").select(
        "video_id", "caption_id", "start_ms", short.alias("short"), (F.col("caption_id") == F.col("_first")).alias("first")
    )
    return ordered_fold(
        rows, VIDEO, ["caption_id"], [None, None], _variety_step(chest), "caption_id bigint, font_variant string, screen_area string", hot=hot
    )
