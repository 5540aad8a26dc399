"""Style allocation: lines compete for rare looks in passes of falling priority."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, functions as F

from voxtable import rules
from voxtable.functions import text as X
from voxtable.operators import gates as G
from voxtable.operators.lines import BIG_GAP, BIG_STYLES, STYLE_GAP, STYLE_WORDS
from voxtable.operators.ordered import HotKeys, find_hot, neighbours, ordered_fold
from voxtable.session import cut_lineage, once

VIDEO = ["video_id"]
DESIGNED = [*BIG_STYLES, "underline"]
# Seconds of talk per filled style, shortest word that can carry it.
FILL = [("oval", 26_000, 5), ("underline", 20_000, 5), ("serif", 7_000, 4)]
OPENING_MS = 30_000
# Pass numbers, in order of claim on the spacing.
HOOK, FIGURE, HIGHLIGHT, ASK, ACCENT, PAYOFF, OPEN_OVAL, OPEN_UNDERLINE, FILL_FIRST = range(9)


def _near(times, t, gap):
    at = bisect_left(times, t)
    return any(abs(t - x) < gap for x in times[max(0, at - 1) : at + 1])


def _place_step(state, row):
    """state: placed times per style, and the lines that are taken."""
    placed, taken = state
    line, t, number = str(row["line_id"]), row["start_ms"], row["number"]
    if number == HOOK:
        if row["style"] != "plain":
            insort(placed.setdefault(row["style"], []), t)
            taken[line] = 1
        if row["absorbs"]:
            taken[str(row["next_id"])] = 1
        return state, [(row["style"],)] if row["style"] != "plain" else []
    style = row["style"]
    mine = placed.get(style, [])
    blocked = (
        line in taken
        or (number in (OPEN_OVAL, OPEN_UNDERLINE) and mine and mine[0] - row["t0"] < OPENING_MS)
        or (row["target"] is not None and len(mine) >= row["target"])
        or _near(mine, t, STYLE_GAP.get(style, 0))
        or (style in DESIGNED and any(_near(placed.get(s, []), t, BIG_GAP + 600) for s in DESIGNED))
    )
    if blocked:
        return state, []
    insort(placed.setdefault(style, []), t)
    taken[line] = 1
    return state, [(style,)]


def _mix_step(state, row):
    before = state[0]
    style = row["style"]
    if style == "plain" and not row["absorbed"] and row["key"]:
        if row["weight"] >= 2 or before in (None, "plain") or row["key_size"] >= 7:
            style = "mix"
    return [style], [(style,)]


def claims(lines: DataFrame, look: str) -> DataFrame:
    """One row per line and pass it may compete in: (number, o1, o2, style, target, ...).

    Only static conditions are tested here; what depends on lines placed before is left to the scan.
    """
    decorative = F.lit(look != "editorial")
    n, w, kind, key = F.col("n"), F.col("weight"), F.col("kind"), F.col("key") != ""
    index, weight_first, longest = F.lit(0), -w, -F.col("n_content")
    none = F.lit(None).cast("bigint")

    def claim(number, cond, style, o1, target=none, sub=0, o2=index):
        return F.when(
            cond,
            F.struct(
                F.lit(number).alias("number"), o1.cast("bigint").alias("o1"), o2.cast("bigint").alias("o2"), F.lit(sub).alias("sub"),
                (F.lit(style) if isinstance(style, str) else style).alias("style"), target.cast("bigint").alias("target"),
            ),
        )

    fits = {s: n <= STYLE_WORDS[s] for s in STYLE_WORDS}
    worthy = (w == 3) | kind.isin("drama", "quote", "term")
    accent = decorative & (w >= 2) & worthy
    figure = X.names_figure(F.col("text"))
    high = (F.col("loud") & (w >= 1)) | (F.col("mood").isin(G.POP_MOODS) & (w >= 2))
    opening = decorative & (F.col("start_ms") - F.col("t0") < OPENING_MS) & (w >= 1) & (F.col("strong_size") >= 4)
    options = [
        claim(HOOK, F.col("is_hook"), F.col("hook_style"), index),
        claim(FIGURE, decorative & figure & fits["chip"], "chip", index),
        claim(HIGHLIGHT, decorative & high & fits["chip"], "chip", index),
        claim(ASK, F.lit(look in ("premium", "editorial")) & F.col("cta") & fits["bubble"], "bubble", index),
        claim(ACCENT, accent & (kind == "concept") & fits["oval"], "oval", weight_first),
        claim(ACCENT, accent & kind.isin("concept", "term") & fits["underline"] & key, "underline", weight_first, sub=1),
        claim(ACCENT, accent & (kind == "drama") & fits["tape"] & key, "tape", weight_first),
        claim(ACCENT, accent & (kind == "quote") & n.between(2, STYLE_WORDS["quote"]), "quote", weight_first),
        claim(PAYOFF, (w >= 2) & ~((kind == "normal") & (w < 3)) & fits["serif"], "serif", weight_first),
        claim(OPEN_OVAL, opening & fits["oval"], "oval", weight_first, o2=longest),
        claim(OPEN_UNDERLINE, opening & fits["underline"], "underline", weight_first, o2=longest),
    ]
    for k, (style, per, size) in enumerate(FILL):
        wanted = F.bround(F.col("talk_ms") / per)
        allowed = F.lit(True) if style == "serif" else decorative
        options.append(claim(FILL_FIRST + k, allowed & (w >= 1) & fits[style] & (F.col("strong_size") >= size), style, weight_first, wanted, o2=longest))
    found = once(lines.withColumn("_c", F.array_compact(F.array(*options)))).withColumn("c", F.explode("_c"))
    return found.select("video_id", "line_id", "start_ms", "t0", "next_id", F.col("absorbs"), "c.*")


def allocate_styles(lines: DataFrame, look: str = "classic", hot: HotKeys | None = None) -> DataFrame:
    """Lines (text, weight, kind, key_note, mood, icon, cta, loud) with style, emphasis, shown_mood and shown_icon.

    Every line offers one row per pass it qualifies for, and one streamed scan in pass
    order gives the slots away. The scan holds the placed lines only, and those are
    kept apart by the spacing it enforces.
    """
    if hot is None:
        hot = find_hot(lines, VIDEO)
    opened = F.when(F.col("line_id") <= 1, X.strip_greeting(F.col("text"))).otherwise(F.col("text"))
    base = neighbours(
        lines.withColumns({"raw": F.col("text"), "text": opened}), VIDEO, "line_id", lead={"next_id": "line_id", "_nt": "text", "_ns": "start_ms"}, hot=hot
    )
    strong = F.when(F.col("key") != "", F.col("key")).otherwise(X.content_word(X.tokens(F.col("text"))))
    content = F.size(F.filter(X.norm_tokens(F.col("text")), lambda t: ~X.one_of(t, rules.FILLER)))
    base = (
        base.withColumns({"n": X.token_count(F.col("text")), "key": X.key_for(F.col("text"), F.col("key_note"))})
        .withColumns({"strong": strong, "n_content": content, "key_size": F.length(X.norm(F.col("key")))})
        .withColumn("strong_size", F.length(X.norm(F.col("strong"))))
    )
    bounds = lines.groupBy("video_id").agg(F.min("start_ms").alias("t0"), F.greatest(F.max("start_ms") - F.min("start_ms"), F.lit(1000)).alias("talk_ms"))
    hooks = G.hook_line(lines.withColumn("style", F.lit("plain")))
    base = base.join(bounds, "video_id").join(hooks, "video_id")
    hook = F.col("line_id") == F.col("hook_line")
    stack = (
        hook
        & F.col("next_id").isNotNull()
        & (F.col("n") <= 3)
        & (X.token_count(F.col("_nt")) <= 4)
        & (F.col("_ns") - F.col("start_ms") <= 1800)
        & ~F.rtrim("text").rlike(r"[.?!]$")
    )
    hook_style = (
        F.when(F.col("absorbs"), F.lit("stack"))
        .when(F.col("n") <= STYLE_WORDS["serif"], F.lit("serif"))
        .when(F.col("strong") != "", F.lit("mix"))
        .otherwise(F.lit("plain"))
    )
    base = base.withColumns({"is_hook": hook, "absorbs": F.coalesce(stack, F.lit(False))}).withColumn("hook_style", hook_style)
    # Read by the scan and by the join behind it, and the rest builds on the result several times: store both.
    base = cut_lineage(base)
    placed = ordered_fold(
        claims(base, look), VIDEO, ["number", "o1", "o2", "start_ms", "line_id", "sub"], [{}, {}], _place_step, "style string", carry=["line_id"], hot=hot
    )
    styled = base.join(placed, ["video_id", "line_id"], "left").withColumn("style", F.coalesce("style", F.lit("plain")))
    styled = neighbours(styled, VIDEO, "line_id", lag={"absorbed": "absorbs"}, hot=hot).withColumn("absorbed", F.coalesce("absorbed", F.lit(False)))
    keep = [
        "line_id", "start_ms", "raw", "text", "weight", "kind", "mood", "icon", "cta", "loud", "key", "strong", "is_hook", "absorbs", "absorbed",
    ]
    mixed = ordered_fold(
        styled.select("video_id", "style", "key_size", *keep), VIDEO, ["line_id"], [None], _mix_step, "style string", carry=keep, hot=hot
    )
    emphasis = (
        F.when((F.col("style") == "mix") & F.col("is_hook"), F.col("strong"))
        .when(F.col("style") == "mix", F.col("key"))
        .when((F.col("style") == "underline"), F.col("strong"))
        .otherwise(F.lit(""))
    )
    capped = G.weakest_mix(cut_lineage(mixed.withColumn("emphasis", emphasis)), hot)
    flagged = cut_lineage(capped.withColumn("stacked", F.col("absorbs")))
    return G.icon_badges(G.mood_pops(flagged, hot), hot)


def absorb_stacks(styled: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """A stacked hook takes the next line as its sub-line, and that line goes."""
    near = neighbours(styled, VIDEO, "line_id", lead={"_sub": "raw"}, hot=hot)
    return near.withColumn("sub", F.when(F.col("absorbs"), F.col("_sub")).otherwise(F.lit(""))).filter(~F.col("absorbed")).drop("_sub")
