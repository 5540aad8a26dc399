"""Card and scene plans: one rule per sentence, then placement."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions import text as X
from voxtable.functions.text import let, one_of
from voxtable.operators import intervals as I
from voxtable.operators.ordered import HotKeys
from voxtable.session import cut_lineage, once

CARD_MIN_MS, CARD_MAX_MS = 4200, 7400
SCENE_MIN_MS, SCENE_MAX_MS = 5200, 9500
QUESTION = r"\?$|^(why|how|what|when|should|is|are|do)\b"


def _hold(start: Column, end: Column, shortest: int, longest: int) -> Column:
    return F.least(F.greatest(end, start + shortest), start + longest)


def snippet(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) > 48, F.concat(F.regexp_replace(F.substring(t, 1, 45), r" [^ ]*\z", ""), F.lit("…"))).otherwise(t)


class Card(NamedTuple):
    """What a card of one rule shows. Texts may hold {figure}, {snippet}, {name}, {note} and {extra} of the sentence."""

    rule: str
    kind: str
    kicker: str
    icon: str
    title: str
    confidence: float
    motion: str = "slide_up"
    subtitle: str = ""
    left: str = ""
    right: str = ""
    bullets: tuple[tuple[str, str], ...] = ()


# Kinds, kickers, icons and confidences of the rules, in the order in which they are tried.
CARD_RULES = [
    Card("compare", "vs_split", "THE TRADEOFF", "⚖️", "{rule}", 0.86, left="RAG", right="Fine-tuning"),
    Card("figure", "stat", "NUMBER", "📊", "{figure}", 0.8, "scale_in", subtitle="{name}"),
    Card("adapters", "bullets", "PEFT", "⚙️", "{rule}", 0.8),
    Card("retrieval_steps", "process", "RAG PATH", "🔍", "{rule}", 0.82),
    Card("tuning_steps", "process", "FINE-TUNE PATH", "🧠", "{rule}", 0.8),
    Card("retrieval_cost", "bullets", "COST", "💰", "{rule}", 0.8),
    Card("tuning_cost", "bullets", "COST", "💰", "{rule}", 0.8),
    Card("concept", "bullets", "CONCEPT", "✨", "{name}", 0.74, subtitle="{note}", bullets=(("", "{note}"), ("✨", "with {extra}"), ("🎯", "{ask}"))),
    Card("take", "bullets", "TAKE", "💡", "{snippet}", 0.6, bullets=(("💡", "{snippet}"),)),
]
CONCEPT_ICONS = {
    "RAG": "🔍", "Fine-tuning": "🧠", "LLM": "💡", "Documents": "📄", "Domain data": "📁", "Cost": "💰", "Latest data": "🔁", "Static data": "📂", "LoRA": "🧩", "PEFT": "⚙️",
}
CONCEPT_KICKERS = {"hook": "HOOK", "question": "HOOK", "key_insight": "INSIGHT", "reveal": "INSIGHT"}
BULLETS_MOST, BULLET_DELAY_MS = 3, 480
BULLET = "array<struct<icon:string,text:string,delay_ms:int>>"
#: What a card without a term calls its figure, and what it says below a question.
FIGURE_NAME, ASK = "figure", "an open question"
#: Columns that a copy table may give beside rule and term; where it has null, or lacks the column, the rule's own stands.
COPY = ["title", "subtitle", "kicker", "icon", "left", "right", "chips", "bullets"]


def _conditions(role: Column, names: Column, text: Column, figure: Column) -> list[Column]:
    """When each rule of CARD_RULES holds, in their order."""
    has = lambda n: F.array_contains(names, n)
    steps, cost, some = X.is_process(text), F.lower(text).contains("cost"), F.size(names) > 0
    return [
        one_of(role, ["contrast", "contradiction"]) | X.is_comparison(text) | (has("RAG") & has("Fine-tuning")),
        (role == "important_number") & figure.isNotNull(),
        has("LoRA") | has("PEFT"),
        has("RAG") & steps,
        has("Fine-tuning") & steps,
        has("RAG") & cost,
        has("Fine-tuning") & cost,
        some,
        one_of(role, ["hook", "key_insight", "reveal", "strong_opinion"]),
    ]


def _filled(template: Column, facts: dict[str, Column]) -> Column:
    for name, value in facts.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def _rule_table() -> Column:
    """The rules as a map from their number to a row of their values."""
    def row(c: Card) -> Column:
        bullets = F.array(*[F.struct(F.lit(i).alias("icon"), F.lit(t).alias("text")) for i, t in c.bullets]) if c.bullets else F.array().cast("array<struct<icon:string,text:string>>")
        return F.struct(*[F.lit(v).alias(n) for n, v in c._asdict().items() if n != "bullets"], bullets.alias("bullets"))

    return F.array(*[row(c) for c in CARD_RULES])


def card_rows(labelled: DataFrame, copy: DataFrame | None = None) -> DataFrame:
    """One card row per sentence that meets a rule: its span and all that the card shows.

    The first rule that holds picks a row of the rule table; its texts are filled with
    the sentence's facts in one expression. A concept card's kicker goes by the role, its
    icon by the term. At most three bullets that say something stay, each shown 480 ms
    after the one before. `copy` (rule, term and any of COPY) puts other wording in
    their place, by rule and for concepts by term.
    """
    base = labelled.withColumn("_t", X.fix_asr(F.col("text"))).withColumns({"_terms": X.terms(F.col("_t")), "_fig": X.first_figure(F.col("_t"))})
    role, terms = F.col("role"), F.col("_terms")
    names = F.transform(terms, lambda s: s["name"])
    base = base.withColumns({"_names": names, "_others": F.slice(names, 2, 2)})
    conditions = _conditions(role, F.col("_names"), F.col("_t"), F.col("_fig"))
    number = F.when(one_of(role, ["cta", "generic"]) & (F.size("_names") == 0), F.lit(None).cast("int"))
    for i, holds in enumerate(conditions):
        number = number.when(holds, i)
    picked = once(base.withColumn("_no", number)).filter("_no IS NOT NULL").withColumn("_r", F.get(_rule_table(), F.col("_no")))

    rule, is_concept = F.col("_r.rule"), F.col("_r.rule") == "concept"
    first = F.get(terms, F.lit(0))
    facts = {
        "rule": rule, "figure": F.col("_fig"), "snippet": snippet(F.col("_t")), "note": first["subtitle"], "extra": F.array_join("_others", " · "),
        "name": F.coalesce(first["name"], F.lit(FIGURE_NAME)), "ask": F.lit(ASK),
    }
    icons, kickers = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (CONCEPT_ICONS, CONCEPT_KICKERS))
    icon = F.when(is_concept, F.coalesce(F.try_element_at(icons, first["name"]), F.col("_r.icon"))).otherwise(F.col("_r.icon"))
    says = F.filter(
        F.col("_r.bullets"),
        lambda b: ~((b["text"].contains("{extra}") & (F.size("_others") == 0)) | (b["text"].contains("{ask}") & (role != "question"))),
    )
    own = F.transform(says, lambda b: F.struct(F.when(b["icon"] == "", icon).otherwise(b["icon"]).alias("icon"), _filled(b["text"], facts).alias("text")))
    rows = picked.select(
        "video_id",
        F.col("sentence_id").alias("beat_id"),
        "start_ms",
        _hold(F.col("start_ms"), F.col("end_ms"), CARD_MIN_MS, CARD_MAX_MS).alias("end_ms"),
        rule.alias("rule"),
        F.col("_r.kind").alias("kind"),
        F.col("_r.motion").alias("motion"),
        F.col("_r.confidence").alias("confidence"),
        F.when(is_concept, first["name"]).otherwise(F.lit("")).alias("term"),
        _filled(F.col("_r.title"), facts).alias("title"),
        _filled(F.col("_r.subtitle"), facts).alias("subtitle"),
        F.when(is_concept, F.coalesce(F.try_element_at(kickers, role), F.col("_r.kicker"))).otherwise(F.col("_r.kicker")).alias("kicker"),
        icon.alias("icon"),
        F.col("_r.left").alias("left"),
        F.col("_r.right").alias("right"),
        F.when(is_concept, F.col("_others")).otherwise(F.array().cast("array<string>")).alias("chips"),
        own.alias("bullets"),
    )
    if copy is not None:
        given = [c for c in COPY if c in copy.columns]
        told = copy.select("rule", "term", *[F.col(c).alias(f"_{c}") for c in given])
        rows = rows.join(told, ["rule", "term"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in given}).drop(*[f"_{c}" for c in given])
    delayed = F.transform(F.slice("bullets", 1, BULLETS_MOST), lambda b, i: F.struct(b["icon"].alias("icon"), b["text"].alias("text"), (i * BULLET_DELAY_MS).alias("delay_ms")))
    return rows.withColumn("bullets", delayed)


def plan_cards(
    labelled: DataFrame, durations: DataFrame, copy: DataFrame | None = None, topic: str = "topic", hot: HotKeys | None = None
) -> DataFrame:
    """Rule cards without overlap or quick repeats, stretched over the whole video; one topic card where none fits."""
    placed = I.dedupe_titles(I.no_overlap(card_rows(labelled, copy), I.CARDS, hot), hot)
    timed = placed.join(durations, "video_id")
    # Read by the second pass and by the search for videos without a card: stored once.
    tiled = cut_lineage(I.cover_duration(I.clamp_duration(timed), "beat_id", hot=hot))
    final = I.cover_duration(I.clamp_duration(tiled), "beat_id", hot=hot)
    none = durations.join(tiled.select("video_id").distinct(), "video_id", "left_anti").filter("duration_ms > 1000")
    fallback = none.select(
        "video_id",
        F.lit(0).cast("bigint").alias("beat_id"),
        F.lit(0).cast("bigint").alias("start_ms"),
        F.col("duration_ms").alias("end_ms"),
        F.lit("topic").alias("rule"),
        F.lit("topic").alias("kind"),
        F.lit("slide_up").alias("motion"),
        F.lit(0.5).alias("confidence"),
        F.lit("").alias("term"),
        F.lit(topic).alias("title"),
        F.lit("").alias("subtitle"),
        F.lit("TOPIC").alias("kicker"),
        *[F.lit("").alias(c) for c in ("icon", "left", "right")],
        F.array().cast("array<string>").alias("chips"),
        F.array().cast(BULLET).alias("bullets"),
        "duration_ms",
    )
    return final.unionByName(fallback)


def _clip(c: Column, n: int) -> Column:
    return X.clip_words(c, n, " ,.;:?", fixed=True)


def _node(label: Column, sub: Column | None = None) -> Column:
    return F.struct(label.alias("label"), (F.lit("") if sub is None else sub).alias("sub"))


def scene_rows(labelled: DataFrame) -> DataFrame:
    """Scene rows: kind, title, kicker, nodes, chips and bullets. `is_first` marks a video's opening sentence."""
    role, hook = F.col("role"), F.col("is_first")
    base = labelled.withColumn("_t", X.stabilize(F.col("text"))).withColumns(
        {"_terms": X.terms(F.col("_t")), "_fig": X.first_figure(F.col("_t")), "_parts": X.even_chunks(F.col("_t"), 3, 20, fixed=True)}
    )
    base = once(base).filter(hook | ~(one_of(role, ["generic", "transition"]) & (F.size("_terms") == 0)))
    terms, parts, n = F.col("_terms"), F.col("_parts"), F.size("_terms")
    asks = (role == "question") | X.matches(F.col("_t"), QUESTION)
    contrast = one_of(role, ["contrast", "contradiction"]) | X.is_comparison(F.col("text"))
    kicker = (
        F.when(asks, F.when(hook, F.lit("HOOK")).otherwise(F.lit("QUESTION")))
        .when((role == "important_number") | F.col("_fig").isNotNull(), F.lit("NUMBER"))
        .when(one_of(role, ["contrast", "contradiction"]), F.lit("COMPARE"))
        .when(role == "cta", F.lit("CTA"))
        .when(hook | (role == "hook"), F.lit("HOOK"))
        .otherwise(F.lit("INSIGHT"))
    )
    rule = (
        F.when(F.col("_fig").isNotNull() & (hook | one_of(role, ["important_number", "hook", "key_insight"])), F.lit("figure"))
        .when(contrast & (n >= 2), F.lit("compare"))
        .when(X.is_process(F.col("_t")) | (one_of(role, ["key_insight", "answer"]) & (n > 0)), F.lit("steps"))
        .when(asks, F.lit("question"))
        .otherwise(F.lit("plain"))
    )
    base = base.withColumns({"rule": rule, "_kick": kicker})
    is_rule = F.col("rule")
    kind = (
        F.when(is_rule == "figure", F.lit("stat"))
        .when(is_rule == "compare", F.lit("vs_split"))
        .when(is_rule == "steps", F.when(hook | one_of(role, ["key_insight", "answer"]), F.lit("diagram")).otherwise(F.lit("process")))
        .when(is_rule == "question", F.when(hook, F.lit("quote")).otherwise(F.lit("topic")))
        .otherwise(F.when(hook, F.lit("topic")).otherwise(F.lit("bullets")))
    )
    shown = (
        F.when(is_rule == "compare", F.when(hook, F.lit("HOOK")).otherwise(F.lit("COMPARE")))
        .when(is_rule == "steps", F.when(hook, F.lit("HOOK")).otherwise(F.lit("STEPS")))
        .otherwise(F.col("_kick"))
    )
    title = (
        F.when(is_rule == "figure", F.col("_fig"))
        .when(is_rule == "compare", X.headline(F.col("_t"), 6, fixed=True))
        .when(is_rule == "question", X.headline(F.col("_t"), 8, fixed=True))
        .otherwise(X.headline(F.col("_t"), fixed=True))
    )
    confidence = (
        F.when(is_rule == "figure", 0.8)
        .when(is_rule == "compare", 0.84)
        .when(is_rule == "steps", 0.78)
        .when(is_rule == "question", 0.76)
        .otherwise(F.when(hook, 0.7).otherwise(0.62))
    )
    motion = F.when((is_rule == "figure") | ((is_rule == "plain") & hook), F.lit("scale_in")).otherwise(F.lit("slide_up"))
    subtitle = (
        F.when(is_rule == "figure", _clip(F.col("_t"), 42))
        .when(is_rule == "compare", _clip(F.get(terms, F.lit(0))["subtitle"], 36))
        .otherwise(F.lit(""))
    )
    none = F.array().cast("array<string>")
    names = F.transform(F.slice(terms, 1, 4), lambda t: t["name"])
    own_chips = F.when(
        is_rule == "steps",
        F.when(n >= 2, names).otherwise(F.transform(F.slice(X.tokens(F.col("_t")), 1, 4), lambda w: _clip(w, 14))),
    ).otherwise(none)
    base = base.withColumns({"_chips": own_chips, "subtitle": subtitle})
    cleaned = F.transform(F.filter("_chips", lambda c: F.trim(c) != ""), lambda c: _clip(c, 18))
    told = F.transform(F.slice(terms, 1, 4), lambda t: _node(_clip(t["name"], 18), _clip(t["subtitle"], 36)))
    plain = F.transform(parts, lambda p: _node(p))
    nodes = (
        F.when(is_rule == "compare", F.slice(told, 1, 2))
        .when(F.size(cleaned) >= 2, F.transform(F.slice(cleaned, 1, 5), lambda c: _node(c)))
        .when(n >= 2, told)
        .when(F.size(parts) >= 2, plain)
        .when(n == 1, told)
        .otherwise(F.slice(plain, 1, 1))
    )
    base = base.withColumn("_nodes", nodes)
    grown = F.when(
        (F.size("_nodes") == 1) & (F.col("subtitle") != ""), F.concat("_nodes", F.array(_node(_clip(F.col("subtitle"), 18))))
    ).otherwise(F.col("_nodes"))
    base = base.withColumn("_nodes", F.slice(grown, 1, 5))

    def bullets(extra):
        lines = F.concat(
            F.transform(F.slice(terms, 1, 3), lambda t: _clip(F.concat(t["name"], F.lit(": "), t["subtitle"]), 44)),
            F.transform(F.filter(extra, lambda x: x != ""), lambda x: _clip(x, 44)),
        )
        full = let(lines, lambda a: F.when(F.size(a) < 3, F.concat(a, X.even_chunks(F.col("_t"), 4, 44, fixed=True))).otherwise(a))

        def unique(a):
            return let(
                F.transform(a, lambda x: F.lower(x)),
                lambda low: F.filter(a, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1)),
            )

        return F.slice(let(full, unique), 1, 5)

    base = base.withColumn("_plainb", bullets(none))
    with_subs = bullets(F.transform("_nodes", lambda x: x["sub"]))
    return base.select(
        "video_id",
        F.col("sentence_id").alias("beat_id"),
        "is_first",
        "start_ms",
        _hold(F.col("start_ms"), F.col("end_ms"), SCENE_MIN_MS, SCENE_MAX_MS).alias("end_ms"),
        kind.alias("kind"),
        title.alias("title"),
        shown.alias("kicker"),
        "subtitle",
        motion.alias("motion"),
        confidence.alias("confidence"),
        F.col("_nodes").alias("nodes"),
        F.slice(F.when(F.size("_chips") > 0, F.col("_chips")).otherwise(F.transform("_nodes", lambda x: x["label"])), 1, 6).alias("chips"),
        F.when(F.size("_plainb") >= 3, F.col("_plainb")).otherwise(with_subs).alias("bullets"),
    )


def plan_scenes(labelled: DataFrame, durations: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Scenes without overlap, tiling the video; the opening sentence always offers one."""
    # Read by the rules and by the search for the opening sentence: what they need is stored once.
    labelled = cut_lineage(labelled.select("video_id", "sentence_id", "start_ms", "end_ms", "text", "role"))
    opening = labelled.groupBy("video_id").agg(F.min("sentence_id").alias("_first"))
    rows = scene_rows(labelled.join(opening, "video_id").withColumn("is_first", F.col("sentence_id") == F.col("_first")))
    timed = rows.join(durations, "video_id").withColumn("end_ms", F.least("end_ms", "duration_ms"))
    # Where the opening scene finds no room no later one does, so it is the one that stays.
    kept = I.no_overlap(timed, I.SCENES, hot, forced=F.col("is_first"))
    return I.cover_duration(kept.drop("is_first"), "beat_id", hot=hot)
