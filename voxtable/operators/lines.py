"""Caption lines: merging, splitting, design rules and model-made groups."""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtable import rules
from voxtable.functions import text as X
from voxtable.operators import gates as G
from voxtable.operators.ordered import HotKeys, dense_ids, neighbours, ordered_fold
from voxtable.operators.segment import PACK_MS, PACK_WORDS, allocate_counts, caption_groups, cover_ranges, time_slices, words_in_ranges
from voxtable.session import cut_lineage, once

VIDEO = ["video_id"]
# Style limits. Gaps in ms.
STYLE_GAP = {"oval": 18000, "underline": 14000, "tape": 50000, "quote": 12000, "stack": 25000, "serif": 4500, "chip": 11000, "bubble": 18000}
BIG_STYLES = ["serif", "quote", "oval", "tape", "stack", "chip", "bubble"]
BIG_GAP = 2400
STYLE_WORDS = {"plain": 5, "mix": 5, "serif": 4, "stack": 4, "quote": 5, "oval": 3, "underline": 4, "tape": 3, "chip": 4, "bubble": 4}
LINE_MS, FLASH_MS = 3400, 500
_FILLER = frozenset(rules.FILLER)


# --- small row helpers --------------------------------------------------------------------------

def norm(token: str) -> str:
    return re.sub("[^a-z0-9]+", "", token.lower())


def carries(tokens: list[str], emphasis: str) -> bool:
    """Is the emphasis one or two words of the line, side by side and not all filler?"""
    want = [w for w in map(norm, emphasis.split()) if w]
    if not 1 <= len(want) <= 2 or _FILLER.issuperset(want):
        return False
    have = [norm(t) for t in tokens]
    return any(have[i : i + len(want)] == want for i in range(len(have) - len(want) + 1))


def strongest(tokens: list[str]) -> str:
    ranked = [(len(norm(t)), i, t) for i, t in enumerate(tokens) if norm(t) and norm(t) not in _FILLER]
    return max(ranked)[2].strip(",?!") if ranked else ""


# --- short captions -----------------------------------------------------------------------------

def _coalesce_step(state, row):
    """state: id, end, tokens and treatment of the open caption."""
    head, end, n, look = state
    both = n + row["n"]
    if head is not None and (n <= 2 or row["n"] <= 2) and row["start_ms"] - end <= 550 and both <= 4:
        t = row["treatment"]
        look = t if t in G.SPECIAL or (t == "mix" and look == "plain") else look
        state = [head, max(end, row["end_ms"]), both, look]
    else:
        state = [row["caption_id"], row["end_ms"], row["n"], row["treatment"]]
    return state, [(state[0], state[3])]


def coalesce_short(caps: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Join neighbours of one or two words while the run stays within four words."""
    rows = caps.withColumn("n", X.token_count(F.col("text")))
    runs = ordered_fold(
        rows, VIDEO, ["caption_id"], [None, 0, 0, "plain"], _coalesce_step, "head_id bigint, running string",
        carry=["caption_id", "start_ms", "end_ms", "text", "words"], hot=hot,
    )
    part = F.struct("caption_id", "text", "words")
    merged = runs.groupBy("video_id", "head_id").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.max_by("running", "caption_id").alias("treatment"),
        F.sort_array(F.collect_list(part)).alias("_p"),
    )
    return merged.select(
        "video_id",
        F.col("head_id").alias("caption_id"),
        "start_ms",
        "end_ms",
        F.array_join(F.transform("_p", lambda p: F.translate(p["text"], "\n", " ")), " ").alias("text"),
        "treatment",
        F.flatten(F.transform("_p", lambda p: p["words"])).alias("words"),
    )


def rule_captions(words: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Captions by rule: corrected words, groups of two or three, emphasis and spoken case."""
    clean = once(words.filter("video_id IS NOT NULL").withColumn("word", X.fix_asr(F.trim("word")))).filter("word <> ''")
    grouped = caption_groups(clean, hot=hot, carry=["word", "start_ms", "end_ms"])
    # Each word's copy is made once, in front of the grouping.
    grouped = grouped.withColumn("_copy", X.stabilize(F.col("word")))
    grouped = grouped.withColumn("_shown", F.when(F.col("_copy") == "", F.col("word")).otherwise(F.col("_copy"))).withColumn("_cased", X.spoken_case(F.col("_shown"), F.lit("plain")))
    text = F.when(F.col("_cased") == "", F.col("_shown")).otherwise(F.col("_cased"))
    told = X.one_of(X.strip(F.lower("word"), ".,!?"), G.EMPHASIS_WORDS)
    starts = F.struct("word_id", "word", "start_ms", "end_ms", text.alias("text"), told.alias("emphasis"))
    packs = grouped.groupBy("video_id", F.col("group_id").alias("caption_id")).agg(
        F.sort_array(F.collect_list(starts)).alias("_w"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("_end")
    )
    packs = packs.withColumn("end_ms", F.greatest(F.col("_end"), F.col("start_ms") + 250))

    def word(w):
        return F.struct(
            w["text"].alias("text"),
            w["start_ms"].alias("start_ms"),
            F.least(F.greatest(w["end_ms"], w["start_ms"] + 50), F.col("end_ms")).alias("end_ms"),
            w["emphasis"].alias("emphasis"),
        )

    packs = packs.withColumn("words", F.transform("_w", word)).withColumn(
        "treatment", F.when(G.any_emphasis(F.col("words")), F.lit("mix")).otherwise(F.lit("plain"))
    )
    running = X.stabilize(F.array_join(F.transform("_w", lambda w: w["word"]), " "))
    return packs.select(
        "video_id", "caption_id", "start_ms", "end_ms", X.spoken_case(running, F.col("treatment")).alias("text"), "treatment", "words"
    )


def plan_captions(words: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Groups, short ones joined, decorated and paced."""
    # Both gates read their input twice (all captions, special ones), so it is stored in front of them.
    return G.pace_treatments(G.decorate(cut_lineage(coalesce_short(rule_captions(words, hot), hot)), hot), hot)


# --- long captions ------------------------------------------------------------------------------

def packs_for(words: DataFrame, keys: list[str], hot: HotKeys | None = None) -> DataFrame:
    """Words with pack_no: a whole caption when short, else groups cut at 3.8 s.

    Keys name one caption. `pack_no` is the first word of the pack, so packs sort by it.
    """
    own = [c for c in words.columns if c not in (*keys, "word_id")]
    size = words.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max("end_ms") - F.min("start_ms")).alias("_ms"), F.min("word_id").alias("_head"))
    sized = words.join(size, keys)
    short = (F.col("_n") <= PACK_WORDS) & (F.col("_ms") <= PACK_MS)
    # The words go through both cuts with all their columns, so no cut has to be joined back.
    grouped = caption_groups(sized.filter(~short), keys, hot, carry=own)
    sliced = time_slices(grouped, [*keys, "group_id"], hot, carry=own)
    long = sliced.withColumn("pack_no", F.min("word_id").over(Window.partitionBy(*keys, "group_id", "slice_id")))
    whole = sized.filter(short).withColumn("pack_no", F.col("_head"))
    names = [*keys, "word_id", "pack_no", *[c for c in words.columns if c in own]]
    return whole.select(*names).unionByName(long.select(*names))


def explode_long(words: DataFrame, caps: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Re-split over-long captions. `words` has caption_id, word_id, text, times and emphasis of every caption word."""
    keys = ["video_id", "caption_id"]
    named = words.withColumn("word", F.col("text"))
    packed = packs_for(named, keys, hot)
    last = F.least(F.col("end_ms"), F.col("start_ms") + PACK_MS)
    w = F.struct("word_id", F.col("word").alias("text"), "start_ms", "end_ms", "emphasis")
    parts = packed.groupBy(*keys, "pack_no").agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by(F.when(F.lit(True), F.col("end_ms")), "word_id").alias("_end"),
        F.count("*").alias("_n"),
        F.min(last).alias("_cut"),
        F.transform(
            F.sort_array(F.collect_list(w)),
            lambda x: F.struct(x["text"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["emphasis"].alias("emphasis")),
        ).alias("words"),
    )
    # A single long word is cut at the limit; every pack shows at least a quarter second.
    end = F.greatest(F.when(F.col("_n") == 1, F.col("_cut")).otherwise(F.col("_end")), F.col("start_ms") + 250)
    joined = X.stabilize(F.array_join(F.transform("words", lambda x: x["text"]), " "))
    return parts.join(caps.select(*keys, "treatment"), keys).select(
        "video_id",
        F.col("pack_no").alias("caption_id"),
        "start_ms",
        end.alias("end_ms"),
        F.when(joined == "", F.get("words", F.lit(0))["text"]).otherwise(joined).alias("text"),
        "treatment",
        "words",
    )


def wrap_lines(text: Column, max_chars: int, max_lines: int = 3) -> Column:
    """Line number of every token: greedy wrap, widened two characters at a time until it fits."""

    def wrapped(lengths, width):
        start = F.struct(F.lit(-1).alias("used"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("at"))

        def place(acc, n):
            fresh = (acc["used"] >= 0) & (acc["used"] + 1 + n > width)
            line = F.when(fresh, acc["line"] + 1).otherwise(acc["line"])
            used = F.when(fresh | (acc["used"] < 0), n).otherwise(acc["used"] + 1 + n)
            return F.struct(used.alias("used"), line.alias("line"), F.concat(acc["at"], F.array(line)).alias("at"))

        return F.aggregate(lengths, start, place, lambda acc: acc["at"])

    widths = F.array(*[F.lit(w) for w in range(max_chars, max_chars + 17, 2)])

    def choose(lengths):
        tries = F.transform(widths, lambda w: wrapped(lengths, w))
        fits = F.filter(tries, lambda a: F.coalesce(F.array_max(a), F.lit(0)) < max_lines)
        return F.coalesce(F.get(fits, F.lit(0)), F.element_at(tries, -1))

    return X.let(F.transform(X.tokens(text), lambda t: F.length(t)), choose)


# --- drafts: split, design rules, flashes -------------------------------------------------------
DRAFT = "text string, sub string, style string, emphasis string, mood string, icon string, cta boolean"


class Piece(NamedTuple):
    """Words lo to hi of a line with the tokens shown for them; mood, icon and cta go with the first piece."""

    lo: int
    hi: int
    tokens: list[str]
    style: str
    emphasis: str
    extra: tuple


#: What the sides of a cut line look like; other small styles are cut into plain lines.
SIDE_LOOK = {"mix": "mix", "underline": "mix"}
NO_EXTRA = ("neutral", "none", False)


def _whole(piece: Piece, starts, ends) -> bool:
    """A line that stays as it is: a stack, too little to cut, or short enough in time and words."""
    short = ends[piece.hi] - starts[piece.lo] <= LINE_MS and len(piece.tokens) <= STYLE_WORDS.get(piece.style, 5)
    return short or piece.style == "stack" or len(piece.tokens) < 4 or piece.hi == piece.lo


def _cut(piece: Piece, starts, ends) -> list[Piece]:
    """Both sides: tokens by their number, words by the middle of their time; of a big style the side with more to say is set large."""
    middle = len(piece.tokens) // 2
    tokens = piece.tokens[:middle], piece.tokens[middle:]
    center = (starts[piece.lo] + ends[piece.hi]) / 2
    early = sum(starts[i] <= center for i in range(piece.lo + 1, piece.hi + 1))  # starts ascend
    cut = min(piece.hi, piece.lo + max(1, early))
    look = [SIDE_LOOK.get(piece.style, "plain")] * 2
    if piece.style in BIG_STYLES:
        left, right = (sum(norm(t) not in _FILLER for t in side) for side in tokens)
        look = ["serif", "plain"] if left > right else ["plain", "serif"]
    word = [piece.emphasis if carries(side, piece.emphasis) else "" for side in tokens]
    look = ["plain" if k == "mix" and not w else k for k, w in zip(look, word)]
    return [Piece(piece.lo, cut - 1, tokens[0], look[0], word[0], piece.extra), Piece(cut, piece.hi, tokens[1], look[1], word[1], NO_EXTRA)]


def pieces(line: Piece, starts, ends):
    """The line's pieces from left to right, each cut until it stays whole."""
    todo = [line]
    while todo:
        piece = todo.pop()
        if _whole(piece, starts, ends):
            yield piece
        else:
            todo += reversed(_cut(piece, starts, ends))


def split_long(lines: DataFrame) -> DataFrame:
    """Lines with the word starts and ends they cover to lines that fit; a narrow per-row pass.

    Needs first, text, sub, style, emphasis, mood, icon, cta and the arrays starts and ends.
    """
    head = [lines.schema["video_id"], lines.schema["line_id"]]
    schema = T.StructType(
        head + T._parse_datatype_string(f"part int, first bigint, last bigint, start_ms bigint, end_ms bigint, {DRAFT}").fields
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                starts, ends = r["starts"], r["ends"]
                line = Piece(0, len(starts) - 1, r["text"].split(), r["style"], r["emphasis"], (r["mood"], r["icon"], r["cta"]))
                for k, p in enumerate(pieces(line, starts, ends)):
                    text = r["text"] if p is line else " ".join(p.tokens)
                    sub = r["sub"] if p.style == "stack" else ""
                    place = (r["first"] + p.lo, r["first"] + p.hi, starts[p.lo], ends[p.hi])
                    rows.append((r["video_id"], r["line_id"], k, *place, text, sub, p.style, p.emphasis, *p.extra))
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return lines.mapInArrow(run, schema)


# --- rungs: the forms of a line from its own style down to plain, as one array column -----------
RUNG = "struct<style:string,emphasis:string,text:string,sub:string>"
#: Styles that go down to serif; a stack becomes mix with both texts; serif and underline become mix with a key word.
TO_SERIF = ["tape", "quote", "chip", "bubble"]
DECORATED = ["oval", "underline", "tape"]


def _rung(style, emphasis, text, sub) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (style, emphasis, text, sub)]
    return F.struct(*[x.alias(n) for x, n in zip(parts, ("style", "emphasis", "text", "sub"))]).cast(RUNG)


def rungs(style: Column, emphasis: Column, text: Column, sub: Column) -> Column:
    """The line as it is, then one step weaker each time."""
    toks = X.tokens(text)
    strong = X.content_word(toks)
    word = F.when(X.emphasis_ok(text, emphasis), emphasis).otherwise(strong)
    both = F.trim(F.concat_ws(" ", text, sub))
    no = F.array().cast(f"array<{RUNG}>")
    own, plain = F.array(_rung(style, emphasis, text, sub)), F.array(_rung("plain", "", text, sub))
    key = F.when(word != "", F.array(_rung("mix", word, text, sub))).otherwise(no)
    serif = F.array(_rung("serif", emphasis, text, sub))
    below = (
        F.when(style.isin("serif", "underline"), F.concat(key, plain))
        .when(style.isin(TO_SERIF) | ((style == "oval") & (F.size(toks) <= STYLE_WORDS["serif"])), F.concat(serif, key, plain))
        .when(style == "oval", F.concat(F.array(_rung("mix", emphasis, text, sub)), plain))
        .when(style == "stack", F.array(_rung("mix", strong, both, ""), _rung("plain", "", both, "")))
        .when(style == "plain", no)
        .otherwise(plain)
    )
    return F.concat(own, below)


def _fitting(rung: Column) -> Column:
    """Plain always fits; other styles have a limit of words."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in STYLE_WORDS.items() for x in kv])[rung["style"]], F.lit(5))
    return (rung["style"] == "plain") | (X.token_count(rung["text"]) <= limit)


def entry_rungs(lines: DataFrame) -> DataFrame:
    """lines with `rungs`, from the strongest form that fits down; a hook line that is small and short starts as serif.

    Emphasis that the text doesn't carry goes, and a mix line without any is plain.
    """
    c = F.col
    first = F.filter(rungs(c("style"), c("emphasis"), c("text"), c("sub")), _fitting)[0]
    d = lines.select(*[x for x in lines.columns if x not in ("style", "emphasis", "text", "sub")], first.alias("_r")).select("*", "_r.*").drop("_r")
    bare = c("style").isin("mix", "underline") & ~X.emphasis_ok(c("text"), c("emphasis"))
    d = d.withColumn("style", F.when(bare & (c("style") == "mix"), F.lit("plain")).otherwise(c("style")))
    d = d.withColumn("emphasis", F.when(bare | (c("style") == "plain"), F.lit("")).otherwise(c("emphasis")))
    lifted = c("hook") & c("style").isin("plain", "mix") & (X.token_count(c("text")) <= STYLE_WORDS["serif"])
    d = d.withColumns({"emphasis": F.when(lifted, F.lit("")).otherwise(c("emphasis")), "style": F.when(lifted, F.lit("serif")).otherwise(c("style"))})
    return d.withColumn("rungs", rungs(c("style"), c("emphasis"), c("text"), c("sub"))).drop("style", "emphasis", "text", "sub")


def _rung_step(state, row):
    """Takes the first form whose style, and whose size if big, is not too recent; a decorated term shows once per video."""
    recent, terms = state
    t, styles = row["start_ms"], row["styles"]

    def watched(style):
        gaps = {style: STYLE_GAP.get(style), "big": BIG_GAP if style in BIG_STYLES else None}
        return [(what, gap) for what, gap in gaps.items() if gap is not None]

    def free(style):
        return all(what not in recent or t - recent[what] >= gap for what, gap in watched(style))

    k = next((i for i, style in enumerate(styles) if free(style)), len(styles) - 1)
    if styles[k] in DECORATED:
        if row["terms"][k] in terms:
            k = min(k + 1, len(styles) - 1)
        else:
            terms[row["terms"][k]] = 1
    recent.update((what, t) for what, _ in watched(styles[k]))
    return [recent, terms], [(k,)]


def _join_look(a, b, tokens):
    """Style and emphasis of two lines in one: those of the decorated one, as far as the joined words allow."""
    owner = a if a["style"] != "plain" else b
    if owner["style"] == "plain" or (owner["style"] == "serif" and len(tokens) <= STYLE_WORDS["serif"]):
        return owner, owner["style"], ""
    own = strongest(owner["text"].split()) if owner["style"] == "serif" else owner["emphasis"]
    word = next((w for w in (own, strongest(tokens)) if carries(tokens, w)), "")
    return owner, "mix" if word else "plain", word


def _joined(a, b):
    """One line of two neighbours, or None where a pause of sense or too many words keep them apart."""
    left, right = a["text"].split(), b["text"].split()
    pause = a["text"].rstrip()[-1:] in {",", ".", "?", "!"} or (right and right[0][0].isupper() and norm(right[0]) != "i")
    if pause or len(left) + len(right) > STYLE_WORDS["mix"]:
        return None
    owner, style, emphasis = _join_look(a, b, left + right)
    extra = {f: owner[f] for f in ("mood", "icon", "cta")}
    return {**a, **extra, "last": b["last"], "end_ms": b["end_ms"], "text": " ".join(left + right), "sub": "", "style": style, "emphasis": emphasis}


FLASH_FIELDS = ["ord", "first", "last", "start_ms", "end_ms", "text", "sub", "style", "emphasis", "mood", "icon", "cta"]


def _flash_settle(held, at, final):
    """Examine line `at` of the held ones as often as it changes; returns the next position.

    A short line joins the next one, else the one before; stacks take no part.
    """
    while at < len(held) and (final or at + 1 < len(held)):
        here = held[at]
        short = here["end_ms"] - here["start_ms"] < FLASH_MS and here["style"] != "stack"
        for first in (at, at - 1) if short else ():
            pair = held[max(first, 0) : first + 2]
            one = _joined(*pair) if len(pair) == 2 and first >= 0 and all(x["style"] != "stack" for x in pair) else None
            if one:
                held[first : first + 2] = [one]
                at = first
                break
        else:
            at += 1
    return at


def _flash_step(state, row):
    held, at = state
    held.append({f: row[f] for f in FLASH_FIELDS})
    at = _flash_settle(held, at, final=False)
    out = []
    # Merged lines hold at most five words, so a line more than five behind is out of reach.
    while at > 6:
        done = held.pop(0)
        out.append(tuple(done[f] for f in FLASH_FIELDS))
        at -= 1
    return [held, at], out


def _flash_end(state):
    held, at = state
    _flash_settle(held, at, final=True)
    return [tuple(h[f] for f in FLASH_FIELDS) for h in held]


def merge_flashes(lines: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Fold lines spoken in under half a second into a neighbour when both still fit."""
    rows = lines.select("video_id", F.col("line_id").alias("ord"), *FLASH_FIELDS[1:])
    out = f"ord bigint, first bigint, last bigint, start_ms bigint, end_ms bigint, {DRAFT}"
    return ordered_fold(rows, VIDEO, ["ord"], [[], 0], _flash_step, out, finish=_flash_end, hot=hot).withColumnRenamed("ord", "line_id")


def clean_drafts(drafts: DataFrame) -> DataFrame:
    """Cleaned copy, known styles, a sub-line only on stacks; empty lines go."""
    style = F.when(F.col("style").isin(list(STYLE_WORDS)), F.col("style")).otherwise(F.lit("plain"))
    d = drafts.withColumns({"text": X.clean_copy(F.col("text")), "sub": X.clean_copy(F.col("sub")), "style": style})
    d = once(d).filter("text <> ''").withColumns(
        {
            "style": F.when((F.col("style") == "stack") & (F.col("sub") == ""), F.lit("serif")).otherwise(F.col("style")),
            "emphasis": F.when(F.col("emphasis") == "", F.lit("")).otherwise(X.strip(X.clean_copy(F.col("emphasis")), ",?!")),
        }
    )
    return d.withColumn("sub", F.when(F.col("style") == "stack", F.col("sub")).otherwise(F.lit("")))


def cover_drafts(lines: DataFrame, words: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Lines whose ranges are repaired to cover each word once, with the times of the words that are theirs now.

    Lines are numbered by their first word; ranges that lie behind the last word go.
    """
    # Read for the ranges and for all else that the lines show: stored once.
    lines = cut_lineage(lines)
    ranges = lines.select("video_id", "line_id", "first", (F.col("first") + F.size("starts") - 1).alias("last"))
    covered = cover_ranges(ranges, words.groupBy("video_id").agg(F.count("*").alias("n_words")), hot)
    inside = words_in_ranges(covered.select("video_id", "line_id", F.col("first").alias("lo"), F.col("last").alias("hi")), words.select("video_id", "word_id", "start_ms", "end_ms"))
    timed = inside.groupBy("video_id", "line_id").agg(F.min("lo").alias("first"), F.sort_array(F.collect_list(F.struct("word_id", "start_ms", "end_ms"))).alias("_w"))
    timed = cut_lineage(timed.select("video_id", "line_id", "first", F.transform("_w", lambda w: w["start_ms"]).alias("starts"), F.transform("_w", lambda w: w["end_ms"]).alias("ends")))
    placed = dense_ids(timed.select("video_id", "line_id", "first"), VIDEO, "first", "_at", hot).select("video_id", "line_id", "_at")
    rest = lines.drop("first", "starts", "ends")
    return rest.join(timed, ["video_id", "line_id"]).join(placed, ["video_id", "line_id"]).drop("line_id").withColumnRenamed("_at", "line_id").select(*lines.columns)


def design_rules(lines: DataFrame, hot: HotKeys | None = None, words: DataFrame | None = None) -> DataFrame:
    """Lines (see split_long) with repaired ranges, split, under rarity rules, with lifted runs and no flashes.

    With `words`, ranges are repaired first; without, lines must cover their words
    already. Lines are numbered anew from 0 in each video.
    """
    # Read by the numbering, the hook and the forms of every line: stored once, as are the forms.
    split = cut_lineage(split_long(lines if words is None else cover_drafts(lines, words, hot)))
    parts = neighbours(split.groupBy("video_id", "line_id").agg(F.count("*").alias("_n")), VIDEO, "line_id", total_before={"_before": "_n"}, hot=hot)
    split = split.join(parts.drop("_n"), ["video_id", "line_id"]).withColumn("line_id", F.col("_before") + F.col("part")).drop("_before", "part")
    hooks = G.hook_line(split)
    ready = entry_rungs(split.join(hooks, "video_id").withColumn("hook", F.col("line_id") == F.col("hook_line")))
    term = lambda r: F.when(r["style"].isin(DECORATED), X.norm(F.when(r["emphasis"] != "", r["emphasis"]).otherwise(r["text"])))
    ready = cut_lineage(ready.withColumn("styles", F.transform("rungs", lambda r: r["style"])).withColumn("terms", F.transform("rungs", term)))
    keep = ["line_id", "first", "last", "start_ms", "end_ms", "mood", "icon", "cta"]
    chosen = ordered_fold(ready.select("video_id", "line_id", "start_ms", "styles", "terms"), VIDEO, ["line_id"], [{}, {}], _rung_step, "rung int", carry=["line_id"], hot=hot)
    ruled = ready.join(chosen, ["video_id", "line_id"]).select("video_id", *keep, F.get("rungs", F.col("rung")).alias("_r")).select("video_id", *keep, "_r.text", "_r.sub", "_r.style", "_r.emphasis")
    return merge_flashes(G.lift_plain_runs(ruled, hot), hot)


# --- model-made groups --------------------------------------------------------------------------

def cover_groups(groups: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Model id groups (in order of group_no, each up to word hi) to contiguous ranges [lo, hi].

    Every group starts right behind the one before and reaches at least one word:
    hi_i = max(hi_i, hi_(i-1) + 1), a running maximum of hi_j - j over the groups' places j.
    """
    numbered = dense_ids(groups, VIDEO, "group_no", "_no", hot)
    near = neighbours(numbered, VIDEO, "group_no", max_before={"_peak": F.col("hi") - F.col("_no")}, hot=hot)
    lo = F.greatest(F.lit(0), F.coalesce(F.col("_peak") + F.col("_no"), F.lit(0)))
    return near.withColumn("lo", lo).withColumn("hi", F.greatest("hi", "lo")).drop("_peak", "_no")


KEYS = ["video_id", "group_no"]


def _spread(packs: DataFrame, facts: DataFrame, tokens: DataFrame, hot: HotKeys | None) -> DataFrame:
    """Give the tokens (pos, _tok) of each group to its packs by word count; facts are _size, _packs, _whole and treatment of a group.

    A token goes by its place to the pack that its place falls to, so no pack carries
    its group's text. A single pack shows the group's text as it is.
    """
    shared = allocate_counts(packs.join(facts, KEYS), KEYS, "pack_no", "_size", "n")
    placed = neighbours(shared, KEYS, "pack_no", total_before={"_from": "share"}, hot=hot)
    slots = placed.filter((F.col("share") > 0) & (F.col("_packs") > 1)).select(*KEYS, "pack_no", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("share") - 1)).alias("pos"))
    own = slots.join(tokens, [*KEYS, "pos"]).groupBy(*KEYS, "pack_no").agg(F.sort_array(F.collect_list(F.struct("pos", "_tok"))).alias("_own"))
    shown = placed.join(own, [*KEYS, "pack_no"], "left")
    shown = shown.withColumn("shown", F.when(F.col("_packs") == 1, F.col("_whole")).otherwise(F.coalesce(F.array_join("_own._tok", " "), X.stabilize(F.col("spoken")))))
    return (
        once(shown).filter((F.col("shown") != "") & ((F.col("_packs") == 1) | ~X.has_devanagari(F.col("shown"))))
        .withColumn("treatment", F.when(F.col("_from") == 0, X.treatment_name(F.col("treatment"))).otherwise(F.lit("plain")))
        .select(*KEYS, "pack_no", "n", "shown", "treatment")
    )


def _covering(size: Column) -> Column:
    """Tokens that count: none if they are too few for the group's words."""
    return F.when((F.col("_all") <= 6) | (size >= F.greatest(F.lit(2), F.floor(F.col("_all") / 4))), size).otherwise(0).cast("bigint")


def _told(packs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and tokens of groups with a text of their own (KEYS, text, treatment)."""
    total = packs.groupBy(*KEYS).agg(F.sum("n").alias("_all"), F.count("*").alias("_packs"))
    told = texts.join(total, KEYS).withColumn("_toks", X.tokens(X.stabilize(F.col("text")))).withColumn("_size", _covering(F.size("_toks")))
    tokens = told.filter("_packs > 1 AND _size > 0").select(*KEYS, F.posexplode("_toks").alias("pos", "_tok"))
    return told.select(*KEYS, "_size", "_packs", F.col("text").alias("_whole"), "treatment"), tokens.withColumn("pos", F.col("pos").cast("bigint"))


def pack_texts(packs: DataFrame, texts: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Spread each group's text over its packs by word count; packs use their own words when the text is too short.

    `packs` (video_id, group_no, pack_no, n, spoken) are the packs of a group, `texts`
    (video_id, group_no, text, treatment) has one row per group. Devanagari packs are left out.
    """
    return _spread(packs, *_told(packs, texts), hot)


# Words that a correction may join with the next one; no correction reaches across any other word's end.
OPEN_WORD = r"(?i)(rag|raka|retrieval|augmented|fine|fune|parameter|competition|vector)-*$"
PIECE_WORDS = 256
EDGE = "\u0001"


def _spoken_tokens(words: DataFrame, piece: int = PIECE_WORDS) -> DataFrame:
    """(KEYS, piece_no, toks): the corrected tokens of a group's own words, in pieces of some hundred words.

    A piece ends behind a word that no correction joins with the next one, so pieces give
    the tokens of the whole. Marks at both ends keep the inner ends of pieces as they are.
    """
    block = F.floor(F.col("word_id") / piece)
    w = words.select(*KEYS, "word_id", "word", block.alias("_b"))
    cuts = w.groupBy(*KEYS, "_b").agg(F.min(F.when(~F.col("word").rlike(OPEN_WORD), F.col("word_id"))).alias("_cut"))
    at = Window.partitionBy(*KEYS).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("_last", F.last(F.when(F.col("_cut").isNotNull(), F.col("_b")), ignorenulls=True).over(at))
    w = w.join(cuts, [*KEYS, "_b"]).withColumn("piece_no", F.coalesce(F.when(F.col("word_id") > F.col("_cut"), F.col("_b")), F.col("_last"), F.lit(-1)))
    ends = Window.partitionBy(*KEYS).orderBy("piece_no")
    whole = w.groupBy(*KEYS, "piece_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_id", "word"))), lambda s: s["word"]), " ").alias("_t"))
    whole = whole.withColumns({"_more": F.lead("piece_no").over(ends).isNotNull(), "_less": F.lag("piece_no").over(ends).isNotNull()})
    text = F.concat(F.when(F.col("_less"), EDGE + " ").otherwise(""), F.col("_t"), F.when(F.col("_more"), " " + EDGE).otherwise(""))
    return whole.select(*KEYS, "piece_no", F.filter(X.tokens(X.stabilize(text)), lambda t: t != EDGE).alias("toks"))


def group_captions(groups: DataFrame, words: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Model groups and the words they leave over to caption rows (video_id, group_no, pack_no, times, text).

    Leftover words are one more group of their video, without a text; it goes if any of
    its words is Devanagari. Groups without a text are told by their own words.
    """
    covered = cover_groups(groups, hot)
    ends = words.groupBy("video_id").agg(F.max("word_id").alias("_last"))
    reach = covered.groupBy("video_id").agg((F.max("hi") + 1).alias("lo"), (F.max("group_no") + 1).alias("group_no"))
    rest = ends.join(reach, "video_id", "left").select(
        "video_id", F.coalesce("group_no", F.lit(0)).alias("group_no"), F.coalesce("lo", F.lit(0)).alias("lo"), F.col("_last").alias("hi"),
        F.lit(None).cast("string").alias("text"), F.lit("plain").alias("treatment"), F.lit(True).alias("_left"),
    )
    ranges = covered.select("video_id", "group_no", "lo", "hi", "text", "treatment", F.lit(False).alias("_left")).unionByName(rest).join(ends, "video_id")
    ranges = ranges.withColumn("hi", F.least("hi", "_last")).filter("lo <= hi").drop("_last")
    # Packs, spoken text and counts are all cut from these words: store them once.
    inside = cut_lineage(words_in_ranges(ranges.select("video_id", "group_no", "lo", "hi", "_left"), words).drop("lo", "hi"))
    foreign = inside.filter(F.col("_left") & X.has_devanagari(F.col("word"))).select(*KEYS).distinct()
    inside = inside.join(foreign, KEYS, "left_anti")
    packed = packs_for(inside, KEYS, hot)
    packs = packed.groupBy(*KEYS, "pack_no").agg(
        F.count("*").alias("n"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_id", "word"))), lambda s: s["word"]), " ").alias("spoken"),
    )
    packs = cut_lineage(packs)
    texts = once(ranges.withColumn("text", X.stabilize(F.col("text"))))
    facts, tokens = _told(packs, texts.filter("text <> ''").select(*KEYS, "text", "treatment"))
    untold = texts.filter("coalesce(text, '') = ''").select(*KEYS, "treatment")
    pieces = _spoken_tokens(inside.join(untold.select(*KEYS), KEYS, "left_semi"))
    placed = neighbours(pieces, KEYS, "piece_no", total_before={"_before": F.size("toks").cast("bigint")}, hot=hot)
    total = packs.groupBy(*KEYS).agg(F.sum("n").alias("_all"), F.count("*").alias("_packs"))
    few = F.sort_array(F.collect_list(F.when(F.col("_packs") == 1, F.struct("piece_no", "toks"))))  # the pieces of one pack of a few words
    alone = F.array_join(F.flatten(F.transform(few, lambda p: p["toks"])), " ")
    own = placed.join(total, KEYS).groupBy(*KEYS).agg(F.sum(F.size("toks")).alias("_n"), F.first("_all").alias("_all"), F.first("_packs").alias("_packs"), alone.alias("_whole"))
    own = own.withColumn("_size", _covering(F.col("_n"))).join(untold, KEYS)
    said = placed.join(own.filter("_size > 0 AND _packs > 1").select(*KEYS), KEYS).select(*KEYS, "_before", F.posexplode("toks").alias("pos", "_tok"))
    tokens = tokens.unionByName(said.select(*KEYS, (F.col("_before") + F.col("pos")).alias("pos"), "_tok"))
    shown = _spread(packs, facts.unionByName(own.select(*facts.columns)), tokens, hot)
    return packs.select(*KEYS, "pack_no", "start_ms", F.greatest("end_ms", F.col("start_ms") + 250).alias("end_ms")).join(shown, [*KEYS, "pack_no"])
