"""Caption and transcript text as column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

from pyspark.sql import Column, functions as F

from voxtable import rules

SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Most characters are settled by one range; the classes behind it are dear.
RUN = rf"(?=[^!-~]){SPACE}+"
# White space that squish() has to change: a space alone is left as it is.
_OTHER = r"(?:[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"
UNEVEN = rf"(?=[^!-~])(?: ?{_OTHER}| {{2,}}){SPACE}*"
# Unicode word boundaries and case folding, so accented letters count as letters.
WORDWISE = "(?iU)"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_of(c: Column, values) -> Column:
    return c.isin(list(values))


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def squish(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, UNEVEN, " "), F.lit(" "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, RUN), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


#: Characters other than the letter's two forms that Unicode folds to it.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def wordwise(pattern: str) -> str:
    """The pattern with Unicode words and case; a literal first letter is looked for before any word boundary, which is dear."""
    head = _literal_head(pattern) if "|" not in pattern else None
    first = f"(?=[{head[0]}{head[0].upper()}{FOLDED.get(head[0], '')}])" if head else ""
    return first + WORDWISE + pattern


#: Letters of a literal start that are looked for, and how many starts a pattern may have.
HEAD_LETTERS, HEADS_MOST = 12, 16


def _starts(tree) -> tuple[set[str], bool]:
    """Literal starts of all that a parsed pattern may match, lower-cased, and whether they are whole; {""} tells nothing."""
    heads = {""}
    for kind, value in tree:
        name = str(kind)
        if name == "AT":
            continue
        if name == "LITERAL":
            more, whole = {chr(value).lower()}, True
        elif name == "SUBPATTERN":
            more, whole = _starts(value[-1])
        elif name == "BRANCH":
            parts = [_starts(p) for p in value[1]]
            more, whole = set().union(*(p for p, _ in parts)), all(w for _, w in parts)
        else:
            return heads, False
        heads = {h + m for h in heads for m in more}
        if not whole or len(heads) > HEADS_MOST:
            return heads, False
    return heads, True


def _literal_starts(pattern: str) -> list[str] | None:
    """Texts of which one must stand, in any case, in whatever `pattern` matches; None where there is no such set."""
    heads = {h[:HEAD_LETTERS] for h in _starts(_parser.parse(pattern))[0]}
    if not heads or len(heads) > HEADS_MOST or any(len(h) < 2 or not h.isascii() for h in heads):
        return None
    return sorted(h for h in heads if not any(o != h and o in h for o in heads))


def matches(c: Column, pattern: str) -> Column:
    """Does the pattern match? Texts without any of its literal starts are settled without it."""
    starts = _literal_starts(pattern)
    if starts is None:
        return c.rlike(wordwise(pattern))
    odd = contains_any(c, "".join(FOLDED.values()))  # lower() does not fold these, a pattern does
    return (let(F.lower(c), lambda low: contains_any(low, starts)) | odd) & c.rlike(wordwise(pattern))


def strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _literal_head(pattern: str) -> str | None:
    """Letters every match of `pattern` must start with, lower-cased; None when there are none."""
    head = re.match(r"\\b([A-Za-z]+)([?*]?)", pattern)
    if head is None:
        return None
    return (head.group(1)[:-1] if head.group(2) else head.group(1)).lower() or None


#: Rules that are tried together: a text passes over those of which it holds no literal start.
FIX_GROUP = 3


def fix_asr(c: Column, fixes=rules.ASR_FIXES) -> Column:
    """Ordered rewrites; texts without the literal start of any pattern skip the whole chain, others the groups they cannot meet."""
    heads = [_literal_head(p) for p, _ in fixes]
    chain = lambda t, some: reduce(lambda acc, f: F.regexp_replace(acc, wordwise(f[0]), f[1]), some, t)
    if None in heads:
        return chain(c, fixes)

    def step(odd, k):
        some, starts = fixes[k : k + FIX_GROUP], sorted(set(heads[k : k + FIX_GROUP]))
        return lambda s: F.when(odd | let(F.lower(s), lambda low: contains_any(low, starts)), chain(s, some)).otherwise(s)

    def grouped(t):
        odd = contains_any(t, "".join(FOLDED.values()))  # lower() does not fold these, a pattern does
        return reduce(lambda acc, k: let(acc, step(odd, k)), range(0, len(fixes), FIX_GROUP), t)

    return F.when(let(F.lower(c), lambda t: contains_any(t, sorted(set(heads)))), let(c, grouped)).otherwise(c)


def stabilize(c: Column) -> Column:
    """Corrected, squished and stripped line by line; a text of one line stays out of the lambda and in generated code."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("\\n"), F.lit("\n"))
    tidy = lambda s: strip(squish(fix_asr(s)), " ,.;:")
    many = F.rtrim(F.array_join(F.transform(F.split(text, "\n"), tidy), "\n"), F.lit("\n"))
    return F.when(text.contains("\n"), many).otherwise(tidy(text))


def known_terms(c: Column, names=rules.KNOWN_TERMS) -> Column:
    return let(
        fix_asr(c),
        lambda t: F.array_compact(
            F.array(*[F.when(matches(t, rf"\b{n}\b"), F.lit(n)) for n in names])
        ),
    )


def _letters(t: Column) -> Column:
    return F.regexp_replace(t, "[^A-Za-z]", "")


def fix_case(c: Column, acronyms=rules.COPY_ACRONYMS) -> Column:
    """Calm shouted words, then undo Title Case when every ordinary word carries it."""

    def listed(t):
        return one_of(F.upper(_letters(t)), acronyms)

    def calm(t):
        shouted = ~t.rlike("[a-z]") & (F.length(t) > 5) & (F.length(_letters(t)) > 5) & ~listed(t)
        return F.when(shouted, F.lower(t)).otherwise(t)

    def deliberate(t):
        return let(_letters(t), lambda a: one_of(F.upper(a), acronyms) | (F.length(a).between(1, 5) & (a == F.upper(a))))

    def ordinary(t):
        return t.rlike("[A-Za-z]") & (_letters(t) != "I") & ~deliberate(t)

    def recase(ts):
        # a word that starts small settles it; the others are judged only where there is none
        small = F.exists(ts, lambda t: t.rlike("^[^A-Za-z]*[a-z]") & ~listed(t))
        titled = (F.size(ts) >= 3) & ~small & (F.size(F.filter(ts, ordinary)) >= 2)
        lowered = F.transform(
            ts, lambda t, i: F.when((i == 0) | deliberate(t) | one_of(t, rules.PRONOUN_FORMS), t).otherwise(F.lower(t))
        )
        return F.array_join(F.when(titled, lowered).otherwise(ts), " ")

    def of_tokens(v, ts):
        return F.when(F.size(ts) == 0, v).otherwise(let(F.transform(ts, calm), recase))

    return let(c, lambda v: let(tokens(v), lambda ts: of_tokens(v, ts)))


def clean_copy(c: Column) -> Column:
    flat = strip(F.trim(stabilize(F.replace(c, F.lit("\n"), F.lit(" ")))), "\"“”")
    flat = F.rtrim(F.regexp_replace(flat, "[ \\n]{2,}|\\n", " "), F.lit(".;:—–-"))  # no other white space is left
    return fix_case(F.trim(flat))


def _spoken_token(tok: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.SPOKEN_ACRONYMS.items() for x in kv])

    def cased(b):
        return let(
            F.upper(b),
            lambda key: F.when(one_of(key, rules.SPOKEN_ACRONYMS), F.element_at(table, key))
            .when(one_of(key, rules.SPOKEN_PRONOUNS), F.concat(F.lit("I"), F.lower(F.substring(b, 2, 100))))
            .otherwise(F.lower(b)),
        )

    def sided(rest):
        body = F.rtrim(rest, F.lit("\"“”',.!?"))
        lead = F.substr(tok, F.lit(1), F.length(tok) - F.length(rest))
        return let(body, lambda b: F.when(b == "", tok).otherwise(F.concat(lead, cased(b), F.substr(rest, F.length(b) + 1))))

    return let(F.ltrim(tok, F.lit("\"“”'")), sided)


def capital_first(c: Column) -> Column:
    lead = F.regexp_extract(c, r"^([^\p{L}]*)", 1)
    return let(
        F.length(lead),
        lambda n: F.concat(F.substr(c, F.lit(1), n), F.upper(F.substr(c, n + 1, F.lit(1))), F.substr(c, n + 2)),
    )


def spoken_case(c: Column, treatment: Column) -> Column:
    lines = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\\n"), F.lit("\n")), "\n")
    cased = F.transform(
        lines,
        lambda s, i: let(
            F.array_join(F.transform(tokens(s), _spoken_token), " "),
            lambda b: F.when((i == 0) & one_of(treatment, rules.CAPITALISED_TREATMENTS), capital_first(b)).otherwise(b),
        ),
    )
    return F.array_join(F.filter(cased, lambda s: s != ""), "\n")


def join_words(words: Column) -> Column:
    """Token array to running text, punctuation glued to the left."""
    spaced = F.btrim(F.array_join(words, " "), F.lit(" "))
    glued = F.regexp_replace(spaced, r"(?<=\S) (?=')", "")
    return F.regexp_replace(glued, SPACE + r"+([,.;:?!])", "$1")


def upload_tokens(c: Column) -> Column:
    """Tokens of an uploaded transcript: punctuation stripped, dashes dropped, word regex as fallback."""
    bare = F.filter(
        F.transform(tokens(c), lambda t: strip(t, ".,;:!?\"“”()[]{}")), lambda t: ~one_of(t, ["", "—", "–", "-"])
    )
    words = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9'’+\-/]*"), F.lit(0))
    return let(bare, lambda b: F.when(F.size(b) > 0, b).otherwise(words))


def is_content(core: Column, filler=rules.FILLER) -> Column:
    return (core != "") & ~one_of(core, filler)


def content_word(toks: Column) -> Column:
    """Longest word that is not filler; the last one wins ties."""
    sized = F.transform(
        toks, lambda t, i: F.struct(F.length(norm(t)).alias("n"), i.alias("i"), t.alias("t"))
    )
    best = F.array_max(F.filter(sized, lambda s: is_content(norm(s["t"]))))
    return F.coalesce(strip(best["t"], ",?!"), F.lit(""))


def _spaced(cores: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(cores, " "), F.lit(" "))


def norm_tokens(c: Column) -> Column:
    return F.transform(tokens(c), norm)


def wanted_tokens(emphasis: Column) -> Column:
    return F.filter(norm_tokens(emphasis), lambda t: t != "")


def _wanted_in(spaced_text: Column, emphasis: Column) -> Column:
    return let(
        wanted_tokens(emphasis),
        lambda w: F.size(w).between(1, 2)
        & ~F.forall(w, lambda t: one_of(t, rules.FILLER))
        & spaced_text.contains(_spaced(w)),
    )


def emphasis_ok(text: Column, emphasis: Column) -> Column:
    """One or two words, not all filler, found side by side in the text."""
    return let(_spaced(norm_tokens(text)), lambda t: _wanted_in(t, emphasis))


def emphasis_flags(text: Column, emphasis: Column) -> Column:
    """Per token: is it part of the first place the emphasis appears?"""
    cores, wanted = norm_tokens(text), wanted_tokens(emphasis)

    def flags(s):
        at = F.instr(_spaced(s["cores"]), _spaced(s["wanted"]))
        # tokens in front of the match; past the end when there is no match
        before = F.when((at == 0) | (F.size(s["wanted"]) == 0), F.size(s["cores"])).otherwise(
            F.size(F.split(F.substr(_spaced(s["cores"]), F.lit(1), at), " ")) - 2
        )
        return let(
            F.struct(before.alias("lo"), (before + F.size(s["wanted"])).alias("hi"), s["cores"].alias("cores")),
            lambda b: F.transform(b["cores"], lambda t, i: (i >= b["lo"]) & (i < b["hi"])),
        )

    return let(F.struct(cores.alias("cores"), wanted.alias("wanted")), flags)


def key_for(text: Column, key: Column) -> Column:
    """The key if the line has it, else its rightmost pair or single word that the line has."""
    parts = F.filter(tokens(key), lambda t: is_content(norm(t)))

    def candidates(p):
        n = F.size(p)
        pairs = F.when(
            n >= 2,
            F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(p, k, 2), " ")),
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(key), pairs, F.reverse(p))

    found = let(
        F.struct(_spaced(norm_tokens(text)).alias("t"), let(parts, candidates).alias("c")),
        lambda s: F.filter(s["c"], lambda k: _wanted_in(s["t"], k)),
    )
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def strip_greeting(c: Column) -> Column:
    def trimmed(ts):
        run = F.array_position(F.transform(ts, lambda t: one_of(norm(t), rules.GREETINGS)), False) - 1
        drop = F.least(F.when(run < 0, F.size(ts)).otherwise(run), F.greatest(F.size(ts) - 2, F.lit(0))).cast("int")
        rest = F.array_join(F.slice(ts, drop + 1, F.size(ts)), " ")
        return F.when(drop > 0, F.concat(F.upper(F.left(rest, F.lit(1))), F.substring(rest, 2, 1 << 30))).otherwise(rest)

    return let(tokens(c), trimmed)


def content_tokens(c: Column) -> Column:
    return F.filter(norm_tokens(c), lambda t: (F.length(t) >= 3) & ~one_of(t, rules.FILLER))


def content_stems(c: Column) -> Column:
    return F.transform(content_tokens(c), lambda t: F.regexp_replace(t, "^(.{3,}?)(?:ing|ed|es|s)$", "$1"))


def has_devanagari(c: Column) -> Column:
    return c.rlike("[\\u0900-\\u097F]")


def terms(c: Column, term_rules=rules.TERM_RULES, priority=rules.TERM_PRIORITY) -> Column:
    """Glossary hits as (name, subtitle), already in report order because the rules are."""
    by_name: dict[str, list] = {}
    for pattern, name, subtitle in term_rules:
        by_name.setdefault(name, []).append((pattern, subtitle))
    ordered = sorted(by_name, key=lambda n: (priority.get(n, 9), n))

    def hits(t):
        return F.array_compact(
            F.array(
                *[
                    F.coalesce(
                        *[
                            F.when(matches(t, p), F.struct(F.lit(n).alias("name"), F.lit(s).alias("subtitle")))
                            for p, s in by_name[n]
                        ]
                    )
                    for n in ordered
                ]
            )
        )

    return let(fix_asr(c), hits)


def is_comparison(c: Column) -> Column:
    return matches(fix_asr(c), rules.COMPARISON)


def is_process(c: Column) -> Column:
    return matches(fix_asr(c), rules.PROCESS)


def first_figure(c: Column) -> Column:
    found = F.trim(F.regexp_extract(fix_asr(c), WORDWISE + rules.FIGURE, 1))
    return F.when(found != "", found)


def names_figure(c: Column) -> Column:
    return matches(c, rules.MONEY)


def tidy(c: Column) -> Column:
    """stabilize() for one line whose words were corrected before: the correction is idempotent."""
    return strip(squish(c), " ,.;:")


def clip_words(c: Column, limit: int, edge: str = " ,.;:", fixed: bool = False) -> Column:
    """Cut at a word boundary to at most `limit` characters. `fixed` marks text that is corrected already."""

    def clipped(t):
        head = F.substring(t, 1, limit + 1)
        cut = strip(F.regexp_replace(head, r" [^ ]*\z", ""), edge)
        return F.when(F.length(t) <= limit, t).when(cut != "", cut).otherwise(F.substring(t, 1, limit))

    return let(tidy(c) if fixed else stabilize(c), clipped)


HEADLINE_OPENERS = ["so", "and", "but", "well", "okay", "um", "uh"]


def headline(c: Column, max_words: int = 7, default: str = "Listen to this", fixed: bool = False) -> Column:
    """Scene title: leading connective dropped, first words, clipped to 44 characters."""

    def built(ts):
        rest = F.when(
            one_of(F.lower(F.get(ts, F.lit(0))), HEADLINE_OPENERS) & (F.size(ts) > 1), F.slice(ts, 2, 1 << 20)
        ).otherwise(ts)
        title = strip(F.array_join(F.slice(rest, 1, max_words), " "), " ,.;:")
        return F.when(F.size(ts) == 0, F.lit(default)).otherwise(clip_words(title, 44, " ,.;:?", fixed=True))

    return let(tokens(strip(c if fixed else stabilize(c), " \"'")), built)


def even_chunks(c: Column, n: int, width: int, fixed: bool = False) -> Column:
    """At most `n` even word chunks, each clipped to `width`; short texts stay whole."""

    def built(ts):
        size = F.when(F.size(ts) <= n, F.greatest(F.size(ts), F.lit(1))).otherwise(F.floor((F.size(ts) + n - 1) / n))
        starts = F.when(F.size(ts) > 0, F.sequence(F.lit(1), F.size(ts), size.cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        pieces = F.transform(starts, lambda i: clip_words(F.array_join(F.slice(ts, i, size.cast("int")), " "), width, " ,.;:?", fixed=True))
        return F.slice(F.filter(pieces, lambda p: p != ""), 1, n)

    return let(tokens(c if fixed else stabilize(c)), built)


def treatment_name(c: Column) -> Column:
    token = F.lower(F.trim(F.coalesce(c, F.lit("plain"))))
    return F.when(one_of(token, rules.TREATMENTS), token).otherwise(F.lit("plain"))


def glyph_name(icon: Column, kind: Column, glyph: Column) -> Column:
    raw = F.trim(F.coalesce(F.nullif(glyph, F.lit("")), F.nullif(icon, F.lit("")), F.lit("")))
    emoji = F.create_map(*[F.lit(x) for kv in rules.EMOJI_GLYPH.items() for x in kv])
    by_kind = F.create_map(*[F.lit(x) for kv in rules.KIND_GLYPH.items() for x in kv])
    return (
        F.when(one_of(F.lower(raw), rules.GLYPHS), F.lower(raw))
        .otherwise(F.coalesce(F.try_element_at(emoji, raw), F.try_element_at(by_kind, kind), F.lit("spark")))
    )


def recency_hint(c: Column) -> Column:
    return F.regexp_extract(c, WORDWISE + rules.RECENCY, 1)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
