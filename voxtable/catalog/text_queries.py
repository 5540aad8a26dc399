"""Scalar text operators over every line of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable import rules
from voxtable.catalog.base import (
    LEFT, LINES, RIGHT, WCHAR, lines, lit, re2, sql_list, sql_matches, sql_pick, sql_replace_words, pick,
)
from voxtable.catalog.registry import query
from voxtable.functions import text as X

ID = ["doc_id", "line_no"]


def sql_squish(e):
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def sql_fix_asr(e):
    for p, new in rules.ASR_FIXES:
        e = sql_replace_words(e, p, new)
    return e


def sql_tokens(e):
    return f"list_filter(string_split_regex({e}, '\\s+'), lambda t: t <> '')"


def sql_norm(e):
    return f"regexp_replace(lower({e}), '[^a-z0-9]+', '', 'g')"


def sql_stabilize_cte(src, out, col="txt", keep="doc_id, line_no"):
    """CTEs that add `st`, the stabilised text of `col`. Lines are split, fixed and joined again."""
    return f"""
{out}_l AS (SELECT {keep}, unnest(range(len(a))) AS li, unnest(a) AS l
  FROM (SELECT {keep}, string_split(replace(COALESCE({col}, ''), '\\n', chr(10)), chr(10)) AS a FROM {src})),
{out}_f AS (SELECT {keep}, li, trim({sql_squish(sql_fix_asr('l'))}, ' ,.;:') AS l FROM {out}_l),
{out} AS (SELECT {keep}, rtrim(string_agg(l, chr(10) ORDER BY li), chr(10)) AS st FROM {out}_f GROUP BY {keep})"""


STABLE = f"{LINES}, {sql_stabilize_cte('lines', 'stable')}"
FILLER = sql_list(rules.FILLER)


def on_lines(build):
    """Query over all lines; `build(txt)` names the output columns, when there is a session to build them in."""

    def run(spark, sf):
        return lines(spark, sf).select(*ID, *[c.alias(n) for n, c in build(F.col("txt")).items()])

    return run


def joined(c):
    return F.array_join(c, "|")


query("txt_asr_fix", f"WITH {LINES} SELECT doc_id, line_no, {sql_fix_asr('txt')} AS fixed FROM lines")(
    on_lines(lambda txt: dict(fixed=X.fix_asr(txt)))
)
query("txt_stabilize", f"WITH {STABLE} SELECT doc_id, line_no, st AS copy FROM stable")(
    on_lines(lambda txt: dict(copy=X.stabilize(txt)))
)
query(
    "txt_known_terms",
    f"""WITH {LINES}, f AS (SELECT doc_id, line_no, {sql_fix_asr('txt')} AS t FROM lines)
SELECT doc_id, line_no, array_to_string(list_filter([{', '.join(f"CASE WHEN {sql_matches('t', chr(92) + 'b' + n + chr(92) + 'b')} THEN {lit(n)} END" for n in rules.KNOWN_TERMS)}],
  lambda x: x IS NOT NULL), '|') AS found FROM f""",
)(on_lines(lambda txt: dict(found=joined(X.known_terms(txt)))))
query(
    "txt_norm_token",
    f"""WITH {LINES}
SELECT doc_id, line_no, array_to_string(list_transform({sql_tokens('txt')}, lambda t: {sql_norm('t')}), '|') AS cores FROM lines""",
)(on_lines(lambda txt: dict(cores=joined(X.norm_tokens(txt)))))

ACR = sql_list(rules.COPY_ACRONYMS)
LETTERS = "regexp_replace(t, '[^A-Za-z]', '', 'g')"


def sql_fix_case_cte(src, out, col, keep="doc_id, line_no"):
    lets = LETTERS
    delib = f"(list_contains({ACR}, upper({lets})) OR (length({lets}) BETWEEN 1 AND 5 AND {lets} = upper({lets})))"
    return f"""
{out}_a AS (SELECT {keep}, {col} AS raw, list_transform({sql_tokens(col)}, lambda t:
   CASE WHEN length({lets}) > 5 AND {lets} = upper({lets}) AND NOT list_contains({ACR}, upper({lets})) THEN lower(t) ELSE t END) AS ts FROM {src}),
{out}_b AS (SELECT *, list_filter(list_transform(list_filter(ts, lambda t: {lets} <> '' AND NOT {delib} AND {lets} <> 'I'), lambda t: {lets}), lambda t: true) AS judged FROM {out}_a),
{out}_c AS (SELECT *, len(ts) >= 3 AND len(judged) >= 2 AND len(list_filter(judged, lambda t: t[1:1] = upper(t[1:1]))) = len(judged) AS titled FROM {out}_b),
{out} AS (SELECT {keep}, CASE WHEN len(ts) = 0 THEN raw WHEN titled THEN array_to_string(list_transform(ts, lambda t, i:
   CASE WHEN i = 1 OR {delib} OR list_contains({sql_list(rules.PRONOUN_FORMS)}, t) THEN t ELSE lower(t) END), ' ')
   ELSE array_to_string(ts, ' ') END AS fc FROM {out}_c)"""


query("txt_fix_case", f"WITH {LINES}, {sql_fix_case_cte('lines', 'cased', 'txt')} SELECT doc_id, line_no, fc AS cased FROM cased")(
    on_lines(lambda txt: dict(cased=X.fix_case(txt)))
)
_flat = sql_stabilize_cte("(SELECT doc_id, line_no, replace(txt, chr(10), ' ') AS txt FROM lines)", "flat")
query(
    "txt_clean_copy",
    f"""WITH {LINES}, {_flat},
bare AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(trim(trim(st), '"“”'), '\\s+', ' ', 'g'), '[.;:—–-]+$', '')) AS b FROM flat),
{sql_fix_case_cte('bare', 'cased', 'b')}
SELECT doc_id, line_no, fc AS clean FROM cased""",
)(on_lines(lambda txt: dict(clean=X.clean_copy(txt))))

_kinds = ["plain", "serif", "mix", "stack", "quote"]
_shape = lit("^([\"“”']*)(.*?)([\"“”',.!?]*)$")
_spoken_map = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in rules.SPOKEN_ACRONYMS.items()) + "}"
_body = f"regexp_extract(t, {_shape}, 2)"
query(
    "txt_spoken_case",
    f"""WITH {LINES},
ls AS (SELECT doc_id, line_no, {sql_pick('doc_id + line_no', _kinds)} AS kind, unnest(range(len(a))) AS li, unnest(a) AS l
  FROM (SELECT doc_id, line_no, string_split(replace(txt, '\\n', chr(10)), chr(10)) AS a FROM lines)),
built AS (SELECT doc_id, line_no, kind, li, array_to_string(list_transform({sql_tokens('l')}, lambda t:
   CASE WHEN {_body} = '' THEN t ELSE regexp_extract(t, {_shape}, 1) ||
     CASE WHEN list_contains({sql_list(rules.SPOKEN_ACRONYMS)}, upper({_body})) THEN ({_spoken_map})[upper({_body})]
          WHEN list_contains({sql_list(rules.SPOKEN_PRONOUNS)}, upper({_body})) THEN 'I' || lower({_body}[2:])
          ELSE lower({_body}) END || regexp_extract(t, {_shape}, 3) END), ' ') AS b FROM ls),
capped AS (SELECT doc_id, line_no, li, CASE WHEN li = 0 AND list_contains({sql_list(rules.CAPITALISED_TREATMENTS)}, kind)
   THEN regexp_extract(b, '^([^\\p{{L}}]*)', 1) || upper(b[length(regexp_extract(b, '^([^\\p{{L}}]*)', 1)) + 1:length(regexp_extract(b, '^([^\\p{{L}}]*)', 1)) + 1])
        || b[length(regexp_extract(b, '^([^\\p{{L}}]*)', 1)) + 2:] ELSE b END AS b FROM built)
SELECT doc_id, line_no, COALESCE(string_agg(b, chr(10) ORDER BY li) FILTER (WHERE b <> ''), '') AS spoken FROM capped GROUP BY ALL""",
)(on_lines(lambda txt: dict(spoken=X.spoken_case(txt, pick(F.col("doc_id") + F.col("line_no"), _kinds)))))
query(
    "txt_join_punct",
    f"""WITH {LINES}
SELECT doc_id, line_no, regexp_replace(regexp_replace(array_to_string({sql_tokens('txt')}, ' '), '([^\\s]) ''', '\\1''', 'g'), '\\s+([,.;:?!])', '\\1', 'g') AS running FROM lines""",
)(on_lines(lambda txt: dict(running=X.join_words(X.tokens(txt)))))
_bare = """list_filter(list_transform(%s, lambda t: trim(t, '.,;:!?"“”()[]{}')), lambda t: NOT list_contains(['', '—', '–', '-'], t))""" % sql_tokens("txt")
query(
    "txt_tokenize_strip",
    f"""WITH {LINES}, b AS (SELECT doc_id, line_no, txt, {_bare} AS ts FROM lines)
SELECT doc_id, line_no, array_to_string(CASE WHEN len(ts) > 0 THEN ts ELSE regexp_extract_all(txt, '[A-Za-z0-9][A-Za-z0-9''’+/-]*') END, '|') AS toks FROM b""",
)(on_lines(lambda txt: dict(toks=joined(X.upload_tokens(txt)))))
_core = sql_norm("t")


def sql_content_word(ts):
    return (
        f"COALESCE(trim(list_aggregate(list_transform(list_filter(list_zip({ts}, range(len({ts}))), "
        f"lambda z: {sql_norm('z[1]')} <> '' AND NOT list_contains({FILLER}, {sql_norm('z[1]')})), "
        f"lambda z: {{'n': length({sql_norm('z[1]')}), 'i': z[2], 't': z[1]}}), 'max').t, ',?!'), '')"
    )


query(
    "txt_content_word",
    f"WITH {LINES}, b AS (SELECT doc_id, line_no, {sql_tokens('txt')} AS ts FROM lines) SELECT doc_id, line_no, {sql_content_word('ts')} AS best FROM b",
)(on_lines(lambda txt: dict(best=X.content_word(X.tokens(txt)))))

_KEYS = ["the real reason", "fine tunning", "AI", "the", "completely wrong!", "static", "", "a year company was", "Brown Fox", "vector d.b"]
def _key():
    return pick(F.col("doc_id") * 3 + F.col("line_no"), _KEYS)


_sql_key = sql_pick("doc_id * 3 + line_no", _KEYS)


def sql_spaced(list_expr):
    return f"(' ' || array_to_string({list_expr}, ' ') || ' ')"


def sql_norms(e):
    return f"list_transform({sql_tokens(e)}, lambda t: {_core})"


def sql_wanted(e):
    return f"list_filter({sql_norms(e)}, lambda t: t <> '')"


def sql_emphasis_ok(text_norms, key):
    w = sql_wanted(key)
    return (
        f"(len({w}) BETWEEN 1 AND 2 AND len(list_filter({w}, lambda t: NOT list_contains({FILLER}, t))) > 0 "
        f"AND contains({sql_spaced(text_norms)}, {sql_spaced(w)}))"
    )


query(
    "txt_emphasis_match",
    f"""WITH {LINES}, b AS (SELECT doc_id, line_no, {sql_norms('txt')} AS ns, {_sql_key} AS k FROM lines),
c AS (SELECT *, {sql_emphasis_ok('ns', 'k')} AS ok, {sql_wanted('k')} AS w FROM b),
d AS (SELECT *, CASE WHEN len(w) > 0 THEN list_filter(range(len(ns) - len(w) + 1), lambda i: ns[i + 1:i + len(w)] = w)[1] END AS hit FROM c)
SELECT doc_id, line_no, ok, array_to_string(list_transform(range(len(ns)), lambda i:
   CASE WHEN hit IS NOT NULL AND i >= hit AND i < hit + len(w) THEN '1' ELSE '0' END), '') AS flags FROM d""",
)(on_lines(lambda txt: dict(ok=X.emphasis_ok(txt, _key()), flags=F.array_join(F.transform(X.emphasis_flags(txt, _key()), lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0"))), ""))))
query(
    "txt_key_for",
    f"""WITH {LINES}, b AS (SELECT doc_id, line_no, {sql_norms('txt')} AS ns, {_sql_key} AS k FROM lines),
p AS (SELECT *, list_filter({sql_tokens('k')}, lambda t: {_core} <> '' AND NOT list_contains({FILLER}, {_core})) AS parts FROM b),
cand AS (SELECT doc_id, line_no, ns, unnest(range(len(cs))) AS ci, unnest(cs) AS cand FROM (SELECT *, list_concat([k],
    list_transform(list_reverse(range(1, greatest(len(parts), 1))), lambda i: parts[i] || ' ' || parts[i + 1]), list_reverse(parts)) AS cs FROM p)),
hit AS (SELECT doc_id, line_no, ci, CASE WHEN {sql_emphasis_ok('ns', 'cand')} THEN cand END AS found FROM cand)
SELECT doc_id, line_no, COALESCE(arg_min(found, ci) FILTER (WHERE found IS NOT NULL), '') AS found FROM hit GROUP BY ALL""",
)(on_lines(lambda txt: dict(found=X.key_for(txt, _key()))))
query(
    "txt_strip_greeting",
    f"""WITH {LINES}, b AS (SELECT doc_id, line_no, {sql_tokens('txt')} AS ts FROM lines),
r AS (SELECT *, COALESCE(list_filter(range(len(ts)), lambda i: NOT list_contains({sql_list(rules.GREETINGS)}, {sql_norm('ts[i + 1]')}))[1], len(ts)) AS run FROM b),
d AS (SELECT doc_id, line_no, least(run, greatest(len(ts) - 2, 0)) AS n, ts FROM r),
e AS (SELECT doc_id, line_no, n, array_to_string(ts[n + 1:], ' ') AS rest FROM d)
SELECT doc_id, line_no, CASE WHEN n > 0 THEN upper(rest[1:1]) || rest[2:] ELSE rest END AS opened FROM e""",
)(on_lines(lambda txt: dict(opened=X.strip_greeting(txt))))


def sql_stem(t):
    """First suffix of the list that leaves three characters."""
    whens = " ".join(
        f"WHEN {t} LIKE '%{s}' AND length({t}) - {len(s)} >= 3 THEN {t}[1:length({t}) - {len(s)}]" for s in ("ing", "ed", "es", "s")
    )
    return f"CASE {whens} ELSE {t} END"


def sql_content(e):
    return f"list_filter({sql_norms(e)}, lambda t: length(t) >= 3 AND NOT list_contains({FILLER}, t))"


query(
    "txt_content_stems",
    f"WITH {LINES} SELECT doc_id, line_no, array_to_string(list_transform({sql_content('txt')}, lambda t: {sql_stem('t')}), '|') AS stems FROM lines",
)(on_lines(lambda txt: dict(stems=joined(X.content_stems(txt)))))
query("txt_devanagari", f"WITH {LINES} SELECT doc_id, line_no, regexp_matches(txt, '[\\x{{0900}}-\\x{{097F}}]') AS hit FROM lines")(
    on_lines(lambda txt: dict(hit=X.has_devanagari(txt)))
)


def sql_terms(e):
    by_name: dict[str, list] = {}
    for p, n, s in rules.TERM_RULES:
        by_name.setdefault(n, []).append((p, s))
    order = sorted(by_name, key=lambda n: (rules.TERM_PRIORITY.get(n, 9), n))
    cases = [
        "CASE " + " ".join(f"WHEN {sql_matches(e, p)} THEN {lit(n + '=' + s)}" for p, s in by_name[n]) + " END" for n in order
    ]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


query(
    "txt_terms",
    f"""WITH {LINES}, f AS (SELECT doc_id, line_no, {sql_fix_asr('txt')} AS t FROM lines)
SELECT doc_id, line_no, array_to_string({sql_terms('t')}, '|') AS glossary FROM f""",
)(on_lines(lambda txt: dict(glossary=joined(F.transform(X.terms(txt), lambda s: F.concat(s["name"], F.lit("="), s["subtitle"]))))))
query(
    "txt_flags",
    f"""WITH {LINES}, f AS (SELECT doc_id, line_no, {sql_fix_asr('txt')} AS t FROM lines)
SELECT doc_id, line_no, {sql_matches('t', rules.COMPARISON)} AS comparison, {sql_matches('t', rules.PROCESS)} AS process,
 nullif(trim(regexp_extract(t, '(?i){LEFT}([0-9]+(?:\\.[0-9]+)?(?:\\s*(?:x|k|million){RIGHT}|\\s*%{WCHAR}|{RIGHT}))', 1)), '') IS NOT NULL AS has_figure FROM f""",
)(
    on_lines(
        lambda txt: dict(
            comparison=X.is_comparison(txt), process=X.is_process(txt), has_figure=X.first_figure(txt).isNotNull()
        )
    )
)


def sql_clip(st, n, edge=" ,.;:"):
    cut = f"trim(CASE WHEN contains({st}[1:{n + 1}], ' ') THEN regexp_replace({st}[1:{n + 1}], ' [^ ]*$', '') ELSE {st}[1:{n + 1}] END, {lit(edge)})"
    return f"CASE WHEN length({st}) <= {n} THEN {st} WHEN {cut} <> '' THEN {cut} ELSE {st}[1:{n}] END"


query(
    "txt_clip_words",
    f"WITH {STABLE} SELECT doc_id, line_no, {sql_clip('st', 32)} AS short, {sql_clip('st', 44, ' ,.;:?')} AS scene FROM stable",
)(on_lines(lambda txt: dict(short=X.clip_words(txt, 32), scene=X.clip_words(txt, 44, " ,.;:?"))))
_head = f"list_filter(string_split_regex(trim(st, ' \"'''), '\\s+'), lambda t: t <> '')"
query(
    "txt_headline_chunks",
    f"""WITH {STABLE},
w AS (SELECT doc_id, line_no, {_head} AS hs, {sql_tokens('st')} AS cs FROM stable),
h AS (SELECT *, CASE WHEN len(hs) > 1 AND list_contains({sql_list(X.HEADLINE_OPENERS)}, lower(hs[1])) THEN hs[2:] ELSE hs END AS kept,
   CASE WHEN len(cs) <= 3 THEN greatest(len(cs), 1) ELSE (len(cs) + 2) // 3 END AS size FROM w),
t AS (SELECT doc_id, line_no, 0 AS slot, CASE WHEN len(hs) > 0 THEN trim(array_to_string(kept[1:7], ' '), ' ,.;:') END AS raw FROM h
  UNION ALL SELECT doc_id, line_no, i + 1 AS slot, array_to_string(cs[i * size + 1:(i + 1) * size], ' ') AS raw
  FROM (SELECT *, unnest(range((len(cs) + size - 1) // size)) AS i FROM h)),
{sql_stabilize_cte('t', 'ts', 'raw', 'doc_id, line_no, slot')},
clipped AS (SELECT doc_id, line_no, slot, CASE WHEN slot = 0 THEN {sql_clip('st', 44, ' ,.;:?')} ELSE {sql_clip('st', 28, ' ,.;:?')} END AS c FROM ts)
SELECT h.doc_id, h.line_no, CASE WHEN len(any_value(h.hs)) = 0 THEN 'Listen to this' ELSE any_value(c.c) FILTER (WHERE slot = 0) END AS title,
 COALESCE(array_to_string((list(c.c ORDER BY slot) FILTER (WHERE slot > 0 AND c.c <> ''))[1:3], '|'), '') AS chunks
FROM h JOIN clipped c USING (doc_id, line_no) GROUP BY h.doc_id, h.line_no""",
)(on_lines(lambda txt: dict(title=X.headline(txt), chunks=joined(X.even_chunks(txt, 3, 28)))))
query("txt_money_flag", f"WITH {LINES} SELECT doc_id, line_no, regexp_matches(txt, {lit('(?i)' + re2(rules.MONEY))}) AS figure FROM lines")(
    on_lines(lambda txt: dict(figure=X.names_figure(txt)))
)
_icons = ["📄", "brain", "", "⚙️", "unknown", "🚀", " Loop "]
_gkinds = ["bullets", "stat", "process", "nothing"]
_treats = ["Oval", " serif ", "sparkle", "plain", "BLOB"]
_emoji_map = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in rules.EMOJI_GLYPH.items()) + "}"
_kind_map = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in rules.KIND_GLYPH.items()) + "}"
query(
    "txt_enum_lookup",
    f"""WITH {LINES}, b AS (SELECT doc_id, line_no, lower(trim({sql_pick('doc_id * 3 + line_no', _treats)})) AS tr,
  trim({sql_pick('doc_id * 3 + line_no', _icons)}) AS ic, {sql_pick('doc_id * 3 + line_no', _gkinds)} AS kd, txt FROM lines)
SELECT doc_id, line_no, length(txt) AS n, CASE WHEN list_contains({sql_list(rules.TREATMENTS)}, tr) THEN tr ELSE 'plain' END AS treatment,
 CASE WHEN list_contains({sql_list(rules.GLYPHS)}, lower(ic)) THEN lower(ic) ELSE COALESCE(({_emoji_map})[ic], ({_kind_map})[kd], 'spark') END AS glyph FROM b""",
)(
    on_lines(lambda txt: dict(
        n=F.length(txt),
        treatment=X.treatment_name(pick(F.col("doc_id") * 3 + F.col("line_no"), _treats)),
        glyph=X.glyph_name(pick(F.col("doc_id") * 3 + F.col("line_no"), _icons), pick(F.col("doc_id") * 3 + F.col("line_no"), _gkinds), F.lit(""))))
)
query(
    "txt_recency_hint",
    f"""WITH {LINES} SELECT doc_id, line_no, regexp_extract(txt, '(?i){LEFT}([0-9]+\\s*(?:m|h|d|w|hour|hours|day|days|min)s? ago){RIGHT}', 1) AS recency,
 trim(regexp_replace(txt, '<[^>]+>', ' ', 'g')) AS plain FROM lines""",
)(on_lines(lambda txt: dict(recency=X.recency_hint(txt), plain=X.strip_tags(txt))))
