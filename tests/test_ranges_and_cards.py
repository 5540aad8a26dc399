"""Coverage repair, windows of long talks, leftover words and the card rule table, against plain rules."""

import random

from pyspark.sql import functions as F

from voxtable.functions import text as X
from voxtable.operators import acoustics as A
from voxtable.operators import lines as N
from voxtable.operators import media as M
from voxtable.operators import segment as S
from voxtable.operators.ordered import find_hot
from voxtable.plans import cards as K
from voxtable.plans import cues as C


def timed(spark, rows):
    return spark.createDataFrame(rows, "video_id long, word_id long, word string, start_ms long, end_ms long")


def test_ranges_meet_their_words_in_blocks(spark):
    words = timed(spark, [(v, i, f"w{i}", i * 100, i * 100 + 80) for v in (1, 2) for i in range(500)])
    ranges = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 10, 499), (2, 0, 63, 64), (2, 1, 70, 69)], "video_id long, group_no long, lo long, hi long")
    got = S.words_in_ranges(ranges, words, 64).groupBy("video_id", "group_no").agg(F.count("*").alias("n"), F.min("word_id").alias("a"), F.max("word_id").alias("b"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 10, 0, 9), (1, 1, 490, 10, 499), (2, 0, 2, 63, 64)]


def repaired(ranges, n):
    """The plain rule: clip to a cursor, gaps to the line in front, the first line from 0, the last one to the end."""
    out, cursor = [], 0
    for first, last, line in sorted(ranges):
        first = max(first, cursor)
        last = min(max(last, first), n - 1)
        if first > n - 1:
            continue
        if out and first > cursor:
            out[-1][1] = first - 1
        elif not out:
            first = 0
        out.append([first, last, line])
        cursor = last + 1
    if out and cursor < n:
        out[-1][1] = n - 1
    return [tuple(r) for r in out]


def test_drafts_cover_every_word_once(spark):
    rnd, n = random.Random(3), 200
    words = timed(spark, [(1, i, "word", i * 300, i * 300 + 250) for i in range(n)])
    ranges = [(rnd.randrange(0, 210), i) for i in range(30)]
    ranges = [(first, first + rnd.randrange(0, 12), i) for first, i in ranges]
    drafts = spark.createDataFrame(
        [(1, i, first, [0] * (last - first + 1), [0] * (last - first + 1), f"line {i}") for first, last, i in ranges],
        "video_id long, line_id long, first long, starts array<long>, ends array<long>, text string",
    )
    want = [(k, first, [300 * w for w in range(first, last + 1)], f"line {i}") for k, (first, last, i) in enumerate(repaired(ranges, n))]
    got = N.cover_drafts(drafts, words).orderBy("line_id").collect()
    assert [(r.line_id, r.first, r.starts, r.text) for r in got] == want
    assert all(len(r.ends) == len(r.starts) for r in got)


def test_long_talks_alone_are_cut_into_windows(spark):
    rows = [(v, i, i * 10_000, i * 10_000 + 9_000, 0 if i == 5 else 3) for v, n in ((1, 33), (2, 34), (3, 80)) for i in range(n)]
    segments = spark.createDataFrame(rows, "video_id long, segment_id long, start_ms long, end_ms long, n_words int")
    got = {(r.video_id, r.segment_id): r.chunk_id for r in S.brief_windows(segments).collect()}
    assert {k: c for k, c in got.items() if k[0] == 1} == {(1, i): 0 for i in range(33)}  # 329 s
    for v, n in ((2, 34), (3, 80)):
        since, chunk = None, -1
        for i in range(n):
            if i == 5:
                assert (v, i) not in got
                continue
            if since is None or i * 10_000 + 9_000 - since > 240_000:
                since, chunk = i * 10_000, chunk + 1
            assert got[v, i] == chunk
    assert got[3, 79] == 3


SAID = ["raka", "system", "fine", "tunning", "is", "cheap,", "vector", "d.b", "and", "so", "on.", "power\\nsecond", "retrieval", "augmented", "generation"]


def test_tokens_of_pieces_are_those_of_the_whole(spark):
    rnd = random.Random(8)
    said = {g: [rnd.choice(SAID) for _ in range(n)] for g, n in ((0, 3), (1, 400), (2, 77), (3, 50))}
    said[3] = ["fine"] * 50  # no safe place to cut
    rows = [(1, g, 1000 * g + i, w) for g, ws in said.items() for i, w in enumerate(ws)]
    words = spark.createDataFrame(rows, "video_id long, group_no long, word_id long, word string")
    pieces = N._spoken_tokens(words, 8).orderBy("group_no", "piece_no").collect()
    whole = spark.createDataFrame([(g, " ".join(ws)) for g, ws in said.items()], "g long, t string").select("g", X.tokens(X.stabilize(F.col("t"))).alias("k")).collect()
    for r in whole:
        assert [t for p in pieces if p.group_no == r.g for t in p.toks] == r.k
    assert sum(p.group_no == 1 for p in pieces) > 20


def test_a_talk_without_an_answer_is_never_one_row(spark):
    n = 100_000
    words = spark.range(n).select(
        F.lit(1).cast("long").alias("video_id"), F.col("id").alias("word_id"), F.concat(F.lit("word"), F.col("id") % 7).alias("word"), (F.col("id") * 300).alias("start_ms"), (F.col("id") * 300 + 250).alias("end_ms"),
    )
    none = spark.createDataFrame([], "video_id long, group_no long, hi long, text string, treatment string")
    got = N.group_captions(none, words, find_hot(words, ["video_id"], 20_000)).orderBy("pack_no").collect()
    assert " ".join(r.shown for r in got) == " ".join(f"word{i % 7}" for i in range(n))
    assert max(r.n for r in got) <= 3 and {r.group_no for r in got} == {0}
    one = timed(spark, [(1, 0, "hello", 0, 250), (1, 1, "एक", 300, 550)])
    assert N.group_captions(none, one).count() == 0  # any Devanagari word keeps the rest off the screen


def sentences(spark, rows):
    return spark.createDataFrame([(1, i, i * 10_000, i * 10_000 + 3000, role, text) for i, (role, text) in enumerate(rows)], "video_id long, sentence_id long, start_ms long, end_ms long, role string, text string")


def test_cards_say_what_their_rule_says(spark):
    told = sentences(spark, [
        ("hook", "We use RAG with the documents"), ("key_insight", "The LLM is the same"), ("question", "what is an LLM"), ("contrast", "this"), ("important_number", "It grew 12 x last year"),
        ("generic", "plain words"), ("reveal", "a very long sentence that says nothing about any known term but goes on"), ("context", "LoRA does it"),
    ])
    rows = {r.beat_id: r for r in K.card_rows(told).collect()}
    assert 5 not in rows
    assert (rows[0].rule, rows[0].kicker, rows[0].icon, rows[0].term) == ("concept", "HOOK", "🔍", "RAG")
    assert rows[0].chips == ["Documents"] and [b.delay_ms for b in rows[0].bullets] == [0, 480] and rows[0].bullets[1].text == "with Documents"
    assert rows[1].kicker == "INSIGHT" and rows[1].icon == "💡" and rows[1].chips == ["AI interviews"]
    assert rows[2].kicker == "HOOK" and [b.icon for b in rows[2].bullets] == ["💡", "✨", "🎯"]
    assert (rows[3].kind, rows[3].left, rows[3].right, rows[3].kicker) == ("vs_split", "RAG", "Fine-tuning", "THE TRADEOFF")
    assert (rows[4].kind, rows[4].title, rows[4].subtitle, rows[4].icon) == ("stat", "12 x", "figure", "📊")
    assert rows[6].kicker == "TAKE" and rows[6].title.endswith("…") and rows[6].bullets[0].text == rows[6].title
    assert (rows[7].rule, rows[7].kicker) == ("adapters", "PEFT")
    copy = spark.createDataFrame([("adapters", "", None, [("🧩", "a"), ("🧩", "b"), ("🧩", "c"), ("🧩", "d")])], "rule string, term string, title string, bullets array<struct<icon:string,text:string>>")
    row = K.card_rows(told, copy).filter("beat_id = 7").first()
    assert row.title == "adapters" and [(b.text, b.delay_ms) for b in row.bullets] == [("a", 0), ("b", 480), ("c", 960)]


def test_hook_cards_are_heard(spark):
    told = sentences(spark, [("context", "plain"), ("hook", "We use RAG"), ("key_insight", "The LLM is the same")])
    cues = C.propose_cues(told, K.card_rows(told)).collect()
    assert {(r.kind, r.reason, r.at_ms) for r in cues} == {("impact", "hook", 10_000)} and len(cues) == 2


def test_span_means_equal_all_pairs(spark):
    rnd = random.Random(2)
    track = [(v, rnd.randrange(0, 400_000), i, rnd.randrange(100)) for v in (1, 2) for i in range(150)]
    spans = [(v, i, s, s + rnd.choice([-5, 0, 1, 400, 70_000])) for v in (1, 2, 3) for i, s in enumerate(rnd.randrange(0, 450_000) for _ in range(60))]
    spans[0] = (1, 0, track[0][1], track[0][1] - 3)
    t = spark.createDataFrame(track, "video_id long, t_ms long, ord long, mdb long")
    for closed in (False, True):
        got = {(r.video_id, r.line_id): r.mdb for r in A.span_means(spark.createDataFrame(spans, "video_id long, line_id long, start_ms long, end_ms long"), t, "line_id", ["mdb"], closed=closed, block_ms=20_000).collect()}
        for v, i, a, b in spans:
            last = b if closed else max(b, a + 1) - 1
            own = [r for r in track if r[0] == v]
            inside = [r[3] for r in own if a <= r[1] <= last]
            if inside:
                want = (2 * sum(inside) + len(inside)) // (2 * len(inside))
            else:
                lo = max((r for r in own if r[1] <= a), key=lambda r: (r[1], -r[2]), default=None)
                hi = min((r for r in own if r[1] > a), key=lambda r: (r[1], r[2]), default=None)
                best = lo if lo and (not hi or a - lo[1] <= hi[1] - a) else hi
                want = best[3] if best else None
            assert got[v, i] == want


def test_common_and_many_needles(spark):
    cands = [(j % 2, j, f"https title {j}", "https://a/b", f"f{j}", "l", "reusable", True) for j in range(60)]
    df = spark.createDataFrame(cands, "job_id int, ordinal int, title string, url string, file_name string, label string, status string, probe_ok boolean")
    needles = [(0, "https"), (0, "HTTPS"), (0, "ti"), *[(0, f"title {k}") for k in range(500)], (1, "nowhere")]
    got = {r.ordinal: r.hits for r in M.relevance(df, spark.createDataFrame(needles, "job_id int, needle string"), ["job_id"], piece=16).collect()}
    assert got == {c[1]: len({n.lower() for j, n in needles if j == c[0] and len(n) > 2 and n.lower() in " ".join(c[2:6])}) for c in cands}
