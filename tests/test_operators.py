"""Behaviour on small literal fixtures, against brute force or known answers."""

import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.functions import text as X
from voxtable.functions import urls
from voxtable.operators import acoustics as A
from voxtable.operators import align, gates as G, intervals as I, labels as L, lines as N, media as M, segment as S
from voxtable.plans.zoom import plan_zoom
from voxtable.sources import files, model_json as MJ, pages, transcripts as TR


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "build, text, want",
    [
        (X.fix_asr, "our raka system and fine tunning on a vector d.b", "our RAG system and Fine-tuning on a vector DB"),
        (X.stabilize, "  LORA,  wins. \\n next line ; \\n", "LoRA, wins\nnext line"),
        (X.fix_case, "This Is Shouting Case", "This is shouting case"),
        (X.fix_case, "we saw UNBELIEVABLE GDPR things", "we saw unbelievable GDPR things"),
        (X.clean_copy, "“The end” is near —", "The end” is near"),
        (lambda c: X.content_word(X.tokens(c)), "the cost, really matter", "matter"),
        (X.strip_greeting, "hey guys welcome back", "Welcome back"),
        (lambda c: F.array_join(X.content_stems(c), "|"), "Cameras walked going", "camera|walk|going"),
        (X.recency_hint, "posted 3 hours ago", "3 hours ago"),
        (X.first_figure, "about 12 x more", "12 x"),
        (lambda c: X.spoken_case(c, F.lit("serif")), "\"I'M using RAG Llms!\"", "\"I'm using RAG LLMs!\""),
        (lambda c: X.clip_words(c, 12), "a long line of words", "a long line"),
    ],
)
def test_text(spark, build, text, want):
    assert one(spark, build(F.col("t")), t=text) == want


def test_percent_needs_a_word_behind_it(spark):
    got = [one(spark, X.names_figure(F.col("t")), t=t) for t in ("50% of", "50%x", "$ 5", "7 crore")]
    assert got == [False, True, True, True]


def test_key_and_emphasis(spark):
    assert one(spark, X.key_for(F.col("t"), F.col("k")), t="we use fine tuning here", k="the fine tuning") == "fine tuning"
    assert one(spark, X.key_for(F.col("t"), F.col("k")), t="we use tuning", k="fine tuning") == "tuning"
    assert one(spark, X.emphasis_flags(F.col("t"), F.col("k")), t="a b a b", k="a b") == [True, True, False, False]


def test_urls(spark):
    def norm(u):
        return one(spark, urls.normalize(F.col("u")), u=u)

    assert norm("HTTPS://a.org/p?utm_source=x&b=1#f") == "https://a.org/p?b=1"
    assert norm("ftp://a.org/") == ""
    assert norm("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx&rut=1") == "https://a.org/x"
    assert norm("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLm9yZy94&n=1") == "https://a.org/x"
    assert one(spark, urls.host(F.col("u")), u="http://u@WWW.A.org:80/x") == "a.org"


@pytest.mark.parametrize(
    "kind, url, page, hint, want",
    [
        ("embed", "https://www.youtube.com/e", "https://a.org", "", ("copyrighted", "embedded/streamed third-party media")),
        ("video", "https://cdn.bbc.co.uk/v", "https://a.org", "", ("copyrighted", "news/stock/social host")),
        ("video", "https://a.org/v", "https://a.org", "All rights reserved", ("copyrighted", "All rights reserved")),
        ("video", "https://x.nasa.gov/v", "https://a.org", "", ("reusable", "allowlisted reusable-media host")),
        ("video", "https://a.org/v", "https://a.org", "CC BY 4.0", ("reusable", "CC BY 4.0")),
        ("video", "https://notx.com/v", "https://a.org", "", ("unknown", "no license found")),
    ],
)
def test_rights(spark, kind, url, page, hint, want):
    df = spark.createDataFrame([(kind, url, page, hint)], "kind string, url string, page_url string, license_hint string")
    r = M.with_rights(df).first()
    assert (r.status, r.label) == want


def test_relevance_equals_all_pairs(spark):
    rnd = random.Random(1)
    text = lambda: "".join(rnd.choice("abc ") for _ in range(30))
    cands = [(j % 3, j, text(), "u", "f", "l", "reusable", True) for j in range(40)]
    needles = [(rnd.randrange(3), "".join(rnd.choice("abc") for _ in range(rnd.choice([2, 3, 4])))) for _ in range(60)]
    df = spark.createDataFrame(cands, "job_id int, ordinal int, title string, url string, file_name string, label string, status string, probe_ok boolean")
    got = {r.ordinal: r.hits for r in M.relevance(df, spark.createDataFrame(needles, "job_id int, needle string"), ["job_id"]).collect()}
    want = {c[1]: len({n for j, n in needles if j == c[0] and len(n) > 2 and n in " ".join(c[2:6])}) for c in cands}
    assert got == want


def sentence_frame(spark, parts):
    data = []
    for text, start in parts:
        for k, w in enumerate(text.split()):
            data.append((1, 0, len(data), w, start * 1000 + k * 200, start * 1000 + k * 200 + 180))
    return spark.createDataFrame(data, "video_id bigint, segment_id bigint, word_id bigint, word string, start_ms bigint, end_ms bigint")


def test_roles_patterns_and_zoom(spark):
    w = sentence_frame(
        spark,
        [("I thought the company was doing $10M a year.", 0), ("I was completely wrong.", 4), ("They were actually doing $100M.", 8)],
    )
    lab = L.analyze(S.sentence_table(S.sentence_words(w)))
    assert [r.role for r in lab.orderBy("sentence_id").collect()] == ["assumption", "contradiction", "reveal"]
    assert [tuple(r)[1:4] for r in L.story_patterns(lab).collect()] == [(0, 3, "setup → reversal → reveal")]
    dur = spark.createDataFrame([(1, 12_000)], "video_id bigint, duration_ms bigint")
    plan = [r for r in plan_zoom(L.zoom_scores(lab), dur).orderBy("sentence_id").collect() if r.action == "apply"]
    assert plan and all(r.target_scale <= 1.35 for r in plan)
    assert all(b.start_ms >= a.span_end_ms for a, b in zip(plan, plan[1:]))


def test_generic_and_question(spark):
    w = sentence_frame(
        spark,
        [("Today we're going to talk about databases.", 0), ("If you want to learn this subscribe.", 4), ("So what does that mean?", 8), ("It means you're wasting money.", 12)],
    )
    lab = L.analyze(S.sentence_table(S.sentence_words(w))).orderBy("sentence_id").collect()
    assert [r.role for r in lab] == ["generic", "cta", "question", "answer"]
    assert lab[0].interest < 0.2 and lab[1].interest < 0.2


def test_vocal_emphasis_is_rare_and_spaced(spark):
    rnd = random.Random(1)
    track = [(1, t, k, round((-32 + rnd.gauss(0, 0.5)) * 1000) + (15_000 if any(abs(t - s) < 400 for s in (5000, 5500, 20_000, 40_000, 40_300)) else 0)) for k, t in enumerate(range(0, 60_000, 200))]
    spans = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900) for i in range(60)], "video_id bigint, line_id bigint, start_ms bigint, end_ms bigint")
    levels = A.span_means(spans, spark.createDataFrame(track, "video_id bigint, t_ms bigint, ord bigint, mdb bigint"), "line_id", ["mdb"])
    picked = sorted(r.line_id for r in A.vocal_emphasis(levels.join(spans, ["video_id", "line_id"]), "line_id").collect())
    assert picked and len(picked) <= 11 and all(b - a >= 5 for a, b in zip(picked, picked[1:]))


def test_span_means_takes_the_nearest_sample(spark):
    track = spark.createDataFrame([(1, 100, 0, 10), (1, 90_000, 1, 20), (1, 90_000, 2, 99)], "video_id bigint, t_ms bigint, ord bigint, mdb bigint")
    spans = spark.createDataFrame([(1, 0, 40_000, 41_000), (1, 1, 80_000, 81_000), (1, 2, 0, 200), (2, 3, 0, 100)], "video_id bigint, line_id bigint, start_ms bigint, end_ms bigint")
    got = {r.line_id: r.mdb for r in A.span_means(spans, track, "line_id", ["mdb"]).collect()}
    assert got == {0: 10, 1: 20, 2: 10, 3: None}


def brute_spans(rows, limit):
    """Twelve passes over plain lists."""
    s = [r[0] for r in rows]
    e = []
    for i, (_, end) in enumerate(rows):
        if i + 1 < len(rows):
            nat = end + 280
            e.append(min(s[i + 1] if s[i + 1] - nat < 800 else nat + 350, s[i + 1]))
        else:
            e.append(min(end + 900, limit))
    for _ in range(12):
        for i in range(len(s)):
            need = 720 - (e[i] - s[i])
            if need <= 0:
                continue
            top = s[i + 1] if i + 1 < len(s) else limit
            g = min(need, max(0, top - e[i]))
            e[i], need = e[i] + g, need - g
            if need > 0 and i + 1 < len(s) and e[i] == s[i + 1]:
                g = min(need, max(0, e[i + 1] - s[i + 1] - 288))
                e[i], s[i + 1], need = e[i] + g, s[i + 1] + g, need - g
            if need > 0 and i:
                g = min(need, max(0, e[i - 1] - s[i - 1] - 288), 350)
                if g > 0:
                    if e[i - 1] == s[i]:
                        e[i - 1] -= g
                    s[i] -= g
    out, last = [], 0
    for a, b in zip(s, e):
        a = max(a, last)
        b = min(max(b, a + 200), limit) if limit > a else a + 200
        out.append((a, b))
        last = b
    return out


def test_caption_spans_equal_brute_force(spark):
    rnd, data, want = random.Random(9), [], {}
    for v in range(25):
        t, rows = 0, []
        for _ in range(rnd.choice([1, 2, 3, 8, 40])):
            t += rnd.choice([0, 20, 400, 2000])
            d = rnd.choice([60, 150, 300, 900, 2500])
            rows.append((t, t + d))
            t += d
        limit = t + rnd.choice([0, 500])
        data += [(v, i, a, b, limit) for i, (a, b) in enumerate(rows)]
        want[v] = brute_spans(rows, limit)
    df = spark.createDataFrame(data, "video_id bigint, line_id bigint, spoken_start bigint, spoken_end bigint, duration_ms bigint")
    got = {}
    for r in I.caption_spans(df).orderBy("video_id", "line_id").collect():
        got.setdefault(r.video_id, []).append((r.start_ms, r.end_ms))
    assert got == want


def brute_groups(words):
    """words: (text, start, end) of one video."""
    out, i = [], 0
    while i < len(words):
        rest = words[i:]
        p3, p2 = (" ".join(w[0].lower() for w in rest[:n]) for n in (3, 2))
        if any(p3.startswith(k) for k in S.KEEP_PHRASES):
            n = min(3, len(rest))
        elif any(p2.startswith(k) for k in S.KEEP_PHRASES):
            n = min(2, len(rest))
        else:
            n = min(2, len(rest))
            if len(rest) >= 3 and rest[2][1] - rest[1][2] < 180 and len(rest[2][0]) <= 4:
                n = 3
            if len(rest) >= 2 and rest[1][1] - rest[0][2] >= 380:
                n = 1
        if n <= 2 and i + n == len(words) - 1:
            n = len(rest)
        out.append(n)
        i += n
    return out


def test_caption_groups_equal_brute_force(spark):
    rnd, data, want = random.Random(4), [], {}
    for v in range(40):
        t, ws = 0, []
        for i in range(rnd.randrange(1, 14)):
            t += rnd.choice([20, 100, 200, 400])
            ws.append((rnd.choice(["Static", "data", "lora", "a", "going", "fine", "tuning", "is"]), t, t + 200))
            data.append((v, i, *ws[-1]))
            t += 200
        want[v] = brute_groups(ws)
    df = spark.createDataFrame(data, "video_id bigint, word_id bigint, word string, start_ms bigint, end_ms bigint")
    sizes = S.caption_groups(df).groupBy("video_id", "group_id").count().orderBy("video_id", "group_id").collect()
    got = {}
    for r in sizes:
        got.setdefault(r.video_id, []).append(r["count"])
    assert got == want


def drafts(spark, items, step=500):
    data = []
    for i, (text, style, emphasis) in enumerate(items):
        n = max(1, len(text.split()))
        at = i * 2 * step
        starts = [at + k * step for k in range(n)]
        data.append((1, i, i * n, starts, [s + step - 20 for s in starts], text, "", style, emphasis, "excited", "star", True))
    return spark.createDataFrame(
        data,
        "video_id bigint, line_id bigint, first bigint, starts array<bigint>, ends array<bigint>, text string, sub string, style string, emphasis string, mood string, icon string, cta boolean",
    )


def test_identical_ovals_become_rare(spark):
    out = N.design_rules(drafts(spark, [("core depth", "oval", "")] * 20)).collect()
    assert sum(r.style == "oval" for r in out) == 1


def test_long_lines_split_and_only_the_left_half_keeps_its_badge(spark):
    out = N.split_long(drafts(spark, [("one two three four five six seven eight", "mix", "seven")])).orderBy("first").collect()
    assert [r.first for r in out] == sorted(r.first for r in out) and len(out) >= 2
    assert " ".join(r.text for r in out) == "one two three four five six seven eight"
    assert [r.icon for r in out].count("star") == 1 and out[0].icon == "star"
    assert all(len(r.text.split()) <= 5 for r in out)


def test_alignment_anchors_on_matching_words():
    spoken = "so the real reason is that cost goes up fast".split()
    assert align.phrase_ranges(["so the real reason is", "that cost goes up fast"], spoken) == [(0, 4), (5, 9)]
    assert align.phrase_ranges(["a", "b", "c"], ["x"]) == [(0, 0)] * 3
    times = align.token_times(["the", "new", "cost"], ["the", "old", "cost"], [0, 400, 900], 1200)
    assert times == [0.0, 450.0, 900.0]


def test_plain_runs_lift_one_line_in_four(spark):
    rows = [(1, i, "plain", "a going thing" if i % 4 == 2 else "a b", "") for i in range(9)]
    out = G.lift_plain_runs(spark.createDataFrame(rows, "video_id bigint, line_id bigint, style string, text string, emphasis string"))
    assert sorted(r.line_id for r in out.filter("style = 'mix'").collect()) == [2, 6]


def test_wav_hops_and_rejects(spark):
    def wav(width, seconds=3):
        t = np.arange(16000 * seconds) / 16000
        loud = np.where((t >= 1) & (t < 2), 0.5, 0.02)
        x = (np.sin(2 * np.pi * 200 * t) * loud * 32000).astype("<i2")
        buf = io.BytesIO()
        with wave.open(buf, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(16000)
            f.writeframes(x.tobytes())
        return buf.getvalue()

    df = spark.createDataFrame([(1, bytearray(wav(2))), (2, bytearray(wav(1))), (3, bytearray(b"junk"))], "video_id bigint, content binary")
    chunks = files.pcm_chunks(df, "video_id")
    assert sorted(r.video_id for r in chunks.filter("problem IS NOT NULL").collect()) == [2, 3]
    mdb = {r.t_ms: r.mdb for r in A.loudness_hops(chunks.filter("problem IS NULL")).collect()}
    assert len(mdb) == 15 and mdb[1400] - mdb[400] > 10_000


def test_markdown_blocks_end_with_their_words(spark):
    from voxtable.sources import transcripts as TR

    docs = spark.createDataFrame(
        [(1, "intro\n00:00 - 00:01\n" + "word " * 20 + "\n00:09 - 00:10\n**00:05 - 00:06**\n- –\n**00:07 - 00:08**\nend"), (2, "no blocks"), (3, "**00:01 - 00:02**\n—"), (4, None)], "video_id bigint, text string"
    )
    got = [tuple(r) for r in TR.markdown_segments(docs, "video_id").orderBy("block").collect()]
    assert [(r[1], r[2], r[3]) for r in got] == [(0, 0, 120 * 22), (2, 7000, 8000)] and got[0][4].endswith("00:09 - 00:10")
    assert sorted(r.video_id for r in TR.markdown_rejects(docs, "video_id").collect()) == [2, 3, 4]


def test_markdown_and_json_transcripts(spark, tmp_path):
    text = "note\n00:00 - 00:04\nHere is the timestamped text\nhello there world\n**00:04 - 00:09**\nand more\n01:00 - 01:05\n**00:09 - 00:09**\nend\n"
    blocks = TR.markdown_segments(spark.createDataFrame([(1, text)], "video_id bigint, text string"), "video_id")
    got = [tuple(r)[1:] for r in blocks.orderBy("block").collect()]
    assert got == [(0, 0, 4000, "hello there world"), (1, 4000, 9000, "and more 01:00 - 01:05"), (2, 9000, 9200, "end")]
    words = TR.markdown_words(blocks, "video_id").filter("block = 0").orderBy("position").collect()
    assert [w.word for w in words] == ["hello", "there", "world"] and words[-1].end_ms == 4000
    (tmp_path / "a.json").write_text('{"language":"en","segments":[{"start":0,"end":1,"text":"hi","words":[{"word":"hi","start":0,"end":0.5}]}]}')
    docs = TR.read_json(spark, str(tmp_path))
    assert [tuple(r) for r in TR.json_words(docs, "video").collect()] == [("a", 0, 0, "hi", 0, 500, 0.0)]


def test_model_json_is_recovered(spark):
    for raw, want in [('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('Sure: {"a":1} ok', '{"a":1}'), ("none", None), ("[1]", None)]:
        assert one(spark, MJ.json_text(F.col("t")), t=raw) == want


def test_jobs_and_probe(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"job_id":"a","status":"rendering","metrics":{"n":3},"extra":1}')
    (tmp_path / "b.json").write_text("{broken")
    jobs = files.read_jobs(spark, str(tmp_path)).collect()
    assert [(j.job_id, j.progress, j.stage, j.metrics) for j in jobs] == [("a", 90, "rendering", {"n": "3"})]
    df = spark.createDataFrame([(bytearray(b"\x89PNG1234"), "/x"), (bytearray(b"  <!DOCTYPE html>"), "/x.png"), (bytearray(b"zz"), "/x.MP4"), (bytearray(b""), "/x")], "c binary, p string")
    got = [r.m for r in df.select(files.sniff_mime(F.col("c"), F.col("p")).alias("m")).collect()]
    assert got == ["image/png", "text/html", "video/mp4", "empty"]


def test_page_media_first_wins(spark):
    html = '<title>T</title><img src="a.png"><img src="/d/a.png"><video src="b.mp4?utm_source=1"></video><iframe></iframe>'
    df = spark.createDataFrame([(1, "https://h.org/d/p.html", html)], "page_id bigint, url string, html string")
    got = [(r.kind, r.url, r.title) for r in pages.page_media(df).orderBy("ordinal").collect()]
    assert got == [("video", "https://h.org/d/b.mp4", "T"), ("image", "https://h.org/d/a.png", "T")]


def test_two_cards_cover_the_video(spark):
    df = spark.createDataFrame([(1, 0, 1000, 4000, 15_000), (1, 1, 8000, 11_000, 15_000)], "video_id bigint, beat_id bigint, start_ms bigint, end_ms bigint, duration_ms bigint")
    got = [(r.start_ms, r.end_ms) for r in I.cover_duration(df, "beat_id").orderBy("beat_id").collect()]
    assert got == [(0, 8000), (8000, 15_000)]
