"""Token times of captions, against a plain version that asks difflib about every caption."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxtable.catalog.base import words
from voxtable.catalog.caption_queries import caps
from voxtable.catalog.line_queries import spoken
from voxtable.functions import text as X
from voxtable.operators import align
from voxtable.operators.lines import norm

TEXTS = ["the real cost, the REAL cost -- of it", "RAG versus fine tunning of lora", "", "one", None, "a - b . c ; d", "GDPR İs \"quoted\" K9", "the the the the the the the", "Every Word Has Its Title Here", "x\ny  z w"]


def plain_times(tokens, words, starts, end):
    if not tokens or not words:
        return [0.0] * len(tokens)
    a, b = [norm(t) for t in tokens], [norm(t) for t in words]
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    fixed = {m.a + k: float(starts[m.b + k]) for m in blocks for k in range(m.size) if a[m.a + k]} | {0: float(starts[0])}
    times, last = [], max(end, starts[0] + 100)
    for i in range(len(tokens)):
        here = max(k for k in fixed if k <= i)
        there = min((k for k in fixed if k > i), default=len(tokens))
        stop = fixed.get(there, float(last))
        times.append(fixed[here] + (stop - fixed[here]) * (i - here) / (there - here))
    return [max(times[: i + 1] + [float(starts[0])]) for i in range(len(times))]


def test_query_gives_a_time_to_every_token(spark, tmp_path):
    rows = [(v, t, "user", TEXTS[(v * 3 + t) % len(TEXTS)]) for v in range(12) for t in range(v)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said: dict = {}
    for r in words(spark, str(tmp_path)).orderBy("video_id", "word_id").collect():
        said.setdefault((r.video_id, r.word_id // 6), []).append(r)
    texts = spark.createDataFrame([(*k, " ".join(r.word for r in rs)) for k, rs in said.items()], "v long, c long, text string")
    shown = texts.select("v", "c", X.tokens(X.clean_copy(F.col("text"))).alias("tokens")).collect()
    want = []
    for r in shown:
        rs = said[r.v, r.c]
        times = plain_times(r.tokens, [x.word for x in rs], [x.start_ms for x in rs], max(x.end_ms for x in rs))
        want += [(r.v, r.c, i, round(t)) for i, t in enumerate(times)]
    assert sorted(map(tuple, entry.queries()["align_token_times"](spark, str(tmp_path)).collect())) == sorted(want) and want


def test_batches_equal_the_plain_version(spark):
    pick, some = random.Random(5), ["a", "b", "the", "The,", "--", "$", "c.", "एक", "A"]
    rows = [(["b", "a"], ["a", "b"], [30, 10], 0), ([], ["a"], [5], 9), (["a"], [], [], 9)]
    for _ in range(400):
        words_ = [pick.choice(some) for _ in range(pick.randrange(7))]
        tokens = pick.choice([words_, words_[1:], [w for w in words_ if pick.random() < 0.8], [pick.choice(some) for _ in range(5)]])
        rows.append((tokens, words_, sorted(pick.randrange(3000) for _ in words_), pick.randrange(3500)))
    odd = [(None, ["a"], [5], 9), (["a"], None, [5], 9), (["a"], ["a"], None, 9), (["a"], ["a"], [5], None), (["a"], ["a"], [None], 9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + odd)], "n int, t array<string>, w array<string>, s array<long>, e long")
    got = df.repartition(3).select("n", align.align_token_times(*map(F.col, "twse")).alias("x")).orderBy("n").collect()
    assert [r.x for r in got] == [plain_times(*r) for r in rows] + [None] * len(odd)
    assert [align.token_times(*r) for r in rows[:50]] == [plain_times(*r) for r in rows[:50]]


def test_parts_of_turns_make_the_captions(spark, tmp_path):
    rows = [(v, t, "user", " ".join(["w"] * ((v or 3) * 7 + t * 5 % 11)) if t % 4 else None) for v in [*range(6), None] for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = caps(spark, str(tmp_path), 4).select("video_id", "caption_id", F.col("words.text").alias("said"), F.col("words.start_ms").alias("starts"), "end_ms")
    made = spoken(spark, str(tmp_path), 4)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, whole.collect())) and made.count() > 20
