"""Hops against the plain scan: random rules, batches, keys and blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import gates as G
from voxtable.operators import segment as S
from voxtable.operators.hops import HIGH, Rule, block_table, first_reaching, hops
from voxtable.operators.ordered import find_hot
from voxtable.plans.zoom import shown_seconds


def scan(rows, rule):
    """rows of one key: (value, threshold, hard) to (picked, pick_no, since, held)."""
    out, held, since, number = [], None, 0, 0
    for i, (value, threshold, hard) in enumerate(rows):
        since += 1
        pick = i == 0 or hard or (rule.most is not None and since >= rule.most) or (since >= rule.least and value is not None and held is not None and value >= held)
        before = held
        if pick:
            held, since, number = threshold, 0, number + 1
        out.append((bool(pick), number, since, before if i else None))
    return out


def rows_of(kind, rnd, n):
    t, out = 0, []
    for _ in range(n):
        t += rnd.choice([0, 1, 2, 5])
        v = t if kind in ("ascending", "hard") else rnd.randrange(200)
        out.append((v, v + rnd.choice([7, 7, 20]), kind == "hard" and rnd.random() < 0.05))
    return out


@pytest.mark.parametrize(("kind", "rule"), [("ascending", Rule()), ("random", Rule()), ("hard", Rule(4, 16)), ("random", Rule(3))])
def test_hops_equal_the_scan(spark, kind, rule):
    rnd = random.Random(7)
    data, want = [], []
    for key, n in (("a", 900), ("b", 1), ("c", 40), (None, 30), ("d", 333)):
        rows = rows_of(kind, rnd, n)
        data += [(key, i, *r) for i, r in enumerate(rows)]
        want += [(key, i, *w) for i, w in enumerate(scan(rows, rule)) if key is not None]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, i long, v long, th long, hard boolean").repartition(3)
    for df, some in ((df, lambda r: r[0] is not None), (df.filter("k IS NOT NULL"), lambda r: True)):
        for hot in (find_hot(df, ["k"]), *([find_hot(df, ["k"], 100)] if df.filter("k IS NULL").isEmpty() else [])):
            got = hops(df, ["k"], ["i"], F.col("v"), F.col("th"), rule, hard=F.col("hard"), hot=hot, block_rows=64)
            found = [tuple(r) for r in got.select("k", "i", "picked", "pick_no", "since", "held").collect()]
            assert sorted(filter(some, found)) == sorted(want)


def test_batches_do_not_matter(spark):
    rows = rows_of("random", random.Random(1), 500)
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k int, i long, v long, th long, hard boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = hops(df, ["k"], ["i"], F.col("v"), F.col("th"), Rule(2, 9)).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.picked, r.pick_no, r.since, r.held) for r in got] == scan(rows, Rule(2, 9))


@pytest.mark.parametrize("kind", ["ascending", "random", "hard"])
@pytest.mark.parametrize("rule", [Rule(), Rule(3), Rule(4, 16), Rule(1, 5)])
def test_block_tables_lead_to_the_state_of_the_scan(kind, rule):
    rows = rows_of(kind, random.Random(7), 900)
    v, th, hard = (np.array([r[k] for r in rows]) for k in range(3))
    last, number = (0, 0), 0
    for a in range(0, 900, 64):
        part = slice(a, a + 64)
        want = scan(rows[: a + 64], rule)
        steps = block_table(v[part], th[part], hard[part], int(th[:a].max()) if a else HIGH, rule)
        if a:
            since = 0 if rule == Rule() else min(last[1], rule.least) if rule.most is None else last[1]
            hit = next((s for s in steps if s[0] == since and s[1] >= last[0]), None)
            state = (hit[2], hit[3], number + hit[4]) if hit else (last[0], last[1] + len(v[part]), number)
            assert state[2] == want[-1][1] and state[1] == want[-1][2] + 1
        picks = [i for i, w in enumerate(want) if w[0]]
        last, number = (int(th[picks[-1]]), len(want) - picks[-1]), want[-1][1]


def test_first_reaching():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 100):
        v, th, at = rnd.integers(0, 30, n), rnd.integers(0, 35, n), rnd.integers(0, n + 2, n)
        want = [next((j for j in range(a, n) if v[j] >= t), n) for t, a in zip(th, at)]
        assert first_reaching(v, th, at).tolist() == want


def test_tables_stay_small_where_times_ascend():
    t = np.arange(0, 100_000, 10)
    steps = block_table(t + 1_000_000, t + 1_010_000, np.zeros(len(t), bool), 1_009_990, Rule())
    assert len(steps) <= 1001 and all(s[1] < HIGH for s in steps)


def test_nulls(spark):
    df = spark.createDataFrame([(1, 0, None, None), (1, 1, 5, 6), (1, 2, None, 9), (1, 3, 7, 8)], "k int, i long, v long, th long")
    got = hops(df, ["k"], ["i"], F.col("v"), F.col("th"), hard=F.lit(None).cast("boolean"))
    assert sorted((r.i, r.picked) for r in got.collect()) == [(0, True), (1, False), (2, False), (3, False)]
    assert hops(df.limit(0), ["k"], ["i"], F.col("v"), F.col("th")).count() == 0


def greedy(words):
    """Caption groups by the plain rule."""
    out, i, group = [], 0, 0
    while i < len(words):
        p = words[i : i + 4]
        three, two = " ".join(w[0] for w in p[:3]), " ".join(w[0] for w in p[:2])
        if three.startswith(tuple(S.KEEP_PHRASES)):
            take = min(3, len(p))
        elif two.startswith(tuple(S.KEEP_PHRASES)):
            take = min(2, len(p))
        elif len(p) >= 2 and p[1][1] - p[0][2] >= 380:
            take = 1
        elif len(p) >= 3 and p[2][1] - p[1][2] < 180 and len(p[2][0]) <= 4:
            take = 3
        else:
            take = min(2, len(p))
        if take <= 2 and len(words) - i == take + 1:
            take += 1
        out += [(i + k, group, k) for k in range(take)]
        i, group = i + take, group + 1
    return out


def test_caption_groups_equal_the_plain_rule(spark):
    rnd, data, want = random.Random(5), [], []
    for v in range(60):
        t, words = 0, []
        for _ in range(rnd.randrange(1, 40) if v else 400):
            t += rnd.choice([280, 330, 350, 700, 1400])
            words.append((rnd.choice(["fine", "lora", "data", "static", "a", "word", "rag", "tuning", "system"]), t, t + rnd.choice([200, 270])))
        data += [(v, i, *w) for i, w in enumerate(words)]
        want += [(v, *g) for g in greedy(words)]
    df = spark.createDataFrame(data, "video_id long, word_id long, word string, start_ms long, end_ms long")
    for hot in (find_hot(df, ["video_id"]), find_hot(df, ["video_id"], 100)):
        assert sorted(tuple(r) for r in S.caption_groups(df, hot=hot).collect()) == sorted(want)


@pytest.mark.parametrize("budget", [None, 3])
def test_spaced_picks_equal_the_scan(spark, budget):
    rnd = random.Random(9)
    data = [(v, i, rnd.randrange(4), rnd.randrange(100_000), budget) for v in range(5) for i in range(300 if v else 2000)]
    df = spark.createDataFrame(data, "video_id long, line_id long, weight long, at long, cap long")
    want = set()
    for v in range(5):
        last, n = None, 0
        for _, i, w, t, cap in sorted((r for r in data if r[0] == v), key=lambda r: (-r[2], r[3], r[1])):
            if (cap is None or n < cap) and (last is None or t - last >= 5000):
                last, n = t, n + 1
                want.add((v, i))
    for hot in (find_hot(df, ["video_id"]), find_hot(df, ["video_id"], 500)):
        got = G.select_with_gap(df, ["video_id"], "line_id", "at", 5000, first=[-F.col("weight")], budget="cap" if budget else None, hot=hot)
        assert {tuple(r) for r in got.collect()} == want


def test_shown_seconds_round_like_the_binary_number(spark):
    ms = [*range(-3000, 3000, 5), 1005, 2675, 10_125, 8_015, 123_456_785]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in ms], "m long").select(shown_seconds(F.col("m"))).collect()]
    assert got == [f"{m / 1000:.2f}" for m in ms]
