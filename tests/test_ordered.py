"""The hot-key paths must give what the ordinary paths give."""

import random

from pyspark.sql import Window, functions as F

from voxtable.operators import gates as G
from voxtable.operators import intervals as I
from voxtable.operators import lines as N
from voxtable.operators import segment as S
from voxtable.operators.ordered import find_hot, first_per, neighbours, ordered_fold


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def words(spark, per_video=(400, 7, 60)):
    rnd, data = random.Random(3), []
    for v, n in enumerate(per_video):
        t = 0
        for i in range(n):
            t += rnd.choice([280, 330, 350, 700, 1400])
            data.append((v, i // 25, i, rnd.choice(["fine", "lora", "data.", "static", "a", "word", "Rag", "tuning"]), t, t + 270))
    return spark.createDataFrame(data, "video_id bigint, segment_id bigint, word_id bigint, word string, start_ms bigint, end_ms bigint")


def test_neighbours_in_blocks_equal_one_window(spark):
    df = words(spark).select("video_id", "word_id", "start_ms", "word")
    hot = find_hot(df, ["video_id"], 50)
    assert hot.rows == 460
    w = Window.partitionBy("video_id").orderBy("word_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.lag("word").over(w).alias("p"), F.lead("start_ms").over(w).alias("n"),
        F.coalesce(F.sum("start_ms").over(before), F.lit(0)).alias("t"), F.max(F.length("word")).over(before).alias("m"),
    )
    spec = dict(lag={"p": "word"}, lead={"n": "start_ms"}, total_before={"t": "start_ms"}, max_before={"m": F.length("word")})
    got = neighbours(df, ["video_id"], "word_id", hot=hot, block_rows=16, **spec)
    assert [tuple(r) for r in got.orderBy("video_id", "word_id").collect()] == [tuple(r) for r in want.orderBy("video_id", "word_id").collect()]


def test_fold_in_blocks_equals_one_pass(spark):
    df = words(spark)

    def step(state, row):
        total = state[0] * 3 % 1009 + row["start_ms"] % 7
        return [total], [(row["word_id"], total)]

    args = (["video_id"], ["word_id"], [1], step, "word_id bigint, total bigint")
    whole = ordered_fold(df, *args, hot=find_hot(df, ["video_id"]))
    # A fold whose state never forgets needs every block in turn; the fixed point still finds it.
    split = ordered_fold(df, *args, hot=find_hot(df, ["video_id"], 50), block_rows=60)
    assert rows(whole) == rows(split)


def test_operators_do_not_depend_on_the_split(spark):
    w = words(spark)
    cold, hot = find_hot(w, ["video_id"]), find_hot(w, ["video_id"], 50)
    caps = w.select("video_id", F.col("word_id").alias("caption_id"), "start_ms")
    lines = w.select(
        "video_id", F.col("word_id").alias("line_id"), F.col("start_ms").alias("spoken_start"), F.col("end_ms").alias("spoken_end"), F.lit(10**7).alias("duration_ms")
    )
    for op in (
        lambda h: S.sentence_words(w, h),
        lambda h: S.caption_groups(w, hot=h),
        lambda h: G.select_with_gap(caps, ["video_id"], "caption_id", "start_ms", 5000, hot=h),
        lambda h: G.select_with_gap(caps, ["video_id"], "caption_id", "start_ms", 5000, first=[F.col("caption_id") % 7], mode="abs_all", hot=h),
        lambda h: I.caption_spans(lines, h),
    ):
        assert rows(op(cold)) == rows(op(hot))


def test_flash_merge_does_not_depend_on_the_split(spark):
    w = words(spark)
    lines = w.select(
        "video_id", F.col("word_id").alias("line_id"), F.col("word_id").alias("first"), F.col("word_id").alias("last"), "start_ms", "end_ms",
        F.col("word").alias("text"), F.lit("").alias("sub"), F.lit("plain").alias("style"), F.lit("").alias("emphasis"), F.lit("neutral").alias("mood"),
        F.lit("none").alias("icon"), F.lit(False).alias("cta"),
    )
    assert rows(N.merge_flashes(lines, find_hot(w, ["video_id"]))) == rows(N.merge_flashes(lines, find_hot(w, ["video_id"], 50)))


def test_groups_inside_large_videos_do_not_depend_on_the_split(spark):
    w = words(spark).withColumns({"group_no": F.floor(F.col("word_id") / 40), "text": F.col("word"), "emphasis": F.lit(False)})
    cold, hot = find_hot(w, ["video_id"]), find_hot(w, ["video_id"], 50)
    keys = ["video_id", "group_no"]
    caps = w.select("video_id", F.col("group_no").alias("caption_id"), F.lit("plain").alias("treatment")).distinct()
    groups = w.groupBy(*keys).agg(F.max("word_id").alias("hi"), F.lit("a few words of text").alias("text"), F.lit("mix").alias("treatment")).filter("group_no < 3")
    ranges = w.groupBy("video_id", F.col("group_no").alias("line_id")).agg((F.min("word_id") - 3).alias("first"), (F.max("word_id") + 5).alias("last"))
    n_words = w.groupBy("video_id").agg(F.count("*").alias("n_words"))
    plain = w.select("video_id", "segment_id", "word_id", "word", "start_ms", "end_ms")
    for op in (
        lambda h: S.time_slices(w, keys, h),
        lambda h: N.packs_for(w, keys, h),
        lambda h: N.explode_long(w.withColumnRenamed("group_no", "caption_id"), caps, h).drop("words"),
        lambda h: N.group_captions(groups, plain, h),
        lambda h: N.cover_groups(groups, h),
        lambda h: S.cover_ranges(ranges, n_words, h),
    ):
        assert rows(op(cold)) == rows(op(hot))


def test_sparse_ids_are_numbered_inside(spark):
    caps = spark.createDataFrame([(1, 0, 0, 300, []), (1, 5, 1000, 1300, []), (1, 9, 1100, 1400, [])], "video_id bigint, caption_id bigint, start_ms bigint, end_ms bigint, words array<struct<text:string,start_ms:bigint,end_ms:bigint,emphasis:boolean>>")
    assert [tuple(r)[1:4] for r in I.dedupe_overlaps(caps).orderBy("caption_id").collect()] == [(0, 0, 300), (5, 1000, 1300), (9, 1340, 1560)]
    groups = spark.createDataFrame([(1, 2, 4), (1, 7, 3), (1, 20, 9)], "video_id bigint, group_no bigint, hi bigint")
    assert [(r.lo, r.hi) for r in N.cover_groups(groups).orderBy("group_no").collect()] == [(0, 4), (5, 5), (6, 9)]


def test_gap_modes_keep_their_promises(spark):
    rnd = random.Random(5)
    data = [(1, i, rnd.randrange(0, 120_000), rnd.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(data, "video_id bigint, id bigint, t bigint, w bigint")
    time = {i: t for _, i, t, _ in data}
    both = {
        mode: [time[r.id] for r in G.select_with_gap(df, ["video_id"], "id", "t", 7000, first=[-F.col("w")], mode=mode).collect()]
        for mode in ("signed", "abs_all")
    }
    spaced = sorted(both["abs_all"])
    assert all(b - a >= 7000 for a, b in zip(spaced, spaced[1:]))
    # the signed scan goes by weight, then time, and only ever moves forward
    last, want = None, []
    for _, i, t, w in sorted(data, key=lambda r: (-r[3], r[2], r[1])):
        if last is None or t - last >= 7000:
            want.append(t)
            last = t
    assert sorted(both["signed"]) == sorted(want)


def test_first_per_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    got = first_per(df, ["k"], "o")
    assert rows(got) == [(1, 1, "a"), (2, 5, "c")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
