"""Costly columns are worked out once a row, and words are not joined back to the cuts made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.catalog.caption_queries import flat_words
from voxtable.functions import text as X
from voxtable.operators import intervals as I
from voxtable.operators import labels as L
from voxtable.operators import lines as N
from voxtable.operators.ordered import HotKeys, find_hot, ordered_fold
from voxtable.plans import cards as K

COLD = HotKeys(None, 0)


def plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def filters(df) -> str:
    return "\n".join(line for line in plan(df) if line.strip(" +-:").startswith("Filter"))


def labelled(spark):
    rows = [(1, i, i * 3000, i * 3000 + 2500, t, "key_insight") for i, t in enumerate(["RAG costs 50% of 12 x", "no way", "Fine-tuning versus RAG", "plain talk"])]
    return spark.createDataFrame(rows, "video_id long, sentence_id long, start_ms long, end_ms long, text string, role string")


def test_filters_do_not_repeat_the_rules(spark):
    said = labelled(spark)
    assert "RLIKE" not in filters(K.card_rows(said)).upper()
    assert "RLIKE" not in filters(K.scene_rows(said.withColumn("is_first", F.col("sentence_id") == 0))).upper()
    plain = said.select("video_id", "sentence_id", "text", F.lit("").alias("previous"), F.lit(0).alias("pause_before_ms"), F.lit(0).alias("pause_after_ms"))
    assert "RLIKE" not in filters(L.with_roles(plain).filter("role = 'hook'")).upper()


def test_reveal_times_are_not_worked_out_in_a_filter(spark):
    line = spark.createDataFrame([(1, 0, 1000, 2000, ["a", "b"], [False, True], [1000, 1900])], "video_id long, caption_id long, start_ms long, end_ms long, tokens array<string>, flags array<boolean>, token_ms array<long>")
    shown = flat_words(I.reveal_times(line))
    assert "lambda" not in filters(shown)
    assert [(r.word, r.word_start, r.word_end) for r in shown.orderBy("i").collect()] == [("a", 1000, 1450), ("b", 1450, 2000)]


def test_packs_take_their_words_along(spark):
    words = spark.range(20).select(F.lit(1).cast("long").alias("video_id"), F.lit(0).cast("long").alias("caption_id"), F.col("id").alias("word_id"), F.concat(F.lit("w"), "id").alias("word"), (F.col("id") * 400).alias("start_ms"), (F.col("id") * 400 + 300).alias("end_ms"))
    packed = N.packs_for(words, ["video_id", "caption_id"], COLD)
    assert sum("Join" in line for line in plan(packed)) <= 2  # the sizes, for short and for long captions
    got = packed.orderBy("word_id").collect()
    assert [r.word for r in got] == [f"w{i}" for i in range(20)] and all(r.pack_no <= r.word_id for r in got)


def test_fold_carries_columns_and_reads_what_the_step_asks_for(spark):
    rows = [(k, i, [f"{k}{i}", None], None if i == 2 else {"a": i}) for k in (1, None) for i in range(4)]
    df = spark.createDataFrame(rows, "video_id long, ord long, words array<string>, extra map<string,int>")
    asked = lambda row: sorted(row._values)

    def step(state, row):
        return [state[0] + row["ord"]], [(state[0], ",".join(asked(row)))] * (row["ord"] % 2)

    got = ordered_fold(df, ["video_id"], ["ord"], [0], step, "total long, asked string", carry=["ord", "words", "extra"], hot=COLD).collect()
    want = sorted((str(k), i, [f"{k}{i}", None], {"a": i}, i * (i - 1) // 2) for k in (1, None) for i in (1, 3))
    assert sorted((str(r.video_id), r.ord, r.words, r.extra, r.total) for r in got) == want
    assert all("words" not in r.asked and "extra" not in r.asked for r in got)


def test_literal_starts_change_no_match(spark):
    texts = ["I THOUGHT so", "talK: İ was wrong", "i waſ wrong", "rethought", "nothing", "Then  next", None, "the Key", "THE KEY", "x but", "But x", "vS. that"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in [L.GENERIC, L.CTA, L.NUMBER, L.MONEY, *[r[3] for r in L.ROLE_RULES], X.rules.PROCESS, X.rules.COMPARISON, *[t[0] for t in X.rules.TERM_RULES]]:
        got = df.select(X.matches(F.col("t"), pattern), F.col("t").rlike(X.wordwise(pattern))).collect()
        assert all(a == b for a, b in got), pattern
    assert X._literal_starts(r"\bvs\.?\b|\bthe (key|point)\b") == ["the key", "the point", "vs"]
    assert X._literal_starts(r"\b\d+x\b") is None


def test_turns_tell_how_many_words_a_video_has(spark):
    turns = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, None)], "video_id long, n int")
    found = find_hot(turns, ["video_id"], 10, rows=F.col("n"))
    assert found.rows == 11 and [r.video_id for r in found.keys.collect()] == [1]
