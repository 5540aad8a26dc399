"""Streams give what the batch rows give, in whatever order their files are read."""

import random

import pytest
from pyspark.sql import functions as F

from voxtable.operators.gates import select_with_gap
from voxtable.session import shared_folder
from voxtable.streaming import live


@pytest.fixture(scope="module")
def events(spark):
    rnd, rows = random.Random(6), []
    for v in range(3):
        t = 1_700_000_000_000_000
        for i in range(120):
            t += rnd.choice([0, 1, 999, 150_000, 450_000, 449_999, 2_000_000, 90_000_000])
            rows.append((v, i, t, rnd.random(), rnd.choice([0, 100, 300])))
    return spark.createDataFrame(rows, "video_id bigint, caption_id bigint, us bigint, sq double, dur_ms bigint").withColumn("ts", F.timestamp_micros("us")).drop("us").cache()


def landed(spark, events, reduce, order, name):
    home = f"{shared_folder(spark)}/{name}-{random.getrandbits(60)}"
    for part in order:  # one file a trigger, in this order
        events.filter(F.col("caption_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    return live.land(stream, reduce, f"{home}/out", f"{home}/state")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_streams_equal_batch_in_any_file_order(spark, events, order):
    assert rows(live.loudness(landed(spark, events, live.hop_sums, order, "hops"))) == rows(live.loudness(live.hop_sums(events)))
    runs = rows(live.pause_sessions(landed(spark, events, live.word_runs, order, "runs")))
    want = []
    for v in range(3):
        end = None
        for r in sorted((r for r in events.filter(F.col("video_id") == v).select("*", F.unix_micros("ts").alias("us")).collect()), key=lambda r: r.us):
            if end is None or r.us - end >= 450_000:
                want.append([v, 0])
            want[-1][1] += 1
            end = max(end or 0, r.us + r.dur_ms * 1000)
    assert sorted(r[:2] for r in runs) == sorted(map(tuple, want))
    gate = rows(live.gap_gate(landed(spark, events, live.gate_rows, order, "gate"), 600).select("video_id", "caption_id"))
    batch = select_with_gap(events.select("video_id", "caption_id", F.unix_millis("ts").alias("t")), ["video_id"], "caption_id", "t", 600)
    assert gate == rows(batch.select("video_id", "caption_id"))


def test_nothing_landed(spark, events):
    home = f"{shared_folder(spark)}/none-{random.getrandbits(60)}"
    events.limit(0).write.parquet(f"{home}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{home}/in")
    assert live.loudness(live.land(stream, live.hop_sums, f"{home}/out", f"{home}/state")).count() == 0
