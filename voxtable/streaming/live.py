"""Streaming twins of loudness hops, pause sessions and the time-order gap gate.

Rows may arrive in any order, so nothing waits for a watermark and nothing is
late: each micro-batch is reduced to rows that can be merged later and is written
under its batch number (a retried batch overwrites itself). The results merge
what has been written, and are those of the batch operators at any point in time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from voxtable.operators.gates import select_with_gap
from voxtable.operators.ordered import neighbours

VIDEO = ["video_id"]
Reduce = Callable[[DataFrame], DataFrame]


def land(stream: DataFrame, reduce: Reduce, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all available input, each batch reduced and written once; returns what has been written."""
    nothing = reduce(stream.sparkSession.createDataFrame([], stream.schema))
    nothing.write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(nothing.schema.add("batch", "long")).parquet(out).drop("batch")


def hop_sums(samples: DataFrame) -> DataFrame:
    """(video_id, ts, sq) samples of a batch to sums per 0.2 s hop."""
    hops = samples.groupBy("video_id", F.window("ts", "200 milliseconds").alias("w")).agg(F.sum("sq").alias("sq"), F.count("*").alias("n"))
    return hops.select("video_id", F.col("w.start").alias("ts"), "sq", "n")


def loudness(sums: DataFrame) -> DataFrame:
    """Level of every hop in thousandths of a decibel."""
    hops = sums.groupBy("video_id", "ts").agg(F.sum("sq").alias("sq"), F.sum("n").alias("n"))
    level = 20000 * F.log10(F.sqrt(F.col("sq") / F.col("n") + 1e-12) + 1e-9)
    return hops.select("video_id", "ts", "n", F.round(level).cast("bigint").alias("mdb"))


def word_runs(words: DataFrame) -> DataFrame:
    """(video_id, ts, dur_ms) words of a batch: how many start at a moment, and how long the longest lasts."""
    return words.groupBy("video_id", "ts").agg(F.max("dur_ms").alias("dur_ms"), F.count("*").alias("n"))


def pause_sessions(moments: DataFrame, pause_ms: int = 450) -> DataFrame:
    """Runs of words in which each starts less than a pause after all before it have ended."""
    merged = moments.groupBy("video_id", F.unix_micros("ts").alias("at")).agg(F.max("dur_ms").alias("dur_ms"), F.sum("n").alias("n"))
    near = neighbours(merged, VIDEO, "at", max_before={"_end": F.col("at") + F.col("dur_ms") * 1000})
    opens = F.when(F.col("_end").isNull() | (F.col("at") - F.col("_end") >= pause_ms * 1000), 1).otherwise(0)
    runs = neighbours(near.withColumn("_opens", opens.cast("bigint")), VIDEO, "at", total_before={"_run": "_opens"})
    placed = runs.withColumn("_run", F.col("_run") + F.col("_opens"))
    return placed.groupBy("video_id", "_run").agg(F.sum("n").alias("n_words"), F.timestamp_micros(F.min("at")).alias("first_ts"), F.timestamp_micros(F.max("at")).alias("last_ts")).drop("_run")


def gate_rows(events: DataFrame) -> DataFrame:
    """Of the events of a batch in one millisecond of a video, the one with the smallest id: no other can be picked."""
    return events.groupBy("video_id", F.unix_millis("ts").alias("at")).agg(F.min(F.struct("caption_id", "ts")).alias("event"))


def gap_gate(rows: DataFrame, gap_ms: int) -> DataFrame:
    """(video_id, caption_id, ts): in time order, events at least gap_ms after the last one picked."""
    moments = rows.groupBy("video_id", "at").agg(F.min("event").alias("event"))
    picked = select_with_gap(moments.select("video_id", "at"), VIDEO, "at", "at", gap_ms)
    return moments.join(picked, ["video_id", "at"]).select("video_id", "event.caption_id", "event.ts")
