"""Transcripts as JSON documents or timestamped markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtable.functions import text as X
from voxtable.operators.ordered import neighbours
from voxtable.operators.segment import uniform_spans

SCHEMA = (
    "language string, duration double, "
    "segments array<struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double,probability:double>>>>"
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One document per file; the file name is the video."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return docs.withColumn("video", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))


def _ms(c: Column) -> Column:
    return F.bround(c * 1000).cast("bigint")


def json_segments(docs: DataFrame, key: str) -> DataFrame:
    s = docs.select(key, F.posexplode("segments").alias("segment_id", "s"))
    return s.select(key, "segment_id", _ms(F.col("s.start")).alias("start_ms"), _ms(F.col("s.end")).alias("end_ms"), "s.text")


def json_words(docs: DataFrame, key: str) -> DataFrame:
    s = docs.select(key, F.posexplode("segments").alias("segment_id", "s"))
    w = s.select(key, "segment_id", F.posexplode("s.words").alias("position", "w"))
    return w.select(
        key, "segment_id", "position", "w.word", _ms(F.col("w.start")).alias("start_ms"), _ms(F.col("w.end")).alias("end_ms"),
        F.coalesce("w.probability", F.lit(0.0)).alias("probability"),
    )


RANGE = r"^\s*(\d{1,2}):(\d{2})\s*[-–—]\s*(\d{1,2}):(\d{2})\s*$"


def _marked_lines(docs: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line, header, block): every trimmed line with the number of its block, -1 in front of the first.

    A line opens a block if it is a range in asterisks, or if it is the first range of
    its document. Blocks are numbered by a running count of such lines.
    """
    lines = docs.select(key, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    lines = lines.select(key, F.col("line_no").cast("bigint").alias("line_no"), F.trim("line").alias("line"))
    ranged = lines.withColumn("_range", F.replace("line", F.lit("*"), F.lit("")).rlike(RANGE).cast("bigint"))
    seen = neighbours(ranged, [key], "line_no", total_before={"_ranges": "_range"})
    marked = seen.withColumn("header", ((F.col("_range") == 1) & (F.col("line").startswith("*") | (F.col("_ranges") == 0))).cast("bigint"))
    numbered = neighbours(marked, [key], "line_no", total_before={"_headers": "header"})
    return numbered.select(key, "line_no", "line", "header", (F.col("_headers") + F.col("header") - 1).alias("block"))


def markdown_segments(docs: DataFrame, key: str) -> DataFrame:
    """(key, text) documents of `**mm:ss - mm:ss**` blocks to (key, block, start_ms, end_ms, text).

    Lines, not documents, are the rows, so a long document is spread; a row of the
    result has one block's lines. A block without a word is no segment, and one whose
    words need more than its range (0.12 s each) ends with its last word.
    """
    lines = _marked_lines(docs, key)

    def at(group):
        return F.regexp_extract(F.replace("line", F.lit("*"), F.lit("")), RANGE, group).cast("bigint")

    begin = (at(1) * 60 + at(2)) * 1000
    heads = lines.filter("header = 1").select(key, "block", begin.alias("start_ms"), F.greatest((at(3) * 60 + at(4)) * 1000, begin + 200).alias("end_ms"))
    body = lines.filter((F.col("header") == 0) & (F.col("block") >= 0) & (F.col("line") != "") & ~F.lower("line").startswith("here is the timestamped"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    texts = body.groupBy(key, "block").agg(F.array_join(in_order, " ").alias("text"))
    said = heads.join(texts, [key, "block"]).withColumn("_n", F.size(X.upload_tokens(F.col("text")))).filter("_n > 0")
    return said.select(key, "block", "start_ms", F.greatest(F.col("end_ms"), F.col("start_ms") + 120 * F.col("_n")).alias("end_ms"), "text")


def markdown_rejects(docs: DataFrame, key: str) -> DataFrame:
    """Keys of documents without any timestamped block that has words."""
    return docs.select(key).distinct().join(markdown_segments(docs, key).select(key).distinct(), key, "left_anti")


def markdown_words(blocks: DataFrame, key: str) -> DataFrame:
    """Evenly timed words of each block; the last word reaches the block's end."""
    timed = blocks.withColumn("toks", X.upload_tokens(F.col("text")))
    spans = uniform_spans(F.size("toks"), F.col("start_ms"), F.col("end_ms"), 120, 60)
    w = timed.select(key, "block", F.size("toks").alias("n"), F.col("end_ms").alias("_e"), F.posexplode(F.arrays_zip(F.col("toks"), spans.alias("at"))).alias("position", "w"))
    end = F.when(F.col("position") == F.col("n") - 1, F.greatest("w.at.end_ms", "_e")).otherwise(F.col("w.at.end_ms"))
    return w.select(key, "block", "position", F.col("w.toks").alias("word"), F.col("w.at.start_ms").alias("start_ms"), end.alias("end_ms"))
