"""Corpus views over the given tables, and the SQL that says the same.

The given prose is invented, so rule words never occur in it. Every row is
therefore prefixed with one phrase of a fixed cycle, picked by the row's own ids:
the work still grows with the tables, and every rule meets rows it fires on.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtable.functions.text import tokens
from voxtable.operators.ordered import HotKeys, find_hot, neighbours

PHRASES = [
    "So what does that mean?",
    "It means you're wasting money on raka system fine tunning.",
    "I thought the company was doing $10M a year.",
    "I was completely wrong.",
    "They were actually doing 100 million.",
    "Today we're going to talk about vector d.b embedings.",
    "If you want to learn this subscribe.",
    "Hey guys, nobody tells you the LLMS cost first.",
    "The real reason is Retrieval Augmented Generation over the documents.",
    "Never avoid the mistake of lora and peft!",
    "But that's not the case, instead of static data.",
    "This is INSANELY UNBELIEVABLE and GDPR wild .",
    "The Quick Brown Fox Jumps I'm Told",
    "hello everyone friends what matters is \"AI\" , really",
    "Welcome back, RAG vs Fine-tuning breakdown then 50% of 12 x",
    "posted 3 hours ago <b>and</b> edited 12 Days ago",
    "I'm proud, i'll say it's hilarious; so anyway next",
    "The most important thing is the bottleneck -- the key",
    "and $ 5 plus 7 crore users, ₹ 9 lakh",
    "Suddenly I was shocked: no way",
    "qunatization, destillation and compution power\\nsecond line here",
    "एक दो Three four",
    "on the contrary it seemed stateic and changing domain re-index",
    "don't stop, ok?",
]


def pick(i: Column, values=PHRASES) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in values]), (i % len(values) + 1).cast("int"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sql_pick(i: str, values=PHRASES) -> str:
    return f"({sql_list(values)})[CAST(({i}) % {len(values)} AS BIGINT) + 1]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Read a table; one of fewer files than cores is spread over them, any other is left as it is."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


# --- lines of documents, for text operators ---------------------------------------------------

def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line_no, txt): every line of every document behind a phrase."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.select(
        "doc_id", "line_no", F.concat(pick(F.col("doc_id") * 5 + F.col("line_no")), F.lit(" "), "line").alias("txt")
    )


LINES = f"""lines AS (
  SELECT doc_id, line_no, {sql_pick('doc_id * 5 + line_no')} || ' ' || line AS txt
  FROM (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"""


# --- timed transcripts from conversations -----------------------------------------------------

def segments(spark: SparkSession, sf: str) -> DataFrame:
    """(video_id, segment_id, speaker, txt) from conversation turns behind a phrase."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("segment_id"),
        F.col("role").alias("speaker"),
        F.concat(pick(F.col("conv_id") * 7 + F.col("turn")), F.lit(" "), F.col("text")).alias("txt"),
    )


SEGMENTS = f"""segments AS (
  SELECT conv_id AS video_id, turn AS segment_id, role AS speaker,
         {sql_pick('conv_id * 7 + turn')} || ' ' || text AS txt
  FROM conversations)"""


@lru_cache
def hot_turns(spark: SparkSession, sf: str) -> HotKeys:
    return find_hot(table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id")), ["video_id"])


def placed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with their words and the number of the video's words in front of them."""
    segs = segments(spark, sf).withColumn("toks", tokens(F.col("txt"))).drop("txt")
    return neighbours(segs, ["video_id"], "segment_id", total_before={"base": F.size("toks").cast("bigint")}, hot=hot_turns(spark, sf))


def word_start(word_id: Column, segment_id: Column) -> Column:
    return 350 * word_id + 600 * segment_id + 500 * F.floor(word_id / 23)


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Timed words: 350 ms apart, 600 ms more at each segment, a 500 ms pause after every 23rd word."""
    return (
        placed_turns(spark, sf).select("video_id", "segment_id", "speaker", "base", F.posexplode("toks").alias("pos", "word"))
        .withColumn("word_id", F.col("base") + F.col("pos"))
        .withColumn("start_ms", word_start(F.col("word_id"), F.col("segment_id")))
        .select("video_id", "segment_id", "speaker", "word_id", "word", "start_ms", (F.col("start_ms") + 300).alias("end_ms"))
    )


WORDS = f"""{SEGMENTS},
toked AS (
  SELECT video_id, segment_id, speaker, list_filter(string_split_regex(txt, '\\s+'), lambda t: t <> '') AS toks FROM segments),
based AS (
  SELECT *, COALESCE(sum(len(toks)) OVER (PARTITION BY video_id ORDER BY segment_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM toked),
words AS (
  SELECT video_id, segment_id, speaker, word_id, word, start_ms, start_ms + 300 AS end_ms FROM (
    SELECT video_id, segment_id, speaker, base + pos AS word_id, word,
           350 * (base + pos) + 600 * segment_id + 500 * ((base + pos) // 23) AS start_ms
    FROM (SELECT video_id, segment_id, speaker, base, unnest(range(len(toks))) AS pos, unnest(toks) AS word FROM based)))"""


# --- regular expressions for the SQL side -----------------------------------------------------
# RE2 has ASCII word boundaries only; spell the Unicode ones out.
LEFT = r"(?:^|[^\p{L}\p{N}_])"
RIGHT = r"(?:$|[^\p{L}\p{N}_])"
WCHAR = r"[\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    out, i = "", 0
    pattern = pattern.replace(r"(lakh|crore|million|billion|percent|%)\b", rf"(?:(?:lakh|crore|million|billion|percent){RIGHT}|%{WCHAR})")
    pattern = pattern.replace(r"(million|billion|percent|%)\b", rf"(?:(?:million|billion|percent){RIGHT}|%{WCHAR})")
    pattern = pattern.replace(r"(%|x|million|billion|k)\b", rf"(?:(?:x|million|billion|k){RIGHT}|%{WCHAR})")
    pattern = pattern.replace(r"\w", WCHAR)
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            rest, before = pattern[i + 2 :], pattern[i - 1 : i]
            left = bool(rest) and rest[0] not in "|)" and (before in ("", "|", "("))
            out += LEFT if left else RIGHT
            i += 2
        else:
            out += pattern[i]
            i += 1
    return out


def sql_matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit('(?i)' + re2(pattern))})"


def sql_replace_words(expr: str, pattern: str, new: str) -> str:
    r"""Replace `\bBODY\b`; run twice because neighbours share their boundary character."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\w", WCHAR).replace(r"d\.?b\.?", r"d\.?b")
    rx = lit(rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{body})($|[^\p{{L}}\p{{N}}_])")
    rep = lit(rf"\1{new}\2")
    once = f"regexp_replace({expr}, {rx}, {rep}, 'g')"
    return f"regexp_replace({once}, {rx}, {rep}, 'g')"
