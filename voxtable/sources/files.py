"""Binary files: media sniffing and PCM audio, and the job state files."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtable.functions.text import one_of

# Media types by suffix.
SUFFIX_MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml",
    "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "mkv": "video/x-matroska", "ogv": "video/ogg",
}


def sniff_mime(content: Column, path: Column) -> Column:
    """Media type from the first bytes, then from HTML or SVG text, then from the suffix."""
    head = F.hex(F.substring(content, 1, 64))
    text = F.lower(F.regexp_replace(F.substring(content, 1, 400).cast("string"), r"^\s+", ""))
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in SUFFIX_MIME.items() for x in kv])

    def at(offset, n, value):
        return F.substring(head, 2 * offset + 1, 2 * n) == value

    return (
        F.when(head == "", F.lit("empty"))
        .when(at(0, 3, "FFD8FF"), F.lit("image/jpeg"))
        .when(at(0, 4, "89504E47"), F.lit("image/png"))
        .when(at(0, 6, "474946383761") | at(0, 6, "474946383961"), F.lit("image/gif"))
        .when(at(0, 4, "52494646") & at(8, 4, "57454250"), F.lit("image/webp"))
        .when(at(4, 4, "66747970"), F.lit("video/mp4"))
        .when(at(0, 4, "1A45DFA3"), F.lit("video/webm"))
        .when(text.startswith("<svg") | (text.startswith("<?xml") & text.contains("svg")), F.lit("image/svg+xml"))
        .when(text.startswith("<!doct") | text.startswith("<html") | text.startswith("<head"), F.lit("text/html"))
        .otherwise(F.coalesce(F.try_element_at(table, suffix), F.lit("application/octet-stream")))
    )


#: Hops of a WAV file that are decoded at one time.
HOPS_AT_ONCE = 2048


def pcm_chunks(files: DataFrame, key: str, hop_s: float = 0.20) -> DataFrame:
    """(key, content) WAV files to per-hop sums: hop_id, sum_sq, n, hop_size; `problem` instead for bad files.

    Only 16-bit PCM is accepted. Samples are decoded HOPS_AT_ONCE hops at a time where
    the file lies, and leave the task as hop sums.
    """
    schema = f"{key} {files.schema[key].dataType.simpleString()}, hop_id bigint, sum_sq double, n bigint, hop_size bigint, problem string"

    def sums(f, hop):
        """Sums of squares and counts of the hops, in bounded reads; a file without samples has one empty hop."""
        first = True
        while raw := f.readframes(hop * HOPS_AT_ONCE):
            x = np.frombuffer(raw, dtype="<i2").astype(np.float64) / 32768.0
            edges = np.arange(0, len(x), hop)
            yield np.add.reduceat(x * x, edges), np.diff(np.append(edges, len(x)))
            first = False
        if first:
            yield np.zeros(1), np.zeros(1, np.int64)

    def one(name, raw):
        try:
            with wave.open(io.BytesIO(raw), "rb") as f:
                if f.getsampwidth() != 2:
                    raise ValueError(f"expected 16-bit PCM, got {f.getsampwidth()} byte samples")
                hop = max(1, round(hop_s * f.getframerate()))
                squares, counts = (np.concatenate(c) for c in zip(*sums(f, hop)))
        except (wave.Error, ValueError, EOFError) as exc:
            return pd.DataFrame({key: [name], "hop_id": [-1], "sum_sq": [0.0], "n": [0], "hop_size": [0], "problem": [str(exc)]})
        return pd.DataFrame({key: name, "hop_id": np.arange(len(squares)), "sum_sq": squares, "n": counts, "hop_size": hop, "problem": None})

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf[key], pdf["content"]):
                yield one(name, raw)

    return files.select(key, "content").mapInPandas(run, schema)


# Progress of each job stage.
STAGE_PROGRESS = {
    "uploaded": 5, "validating": 10, "extracting_audio": 25, "transcribing": 45, "repairing_transcript": 52,
    "analyzing_editorial": 58, "generating_captions": 72, "planning_edits": 82, "rendering": 90, "completed": 100, "failed": 100,
}
JOB_SCHEMA = (
    "job_id string, source_path string, kind string, theme string, split_layout boolean, status string, stage string, "
    "progress int, error string, result_path string, skip_stt boolean, caption_style string, caption_position string, metrics map<string,string>"
)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return complete_jobs(spark.read.schema(JOB_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path))


def complete_jobs(jobs: DataFrame) -> DataFrame:
    """Defaults for missing fields; rows without an id or with an unknown status are unreadable and go."""
    status = F.coalesce("status", F.lit("uploaded"))
    table = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    known = jobs.filter(F.col("job_id").isNotNull() & one_of(status, STAGE_PROGRESS))
    defaults = {"source_path": "", "kind": "video", "theme": "", "caption_style": "classic", "caption_position": "head"}
    return known.withColumns(
        {
            "status": status,
            "stage": F.coalesce("stage", status),
            "progress": F.coalesce("progress", F.element_at(table, status)),
            "split_layout": F.coalesce("split_layout", F.lit(False)),
            "skip_stt": F.coalesce("skip_stt", F.lit(False)),
            **{c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()},
        }
    )
