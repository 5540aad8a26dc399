"""The registered queries: complete, and equal to their SQL on the smallest tables."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
QUICK = [
    "txt_fix_case", "txt_key_for", "url_normalize", "src_pages_media", "lab_rights", "topk_downloads", "seg_sentences", "lab_role_signals",
    "plan_zoom", "gate_cues", "gate_vocal_emphasis", "ivl_dedupe_overlap", "seg_cover_ranges", "dq_script", "join_review_edits", "src_job_manifests",
]


def test_sql_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.os.path.dirname(entry.os.path.abspath(entry.__file__)))


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["speaker", "sentences", "mean_rate", "mean_pause_ms"] and df.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    assert compare(got, df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


@pytest.mark.parametrize("name", ["stream_loudness", "stream_pause_sessions", "stream_gap_gate"])
def test_streams_drain(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_gap_gate_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from voxtable.catalog.base import table
    from voxtable.operators.gates import select_with_gap

    ev = table(spark, SF, "events").select((F.col("user_id") % 100).alias("video_id"), F.col("event_id").alias("caption_id"), F.col("ts").cast("timestamp").alias("ts"))
    batch = select_with_gap(ev.withColumn("t", F.unix_millis("ts")), ["video_id"], "caption_id", "t", 600_000)
    live = entry.queries()["stream_gap_gate"](spark, SF)
    assert {(r.video_id, r.caption_id) for r in batch.collect()} == {(r.video_id, r.caption_id) for r in live.collect()}
