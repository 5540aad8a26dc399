"""Output documents: edit plans, design rows and job manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtable.operators.ordered import top_per


def _children(rows: DataFrame, time: str, fields: list[str], alias: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(F.col(time).alias("_o"), F.struct(*fields).alias("v"))))
    return rows.groupBy("video_id").agg(F.transform(packed, lambda s: s["v"]).alias(alias))


def edit_plans(captions: DataFrame, graphics: DataFrame, cues: DataFrame, moods: DataFrame) -> DataFrame:
    """One nested document per video, children in time order.

    The format is one document per video, so a row is as large as its video's plan;
    `plan_rows` is the same content for those who read it row by row.
    """
    caps = _children(captions, "start_ms", ["start_ms", "end_ms", "text", "treatment"], "captions")
    cards = _children(graphics, "start_ms", ["start_ms", "end_ms", "kind"], "graphics")
    sounds = _children(cues, "at_ms", ["at_ms", "kind", "gain", "reason"], "sfx")
    return caps.join(cards, "video_id", "full").join(sounds, "video_id", "full").join(moods, "video_id", "left").select(
        "video_id", "captions", "graphics", "sfx", F.coalesce("music_mood", F.lit("warm_inspiring")).alias("music_mood")
    )


def plan_rows(captions: DataFrame, graphics: DataFrame, cues: DataFrame) -> DataFrame:
    """The children of all plans as rows (video_id, section, at_ms, child as JSON); no row or task holds a video."""
    parts = [(captions, "captions", "start_ms", ["start_ms", "end_ms", "text", "treatment"]), (graphics, "graphics", "start_ms", ["start_ms", "end_ms", "kind"]), (cues, "sfx", "at_ms", ["at_ms", "kind", "gain", "reason"])]
    rows = [df.select("video_id", F.lit(name).alias("section"), F.col(time).alias("at_ms"), F.to_json(F.struct(*fields)).alias("child")) for df, name, time, fields in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def write_edit_plans(plans: DataFrame, path: str, buckets: int = 256) -> None:
    """JSON lines in hash buckets, so that files stay few however many videos there are."""
    plans.withColumn("bucket", F.pmod(F.hash("video_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(path)


def design_rows(drafts: DataFrame, notes: DataFrame) -> DataFrame:
    """One audit row per line: what it says, how it is drawn, what the note said."""
    return drafts.join(notes.select("video_id", "line_id", "key", "weight", "kind"), ["video_id", "line_id"], "left").withColumns(
        {
            "key": F.coalesce("key", F.lit("")),
            "weight": F.coalesce("weight", F.lit(1)),
            "kind": F.coalesce("kind", F.lit("normal")),
        }
    )


def manifest_rows(candidates: DataFrame, blocked_limit: int = 40, sources_limit: int = 30) -> DataFrame:
    """Rows of a job's manifest and sources list: all accepted candidates, and the first blocked ones of each list.

    Both limits are part of the formats.
    """
    fields = ["job_id", "ordinal", "title", "kind", "url"]
    accepted = candidates.filter("action = 'accepted'").select(F.lit("accepted").alias("section"), *fields)
    blocked = top_per(candidates.filter("action = 'blocked'").select(*fields), ["job_id"], max(blocked_limit, sources_limit), "ordinal", rank="_place")
    lists = F.array_compact(F.array(F.when(F.col("_place") <= blocked_limit, F.lit("blocked_copyrighted")), F.when(F.col("_place") <= sources_limit, F.lit("copyrighted_not_downloaded"))))
    return accepted.unionByName(blocked.select(F.explode(lists).alias("section"), *fields))
