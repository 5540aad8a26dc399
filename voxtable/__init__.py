"""Spoken-media analytics on Spark: DataFrame operators over timed transcripts and crawled media."""
