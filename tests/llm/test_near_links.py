"""Cases of the third review's findings."""

import corpus_pipeline
from voxtable.llm import simhash


def test_near_stage_takes_candidates_from_simhash_links(spark, monkeypatch):
    seen, own = [], simhash.links

    def links(fps, radius=simhash.RADIUS):
        seen.append(sorted(r.fp % (1 << 64) for r in fps.collect()))
        return own(fps, radius)

    monkeypatch.setattr(simhash, "links", links)
    long = [f"w{i}" for i in range(300)]
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), "by itself", "by  Itself", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [0, 2, 4]
    assert seen == [sorted({simhash.fingerprint(t.encode()) for t in texts[:4]})]
