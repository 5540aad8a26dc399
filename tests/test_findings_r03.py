"""Cases of the third review's findings outside of voxtable/llm."""

import random

from pyspark.sql import functions as F

from voxtable import rules
from voxtable.functions import text as X
from voxtable.operators import media as M



def test_needles_meet_words_not_candidates(spark):
    rnd = random.Random(3)
    letters = "abé"
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(4)) for _ in range(60)]
    rows = [(i % 2 if i % 9 else None, i // 2 if i % 7 else i, t, t.upper()) for i, t in enumerate(texts)]
    needles = [(i % 2, "".join(rnd.choice(letters + "A ") for _ in range(rnd.randrange(1, 6)))) for i in range(150)] + [(0, None), (None, "abé")]
    cands = spark.createDataFrame(rows, "job_id long, ordinal long, title string, url string").withColumns(
        {"file_name": F.lit("x"), "label": F.lit(None).cast("string"), "probe_ok": F.lit(True), "status": F.lit("reusable")}
    )
    got = M.relevance(cands, spark.createDataFrame(needles, "job_id long, needle string"), ["job_id"], piece=8)
    want = {(j, n.lower()) for j, n in needles if n is not None and len(n) > 2}
    hits = {}
    for j, o, t, u in rows:
        blob = f"{t} {u} x".lower()
        hits[j, o] = hits.get((j, o), 0) + sum(k == j and n in blob for k, n in want if j is not None)
    assert sorted((r.job_id is None, r.job_id or 0, r.ordinal, r.hits) for r in got.collect()) == sorted((j is None, j or 0, o, hits[j, o]) for j, o, *_ in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_word" in plan  # candidates meet needles by their words


def test_dear_patterns_start_with_a_cheap_test():
    fixes = [X.wordwise(p) for p, _ in rules.ASR_FIXES]
    assert all(p.startswith("(?=[") for p in fixes)
    assert X.wordwise(r"\bstateic\b").startswith("(?=[sSſ])") and X.wordwise(r"\b(a|b)\b").startswith("(?iU)")


def test_cheap_patterns_keep_their_results(spark):
    cases = {
        "  a\t b   c \n": ("a b c", ["a", "b", "c"]),
        "   x  y": ("x y", ["x", "y"]),
        " ": ("", []),
        "x y": ("x y", ["x", "y"]),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.squish(F.col("t")).alias("s"), X.tokens(F.col("t")).alias("k")).collect()
    assert {r.t: (r.s, r.k) for r in rows} == cases
    texts = {
        "raka system ſtateic": "RAG system static", "fine tunning of lora": "Fine-tuning of LoRA", "ſtateic": "ſtateic",
        "vector d.b and compution": "vector DB and compute", None: None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fix_asr(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == texts
    copies = {
        "\"The Quick Brown AI Fox I'm\" --": "The quick brown AI fox I'm\" ",
        "BREAKING news;": "breaking news",
    }
    rows = spark.createDataFrame([(t,) for t in copies], "t string").select("t", X.clean_copy(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows}["BREAKING news;"] == copies["BREAKING news;"]
