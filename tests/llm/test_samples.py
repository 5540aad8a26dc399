"""The samples that the classifiers learn from: which texts count once, and that a rerun draws the same."""

import math
import random

from voxtable.llm import language_id, toxicity

SF = "/root/testdata/sf0.001"


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def test_a_common_footer_merges_no_texts():
    rnd = random.Random(3)
    footer = words(rnd, 60)
    assert not sum(toxicity.sketch(" ".join(words(rnd, 40) + footer)) == toxicity.sketch(" ".join(words(rnd, 40) + footer)) for _ in range(200))
    assert toxicity.sketch("One two  three four") == toxicity.sketch("one two three four")


def test_a_rerun_learns_the_same_and_repeated_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    first = toxicity.learn(docs, labels)
    hot = docs.filter("doc_id = 5").crossJoin(spark.range(60)).drop("id")
    assert first == toxicity.learn(docs.unionByName(hot).repartition(7), labels.repartition(3))


def test_every_language_keeps_its_windows_beside_a_hot_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = docs.filter("lang = 'de'").limit(1).crossJoin(spark.range(1000)).drop("id")
    langs, _ = language_id.learn(docs.unionByName(hot).repartition(5), rows=40)
    assert langs == sorted({r.lang for r in docs.select("lang").distinct().collect() if r.lang})


def naive_score(text, weights, exceptions, calibration):
    """The score by trying every term and phrase at every place."""
    low = toxicity.folded(text)
    bounded = lambda a: a == 0 or not low[a - 1].isalnum()
    ends = lambda b: b == len(low) or not low[b].isalnum()
    at = {}
    for a in range(len(low)):
        for term, weight in weights.items():
            t = term.rstrip()
            if bounded(a) and low.startswith(t, a) and (not term.endswith(" ") or ends(a + len(t))):
                at[a] = max(at.get(a, 0.0), weight)
    for p in exceptions:
        for a in range(len(low)):
            if bounded(a) and low.startswith(p, a) and ends(a + len(p)):
                at = {x: w for x, w in at.items() if not a <= x < a + len(p)}
    total, words = sum(at.values()), len(text.split())
    z = sum(c * f for c, f in zip(calibration, (1.0, math.log1p(total), math.log1p(100 * total / (words + 20)), float(total > 0))))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_equal_a_naive_matcher():
    rnd = random.Random(4)
    weights = {"trash ": 2.0, "gruk": 3.0, "gruks ": 1.5, "vile ": 4.0, "tra": 0.5}
    exceptions, calibration = ["trash can", "vile weather"], [-2.0, 0.7, 0.9, 0.3]
    lexicon = toxicity.Lexicon(weights, exceptions, calibration)
    parts = ["trash", "Trash", "tr4sh", "trashcan", "trash can", "gruk", "grukling", "GRUKS", "vile", "v1le", "vile weather", "аpple", "ok", "tra", "x-gruk", "!", "7", "$um"]
    for _ in range(300):
        text = rnd.choice([" ", ", ", "  "]).join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14)))
        assert abs(lexicon.score(text) - naive_score(text, weights, exceptions, calibration)) < 1e-12
