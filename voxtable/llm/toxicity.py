"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

The lexicon, its weights, the exception phrases and the calibration are learned
from a bounded sample of labelled documents. A term is a word, or a beginning that
many words share. It must occur in many different toxic texts: near copies share a
sketch and count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import fold_column, over_batches, stored, text_column

#: Labelled documents of each class that the model learns from, at most about; fewer if there are fewer.
SAMPLE_ROWS = 6000
LEXICON_TERMS = 500
TERM_CHARS = 40
#: Shortest and longest word beginning that may be a term.
STEM_CHARS = (4, 10)
MIN_TEXTS = 3
REJECT = 0.7
FOLDS, HELD_OUT = 3, 1

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝαβεικνορτυχ", "abekmhopctyxijsdqwabeiknoptux"))
DIGITS = dict(zip("013457", "oieast"))
SIGNS = {"@": "a", "$": "s"}
FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
INSIDE = re.compile(r"(?<=[^\W\d_])[013457]|[013457](?=[^\W\d_])")
SIGN = re.compile(r"(?<![$@])(?:(?<=[^\W\d_])|(?<!\S))[@$](?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower-case text with look-alikes, and digits and signs beside letters, as the letters that they stand for."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(FOLD)
    if re.search("[013457]", low):
        low = INSIDE.sub(lambda m: DIGITS[m[0]], low)
    if "@" in low or "$" in low:
        low = SIGN.sub(lambda m: SIGNS[m[0]], low)
    return low


class Lexicon:
    """Terms with weights, exception phrases that hide the terms inside, and the calibration of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], calibration: list[float]):
        import ahocorasick

        self.calibration = calibration
        self.automaton = ahocorasick.Automaton()
        known: dict[str, list[float]] = {p: [0.0, 0.0, 1.0] for p in exceptions}  # weights as a beginning, as a word; exception
        for term, weight in weights.items():
            known.setdefault(term.rstrip(), [0.0, 0.0, 0.0])[term.endswith(" ")] = weight
        for term, values in known.items():
            self.automaton.add_word(term, (len(term), *values))
        self.any = bool(weights)
        if self.any:
            self.automaton.make_automaton()

    def mass(self, text: str) -> tuple[float, int]:
        """Weight of the words that are, or begin with, terms outside exception phrases; the number of words."""
        low = folded(text)
        best: dict[int, float] = {}
        hidden: list[tuple[int, int]] = []
        if self.any:
            for last, (size, start, word, exception) in self.automaton.iter(low):
                a, b = last - size + 1, last + 1
                if a and low[a - 1].isalnum():
                    continue
                ends = b == len(low) or not low[b].isalnum()
                if ends and exception:
                    hidden.append((a, b))
                if (weight := max(start, word if ends else 0.0)) > best.get(a, 0.0):
                    best[a] = weight
        if hidden:
            best = {a: w for a, w in best.items() if not any(x <= a < y for x, y in hidden)}
        return sum(best.values()), len(text.split())

    def features(self, text: str) -> list[float]:
        total, words = self.mass(text)
        return [1.0, math.log1p(total), math.log1p(100 * total / (words + 20)), float(total > 0)]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.calibration, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(maxsize=2)
def lexicon(weights: tuple, exceptions: tuple, calibration: tuple) -> Lexicon:
    return Lexicon(dict(weights), list(exceptions), list(calibration))


def _sample(docs: DataFrame, labels: DataFrame, rows: int, text: str) -> tuple[DataFrame, dict[int, int]]:
    """Labelled training texts (id, t, toxic), about `rows` of each class by the hash of their ids; and all rows per class."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(fold_column(FOLDS) != HELD_OUT)
    sizes = {int(r["toxic"] > 0): r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    share = F.when(F.col("toxic") > 0, F.lit(rows / max(1, sizes.get(1, 0)))).otherwise(F.lit(rows / max(1, sizes.get(0, 0))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(chance < share).orderBy(chance, "doc_id").limit(3 * rows).select(F.col("doc_id").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("id"), text_column(text).alias("t")).join(F.broadcast(chosen), "id")
    # one row per id, so the sample is bounded in rows too
    texts = texts.groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("toxic").alias("toxic"))
    sketched = texts.select("id", "t", "toxic").mapInArrow(over_batches(_sketched), "id long, t binary, toxic int, sketch long")
    return stored(sketched, "toxic-sample"), sizes


#: Least hashes that texts must share to count once: those of a passage that is half of both do so once in hundreds of pairs.
SKETCH_HASHES = 8


def sketch(text: str) -> int:
    """A hash of the least hashes of the text's runs of three words: near copies mostly share all of them, texts with a common passage don't."""
    words = WORD.findall(folded(text))
    hashes = {xxhash.xxh64_intdigest(" ".join(x)) for x in zip(words, words[1:], words[2:])} or {xxhash.xxh64_intdigest(" ".join(words))}
    return xxhash.xxh64_intdigest(",".join(map(str, nsmallest(SKETCH_HASHES, hashes)))) >> 1


def _sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [sketch(t.as_py().decode(errors="replace")) for t in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *batch.columns[1:], pa.array(found, pa.int64())], ["id", "t", "toxic", "sketch"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each word (with a space behind) and each beginning occurs; partial counts."""
    counts = (Counter(), Counter())

    def out():
        both = list(set(counts[0]) | set(counts[1]))
        rows = [pa.array(both, pa.string()), *[pa.array([counts[c][t] for t in both], pa.int64()) for c in (1, 0)]]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(rows, ["term", "bad", "good"])

    low, high = STEM_CHARS
    for batch in batches:
        for t, label in zip(batch.column(0), batch.column(1).to_pylist()):
            words = {w for w in WORD.findall(folded(t.as_py().decode(errors="replace"))) if len(w) <= TERM_CHARS}
            counts[label].update({w[:k] for w in words for k in range(low, min(high, len(w)) + 1)})
            counts[label].update(w + " " for w in words)
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield out()
    yield out()


def _phrases(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Terms with one neighbour, as they stand in each text."""
    phrases, toxic = [], []
    for t, label in zip(batch.column(1), batch.column(2).to_pylist()):
        low = folded(t.as_py().decode(errors="replace"))
        spots = list(WORD.finditer(low))
        found = set()
        for k, m in enumerate(spots):
            if any(m[0][:n] in shared.value for n in range(STEM_CHARS[0], len(m[0]) + 1)) or m[0] + " " in shared.value:
                found |= {low[x.start() : y.end()] for x, y in zip(spots[max(0, k - 1) : k + 1], spots[max(1, k) : k + 2]) if y.start() - x.end() == 1}
        phrases += found
        toxic += [label] * len(found)
    return pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())], ["p", "toxic"])


def _featured(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    model = lexicon(*shared.value)
    rows = [model.features(t.as_py().decode(errors="replace")) for t in batch.column(1)]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(2)], ["x", "toxic"])


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: int = LEXICON_TERMS, exceptions: tuple[str, ...] = (), text: str = "text") -> tuple[tuple, tuple, tuple]:
    """(weights, exception phrases, calibration) from labelled documents outside the held-out fold.

    A term is a word or beginning of at least MIN_TEXTS different toxic texts that occurs there
    far beyond chance; its weight is the logarithm of how much more often. A phrase of a term and one neighbour that clean texts have and toxic
    ones don't is an exception. Without labels nothing is a term. Null texts are
    empty, labels without an id are left out, of repeated rows of an id one text is
    taken (the least by hash), near copies of one label count once.
    """
    spark = docs.sparkSession
    sample, sizes = _sample(docs, labels, rows, text)
    different = sample.groupBy("sketch", "toxic").agg(F.min_by("t", "id").alias("t")).select("t", "toxic")  # copies of unlike labels stay apart
    found = different.mapInArrow(_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = stored(found, "toxic-terms")
    total = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum((F.col("bad") >= MIN_TEXTS).cast("int")).alias("n")).first()
    chosen: dict[str, float] = {}
    if total["bad"] and total["good"]:
        part = total["bad"] / (total["bad"] + total["good"])
        n = F.col("bad") + F.col("good")
        surprise = 2 * (F.col("bad") * F.log(F.col("bad") / n / part) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / n / (1 - part))).otherwise(0.0))
        ratio = F.log((F.col("bad") + 0.5) / float(total["bad"])) - F.log((F.col("good") + 0.5) / float(total["good"]))
        found = counted.filter(F.col("bad") >= MIN_TEXTS).withColumn("weight", ratio).withColumn("surprise", surprise)
        found = found.filter((F.col("weight") > math.log(4)) & (F.col("surprise") > 2 * math.log(max(1, total["n"])) + 6))
        found = found.orderBy(F.desc("surprise"), "term").limit(8 * terms).collect()
        bad_of = {r["term"]: r["bad"] for r in found}
        # of beginnings that say the same, the longest
        longer = {t[:k] for t, n in bad_of.items() for k in range(1, len(t)) if n >= 0.9 * bad_of.get(t[:k], math.inf)}
        chosen = dict([(r["term"], float(r["weight"])) for r in found if r["term"] not in longer][:terms])
    hidden = sorted(set(exceptions))
    if chosen:
        known = spark.sparkContext.broadcast(frozenset(chosen))
        phrases = sample.mapInArrow(over_batches(partial(_phrases, known)), "p string, toxic int")
        clean = phrases.groupBy("p").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).filter((F.col("bad") == 0) & (F.col("n") >= MIN_TEXTS))
        hidden += [r["p"] for r in clean.orderBy(F.desc("n"), "p").limit(terms).collect() if r["p"] not in hidden]
    first = (tuple(sorted(chosen.items())), tuple(hidden))
    rows_ = sample.mapInArrow(over_batches(partial(_featured, spark.sparkContext.broadcast((*first, (0.0,) * 4)))), "x array<double>, toxic int").collect()  # the sample's size
    x, y = np.array([r["x"] for r in rows_]).reshape(-1, 4), np.array([r["toxic"] for r in rows_], float)
    share = {c: sizes.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    w = calibrate(x, y, np.where(y > 0, share[1], share[0]) / max(1.0, min(share.values()) or 1.0)) if len(y) else np.zeros(4)
    return (*first, tuple(w.tolist()))


def _scored(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    model = lexicon(*shared.value)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.score(t.as_py().decode(errors="replace")) for t in batch.column(2)], pa.float64())], ["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: tuple[tuple, tuple, tuple], reject: float = REJECT, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null is an empty text; a null id's fold is that of ''."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), (fold_column(FOLDS) == HELD_OUT).alias("held_out"), text_column(text))
    return rows.mapInArrow(over_batches(partial(_scored, shared)), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= reject).cast("int"))


def _kept(shared, at: int, reject: float, batch: pa.RecordBatch) -> pa.RecordBatch:
    model = lexicon(*shared.value)
    return batch.filter(pa.array([model.score(t.as_py() or "") < reject for t in batch.column(at)]))


def drop_toxic(docs: DataFrame, model: tuple[tuple, tuple, tuple], reject: float = REJECT, text: str = "text") -> DataFrame:
    """docs without those that score reject or more; all columns stay as they are, whatever their names.

    Each row goes by its own text, null being empty; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(over_batches(partial(_kept, shared, docs.columns.index(text), reject)), docs.schema)
