"""A hidden Markov language model: words as symbols, Baum-Welch counts from every partition, exact scaled forward scores.

The most frequent training words are symbols of their own; every other word is
emitted as its class, by its last bytes, and then drawn from the class by its
count. So the tables that go to the workers have a fixed size, and the counts of
all other words, however many, meet their documents in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import chunks, fold_column, over_batches, stored, text_column

FOLDS, HELD_OUT = 5, 1
STATES = 8
#: Words with a symbol of their own, at most, and the longest such word in bytes: bounds what is broadcast.
OWN_WORDS, OWN_BYTES = 60_000, 48
CLASSES = 256
CLASS_BYTES = 3
#: Training sequences are documents in pieces of at most so many tokens; scores are of whole documents.
PIECE = 128
LANES = 1024
#: Forward chances are scaled every so many steps: chances of 1e-30 a step would not yet underflow in between.
SCALED_STEPS = 8
#: Training ends with the first pass over all pieces whose log-likelihood gains less than this share on the pass before.
TOLERANCE = 1e-4
#: Every task of a pass sends a sum per symbol and state: there are no more tasks than cores, unless each has so many tokens.
TASK_TOKENS = 1 << 24
FLUSH_WORDS = 250_000
ENCODED_ROWS = 1000
#: Documents scored in step: one step of the recursion serves all that are as long.
SCORED_ROWS = 10_000
#: Steps of the logarithm of a count, per doubling, by which the words with a symbol are cut off.
CUT_STEPS = 64


def words_of(text: bytes) -> Iterator[list[bytes]]:
    for part in chunks(text):
        yield part.lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words; the end of a document is the empty word."""
    counts: Counter[bytes] = Counter()

    def out():
        row = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return row

    for batch in batches:
        for t in batch.column(0):
            for words in words_of(t.as_py()):
                counts.update(words)
            counts[b""] += 1
            if len(counts) > FLUSH_WORDS:
                yield out()
    yield out()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-CLASS_BYTES:]) % CLASSES


def class_column(word: str = "word"):
    return F.crc32(F.substring(word, -CLASS_BYTES, CLASS_BYTES)) % CLASSES


class Symbols:
    """Numbers of the words that have one; behind them the classes and the end."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        self.first_class, self.end = len(words), len(words) + CLASSES

    def encode(self, text: bytes) -> tuple[np.ndarray, Counter]:
        """Symbols of the text's tokens with the end last, and the words that are there by class only."""
        parts, rest = [], Counter()
        get = self.number.get
        for words in words_of(text):
            found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            other = np.flatnonzero(found < 0).tolist()
            unnamed = [words[i] for i in other]
            rest.update(unnamed)
            found[other] = [self.first_class + word_class(w) for w in unnamed]
            parts.append(found)
        return np.concatenate([*parts, [self.end]]).astype("<u2"), rest


def _encode(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols, part, row = Symbols(shared.value), TaskContext.get().partitionId(), 0
    for whole in batches:
        for at in range(0, whole.num_rows, ENCODED_ROWS):
            batch = whole.slice(at, ENCODED_ROWS)
            coded, words, counts, ends = [], [], [], [0]
            for t in batch.column(2):
                ids, rest = symbols.encode(t.as_py())
                coded.append(ids.tobytes())
                words += rest.keys()
                counts += rest.values()
                ends.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])
            keys = pa.array([(part << 33) + row + i for i in range(batch.num_rows)], pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(1), pa.array(coded, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)], ["key", "doc_id", "held_out", "symbols", "rest"])


class Model:
    """start[k], move[k, l], and emit[s, k]: the chance of symbol s in state k."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)  # rows are taken whole

    def log10_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact, by the scaled forward recursion, all sequences in step; none is empty."""
        sizes = np.array([len(s) for s in sequences])
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate(sequences).astype(np.int64)
        at = (np.cumsum(sizes) - sizes)[order]
        alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes[order[0]]), side="right")
        total = np.zeros(len(sizes))
        one = np.ones(len(self.start))
        left = [*alive[1:].tolist(), 0]
        for step, (n, m) in enumerate(zip(alive.tolist(), left)):
            e = np.take(self.emit, flat[at[:n] + step], axis=0)
            a = a[:n] @ self.move if step else self.start
            a = np.multiply(a, e, out=e)
            if step % SCALED_STEPS == SCALED_STEPS - 1:
                scale = a @ one
                a /= scale[:, None]
                total[:n] += np.log10(scale)
            total[m:n] += np.log10(a[m:] @ one)
        out = np.empty(len(sizes))
        out[order] = total
        return out

    def expected(self, pieces: list[np.ndarray], into: "Counts") -> None:
        """Adds the expected counts of the pieces, at most LANES of them, all in step."""
        pieces = sorted(pieces, key=len, reverse=True)
        sizes = np.array([len(p) for p in pieces])
        alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]  # sizes > t
        ends = np.cumsum(alive).tolist()  # the rows of a step lie together, the longest piece first
        flat, at = np.concatenate(pieces).astype(np.int64), np.cumsum(sizes) - sizes
        seen = np.concatenate([flat[at[:n] + t] for t, n in enumerate(alive)])
        emit = np.take(self.emit, seen, axis=0)
        share, scales, one = np.empty_like(emit), {}, np.ones(len(self.start))
        for t, (n, end) in enumerate(zip(alive, ends)):
            now = share[end - n : end]
            if t:
                np.matmul(before[:n], self.move, out=now)
                now *= emit[end - n : end]
            else:
                np.multiply(self.start, emit[:n], out=now)
            if t % SCALED_STEPS == SCALED_STEPS - 1:
                scales[t] = now @ one
                now /= scales[t][:, None]
                into.log10 += float(np.log10(scales[t]).sum())
            before = now
        back, later = np.ascontiguousarray(self.move.T), np.empty((len(pieces), len(one)))
        moves, m = np.zeros_like(self.move), 0
        for t in range(len(alive) - 1, -1, -1):
            n, end = alive[t], ends[t]
            now = share[end - n : end]
            if m:
                ahead = emit[end : end + m]
                ahead *= later[:m]
                if t + 1 in scales:
                    ahead /= scales[t + 1][:, None]
                moves += now[:m].T @ ahead
                np.matmul(ahead, back, out=later[:m])
            if n > m:  # pieces that end here: what lies behind them is one over their sum, so that shares add up to one
                total = now[m:] @ one
                into.log10 += float(np.log10(total).sum())
                later[m:n] = 1 / total[:, None]
            now *= later[:n]
            m = n
        into.start += share[: alive[0]].sum(axis=0)
        into.move += moves * self.move
        by_state = np.eye(len(one)) @ share.T  # bincount needs each state's shares side by side
        for k, weights in enumerate(by_state):
            into.emit[:, k] += np.bincount(seen, weights, len(into.emit))


class Counts:
    """Expected counts of one Baum-Welch pass."""

    def __init__(self, states: int, symbols: int):
        self.start, self.move, self.emit, self.log10 = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)).T, 0.0

    def model(self, frequency: np.ndarray) -> Model:
        """The model of these counts. Each state's words are mixed with the plain frequencies, which weigh as many tokens as
        the state has different words: the more new words a state keeps meeting, the less it trusts its own counts."""
        states = len(self.start)
        start, move = self.start + 1 / states, self.move + np.eye(states) + 1 / states
        emit = self.emit + (np.minimum(self.emit, 1).sum(axis=0) + 1) * frequency[:, None]
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_model(states: int, frequency: np.ndarray, seed: int = 7) -> Model:
    """States that stay, each with frequencies shaken a little, from a fixed seed."""
    shaken = frequency[:, None] * np.random.default_rng(seed).uniform(0.5, 1.5, (len(frequency), states))
    return Model(np.full(states, 1 / states), 0.9 * np.eye(states) + 0.1 / states, shaken / shaken.sum(axis=0))


def cut_pieces(symbols: np.ndarray) -> list[np.ndarray]:
    return [symbols[i : i + PIECE] for i in range(0, len(symbols), PIECE)]


def _expected(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of expected counts: symbols from 0 on, moves from -1 - state, the start and the likelihood behind them."""
    model = Model(*shared.value)
    counts = Counts(len(model.start), len(model.emit))
    waiting: list[np.ndarray] = []
    for batch in batches:
        for s in batch.column(0):
            waiting += cut_pieces(np.frombuffer(s.as_py(), "<u2"))
            while len(waiting) >= LANES:
                model.expected(waiting[:LANES], counts)
                del waiting[:LANES]
    if waiting:
        model.expected(waiting, counts)
    states = len(model.start)
    some = np.flatnonzero(counts.emit.any(axis=1))
    ids = np.concatenate([some, -1 - np.arange(states), [-1 - states, -2 - states]])
    values = np.concatenate([counts.emit[some], counts.move, counts.start[None], np.full((1, states), counts.log10)])
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(values[:, k], pa.float64()) for k in range(states)]], ["id", *[f"k{k}" for k in range(states)]])


def baum_welch_pass(sequences: DataFrame, model: Model, frequency: np.ndarray) -> tuple[Model, float]:
    """One pass over all training sequences: tasks send expected counts, Spark adds them up, the sums make the next model.

    Also the log10 likelihood of the sequences' pieces under the model given.
    """
    states = len(model.start)
    shared = sequences.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    names = [f"k{k}" for k in range(states)]
    rows = sequences.select("symbols").mapInArrow(partial(_expected, shared), ", ".join(["id long", *[f"{n} double" for n in names]]))
    sums = rows.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # a row per symbol and state at most
    ids = sums.column("id").to_numpy()
    values = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
    counts = Counts(states, len(model.emit))
    counts.emit[ids[ids >= 0]] = values[ids >= 0]
    for k in range(states):
        counts.move[k] = values[ids == -1 - k].sum(axis=0)
    counts.start = values[ids == -1 - states].sum(axis=0)
    return counts.model(frequency), float(values[ids == -2 - states, 0].sum())


def for_passes(sequences: DataFrame, tokens: int) -> DataFrame:
    """The sequences, of so many tokens, in as many partitions as a pass has tasks."""
    return sequences.coalesce(max(sequences.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS)))


def train(sequences: DataFrame, frequency: np.ndarray, rows: int, states: int = STATES) -> Model:
    """Passes over all sequences (symbols binary), of which there are `rows`, until the likelihood gains less than TOLERANCE."""
    model, last = first_model(states, frequency), -np.inf
    while rows:
        model, log10 = baum_welch_pass(sequences, model, frequency)
        if not log10 - last > TOLERANCE * abs(log10):
            break
        last = log10
    return model


def _score(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    (start, move, emit), base, first_class = shared.value
    coded = [np.frombuffer(s.as_py(), "<u2") for s in batch.column(3)]
    likely = Model(start, move, emit).log10_likelihoods(coded)
    sizes = np.array([len(c) for c in coded])
    flat = np.concatenate(coded)
    own = (flat < first_class) | (flat == first_class + CLASSES)
    ends = np.cumsum(sizes) - sizes
    known = np.add.reduceat(own & (base[flat] > -np.inf), ends)
    plain = np.add.reduceat(np.where(own & (base[flat] > -np.inf), base[flat], 0.0), ends)
    arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(plain), pa.array(likely)]
    return pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "held_out", "n_tokens", "own_known", "own_base", "own_score"])


def score_corpus(docs: DataFrame, text: str = "text", states: int = STATES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the documents outside the held-out fold, scores all. Null is an
    empty text, whose only token is its end; a null id's fold is that of the empty
    text. Repeated rows are each learned from and scored. Without training
    documents every score is that of an untrained model. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), (fold_column(FOLDS) == HELD_OUT).alias("held_out"), text_column(text).alias("t"))
    counts = stored(rows.filter(~F.col("held_out")).select("t").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("docs")).first()
    n, v, n_docs = (totals[k] or 0 for k in ("n", "v", "docs"))
    norm = float(np.log10(n + 0.5 * (v + 1)))
    level = F.floor(F.log2("c") * CUT_STEPS)
    may = (F.length("word") > 0) & (F.length("word") <= OWN_BYTES)
    levels = sorted(((r["level"], r["n"]) for r in counts.filter(may).groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    # the lowest level down to which all words have a symbol; a level is a row, and there are CUT_STEPS per doubling
    enough = np.cumsum([k for _, k in levels]) <= OWN_WORDS
    least = levels[int(enough.sum()) - 1][0] if enough.any() else np.inf
    named = counts.filter(may & (level >= float(least))).toArrow()  # OWN_WORDS rows at most
    pairs = sorted(zip(named.column("word").to_pylist(), named.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    own, own_counts = [w for w, _ in pairs], np.array([c for _, c in pairs], np.float64)
    encoded = stored(rows.mapInArrow(partial(_encode, spark.sparkContext.broadcast(own)), "key long, doc_id long, held_out boolean, symbols binary, rest array<struct<word:binary,n:long>>"), "symbols")
    tail = counts.filter(((F.length("word") > OWN_BYTES) | (level < float(least))) & (F.length("word") > 0))
    by_class = {r["k"]: (r["n"], r["v"]) for r in tail.groupBy(class_column().alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    sums = np.array([by_class.get(k, (0, 0)) for k in range(CLASSES)], np.float64)

    mass = np.concatenate([own_counts, sums[:, 0], [n_docs]]) + 0.5
    frequency = mass / mass.sum()
    model = train(for_passes(encoded.filter(~F.col("held_out")).select("key", "symbols"), n), frequency, n_docs, states)

    base = np.full(len(mass), -np.inf)
    base[: len(own)] = np.log10(own_counts + 0.5) - norm
    if n_docs:
        base[-1] = np.log10(n_docs + 0.5) - norm
    shared = spark.sparkContext.broadcast(((model.start, model.move, model.emit), base, len(own)))
    forward = encoded.select("key", "doc_id", "held_out", "symbols").mapInArrow(over_batches(partial(_score, shared), SCORED_ROWS), "key long, doc_id long, held_out boolean, n_tokens long, own_known long, own_base double, own_score double")

    classes = spark.createDataFrame([(k, float(np.log10(s + 0.5 * (d + 1)))) for k, (s, d) in enumerate(sums.tolist())], "k long, class_norm double")
    rest = encoded.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.n")
    met = rest.join(tail.select("word", "c").hint("merge"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long"))).withColumn("k", class_column())
    chance = F.log10(F.col("c") + 0.5)
    per_doc = met.join(F.broadcast(classes), "k").groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0))).alias("rest_known"), F.sum(F.col("n") * (chance - norm)).alias("rest_base"), F.sum(F.col("n") * (chance - F.col("class_norm"))).alias("rest_score")
    )
    out = stored(forward, "forward").join(per_doc.hint("merge"), "key", "left")
    zero = F.lit(0.0)
    end_base = zero if n_docs else F.lit(float(np.log10(0.5) - norm))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("own_known") + F.coalesce("rest_known", F.lit(0).cast("long"))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("own_base") + F.coalesce("rest_base", zero) + end_base).alias("base_score"), (F.col("own_score") + F.coalesce("rest_score", zero)).alias("score"),
    )
