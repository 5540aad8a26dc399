"""The passes of op1_hidden_markov: cheap for each token, few sums to send, the same counts and scores."""

from __future__ import annotations

import time

import numpy as np

from voxtable.llm import hmm


def made_model(symbols, states=8):
    rng = np.random.default_rng(5)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states)) ** 6
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def plain(model, pieces, into):
    """Scaled at every step, with the arrays of every step by themselves."""
    pieces = sorted(pieces, key=len, reverse=True)
    grid, alive = np.zeros((len(pieces[0]), len(pieces)), np.int64), [sum(len(p) > t for p in pieces) for t in range(len(pieces[0]))]
    for lane, p in enumerate(pieces):
        grid[: len(p), lane] = p
    forward, scales = [], []
    for t, n in enumerate(alive):
        a = ((forward[-1][:n] @ model.move) if t else model.start) * model.emit[grid[t, :n]]
        scales.append(a.sum(axis=1, keepdims=True))
        forward.append(a / scales[-1])
        into.log10 += float(np.log10(scales[-1]).sum())
    seen, share, later = [], [], np.ones((alive[-1], len(model.start)))
    for t in range(len(alive) - 1, -1, -1):
        if t + 1 < len(alive):
            m = alive[t + 1]
            ahead = model.emit[grid[t + 1, :m]] * later / scales[t + 1]
            into.move += (forward[t][:m].T @ ahead) * model.move
            later = np.concatenate([ahead @ model.move.T, np.ones((alive[t] - m, len(model.start)))])
        seen.append(grid[t, : alive[t]])
        share.append(forward[t] * later)
    into.start += share[-1].sum(axis=0)
    seen, share = np.concatenate(seen), np.concatenate(share)
    for k in range(len(model.start)):
        into.emit[:, k] += np.bincount(seen, share[:, k], len(into.emit))


def test_a_pass_counts_as_before_in_less_time():
    rng, symbols = np.random.default_rng(6), 20_000
    model = made_model(symbols)
    pieces = [rng.integers(0, symbols, n) for n in [hmm.PIECE] * 3600 + rng.integers(1, hmm.PIECE, 400).tolist() + [1, 7, 8, 9, 16, 17]]

    def run(fn, lanes):
        counts, began = hmm.Counts(8, symbols), time.process_time()
        for at in range(0, len(pieces), lanes):
            fn(pieces[at : at + lanes], counts)
        return counts, time.process_time() - began

    runs = [(run(model.expected, hmm.LANES), run(lambda p, into: plain(model, p, into), 2048)) for _ in range(4)]
    got, want = runs[0][0][0], runs[0][1][0]
    for name in ("start", "move", "emit", "log10"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-9, atol=1e-12)
    assert min(now[1] for now, _ in runs) < 0.75 * min(before[1] for _, before in runs)


def test_scores_of_all_lengths_equal_those_scaled_at_every_step():
    rng = np.random.default_rng(7)
    model = made_model(300)
    model.emit[:50] = 1e-25  # rare symbols in a row
    sequences = [rng.integers(0, 300, n) for n in [*range(1, 40), 1000, 5000]] + [np.arange(50)]
    want = []
    for s in sequences:
        a, total = None, 0.0
        for x in s:
            a = (model.start if a is None else a @ model.move) * model.emit[x]
            total += np.log10(a.sum())
            a = a / a.sum()
        want.append(total)
    assert np.allclose(model.log10_likelihoods(sequences), want, rtol=1e-12)


def test_a_pass_has_a_task_a_core_or_one_per_so_many_tokens(spark):
    cores = spark.sparkContext.defaultParallelism
    sequences = spark.range(1000).repartition(10 * cores)
    assert hmm.for_passes(sequences, 1000).rdd.getNumPartitions() == cores
    assert hmm.for_passes(sequences, 3 * cores * hmm.TASK_TOKENS - 5).rdd.getNumPartitions() == 3 * cores
    assert hmm.for_passes(sequences.coalesce(2), 0).count() == 1000


def test_many_small_partitions_train_the_same_model(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 30))) for i in range(200)], "doc_id long, text string")
    parts, run = [], hmm.baum_welch_pass
    monkeypatch.setattr(hmm, "baum_welch_pass", lambda sequences, *rest: parts.append(sequences.rdd.getNumPartitions()) or run(sequences, *rest))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        many = {r.doc_id: r for r in hmm.score_corpus(docs.repartition(12)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism
    few = {r.doc_id: r for r in hmm.score_corpus(docs.coalesce(1)).collect()}
    assert len(many) == 200 and all(abs(many[i].score - few[i].score) < 1e-6 * abs(few[i].score) for i in few)
