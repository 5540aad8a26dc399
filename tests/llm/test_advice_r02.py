"""Cases of the second review: each failed before its finding was settled."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from voxtable.llm import decontaminate, exact, hmm, language_id, near, pii
from voxtable.llm.common import fold

SF = "/root/testdata/sf0.001"


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def left(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rows_of_one_id_are_dropped_by_their_own_text(spark):
    rows = [(3, "a copy of three"), (5, "a copy  of three"), (5, "z unique"), (None, "first"), (None, "second"), (None, "third"), (7, "first"), (5, "z unique")]
    assert left(exact.drop_copies(made(spark, rows))) == sorted([(3, "a copy of three"), (5, "z unique"), (None, "second"), (None, "third"), (7, "first")], key=str)


def words(rnd, n):
    return [f"w{rnd.randrange(3000)}" for _ in range(n)]


def changed(rnd, own, k):
    return [f"c{rnd.randrange(10**9)}" if i in set(rnd.sample(range(len(own)), k)) else w for i, w in enumerate(own)]


@pytest.mark.parametrize("pairs_a_member", [0, 4])
def test_near_copies_equal_brute_force(spark, monkeypatch, pairs_a_member):
    monkeypatch.setattr(near, "PAIRS_A_MEMBER", pairs_a_member)
    rnd = random.Random(2)
    texts = []
    for _ in range(12):
        own = words(rnd, 150)
        texts += [own, *[changed(rnd, own, rnd.randrange(1, 6)) for _ in range(5)]]
    chain = words(rnd, 200)
    for k in range(12):  # neighbours are alike, the ends are not
        texts.append(chain[:])
        chain = chain[6:] + words(rnd, 6)
    texts += [["one"], ["One"], [], [], ["one", "two"]]
    rows = [(None if i % 17 == 5 else i // 2 if i % 11 == 3 else i, " ".join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    ids = {}
    for (i, t), g in zip(rows, group):
        ids.setdefault(g, []).append((i is None, i or 0, t))
    got = left(near.drop_near_copies(made(spark, rows)))
    assert len(got) == len(ids) and len({group[rows.index(r)] for r in got}) == len(got)
    assert sorted((i is None, i or 0) for i, _ in got) == sorted(min(m)[:2] for m in ids.values())


def test_near_stage_drops_what_two_bits_leave(spark):
    rnd = random.Random(4)
    own = words(rnd, 300)
    docs = made(spark, [(2, " ".join(own)), (1, " ".join(changed(rnd, own, 5))), (None, "by itself"), (None, "by itself too")])
    assert [r[0] for r in left(corpus_pipeline.near_dedup(spark, docs, SF))] == [1, None, None]


def test_training_sees_all_pieces_until_the_likelihood_stands(spark):
    rng = np.random.default_rng(1)
    coded = [np.concatenate([rng.integers(0, 2, hmm.PIECE), rng.integers(2, 4, hmm.PIECE), rng.integers(0, 2, hmm.PIECE), rng.choice([4, 5, 6], 40 + i)]) for i in range(6)]
    frequency = np.full(7, 1 / 7)
    pieces = [p for c in coded for p in hmm.cut_pieces(c)]
    want, last = hmm.first_model(2, frequency), -np.inf
    while True:
        counts = hmm.Counts(2, 7)
        want.expected(pieces, counts)
        want = counts.model(frequency)
        if not counts.log10 - last > hmm.TOLERANCE * abs(counts.log10):
            break
        last = counts.log10
    sequences = spark.createDataFrame([(i, bytearray(c.astype("<u2").tobytes())) for i, c in enumerate(coded)], "key long, symbols binary").repartition(3)
    got = hmm.train(sequences, frequency, len(coded), 2)
    assert np.allclose(got.emit, want.emit) and np.allclose(got.move, want.move) and np.allclose(got.start, want.start)


def test_spans_are_cut_alike_at_every_set_size(spark):
    passage = [f"p{i}" for i in range(60)]
    docs = made(spark, [(1, " ".join(["before", *passage, "after"])), (2, "nothing of it"), (3, None)])
    bench = spark.createDataFrame([("x", " ".join(passage))], "item_id string, text string")
    for set_bytes in (1 << 25, 2000, 300):
        assert left(decontaminate.decontaminate(docs, bench, mode="spans", set_bytes=set_bytes)) == [(1, "before  after"), (2, "nothing of it"), (3, None)]


def test_every_language_is_learned(spark):
    names = [f"l{k:03d}" for k in range(205)]
    rows = [(6 * k + i, f"{name} says {name} {name}", name) for k, name in enumerate(names) for i in range(6)]
    learned = {name for i, _, name in rows if fold(i, language_id.FOLDS) != language_id.HELD_OUT}
    assert language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0] == sorted(learned)
    assert len(learned) > 200


@pytest.mark.parametrize("between", [" ", "\n", "  "])
def test_spelled_address_does_not_depend_on_other_words(between):
    said = f"write to john{between}at{between}example.com now"
    own = [p for p in pii.proposals(said) if p[0] == "email"]
    assert own == [p for p in pii.proposals(said + " anecdote") if p[0] == "email"]
    assert own or not pii.SPELLED.search(said)
