"""The corpus operators against brute force, and their defined results on odd input."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from voxtable.llm import decontaminate, exact, hmm, huffman, language_id, packing, pii, prefix_counts, simhash, tokens, toxicity
from voxtable.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, t string, items string"
WORDS = "the of and river stone light paper garden window music bread silver winter summer doctor market".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".", "ing", "er"]) for _ in range(n))


#: Null, empty and blank texts, ties, repeated rows and ids, case, white space, a text without blanks, special strings, one long text.
ODD = [
    (1, prose(1, 40)), (2, None), (3, ""), (4, " \t\n"), (5, prose(1, 40).replace(" ", " \n ")), (6, prose(2, 6)), (7, prose(1, 40).upper()), (8, "x" * 5000), (9, "a<|endoftext|>b <|startoftext|>"),
    (10, "Ärger, élan! İ ≠ 中文 😀 don't we'll 12 3.5"), (11, prose(3, 20000)), (12, prose(2, 6)), (13, "one two"), (None, prose(2, 6)), (14, "!!! ... 123"), (15, "I\x00J\x1cK\x85L"), (12, prose(2, 6)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", "clash", "clash") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(t):
    return t or ""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ids_of(name, t, end=None):
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode(text(t), add_special_tokens=False).ids
    return found + ([end] if end is not None else [])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exact_groups(odd):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", text(t)) for _, t in ODD]
    want = []
    for (i, _), n in zip(ODD, norm):
        same = [j for (j, _), m in zip(ODD, norm) if m == n]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert rows(exact.exact_groups(odd, sha=True)) == sorted(want, key=str)
    assert rows(exact.exact_groups(odd)) == sorted((w[:4] for w in want), key=str)


def test_drop_copies_keeps_one_row_of_each_text_and_all_columns(odd, none):
    out = exact.drop_copies(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 6, 7, 8, 9, 10, 11, 13, 14, 15]
    assert exact.drop_copies(none).count() == 0


def brute_fingerprint(t):
    words = text(t).encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(odd):
    prints = [(i, brute_fingerprint(t)) for i, t in ODD]
    group = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            group = [group[a] if g == group[b] else g for g in group]
    first = {g: min((i for (i, _), h in zip(prints, group) if h == g and i is not None), default=None) for g in group}
    want = [(i, f, first[g]) for (i, f), g in zip(prints, group)]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_leave_the_components_of_all_pairs(spark):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(prints):
        for _ in range(6):
            f ^= 1 << rnd.randrange(64)
            prints.add(f)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    parent = {p: p for p in signed}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= 2:
            parent[top(a)] = top(b)
    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    for a, b in itertools.combinations(signed, 2):
        assert (found.get(a, a) == found.get(b, b)) == (top(a) == top(b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {len({found[n] for n in some}) for some in (range(31), range(100, 120))} == {1} and found[0] != found[100]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


BENCH = [(1, prose(1, 40)), (2, "One, TWO"), (3, None), (4, "..."), (5, prose(1, 12)), (5, prose(1, 12)), (None, prose(3, 15)), (7, prose(9, 30))]


@pytest.mark.parametrize("set_bytes", [1 << 20, 2000])
def test_scan(spark, odd, set_bytes):
    bench = spark.createDataFrame([(i, t, "clash") for i, t in BENCH], "item_id long, text string, spans string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text(t).encode().lower())
    want = []
    for i, t in ODD:
        words, hit, items = split(t), set(), set()
        for item, b in BENCH:
            own = split(b)
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1):
                if n and tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= {str(item)} if item is not None else set()
        want.append((i, len(words), len(hit), sorted(items)))
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.scan(odd, bench, set_bytes=set_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.decontaminate(odd, bench, set_bytes=set_bytes)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_spans_are_cut_out_and_no_items_hit_nothing(spark, none):
    docs = spark.createDataFrame([(1, "Before, one TWO! after"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(2, "One, two")], "item_id long, text string")
    assert [r.text for r in decontaminate.decontaminate(docs, bench, mode="spans").orderBy("doc_id").collect()] == ["Before, ! after", None]
    empty = bench.limit(0)
    assert [(r.n_words, r.n_hit) for r in decontaminate.scan(docs, empty).orderBy("doc_id").collect()] == [(4, 0), (0, 0)]
    assert decontaminate.decontaminate(docs, empty).count() == 2 and decontaminate.scan(none, bench).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 20), (2, 20), (6, 3), (200, 8), (3000, 14)):
        ids, counts = np.arange(n, dtype=np.uint32) * 3, (1 + rng.pareto(0.6, n) * 5).astype(np.int64)
        sizes = huffman.code_lengths(ids, counts, limit)
        assert sizes.max() <= limit and (2.0 ** -sizes.astype(float)).sum() <= 1
        code = huffman.Code(ids, sizes)
        texts = [rng.choice(ids, m) for m in (1, 63, 64, 65, 700)]
        coded = [code.encode(t) for t in texts]
        assert all((a == b).all() for a, b in zip(code.decode([(len(t), lanes, bits) for t, (bits, lanes) in zip(texts, coded)]), texts))


def test_package_merge_equals_search():
    counts = np.array([1, 1, 2, 3, 20, 40])
    best = min(sum(c * s for c, s in zip(counts, sizes)) for sizes in itertools.product(range(1, 5), repeat=6) if sum(2.0**-s for s in sizes) <= 1)
    assert (huffman.code_lengths(np.arange(6), counts, 4).astype(int) * counts).sum() == best


def test_coded_corpus_round_trip(odd, none):
    found = {}
    for r in huffman.code_corpus(odd).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.n_tokens, bytes(r.ids)))
    start = 0
    for i in sorted({i for i, _ in ODD}, key=lambda i: (i is not None, i)):
        for got in sorted(found[i]):
            want = np.array(ids_of("word_bpe_49k.json", dict(ODD)[i], 1), "<u4")
            assert got == (start, len(want), want.tobytes())
            start += len(want)
    assert huffman.code_corpus(none).count() == 0


def test_encoder_equals_library_on_random_texts():
    encoder, library = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["e. ", "é, ", "÷, ", "×.\n", "1, ", "B", "e", " ", "\n", "'s", "'LL", "re", ".", ",", "?!", "É", "ß", "\xa0", "中", "😀", "́", "\x1c", "<|endoftext|>", "<|endo", "\x85", "ǅ", "İ", "Σ", "=", "̸"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    got = encoder.encode_all([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_prefix_counts_equal_the_library_at_every_prefix():
    counter, library = prefix_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["a", "the", "th", " ", "  ", "\n", "\t", "'", "'s", "'ll", "re", "23", ".", "!!", "é", "\xa0", "　", "中", "😀", "́", "\x1c", "<|endoftext|>", "<|endo", "ing", "-", "\x85"]
    rnd = random.Random(1)
    for _ in range(400):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.cumsum(counter.differences(t)).tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)]


def test_count_corpus(odd, none):
    want = []
    for i, t in ODD:
        counts = [len(ids_of("byte_bpe_50k.json", text(t)[:k])) for k in range(1, min(len(text(t)), 300) + 1)]
        total = len(ids_of("byte_bpe_50k.json", t))
        want.append((i, len(text(t).encode()), total, total > 20, max([k + 1 for k, c in enumerate(counts) if c <= 20], default=0)))
    got = rows(prefix_counts.count_corpus(odd, limit=20))
    assert [g for g in got if g[0] != 8] == sorted((w for w in want if w[0] != 8), key=str)
    assert [g[:4] for g in got if g[0] == 8] == [w[:4] for w in want if w[0] == 8]
    assert prefix_counts.count_corpus(none).count() == 0


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_packing(odd, capacity):
    placed = packing.pack(odd, capacity=capacity).collect()
    want = []
    for i, t in ODD:
        ids = ids_of("word_bpe_49k.json", t, 1)
        want += [(i, k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed), key=str) == sorted(want, key=str)
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0] + [n for _, n in parts]))[:-1] and sum(n for _, n in parts) <= capacity


def test_plan_equals_best_fit_decreasing_one_by_one():
    rnd = random.Random(4)
    for _ in range(60):
        capacity = rnd.choice([5, 10, 37])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))]
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            room = min(fits) if fits else capacity
            if fits:
                rooms.remove(room)
            rooms.append(room - n)
        steps = packing.plan_best_fit(dict(Counter(lengths)), capacity)
        used = {s[3] + (r - s[1]) // s[4] for s in steps for r in range(s[1], s[2])}
        assert len(used) == len(rooms)


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


def brute_personal(t):
    luhn = lambda g: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(g))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(g := re.sub("[ -]", "", m[0])) <= 19 and luhn(g)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_plain_patterns():
    parts = ["a", "b.c", "@", "@x.de", "1", "12", ".", "4111 1111", "4111111111111111", "-", " ", "+", "(", ")", "255", "256.", "0", "é", "_", "%", "5500-0000-0000-0004"]
    rnd = random.Random(2)
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert [(k, a, b) for k, found in pii.base_spans(t).items() for a, b in found] == brute_personal(t), t


def test_personal_data(spark, none):
    said = [(1, "mail me: jo@ex.org or +49 30 1234567, ip 10.0.0.1, card 4111 1111 1111 1111"), (2, None), (3, ""), (4, "a@" * 20000), (5, "1" * 20000), (6, "jo (at) ex (dot) org; call (030) 555-0134"), (6, "x")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in said], "doc_id long, text string, base string")
    got = rows(pii.find_personal_data(docs))
    assert [(r[0], *r[1:5]) for r in got] == [(1, 1, 1, 1, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0), (5, 0, 0, 0, 0), (6, 0, 0, 0, 0), (6, 0, 0, 0, 0)]
    for (_, t), r in zip(sorted(said, key=str), got):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_personal(text(t)))
        assert r[5] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r[6].split(","))
    assert pii.find_personal_data(none).count() == 0


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1 for right in (0.95, 0.9, 0.55)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, chance = pii.reliabilities(patterns, counts.astype(float))
    right = [(chance[1, j, 2] + chance[0, j, 0]) / 2 for j in range(3)]
    assert right[0] > 0.85 and right[1] > 0.8 and right[2] < 0.65


def test_toxicity_learns_words_and_beginnings(spark, none):
    rnd = random.Random(8)
    made, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = prose(i, 30).split() + ([rnd.choice(["vilewort", "gruk" + rnd.choice(["en", "ost", "illa", "ar"])])] if bad else [])
        rnd.shuffle(words)
        made.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(made + [(10001, None), (10002, ""), (10003, "a V1lew0rt here"), (10004, "vilewortish"), (10005, "the GRUKABC")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == bad for i, bad in labels)
    assert [got[10000 + k].predicted for k in range(1, 6)] == [0, 0, 1, 0, 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(not r.predicted for r in got.values())
    assert toxicity.score(none, toxicity.learn(none, known)).count() == 0
    assert {r.predicted for r in toxicity.score(docs, toxicity.learn(docs, known.limit(0))).collect()} == {0}


def test_exception_phrases_hide_terms():
    lexicon = toxicity.Lexicon({"trash ": 5.0, "gruk": 4.0}, ["trash can"], [0.0, 1.0, 0.0, 0.0])
    assert [lexicon.mass(t)[0] for t in ("the trash can", "the tr4sh", "trashy", "grukilla, TRASH!", "", "trash$$$", "$gruk")] == [0, 5, 0, 9, 0, 5, 0]


def test_sequence_likelihood_equals_the_sum_over_paths():
    rng = np.random.default_rng(3)
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((5, 3))
    model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    want = []
    for s in sequences:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for k in range(1, len(s)):
                p *= model.move[path[k - 1], path[k]] * model.emit[s[k], path[k]]
            total += p
        want.append(math.log10(total))
    assert np.allclose(model.log10_likelihoods(sequences), want)


def test_expected_counts_equal_enumeration_and_rounds_gain():
    rng = np.random.default_rng(4)
    start, move, emit = rng.random(2), rng.random((2, 2)), rng.random((3, 2))
    model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    pieces = [np.array([0, 2, 1]), np.array([1, 1]), np.array([2])]
    got, want = hmm.Counts(2, 3), hmm.Counts(2, 3)
    model.expected(pieces, got)
    for s in pieces:
        paths = list(itertools.product(range(2), repeat=len(s)))
        weight = np.array([model.start[p[0]] * np.prod([model.emit[x, k] for x, k in zip(s, p)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            want.start[p[0]] += w
            for a, b in zip(p, p[1:]):
                want.move[a, b] += w
            for x, k in zip(s, p):
                want.emit[x, k] += w
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit)


def test_corpus_scores(odd, none):
    tokens_of = lambda t: [*text(t).encode().lower().split(), None]
    counts, total = Counter(), 0
    for i, t in ODD:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            counts.update(tokens_of(t))
            total += len(tokens_of(t))
    want = []
    for i, t in ODD:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens_of(t))
        want.append((i, len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), total, round(base, 6)))
    got = hmm.score_corpus(odd).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got) and hmm.score_corpus(none).count() == 0


def test_scores_beat_plain_frequencies_on_held_out_documents(spark):
    got = [r for r in entry.queries()["op1_hidden_markov"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_a_model_of_a_small_vocabulary_sums_to_one(spark, monkeypatch):
    """Chances of all texts of one known word, of the unknown words' share and of no word add up."""
    monkeypatch.setattr(hmm, "OWN_WORDS", 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a a d", "b a e", "a", None, "c"] * 4)], "doc_id long, text string")
    got = {r.doc_id: r for r in hmm.score_corpus(docs).collect()}
    assert all(r.score < 0 and r.base_score < 0 for r in got.values())


def test_language_network_gradients():
    rng = np.random.default_rng(0)
    network = language_id.Network(3)
    network.embed, network.out = network.embed.astype(float), network.out.astype(float)
    network.filters = {w: f.astype(float) for w, f in network.filters.items()}
    x, y = rng.integers(0, language_id.CLASSES, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, gradients = network.gradients(x, y)
    for weight, gradient in zip(network.weights(), gradients):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        keep, step = weight[at], 1e-3
        weight[at] = keep + step
        up = network.gradients(x, y)[0]
        weight[at] = keep - step
        down = network.gradients(x, y)[0]
        weight[at] = keep
        assert abs((up - down) / (2 * step) - gradient[at]) < 0.02 * abs(gradient[at]) + 1e-4


def test_language_tables_equal_the_filters():
    network, x = language_id.Network(3), language_id.windows(prose(1, 200).encode())
    e = network.embed[x]
    pooled = [sum(e[:, j : j + language_id.WINDOW - w + 1] @ f[j] for j in range(w)).max(axis=1) for w, f in network.filters.items()]
    logits = np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0) @ network.out + network.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(language_id.chances(network.tables(), x), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_windows_show_every_run_of_bytes():
    for n in (0, 1, 3, 127, 128, 129, 253, 254, 1000):
        t = bytes(random.Random(n).choices(b"abcdefghij", k=n))
        codes = t.translate(language_id.CLASS_OF)
        seen = {w.tobytes()[i : i + 4] for w in language_id.windows(t) for i in range(language_id.WINDOW - 3)}
        assert {codes[i : i + 4] for i in range(n - 3)} <= seen


def test_language_of_held_out_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language_id.predict(docs, model).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 14)) and got[11][0] in model[0] and 0 < got[11][1] <= 1
    assert language_id.predict(none, language_id.learn(none)).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.learn(none)).collect()} == {"und"}


def five_word_shingles(t):
    words = text(t).encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learned = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    lexicon = toxicity.Lexicon(dict(learned[0]), list(learned[1]), list(learned[2]))
    left = {i: r.text for i, r in sorted(docs.items()) if lexicon.score(text(r.text)) < 0.7}
    first: dict[str, int] = {}
    for i, t in left.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text(t)), i)
    left = {i: left[i] for i in sorted(first.values())}
    sets = {i: five_word_shingles(t) for i, t in left.items()}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:  # two texts without words are equal
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if g == old else g for k, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    windows = set()
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text(t).encode().lower())
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = split(r.text)
        windows |= {tuple(own[k : k + min(10, len(own))]) for k in range(max(1, len(own) - 9))} if own else set()
    sizes = {len(w) for w in windows}
    left = {i: t for i, t in left.items() if not any(tuple(w[k : k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))}
    want = [(i, k, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for i, t in left.items() for ids in [ids_of("word_bpe_49k.json", t, 1)] for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def test_stages_take_odd_documents(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and 0 < out.count() <= len(ODD)
        assert stage(spark, none, SF).count() == 0


def test_every_query_is_registered():
    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if re.match(r"op\d+_", n)} == {"pipeline", *(n for n in names if n.startswith("op"))}
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert json.dumps(sorted(entry.oracle_sql()))
