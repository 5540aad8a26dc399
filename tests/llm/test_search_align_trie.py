"""Top-k search, token alignment and prefix tries against brute force, and their defined results on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voxtable.llm import prefix_trie, token_alignment, topk_search

VECTORS = "vec_id long, embedding array<double>, label int, score string, row string, n2 string"


def brute_top(rows, k=20, every=20):
    whole = []
    for vec_id, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            if sum(x * x for x in w) < 1 << 62:
                whole.append((vec_id, w))
    out = []
    for i, (q, v) in enumerate(whole):
        if q is not None and q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), c is None, c or 0, c) for j, (c, w) in enumerate(whole) if j != i)[:k]
            out += [(q, r + 1, f[3], -f[0]) for r, f in enumerate(found)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], VECTORS).repartition(5)


@pytest.mark.parametrize("kind", ["plain", "skewed", "copies", "huge"])
def test_top_k(spark, kind):
    rnd = np.random.default_rng(3)
    n, d = 700, 24
    m = rnd.normal(size=(n, d)) * (rnd.lognormal(size=(n, 1)) if kind == "skewed" else 1)
    if kind == "skewed":
        m *= np.linspace(3, 0.01, d)
    if kind == "huge":
        m *= 1e6
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(m)]
    if kind == "copies":  # one vector is a third of all
        rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]
    got = topk_search.top_k(vectors(spark, rows), head_bytes=1 << 12, block=128)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows)


def test_top_k_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (20, [1.0]), (40, None), (60, []), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (120, [float("inf")]), (None, [5.0, 5.0]), (None, [5.0, 5.0]), (-20, [-1.5, 0.0]), (3, [1e30]), (5, [0.0, 0.0])]
    assert sorted((tuple(r) for r in topk_search.top_k(vectors(spark, rows)).collect()), key=str) == brute_top(rows)
    assert topk_search.top_k(vectors(spark, [])).count() == 0
    assert topk_search.top_k(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
    assert topk_search.top_k(vectors(spark, [(20, [1.0])])).count() == 0


def brute_alignment(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs = []
    for x in texts:
        a, b = ([], []) if not x else (t.encode(" " + x, add_special_tokens=False).ids, sp.encode(x))
        ba = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        groups = []
        if not x or not b"".join(ba) == b"".join(bb) == (" " + x).encode():
            docs.append((0, 0, groups, []))
            continue
        ends = sorted({sum(map(len, ba[: i + 1])) for i in range(len(a))} & {sum(map(len, bb[: i + 1])) for i in range(len(b))}) if len(a) < 300 else None
        i = j = ea = eb = 0
        while i < len(a):
            ga, gb = [a[i]], [b[j]]
            ea, eb, i, j = ea + len(ba[i]), eb + len(bb[j]), i + 1, j + 1
            while ea != eb:
                if ea < eb:
                    ga, ea, i = [*ga, a[i]], ea + len(ba[i]), i + 1
                else:
                    gb, eb, j = [*gb, b[j]], eb + len(bb[j]), j + 1
            groups.append((ga, gb))
        assert ends is None or len(ends) == len(groups)
        docs.append((len(a), len(b), groups, [(p, q) for ga, gb in groups for p in ga for q in gb]))
    counts = Counter(p for d in docs for p in set(d[3]))
    high = defaultdict(int)
    for (p, _), n in counts.items():
        high[p] = max(high[p], n)
    out = []
    for na, nb, groups, links in docs:
        digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        out.append((na, nb, len(groups), len(links), sum(counts[x] == high[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out


ODD = [
    None, "", " ", "  a", "a\nb", "a \n b", "word, word; word! don't we'll", "<s>a</s> <0x41> <|endoftext|>x", "a\x00b\x1c", "\ta  b\r\n", "café élan, Ärger.", "１２ 中文。日本語 😀😀 　x\xa0 y  z", "x" * 3000, "Ω≈ç√∫˜µ≤≥÷" * 40,
    "the same words", "the same words", "1234567 3.14,15", "a.b,c;d!e?f:g", "é ‍ ﬁ", "﻿bom", ".", "\n\n\n", "İstanbul ŉ",
]


def test_alignment(spark):
    rnd = random.Random(4)
    texts = [*ODD, " ".join(rnd.choice(["river", "stone,", "Light", "zqxv", "été", "naïve."]) for _ in range(3000))]
    docs = spark.createDataFrame([(i % 20, t, "row", "pairs") for i, t in enumerate(texts)], "doc_id long, text string, row string, pairs string").repartition(3)
    want = sorted(((i % 20, *w) for i, w in enumerate(brute_alignment(texts))), key=str)
    for head in (token_alignment.HEAD_PAIRS, 40, 0):
        got = token_alignment.align_corpus(docs, head_pairs=head)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert token_alignment.align_corpus(docs.filter("doc_id < 0")).count() == 0


def test_long_texts_are_aligned_in_pieces(monkeypatch):
    tool = token_alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    text = " ".join(random.Random(2).choice(["stone", "lights,", "été", "zq\n"]) for _ in range(2000)).encode()
    whole = token_alignment._row(1, list(tool.align(tool.pieces(text))))
    monkeypatch.setattr(token_alignment, "GROUP_BYTES", 500)
    pieces = tool.pieces(text)
    assert len(pieces) > 10 and b"".join(pieces) == b" " + text
    cut = token_alignment._row(1, [next(iter(tool.align([p]))) for p in pieces])
    assert cut[:6] == whole[:6] and cut[6].tolist() == whole[6].tolist() and cut[7].tolist() == whole[7].tolist()


def test_wide_groups_link_all_different_ids():
    rnd = np.random.default_rng(1)
    ids = (rnd.integers(0, 30, 300), rnd.integers(0, 20, 200))
    of = (np.zeros(300, np.int64), np.zeros(200, np.int64))
    parts = list(token_alignment.linked(ids, of, (np.array([300]), np.array([200])), np.array([5]), 100))
    want = Counter(int(a) * 100 + int(b) for a in ids[0] for b in ids[1])
    assert {int(c) - (5 << token_alignment.CODE_BITS): int(n) for code, times in parts for c, n in zip(code, times)} == want


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    saved, leaves = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
    out = []
    for k, members in nodes.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(members) if len(made[c]) == len(k)).encode()).hexdigest()
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), leaves[k], saved[k], ends))
    return sorted(out, key=str)


def talk(rnd, n):
    return [(rnd.choice(["user", "bot", None]), rnd.choice(["hi", "yes", "no", "", None, "größer"])) for _ in range(n)]


def conversations(kind):
    rnd = random.Random(kind)
    rows = []
    if kind == "mixed":
        for c in range(0, 120):
            rows += [(c, t, *x) for t, x in enumerate(talk(rnd, rnd.randrange(1, 7)))]
    elif kind == "hot":  # a third of all conversations are copies, most share the first turn
        same = talk(rnd, 5)
        for c in range(150):
            rows += [(c, t, *x) for t, x in enumerate(same if c % 3 == 0 else [("user", "hello"), *talk(rnd, 3)])]
    elif kind == "long":  # several bands, shared and not
        base = talk(rnd, 300)
        for c, n in [(0, 300), (1, 300), (2, 64), (3, 128), (4, 129), (5, 65), (6, 300), (7, 190), (13, 300)]:
            turns = base[:n] if c != 7 else base[:100] + talk(rnd, 90)
            rows += [(c, t, *x) for t, x in enumerate(turns)]
    else:  # ties, nulls, repeated rows, gaps, negative ids, a conversation whose source is missing
        rows = [(3, None, "a", "b"), (3, None, None, None), (3, 1, "a", "x"), (3, 1, "a", "x"), (3, 1, "a", "w"), (None, 1, "a", "b"), (-7, 5, "a", "b"), (-5, 9, "a", "c"), (-5, 2, "a", "d"), (10**12 + 1, 0, "u", "v"), (8, 0, "a", "b"), (8, 0, "a", "b"), (8, 0, "a", "b")]
    return rows


@pytest.mark.parametrize("kind", ["mixed", "hot", "long", "odd"])
def test_prefix_nodes(spark, kind):
    rows = conversations(kind)
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, size long").repartition(4)
    got = prefix_trie.prefix_nodes(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_double_array_leads_back_and_holds_all_paths():
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(0, 9, 500)
    codes = np.where(np.arange(9) < lengths[:, None], rnd.integers(1, 300, (500, 9)) ** 2 % 97 + 1, 0)
    base, check = prefix_trie.packed(codes, lengths)
    seen = {}
    for row, n in zip(codes, lengths):
        state = 0
        for j in range(n):
            step = base[state] + row[j]
            assert check[step] == state
            assert seen.setdefault(step, tuple(row[: j + 1])) == tuple(row[: j + 1])
            state = step
    assert len(seen) == len({tuple(r[:j]) for r, n in zip(codes, lengths) for j in range(1, n + 1)})
    assert ((check >= 0).sum()) == len(seen)
