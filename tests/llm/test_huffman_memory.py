"""F1 of round 3: op2_huffman's workers take room for a step's tokens, not for a batch's, and keep no encoder they are done with."""

import tracemalloc
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa

from voxtable.llm import huffman, tokens

MANY = 1 << 22


def peak(fn):
    """What fn gives, and the most bytes it held at a time."""
    tracemalloc.start()
    try:
        return fn(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def some_ids(n, dtype="<u2"):
    return (np.random.default_rng(5).pareto(1.0, n) * 20).clip(0, 4999).astype(dtype)


def test_encoding_takes_little_more_than_the_ids():
    ids = some_ids(MANY)
    code = huffman.Code(np.arange(5000, dtype=np.uint32), huffman.code_lengths(np.arange(5000, dtype=np.uint32), 1 + np.bincount(ids, minlength=5000)))
    (bits, lanes), most = peak(lambda: code.encode(ids))
    assert most < 6 * ids.nbytes  # 8 bytes a token for each of a dozen arrays before
    assert (code.decode([(len(ids), lanes, bits)])[0] == ids).all()
    assert np.frombuffer(lanes, "<u4")[:: MANY // 256].tolist() == np.concatenate([[0], np.cumsum(code.bits[ids])])[:-1][:: huffman.LANE * MANY // 256].tolist()


def test_parts_of_an_encoding_meet_at_any_bit():
    step = huffman.STEP_TOKENS
    for n in (0, 1, step - 1, step, step + 1, 3 * step, 3 * step + 65):
        ids = some_ids(n)
        code = huffman.Code(np.arange(5000, dtype=np.uint32), huffman.code_lengths(np.arange(5000, dtype=np.uint32), 1 + np.bincount(ids, minlength=5000)))
        bits, lanes = code.encode(ids)
        size, codes = code.bits[ids], code.code[ids]
        want = "".join(format(int(c), f"0{s}b") for c, s in zip(codes, size))
        assert len(bits) == (len(want) + 7) // 8 and np.unpackbits(np.frombuffer(bits, np.uint8))[: len(want)].tobytes() == bytes(map(int, want))
        assert len(lanes) == 4 * (-(-n // huffman.LANE))


def test_counting_takes_little_more_than_a_batch():
    rows = [(some_ids(n, f"<u{w}"), w) for n, w in ((MANY, 2), (0, 2), (1, 2), (MANY // 2, 4), (0, 4), (70_000, 4), (5, 2))]
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tobytes() for ids, _ in rows], pa.binary()), pa.array([w for _, w in rows], pa.int32())], ["ids", "width"])
    found, most = peak(lambda: list(huffman._count_ids(iter([batch, batch.slice(3)]))))
    assert most < 2 * batch.nbytes  # a long a token before
    want = sum(np.bincount(ids, minlength=5000) for ids, _ in [*rows, *rows[3:]])
    assert found[0].column(0).to_pylist() == np.flatnonzero(want).tolist() and found[0].column(1).to_pylist() == want[want > 0].tolist()


def test_later_stages_forget_the_encoder():
    path = public_tokenizers.path(tokens.VOCABULARY)
    for later in (huffman._count_ids, partial(huffman._read, type("Shared", (), {"value": (np.arange(2, dtype=np.uint32).tobytes(), b"\1\1")})())):
        assert tokens.document_ids(path, None, [b"some words"])[0][0] and tokens.encoder.cache_info().currsize
        list(later(iter([])))
        assert not tokens.encoder.cache_info().currsize
