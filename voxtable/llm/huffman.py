"""Token ids as canonical, length-limited Huffman codes in blocks that decode alone.

A block is one row: its documents' ids and lengths, the coded bits, and the bit
offset of every LANE-th token. A document lies in one block; a block is closed
once it has BLOCK_TOKENS. The decoder starts at all of those offsets at
once and takes one token from each per step, by a table of 2^LIMIT entries. The
code lengths come from the counts of all ids; they are the file's only header.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import stored
from voxtable.llm.tokens import END_ID, forget, token_table

LIMIT = 20
LANE = 64
BLOCK_TOKENS = 1 << 18
#: Tokens whose places are worked out at one time, a multiple of LANE, and blocks that are decoded together.
STEP_TOKENS, READ_BLOCKS = 1 << 16, 2
BLOCKS = "part int, block int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, lanes binary, bits binary"


def code_lengths(ids: np.ndarray, counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; ids with their counts, both in the ids' order."""
    n = len(ids)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = np.lexsort((ids, counts))
    weights = counts[order].astype(np.float64)
    merged: list[np.ndarray] = []  # for each level, which entries of the sorted list are single ids
    packed = np.empty(0)
    for _ in range(limit):
        both = np.concatenate([weights, packed])
        rank = np.argsort(both, kind="stable")
        merged.append(rank < n)
        both = both[rank]
        packed = both[0 : len(both) // 2 * 2 : 2] + both[1::2][: len(both) // 2]
    lengths = np.zeros(n, np.uint8)
    take = 2 * n - 2
    for single in reversed(merged):
        chosen = int(np.count_nonzero(single[:take]))
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


class Code:
    """Canonical codes: shorter first, then by id. Made from the ids and their lengths alone."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.sizes = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.limit = int(self.sizes.max(initial=1))
        steps = (1 << (self.limit - self.sizes)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(steps)[:-1]]).astype(np.int64) if len(steps) else np.zeros(0, np.int64)
        top = int(ids.max(initial=0)) + 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.ids] = (first >> (self.limit - self.sizes)).astype(np.uint64)
        self.bits[self.ids] = self.sizes
        self.table = np.zeros(1 << self.limit, np.uint64)  # id and size of the code that starts so
        self.table[: int(steps.sum())] = np.repeat(self.ids.astype(np.uint64) << np.uint64(8) | self.sizes.astype(np.uint64), steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The coded bits, and the bit offset of every LANE-th token; worked out STEP_TOKENS at a time."""
        parts = [ids[a : a + STEP_TOKENS] for a in range(0, len(ids), STEP_TOKENS)]
        total = sum(int(self.bits[part].sum()) for part in parts)
        words = np.zeros(total // 64 + 2, np.uint64)
        lanes, done = [np.zeros(0, np.int64)], 0
        for part in parts:
            size = self.bits[part]
            ends = done + np.cumsum(size)
            starts = ends - size
            word, shift = starts >> 6, 64 - (starts & 63) - size  # a negative shift: the code goes on in the next word
            code = self.code[part]
            high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
            at = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[at]] |= np.bitwise_or.reduceat(high, at)  # the part before may have begun the first word
            over = np.flatnonzero(shift < 0)
            words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
            lanes.append(starts[::LANE])
            done = int(ends[-1])
        return words.astype(">u8").tobytes()[: (total + 7) // 8], np.concatenate(lanes).astype("<u4").tobytes()

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """Ids of blocks (n_tokens, lanes, bits), all lanes of all blocks in step."""
        at, total = [], 0
        for _, lanes, bits in blocks:
            at.append(np.frombuffer(lanes, "<u4").astype(np.int64) + 8 * total)
            total += len(bits)
        # a block's last lane may have fewer tokens: it reads on into what follows, and the rest is cut off below
        raw = np.frombuffer(b"".join([*(bits for _, _, bits in blocks), bytes(LANE * 4 + 8)]), np.uint8)
        pos = np.concatenate(at)
        out = np.empty((LANE, len(pos)), np.uint32)
        window = raw[:-3].astype(np.uint32)  # the 32 bits from each byte on
        for k in range(1, 4):
            window = window << np.uint32(8) | raw[k : len(raw) - 3 + k]
        down = 32 - self.limit
        mask = np.int64((1 << self.limit) - 1)
        for step in range(LANE):
            found = self.table[window[pos >> 3].astype(np.int64) >> (down - (pos & 7)) & mask]
            out[step] = found >> np.uint64(8)
            pos += (found & np.uint64(255)).astype(np.int64)
        flat, done, ids = out.T.reshape(-1), 0, []
        for n, lanes, _ in blocks:
            ids.append(flat[LANE * done : LANE * done + n])
            done += len(lanes) // 4
        return ids


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All ids of rows (ids, width), in runs of at most STEP_TOKENS: a batch holds many times that."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for raw, width in zip(batch.column(0), batch.column(1).to_pylist()):
            ids = np.frombuffer(raw.as_py(), f"<u{width}")
            if size + len(ids) > STEP_TOKENS and held:
                yield np.concatenate(held)
                held, size = [], 0
            for at in range(0, len(ids) - STEP_TOKENS, STEP_TOKENS):
                yield ids[at : at + STEP_TOKENS]
            held.append(ids[(len(ids) - 1) // STEP_TOKENS * STEP_TOKENS :] if len(ids) else ids)
            size += len(held[-1])
    if held:
        yield np.concatenate(held)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    total = np.zeros(0, np.int64)
    for ids in _runs(batches):
        found = np.bincount(ids, minlength=len(total))
        found[: len(total)] += total
        total = found
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])


@lru_cache(maxsize=2)
def _code(ids: bytes, lengths: bytes) -> Code:
    return Code(np.frombuffer(ids, np.uint32), np.frombuffer(lengths, np.uint8))


def _write(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents in the order of the rows; first counts the tokens of this part before the block."""
    from pyspark import TaskContext

    forget()
    part, block, first, code = TaskContext.get().partitionId(), 0, 0, _code(*shared.value)
    ids: list[np.ndarray] = []
    docs: list[int] = []

    def row() -> pa.RecordBatch:
        sizes = [len(x) for x in ids]
        bits, lanes = code.encode(np.concatenate(ids))
        values = [[part], [block], [first], [sum(sizes)], [docs], [sizes], [lanes], [bits]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [f.split()[0] for f in BLOCKS.split(", ")])

    held = 0
    for batch in batches:
        for doc_id, raw, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            ids.append(np.frombuffer(raw.as_py(), f"<u{width}"))
            docs.append(doc_id)
            held += len(ids[-1])
            if held >= BLOCK_TOKENS:
                yield row()
                ids, docs, held, block, first = [], [], 0, block + 1, first + held
    if docs:
        yield row()


def write_ids(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write a stored token table (doc_id, n_tokens, width, ids) in the block format, in ascending doc_id order.

    Returns the written blocks and the written header (ids, lengths). Rows with
    equal doc_ids stand in the order of their contents; a null doc_id stands first.
    """
    spark = tokens.sparkSession
    counted = tokens.select("ids", "width").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = sorted((r["id"], r["n"]) for r in counted.collect())  # a row per id of the vocabulary at most
    ids = np.array([i for i, _ in counts], np.uint32)
    made = (ids.tobytes(), code_lengths(ids, np.array([n for _, n in counts], np.int64)).tobytes())
    header = stored(spark.createDataFrame(pa.table({"ids": [made[0]], "lengths": [made[1]]})), "code-header")  # by Arrow: a list of rows takes workers of its own
    order = tokens.select("doc_id", "ids", "width").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return stored(order.mapInArrow(partial(_write, spark.sparkContext.broadcast(made)), BLOCKS), "code-blocks"), header


def _read(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    code = _code(*shared.value)
    names = ["part", "first", "n_tokens", "doc_ids", "doc_tokens", "lanes", "bits"]
    for batch in batches:
        for at in range(0, batch.num_rows, READ_BLOCKS):
            part, first, total, docs, sizes, lanes, bits = (batch.column(batch.schema.get_field_index(n)).slice(at, READ_BLOCKS).to_pylist() for n in names)
            decoded = code.decode(list(zip(total, lanes, bits)))
            before = [f + np.cumsum([0, *s])[:-1] for f, s in zip(first, sizes)]
            rows = [
                pa.array(np.repeat(part, [len(d) for d in docs]), pa.int32()),
                pa.array([d for some in docs for d in some], pa.int64()),
                pa.array(np.concatenate(before), pa.int64()),
                pa.array([n for some in sizes for n in some], pa.int64()),
                pa.array([x.tobytes() for ids, some in zip(decoded, sizes) for x in np.split(ids, np.cumsum(some)[:-1])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(rows, ["part", "doc_id", "before", "n_tokens", "ids"])


def read_ids(blocks: DataFrame, header: DataFrame) -> DataFrame:
    """Decode a written file: doc_id, start (ids of all documents before it), n_tokens, ids."""
    spark, head = blocks.sparkSession, header.first()
    shared = spark.sparkContext.broadcast((bytes(head["ids"]), bytes(head["lengths"])))
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row per written task
    bases = np.cumsum([0, *[n for _, n in totals]])[:-1]
    base = spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in totals], pa.int32()), "base": pa.array(bases, pa.int64())}))
    rows = blocks.mapInArrow(partial(_read, shared), "part int, doc_id long, before long, n_tokens long, ids binary")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def code_corpus(docs: DataFrame, path: str | None = None, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Encode docs, write the file, read it back: one row per row of docs, as read_ids gives them.

    Null and empty texts are the end id alone. Repeated rows are each written.
    Other columns are not read. No rows: an empty file and no rows.
    """
    return read_ids(*write_ids(stored(token_table(docs, path, end_id, text), "token-ids")))
