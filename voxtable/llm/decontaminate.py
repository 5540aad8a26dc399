"""Benchmark decontamination: windows of benchmark words as a broadcast hash set, looked up in every document."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import chunks, over_batches, stored, text_column

WINDOW = 10
#: Bytes of windows that one broadcast set may hold; a larger benchmark goes over the documents in several sets.
SET_BYTES = 32 << 20
#: A to Z lower-cased; digits, letters and all bytes from 0x80 are words; the rest is space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def _item_windows(n: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    items, windows = [], []
    for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        words = text.as_py().translate(FOLD).split()
        found = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else ()
        windows += found
        items += [item] * len(found)
    return pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["window", "item"])


class WindowSet:
    """Windows of one broadcast set: a sorted array of rolling hashes to test, and the words themselves to verify."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.items = windows
        split = [w.split(b" ") for w in windows]
        self.word_ids = {w: i + 1 for i, w in enumerate(sorted({x for s in split for x in s}))}
        by_size: dict[int, list[list[int]]] = {}
        for s in split:
            by_size.setdefault(len(s), []).append([self.word_ids[x] for x in s])
        self.hashes = {n: np.unique(self._rolled(np.array(rows, np.uint64).reshape(len(rows), n).ravel(), n)[::n]) for n, rows in by_size.items()}

    @staticmethod
    def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            total = total * BASE + ids[k : len(ids) - n + 1 + k]
        return total ^ (total >> np.uint64(29))

    def hits(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, [first, last) of each occurring window, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        most = max(self.hashes, default=1)
        done, tail = 0, []
        for part in chunks(text.translate(FOLD)):
            words = tail + part.split()
            get = self.word_ids.get
            ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
            for n, known in self.hashes.items():
                if np.count_nonzero(ids) < n:
                    continue
                rolled = self._rolled(ids, n)
                at = np.searchsorted(known, rolled)
                at[at == len(known)] = 0
                for p in np.flatnonzero(known[at] == rolled).tolist():
                    if (got := self.items.get(b" ".join(words[p : p + n]))) is not None:
                        spans.append((done + p, done + p + n))
                        items.update(got)
            keep = min(len(words), most - 1)
            done += len(words) - keep
            tail = words[len(words) - keep :]
        return done + len(tail), np.array(sorted(set(spans)), np.int64).reshape(-1, 2), items


def _covered(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted spans, joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in spans.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds a set's hits to the state columns; the text goes on to the next set."""
    windows: WindowSet = _opened(shared)
    counts, spans, items = [], [], []
    for text, old, had in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
        n, now, got = windows.hits(text.as_py())
        before = np.frombuffer(old, np.int64).reshape(-1, 2)
        merged = np.array(_covered(np.unique(np.concatenate([before, now]), axis=0)) if len(before) or len(now) else [], np.int64)
        counts.append(n)
        spans.append(merged.tobytes())
        items.append(sorted(got.union(had)))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "t", "n_words", "spans", "items"])


_SETS: dict[str, WindowSet] = {}


def _opened(shared) -> WindowSet:
    """The broadcast's set, built once in each Python worker; only the latest stays."""
    if shared.value[0] not in _SETS:
        _SETS.clear()
        _SETS[shared.value[0]] = WindowSet(dict(zip(*shared.value[1:])))
    return _SETS[shared.value[0]]


def window_sets(benchmark: DataFrame, n: int = WINDOW, text: str = "text", set_bytes: int = SET_BYTES) -> Iterator:
    """Broadcasts of (key, windows, items of each), each of about set_bytes, until all windows are out."""
    spark, name = benchmark.sparkSession, uuid.uuid4().hex  # workers keep a set by this name
    rows = benchmark.select(F.col("item_id").cast("string"), text_column(text).alias("t")).mapInArrow(over_batches(partial(_item_windows, n)), "window binary, item string")
    by_window = stored(rows.groupBy("window").agg(F.collect_set("item").alias("items")), "benchmark-windows")
    weight = F.length("window") + 120 + 16 * F.size("items")
    total = by_window.agg(F.sum(weight).alias("b")).first()["b"] or 0
    sets = int(total // set_bytes) + 1
    for k in range(sets):
        part = by_window.filter(F.pmod(F.xxhash64("window"), F.lit(sets)) == k).collect() if total else []
        if part:
            yield spark.sparkContext.broadcast((f"{name}-{k}", [bytes(r["window"]) for r in part], [r["items"] for r in part]))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, spans (array of [first, last) word numbers), items (array).

    A document word is hit if it lies in an occurrence of n consecutive words of an
    item, or of a whole item of fewer words. Null has no words, in documents and
    items alike; an item without words has no window. An item whose id is null
    counts by its windows but is not named. Repeated items and rows are each
    handled as they come. No items: nothing is hit. No rows give no rows.
    """
    state = docs.select("doc_id", text_column(text).alias("t"), F.lit(0).cast("long").alias("n_words"), F.lit(bytearray()).alias("spans"), F.array().cast("array<string>").alias("items"))
    kind = state.select(F.col("doc_id").cast("long"), "t", "n_words", "spans", "items").schema
    state = state.withColumn("doc_id", F.col("doc_id").cast("long"))
    done = False
    for shared in window_sets(benchmark, n, text, set_bytes):
        state = (stored(state, "scanned") if done else state).mapInArrow(over_batches(partial(_scan, shared)), kind)
        done = True
    if not done:
        empty = docs.sparkSession.sparkContext.broadcast(("none", [], []))
        state = state.mapInArrow(over_batches(partial(_scan, empty)), kind)
    return state.mapInArrow(over_batches(_told), "doc_id long, n_words long, n_hit long, spans array<array<long>>, items array<string>")


def _told(batch: pa.RecordBatch) -> pa.RecordBatch:
    spans = [np.frombuffer(s, np.int64).reshape(-1, 2) for s in batch.column(3).to_pylist()]
    hit = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hit, pa.int64()), pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64()))), batch.column(4)], ["doc_id", "n_words", "n_hit", "spans", "items"])


def items_digest(items: str = "items"):
    """sha256 of the sorted item ids, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def _clean(shared, at: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    windows = _opened(shared)
    return batch.filter(pa.array([not len(windows.hits((t or "").encode())[1]) for t in batch.column(at).to_pylist()]))


def _marked(shared, at: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds a set's spans to those in the last column."""
    windows, last = _opened(shared), batch.num_columns - 1
    now = [windows.hits((t or "").encode())[1].tobytes() for t in batch.column(at).to_pylist()]
    return batch.set_column(last, batch.schema.field(last), pa.array([a + b for a, b in zip(batch.column(last).to_pylist(), now)], pa.binary()))


def _cut(at: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    spans = [np.frombuffer(s, np.int64).reshape(-1, 2) for s in batch.column(batch.num_columns - 1).to_pylist()]
    new = [cut_words(t, _covered(np.unique(s, axis=0))) if len(s) else t for t, s in zip(batch.column(at).to_pylist(), spans)]
    arrays = [pa.array(new, c.type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(batch.schema)[:-1]))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words; what stands between two words of a run goes with them."""
    raw = text.encode()
    words = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : words[a][0]])
        last = words[b - 1][1]
    return b"".join([*out, raw[last:]]).decode(errors="ignore")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, mode: str = "documents", text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """docs without the contaminated documents (mode "documents") or without the hit words (mode "spans").

    All columns stay as they are, whatever their names; no row is shuffled. Words
    are cut once, after all sets have looked, so the set size changes nothing.
    """
    at = docs.columns.index(text)
    if mode == "documents":
        out = docs
        for shared in window_sets(benchmark, n, "text", set_bytes):
            out = out.mapInArrow(over_batches(partial(_clean, shared, at)), docs.schema)
        return out
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("spans", F.lit(bytearray()))
    kind = out.schema
    for shared in window_sets(benchmark, n, "text", set_bytes):
        out = out.mapInArrow(over_batches(partial(_marked, shared, at)), kind)
    return out.mapInArrow(over_batches(partial(_cut, at)), type(kind)(kind.fields[:-1])).toDF(*docs.columns)
