"""SimHash near-duplicates: equal or close 64-bit fingerprints meet on the points halfway between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from voxtable.llm.common import chunks, over_batches, stored, text_column
from voxtable.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2


def _shingles(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The lower-cased text's shingles, repeats included, in lists of bounded length."""
    tail: list[bytes] = []
    full = False
    for part in chunks(text):
        words = tail + part.lower().split()
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends.tolist()]
        if len(words) >= size:
            full = True
            yield [joined[a : b - 1] for a, b in zip(starts, starts[size:])]
            tail = words[len(words) - size + 1 :]
        else:
            tail = words
    if tail and not full:
        yield [b" ".join(tail)]


def fingerprint(text: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64 values; no words give 0."""
    digest = xxhash.xxh64_intdigest
    total, ones = 0, np.zeros(64, np.int64)
    for some in _shingles(text, size):
        hashes = np.fromiter((digest(s, seed) for s in some), np.uint64, len(some))
        for k in range(0, len(hashes), 4096):
            bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint16)
        total += len(some)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(size: int, seed: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    found = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) per row of docs."""
    return docs.select(F.col("doc_id").cast("long"), text_column(text).alias("t")).mapInArrow(over_batches(partial(_fingerprints, size, seed)), "doc_id long, fp long")


def _ball(radius: int) -> list[int]:
    masks = [sum(1 << i for i in flips) for k in range(radius + 1) for flips in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that leave the same components as all pairs within the radius.

    Every fingerprint is sent to all points within half the radius (65 for a radius
    of 2). Two fingerprints are within the radius exactly if they share a point, and
    all that meet in one point are within the radius of each other. So a point links
    each to the next in order, not all pairs; and as fps are distinct, no point has
    more members than the ball has points.
    """
    if radius % 2:
        raise ValueError("the radius must be even: both halves go to the same points")
    around = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in _ball(radius // 2)])).alias("m"))
    at = around.select(F.col("fp").bitwiseXOR(F.col("m")).alias("point"), F.col("fp").alias("b"))
    met = at.withColumn("a", F.lag("b").over(Window.partitionBy("point").orderBy("b"))).filter("a IS NOT NULL").select("a", "b").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_groups(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over links).

    Null and empty texts have the fingerprint 0, linked like any other. Repeated
    rows are each listed. Null ids come first only if a component has no other.
    No rows give no rows; other columns of docs are not read.
    """
    rows = stored(fingerprints(docs, text, size), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    roots = components(links(distinct, radius))
    placed = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "placed-fps")
    smallest = stored(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    named = stored(placed.join(smallest, "root").select("fp", "component_id"), "named-fps")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
