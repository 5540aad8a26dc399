"""Near copies by the Jaccard similarity of five-word shingles: SimHash links and MinHash bands propose pairs, the shingle sets decide."""

from __future__ import annotations

from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtable.llm import simhash
from voxtable.llm.common import over_batches, stored, text_column
from voxtable.llm.components import components
from voxtable.llm.exact import _bit_set, _maybe, first_row, keep_rows, row_hash
from voxtable.llm.simhash import _shingles

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity s shares a band with the chance 1 - (1 - s**ROWS)**BANDS: 0.989 at 0.8, 0.9998 at 0.85, 0.04 at 0.5.
BANDS, ROWS = 40, 10
SEED = 42
#: Rows whose shingle sets a worker holds at one time.
ROWS_AT_A_TIME = 500
#: MinHash values of which a signature keeps a byte.
SIGNED = 399
#: Buckets go on to all pairs of different components once these are at most so many for each member.
PAIRS_A_MEMBER = 4
#: Rounds of leaders go on while one joins at least one in so many members of buckets.
ROUND_GAIN = 100
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingle_set(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted different XXH64 values of the lower-cased text's shingles; fewer words than a shingle are one."""
    parts = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in some), np.uint64, len(some))) for some in _shingles(text, size)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """One MinHash value for each row of each band."""
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(hashes), 1024):
        part = (hashes[k : k + 1024] >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, (part[:, None] * _TIMES + _PLUS).min(axis=0))
    return least


def bands(hashes: np.ndarray) -> np.ndarray:
    raw = least_hashes(hashes).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One byte of each of the first MinHash values, seven in a long."""
    low = np.zeros((SIGNED // 7, 8), np.uint8)
    low[:, :7] = least_hashes(hashes)[:SIGNED].astype(np.uint8).reshape(-1, 7)
    return low.view("<i8").ravel()


def may_be_alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two signatures agree in as many bytes as sets of the similarity do, less four standard deviations (missed once in 30,000 at the limit)."""
    most, high = F.lit(0x007F7F7F7F7F7F7F), F.lit(0x0080808080808080)

    def equal(x: Column, y: Column) -> Column:
        differ = x.bitwiseXOR(y)  # a byte is zero if its high bit stays clear here
        return F.bit_count(F.bitwise_not((differ.bitwiseAND(most) + most).bitwiseOR(differ)).bitwiseAND(high))

    least = SIGNED * (similarity - 4 * (similarity * (1 - similarity) / SIGNED) ** 0.5)
    return reduce(add, [equal(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(SIGNED // 7)]) >= least


def node_of(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def _banded(size: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingle_set(t.as_py(), size) for t in batch.column(2)]
    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([bands(s) for s in sets])))
    prints = pa.array(np.array([simhash.fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), keys, prints], ["doc_id", "h", "node", "n", "keys", "fp"])


def _sets(size: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingle_set(t.as_py(), size) for t in batch.column(0)]
    flat = np.concatenate(sets).view(np.int64)
    ends = np.cumsum([0, *map(len, sets)])
    signs = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (SIGNED // 7), pa.int32()), pa.array(np.concatenate([signature(s) for s in sets])))
    return pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), signs], ["node", "s", "sign"])


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, ra, rb) whose shingle sets have the similarity."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.filter(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b", "ra", "rb")


def _contracted(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their new components, of buckets that still hold several; the new edges join components, not nodes."""
    step = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "r")
    placed = members.join(step, "root", "left").select("key", "node", "n", F.coalesce("r", "root").alias("root"))
    by_key = Window.partitionBy("key")
    placed = placed.withColumns({"x": F.min("root").over(by_key), "y": F.max("root").over(by_key)})
    return stored(placed.filter("x <> y").drop("x", "y"), "near-placed")


def _close(rows: DataFrame) -> DataFrame:
    """(key, node, n): a bucket for the rows of each component of SimHash links, as op6 finds them."""
    prints = stored(rows.select("fp", "node", "n").distinct(), "near-prints")
    roots = components(simhash.links(stored(prints.select("fp").distinct(), "near-fps"))).toDF("fp", "root")
    linked = prints.join(roots, "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "node", "n")
    return linked.distinct()


def _near(similarity: float, a: str = "n", b: str = "m") -> Column:
    """Sets of these sizes may have the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def near_edges(nodes: DataFrame, sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that leave the components of all pairs that share a bucket and have the similarity.

    Each round tries every member with one leader of its bucket, another one in each
    round; buckets whose members are all of one component are done. When few pairs of
    different components are left, or a round joins hardly any, all of those whose
    signatures allow the similarity are tried.
    """
    edges = nodes.sparkSession.createDataFrame([], "a long, b long")
    left, tried = members.withColumn("root", F.col("node")), 0
    while True:
        of = left.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"))
        size = of.agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m") - F.col("own")).alias("pairs")).first()
        if not size["m"]:
            return edges
        if size["pairs"] > 2 * PAIRS_A_MEMBER * size["m"]:
            leaders = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(tried)).alias("o"), "node", "n", "root")).alias("l"))
            star = left.join(leaders, "key").filter(F.col("root") != F.col("l.root")).withColumn("m", F.col("l.n")).filter(_near(similarity))
            pairs = star.select(F.col("l.node").alias("a"), F.col("node").alias("b"), F.col("l.root").alias("ra"), F.col("root").alias("rb")).distinct()
            found = stored(_alike(pairs, sets, similarity), "near-edges")
            tried += 1
            joined = found.count()
            if joined:
                edges = edges.unionByName(found.select("a", "b"))
                left = _contracted(left, found)
            if joined * ROUND_GAIN >= size["m"]:
                continue
        signed = stored(left.join(sets.select("node", "sign"), "node"), "near-signed")
        other = signed.select("key", F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("ra"), F.col("sign").alias("other"))
        apart = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _near(similarity) & may_be_alike(F.col("sign"), F.col("other"), similarity)
        pairs = signed.withColumnsRenamed({"node": "b", "root": "rb"}).join(other, "key").filter(apart)
        return edges.unionByName(stored(_alike(pairs.select("a", "b", "ra", "rb").distinct(), sets, similarity), "near-edges").select("a", "b"))


def drop_near_copies(docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of near copies, the one with the smallest id; columns unchanged.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least
    `similarity`, as are rows of equal sets, among them all without words. Candidates
    are the rows that SimHash links join and those that share a MinHash band. A null id
    comes last; equal ids go by a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), row_hash(text).alias("h"), text_column(text).alias("t"))
    rows = stored(rows.mapInArrow(over_batches(partial(_banded, size), ROWS_AT_A_TIME), "doc_id long, h long, node long, n long, keys array<long>, fp long"), "near-rows")
    nodes = stored(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(first_row()).alias("first"), F.count("*").alias("rows")), "near-nodes")
    dealt = nodes.filter("n > 0").select(F.explode("keys").alias("key"), "node", "n").unionByName(_close(rows.filter("n > 0")))
    members = stored(dealt.withColumn("m", F.count("*").over(Window.partitionBy("key"))).filter("m > 1").drop("m"), "near-members")
    # of the texts, only those of rows in shared buckets are read again
    wanted = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select("first.doc_id", "first.h"), "near-wanted")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(text).alias("h"), text_column(text).alias("t"))
    again = _maybe(own, _bit_set(wanted, F.struct("doc_id", "h")), F.struct("doc_id", "h")).filter("maybe").select("t")
    sets = stored(again.mapInArrow(over_batches(partial(_sets, size), ROWS_AT_A_TIME), "node long, s array<long>, sign array<long>").groupBy("node").agg(F.first("s").alias("s"), F.first("sign").alias("sign")), "near-sets")
    roots = components(near_edges(nodes, sets, members, similarity))
    placed = stored(nodes.join(roots.withColumnRenamed("root", "r"), "node", "left").select("node", "first", "rows", F.coalesce("r", "node").alias("root")), "near-roots")
    groups = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1").select("root", "first")
    named = stored(placed.select("node", "root").join(groups, "root").select("node", "first"), "near-named")
    return keep_rows(docs, rows.join(named, "node").select("doc_id", "h", (first_row() == F.col("first")).alias("kept")), text)
