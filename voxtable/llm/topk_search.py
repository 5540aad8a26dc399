"""Exact top-k by inner product: vectors in order of length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Components become integers, so scores are exact. The longest vectors, a bounded
set, give each query a score that its k best are known to reach. Everything else
is dealt in blocks of vectors of like length against blocks of queries of like
reach: a block of vectors meets those queries alone whose length times the
block's length can get there. Inside a pair of blocks vectors are tried from the
longest on. The rotation puts most of a vector's length into the first
coordinates; their partial product plus the product of the two rests bounds the
score, and only pairs whose bound gets there are worked out in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from voxtable.llm.common import over_batches, stored

K, QUERY_EVERY, SCALE = 20, 20, 64
#: Length steps; vectors and queries of a block at 64 components (fewer of longer vectors); vectors tried at one time.
STEPS, BLOCK, QUERY_BLOCK, SPAN = 16, 8192, 16384, 1024
#: Bytes of the longest vectors that every query meets first.
HEAD_BYTES = 1 << 20
#: Squared lengths from here on might give scores beyond 64 bits.
MOST_SQUARE = 1 << 62
VECTOR = "vec_id long, v binary, n2 long"
LOW = -(1 << 63)


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """vec_id, v (int32 components) and n2 of the rows that take part."""
    column = batch.column(1)
    offsets = np.asarray(column.offsets)
    flat = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(SCALE * flat)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    ids, vectors, squares, keep = batch.column(0), [], [], []
    for i in np.flatnonzero(there & (np.diff(offsets) > 0)).tolist():
        v = flat[offsets[i] : offsets[i + 1]]
        if np.isfinite(v).all() and float(v @ v) < MOST_SQUARE * (1 - 1e-9):
            keep.append(i)
            vectors.append(v.astype("<i4").tobytes())
            whole = v.astype(np.int64)
            squares.append(int(whole @ whole))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(vectors, pa.binary()), pa.array(squares, pa.int64())], ["vec_id", "v", "n2"])


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """row (a key), vec_id, v, n2 of the vectors that take part, stored.

    Null and empty vectors, those with a null or non-finite component and those whose
    squared length comes near 2^62 take no part.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(over_batches(_whole), VECTOR)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(vectors, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of int32 components, short ones filled up with zeros."""
    out = np.zeros((len(vectors), dim), kind)
    for i, v in enumerate(vectors):
        v = np.frombuffer(v, "<i4")
        out[i, : len(v)] = v
    return out


def _gram(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dim, dim))
    for batch in batches:
        for at in range(0, batch.num_rows, SPAN):
            m = matrix(batch.column(0).slice(at, SPAN).to_pylist(), dim)
            total += m.T @ m
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first: the eigenvectors of their dim x dim product sums, made by Spark."""
    rows = vectors.select("v").mapInArrow(partial(_gram, dim), "i int, sums array<double>")
    summed = rows.groupBy("i").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(dim)]).alias("sums")).collect()
    gram = np.zeros((dim, dim))
    for r in summed:
        gram[r.i] = r.sums
    return np.ascontiguousarray(np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1])


def products(q: np.ndarray, c: np.ndarray, longest: float) -> np.ndarray:
    """Exact integer products: in doubles while lengths keep all sums under 2^53."""
    if longest < 1 << 53:
        return (q @ c.T).astype(np.int64)
    return np.einsum("ij,kj->ik", q.astype(np.int64), c.astype(np.int64))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= cut)
        return among[np.lexsort((ids[among], -scores[among]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Block:
    """Vectors of a block, longest first, with rotated coordinates and the length of what the first coordinates leave."""

    def __init__(self, table: pa.Table, turn: np.ndarray):
        n2 = table.column("n2").to_numpy()
        order = np.argsort(-n2, kind="stable")
        table = table.take(pa.array(order))
        self.n2, self.row = n2[order], table.column("row").to_numpy()
        ids = table.column("vec_id")
        self.ids = pc.fill_null(ids, (1 << 63) - 1).to_numpy()  # rows without id come last among equals
        self.null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        dim = len(turn)
        self.whole = matrix(table.column("v").to_pylist(), dim)
        self.length = np.sqrt(self.n2.astype(np.float64))
        self.lead = max(1, dim // 4)
        first = self.whole @ turn[:, : self.lead]
        self.first = first
        self.rest = np.sqrt(np.maximum(0.0, self.n2 - np.einsum("ij,ij->i", first, first)))


def search(queries: Block, table: Block, known: np.ndarray, k: int, most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query place, vector places, scores) for each query with something to say: its k best of the block that reach known[q]."""
    dim = table.whole.shape[1]
    for a in range(0, len(queries.row), most):
        part = slice(a, a + most)
        q, own, q_len = queries.whole[part], queries.row[part], queries.length[part]
        reach = known[part].astype(np.float64)
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in own]
        counts = np.zeros(len(own), np.int64)
        for b in range(0, len(table.row), SPAN):
            span = slice(b, b + SPAN)
            c_len = table.length[b]  # the longest of the span
            slack = 1e-9 * q_len * c_len + 1e-6
            on = np.flatnonzero(q_len * c_len + slack >= reach)
            if not len(on):
                if (reach > q_len * c_len + slack).all() and (reach >= 0).all():
                    break  # only shorter vectors follow
                continue
            bound = queries.first[part][on] @ table.first[span].T
            bound += queries.rest[part][on][:, None] * table.rest[span][None, :]
            hit = bound + slack[on][:, None] >= reach[on][:, None]
            hit &= own[on][:, None] != table.row[span][None, :]
            longest = float(q_len.max() * c_len)
            n_hit = int(hit.sum())
            if n_hit * 8 < hit.size and longest < 1 << 53:  # few pairs are left: they alone in full
                i, j = np.nonzero(hit)
                scores = np.einsum("ij,ij->i", q[on[i]], table.whole[span][j]).astype(np.int64) if n_hit * dim < 1 << 24 else products(q[on], table.whole[span], longest)[i, j]
            else:
                i, j = np.nonzero(hit)
                scores = products(q[on], table.whole[span], longest)[i, j]
            good = scores >= known[part][on[i]]
            i, j, scores = i[good], j[good], scores[good]
            starts = np.searchsorted(i, np.arange(len(on) + 1))
            for x in np.flatnonzero(np.diff(starts)).tolist():
                s = slice(starts[x], starts[x + 1])
                y = int(on[x])
                held[y].append((j[s] + b, scores[s]))
                counts[y] += len(scores[s])
                if counts[y] >= k:
                    places, values = (np.concatenate(z) for z in zip(*held[y]))
                    top = best_of(values, table.ids[places], k)
                    held[y], counts[y] = [(places[top], values[top])], len(top)
                    reach[y] = max(reach[y], float(values[top[-1]]))
        for y, found in enumerate(held):
            if found:
                places, values = (np.concatenate(z) for z in zip(*found))
                top = best_of(values, table.ids[places], k)
                yield a + y, places[top], values[top]


def _reach(head: pa.Table, turn: np.ndarray, k: int, steps: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries with known (what their k best reach within the head) and last, the last length step that can get there."""
    table = Block(head, turn)
    tops = np.sqrt(np.array(steps, np.float64))  # the longest vector of each step, descending
    for batch in batches:
        for at in range(0, batch.num_rows, SPAN):
            part = batch.slice(at, SPAN)
            q = matrix(part.column("v").to_pylist(), len(turn))
            n2, own = part.column("n2").to_numpy(), part.column("row").to_numpy()
            length = np.sqrt(n2.astype(np.float64))
            scores = products(q, table.whole, float(length.max() * table.length.max(initial=0)))
            scores[own[:, None] == table.row[None, :]] = LOW
            known = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(own), LOW)
            ends = (length[:, None] * tops[None, :] * (1 + 1e-9) + 1e-6 >= known[:, None].astype(np.float64)).sum(axis=1)
            out = [*part.columns, pa.array(known, pa.int64()), pa.array(np.maximum(ends - 1, 0), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, [*part.schema.names, "known", "last"])


def _pair(turn: np.ndarray, k: int, queries: pa.Table, vectors: pa.Table) -> pa.Table:
    names = ["query_row", "query_id", "vec_id", "score"]
    kinds = [pa.int64()] * 4
    out: list[list] = [[], [], [], []]
    if queries.num_rows and vectors.num_rows:
        order = np.argsort(-queries.column("n2").to_numpy(), kind="stable")
        known = queries.column("known").to_numpy()[order]
        q, c = Block(queries, turn), Block(vectors, turn)
        for y, places, scores in search(q, c, known, k):
            out[0] += [int(q.row[y])] * len(places)
            out[1] += [int(q.ids[y])] * len(places)
            out[2] += [None if c.null[p] else int(c.ids[p]) for p in places]
            out[3] += scores.tolist()
    return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], names=names)


def top_k(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY, head_bytes: int = HEAD_BYTES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each row whose vec_id is divisible by `every`.

    Components are floor(64 x), short vectors count as filled up with zeros. Ties go
    to the smaller vec_id, rows without vec_id last; they are candidates, never
    queries. A row is no candidate of its own, other rows of its id are; repeated ids
    ask once per row. No vectors, or no query: no rows. See integer_vectors() for
    the rows that take no part. Other columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings)
    marks = [i / STEPS for i in range(1, STEPS)]
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.octet_length("v") / 4).alias("dim"), F.max("n2").alias("most"), F.expr(f"approx_percentile(n2, array({','.join(map(str, marks))}), 1000)").alias("cuts")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts["n"]:
        return empty
    dim = int(facts["dim"])
    turn = rotation(vectors, dim)
    fewer = max(1, dim // 64)
    block, query_block = max(64, block // fewer), max(64, QUERY_BLOCK // fewer)

    tops = sorted({int(facts["most"]), *map(int, facts["cuts"])}, reverse=True)  # the longest squared length of each step
    step = F.size(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t > F.col("n2")))  # steps whose longest is longer, but for the own one
    vectors_in = vectors.withColumn("step", F.greatest(step - F.when(F.array_contains(F.array(*[F.lit(t) for t in tops]), F.col("n2")), 0).otherwise(1), F.lit(0)))
    vectors_in = stored(vectors_in, "vectors-in-steps")
    sizes = {r.step: r["count"] for r in vectors_in.groupBy("step").count().collect()}  # a row per step

    head = vectors.orderBy(F.desc("n2"), "row").limit(max(k + 1, head_bytes // (4 * dim))).toArrow()
    asking = vectors.filter(F.col("vec_id") % every == 0)
    asking = asking.mapInArrow(partial(_reach, head, turn, k, tops), f"{VECTOR}, row long, known long, last int")
    asking = stored(asking, "queries")
    reach = {r["last"]: r["count"] for r in asking.groupBy("last").count().collect()}
    if not reach:
        return empty

    # pairs of blocks: (step, part of it) x (last step of the queries, part of those), never a step behind the last one
    pairs = [(s, -(-n // block), last, -(-m // query_block)) for s, n in sizes.items() for last, m in reach.items() if s <= last]
    pairs = F.broadcast(spark.createDataFrame(pairs, "step int, parts int, last int, query_parts int"))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    c = vectors_in.join(pairs, "step").withColumn("part", part("parts")).withColumn("query_part", F.explode(spread("query_parts")))
    q = asking.join(pairs, "last").withColumn("query_part", part("query_parts")).withColumn("part", F.explode(spread("parts")))
    keys = ["step", "part", "last", "query_part"]
    columns = ["vec_id", "v", "n2", "row"]
    q = q.select(*keys, *columns, "known").groupBy(*keys)
    c = c.select(*keys, *columns).groupBy(*keys)
    found = q.cogroup(c).applyInArrow(_pair_of(turn, k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _pair_of(turn: np.ndarray, k: int):
    def pair(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        return _pair(turn, k, queries, vectors)

    return pair
