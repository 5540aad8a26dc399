"""Best-fit packing planned on the histogram of piece lengths; documents then take the planned slots by rank.

The plan works on counts: a step places many pieces of one length into many
sequences that have the same room left. Its size depends on the sequence length
only, so it is made on the driver from at most `capacity` counts and broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from voxtable.llm.common import slices, stored, text_column
from voxtable.llm.tokens import END_ID, VOCABULARY, document_ids, wide

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, width int, ids binary"


def _cut(path: str, end_id: int, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each document, numbered within their length in the order in which this task meets them."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    names = [f.split()[0] for f in PIECES.split(", ")]
    for batch in slices(batches):
        rows: list[tuple] = []
        coded, width = document_ids(path, end_id, batch.column(1).to_pylist())
        for doc_id, ids in zip(batch.column(0).to_pylist(), coded):
            for piece, start in enumerate(range(0, len(ids), width * capacity)):
                some = ids[start : start + width * capacity]
                rank = seen.get(n := len(some) // width, 0)
                seen[n] = rank + 1
                rows.append((doc_id, piece, start // width, n, zlib.crc32(wide(some, width)), part, rank, width, some))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Stored pieces of at most capacity tokens; only documents longer than that are cut."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long"), text_column(text)).mapInArrow(partial(_cut, path, end_id, capacity), PIECES)
    return stored(rows, "pieces")


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: steps (length, first rank, last rank + 1, first sequence, pieces per sequence, offset).

    A step gives ranks to sequences in order, pieces-per-sequence at a time, each
    sequence's pieces one behind the other from the offset on.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many) with that room
    opened = 0

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            room.setdefault(left, []).append((first, many))

    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            fits = min((r for r in room if r >= length), default=None)
            each = (capacity if fits is None else fits) // length
            if fits is None:
                first, there = opened, -(-todo // each)
                opened += there
                left = capacity
            else:
                first, there = room[fits].pop()
                left = fits
                if not room[fits]:
                    del room[fits]
            full = min(there, todo // each)
            if full:
                steps.append((length, rank, rank + full * each, first, each, capacity - left))
                put(left - each * length, first, full)
            rank, todo, rest = rank + full * each, todo - full * each, there - full
            if rest and todo:  # fewer pieces are left than one more sequence takes
                steps.append((length, rank, rank + todo, first + full, todo, capacity - left))
                put(left - todo * length, first + full, 1)
                full, rest, todo = full + 1, rest - 1, 0
            put(left, first + full, rest)
    return steps


def place(stored_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; all columns of the pieces stay but for part and rank."""
    spark = stored_pieces.sparkSession
    per_task = stored(stored_pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan_best_fit(counts, capacity)
    plan = spark.createDataFrame(steps, "length long, first_rank long, end_rank long, first_sequence long, each long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-ranks")
    # a row per task and length: it grows with the input, so it is merged, never broadcast
    ranked = stored_pieces.join(offsets.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")) & (F.col("length") == F.col("l"))
    slots = ranked.join(F.broadcast(plan.withColumnRenamed("length", "l")), inside)
    nth = F.col("rank") - F.col("first_rank")
    own = [c for c in stored_pieces.columns if c not in ("part", "rank")]
    return slots.select(*own, (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, text: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ids the ids themselves
    (width bytes each).

    Null and empty texts are a piece with the end id alone. Repeated rows and ids
    are packed as often as they come. Other columns are not read. No rows: no rows.
    """
    found = pieces(docs, path, end_id, capacity, text)
    return place(found if ids else found.drop("width", "ids"), capacity)
