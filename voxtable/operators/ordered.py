"""Order-sensitive building blocks that hold when one key owns much of the table.

`neighbours` gives lag, lead and running totals. Keys above a million rows never
go to one task whole: their rows are keyed by (key, block of the ordinal), the edge
rows of every block are aggregated map-side, and one row per block is windowed.

`ordered_fold` runs a small state machine over the rows of each key in order.
Rows stream through sorted partitions, so no group is ever held in memory. Keys
above `block_rows` are cut into range partitions that run in parallel and are
re-run until every block starts from the state its predecessor ended in. That
fixed point is the sequential answer, whatever the state machine does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtable.session import cut_lineage

BLOCK_ROWS = 1 << 16
HOT_ROWS = 1 << 20


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    *,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    total_before: dict[str, Column | str] | None = None,
    max_before: dict[str, Column | str] | None = None,
    hot: "HotKeys | None" = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns taken from the previous/next row, and running totals/maxima of all earlier rows.

    `ordinal` is an integer unique within the key. Totals and maxima exclude the
    current row (0 and null when there is none before). Keys of ordinary size use one
    window each; the rows of hot keys are windowed per block of the ordinal, so a
    block holds at most `block_rows` rows, and one carried row per block links them.
    """
    totals = {n: F.expr(c) if isinstance(c, str) else c for n, c in (total_before or {}).items()}
    maxima = {n: F.expr(c) if isinstance(c, str) else c for n, c in (max_before or {}).items()}
    spec = (list(keys), ordinal, lag or {}, lead or {}, totals, maxima)
    hot = _own_hot(df, keys, hot, HOT_ROWS)
    if hot.keys is None:
        return _key_windows(df, *spec)
    cold = _key_windows(df.join(hot.keys, hot.keys.columns, "left_anti"), *spec)
    rows = cut_lineage(df.join(hot.keys, hot.keys.columns, "left_semi"))
    return cold.unionByName(_block_windows(rows, *spec, block_rows))


def _key_windows(df, keys, ordinal, lag, lead, totals, maxima) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ordinal)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        *[F.lag(c).over(w).alias(n) for n, c in lag.items()],
        *[F.lead(c).over(w).alias(n) for n, c in lead.items()],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in totals.items()],
        *[F.max(c).over(before).alias(n) for n, c in maxima.items()],
    )


def _block_windows(df, keys, ordinal, lag, lead, totals, maxima, block_rows) -> DataFrame:
    names = list(df.columns)
    for n, c in totals.items():
        df = df.withColumn(f"_t_{n}", c)
    for n, c in maxima.items():
        df = df.withColumn(f"_m_{n}", c)
    rows = df.withColumn("_blk", F.floor(F.col(ordinal) / block_rows)).repartition(*keys, "_blk")

    edges = [F.lit(1).alias("_one")]
    if lag:
        edges.append(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lag.items()]), ordinal).alias("_last"))
    if lead:
        edges.append(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in lead.items()]), ordinal).alias("_first"))
    edges += [F.sum(f"_t_{n}").alias(f"_bt_{n}") for n in totals]
    edges += [F.max(f"_m_{n}").alias(f"_bm_{n}") for n in maxima]
    over_key = Window.partitionBy(*keys).orderBy("_blk")
    earlier = over_key.rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_blk").agg(*edges).select(
        *keys,
        "_blk",
        *([F.lag("_last").over(over_key).alias("_prev")] if lag else []),
        *([F.lead("_first").over(over_key).alias("_next")] if lead else []),
        *[F.coalesce(F.sum(f"_bt_{n}").over(earlier), F.lit(0)).alias(f"_bt_{n}") for n in totals],
        *[F.max(f"_bm_{n}").over(earlier).alias(f"_bm_{n}") for n in maxima],
    )
    in_block = Window.partitionBy(*keys, "_blk").orderBy(ordinal)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carry, [*keys, "_blk"])
    out: list[Column] = [F.col(c) for c in names]
    if lag:
        first_in_block = F.row_number().over(in_block) == 1
        out += [
            F.when(first_in_block, F.col(f"_prev.{n}")).otherwise(F.lag(c).over(in_block)).alias(n)
            for n, c in lag.items()
        ]
    if lead:
        last_in_block = F.lead(F.lit(1)).over(in_block).isNull()
        out += [
            F.when(last_in_block, F.col(f"_next.{n}")).otherwise(F.lead(c).over(in_block)).alias(n)
            for n, c in lead.items()
        ]
    out += [
        (F.col(f"_bt_{n}") + F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0))).alias(n) for n in totals
    ]
    out += [F.greatest(F.col(f"_bm_{n}"), F.max(f"_m_{n}").over(before)).alias(n) for n in maxima]
    return joined.select(*out)


State = list
Step = Callable[[State, dict], tuple[State, Iterable[tuple]]]


class _Row:
    """One row of a batch at a time, as steps read it; a column becomes Python values when it is first asked for."""

    def __init__(self, batch: pa.RecordBatch):
        self._batch, self._values, self.at = batch, {}, 0

    def __getitem__(self, name: str):
        values = self._values.get(name)
        if values is None:
            values = self._values[name] = self._batch.column(name).to_pylist()
        return values[self.at]


def _fold_batches(keys, carry, step, init, finish, schema, ends_only):
    """Build the mapInArrow function: one pass over sorted rows, state reset at each (key, block).

    Keys and carried columns go out as Arrow values of the rows they belong to; only what a step reads becomes Python values.
    """
    arrow = to_arrow_schema(schema)
    along = [*keys, *carry]

    def table(rows: list[tuple], fields) -> list[pa.Array]:
        columns = list(zip(*rows)) if rows else [[] for _ in fields]
        return [pa.array(list(c), type=f.type) for c, f in zip(columns, fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: State = []
        closes = False
        ended: list[tuple] = []  # whole rows: ends of blocks, and what finish makes of them

        def close() -> None:
            if current is None:
                return
            if ends_only:
                ended.append((*current, json.dumps(state)))
            elif closes and finish is not None:
                ended.extend((*current[: len(keys)], *r) for r in finish(state))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(table(ended, arrow), schema=arrow)
            ended.clear()
            return made

        for batch in batches:
            row = _Row(batch)
            groups = list(zip(*[batch.column(c).to_pylist() for c in (*keys, "_blk")]))
            places: list[int] = []
            out: list[tuple] = []
            for i, group in enumerate(groups):
                row.at = i
                if group != current:
                    close()
                    current = group
                    entry = row["_entry"]
                    state = json.loads(entry) if entry is not None else json.loads(init)
                    closes = row["_closes"]
                state, emitted = step(state, row)
                if not ends_only:
                    for r in emitted:
                        places.append(i)
                        out.append(r)
            if places:
                taken = pa.array(places, pa.int32())
                carried = [c if c.type == f.type else c.cast(f.type) for c, f in zip((batch.column(n).take(taken) for n in along), arrow)]
                yield pa.RecordBatch.from_arrays([*carried, *table(out, list(arrow)[len(along) :])], schema=arrow)
            if len(ended) >= 10_000:
                yield flush()
        close()
        if ended:
            yield flush()

    return run


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def _run(df, keys, order, carry, step, init, finish, schema, ends_only=False) -> DataFrame:
    ordered = df.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", *order)
    return ordered.mapInArrow(_fold_batches(list(keys), list(carry), step, init, finish, schema, ends_only), schema)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    init: State,
    step: Step,
    out: str,
    *,
    finish: Callable[[State], Iterable[tuple]] | None = None,
    carry: Sequence[str] = (),
    hot: "HotKeys | None" = None,
    block_rows: int = HOT_ROWS,
) -> DataFrame:
    """Stream the rows of each key in `order` through `step(state, row) -> (state, emitted rows)`.

    `out` is the DDL of the emitted columns; the keys are put in front. `finish`
    turns the last state of a key into rows. `carry` names columns of the current row
    that go out in front of what `step` emits for it. `order` must be total within a key.
    `hot` may give the keys above `block_rows`, found once on the table everything was cut from
    (captions are never more than words); otherwise one counting job finds them.
    """
    fields = _key_fields(df, keys)
    along = [df.schema[c] for c in carry]
    schema = T.StructType(fields + along + (T._parse_datatype_string(out).fields if out else []))
    start = json.dumps(init)
    whole = df.withColumns(
        {"_blk": F.lit(0), "_entry": F.lit(None).cast("string"), "_closes": F.lit(True)}
    )
    hot = _own_hot(df, keys, hot, block_rows)
    if hot.keys is None:
        return _run(whole, keys, order, carry, step, start, finish, schema)

    n_rows, hot = hot.rows, hot.keys
    cold = _run(whole.join(hot, hot.columns, "left_anti"), keys, order, carry, step, start, finish, schema)
    parts = max(2, -(-n_rows // block_rows))
    blocks = cut_lineage(
        df.join(hot, hot.columns, "left_semi")
        .repartitionByRange(parts, *keys, *order)
        .withColumn("_blk", F.spark_partition_id())
    )
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    entries = blocks.select(*keys, "_blk").distinct().select(
        *keys,
        "_blk",
        F.lit(None).cast("string").alias("_entry"),
        F.lead("_blk").over(by_block).isNull().alias("_closes"),
        F.lit(True).alias("_dirty"),
        F.lit(None).cast("string").alias("_exit"),
    )
    entries = cut_lineage(entries)
    ends = T.StructType(fields + T._parse_datatype_string("_blk int, _new string").fields)
    while True:
        dirty = entries.filter("_dirty").drop("_dirty", "_exit")
        exits = _run(blocks.join(dirty, [*keys, "_blk"]), keys, order, (), step, start, None, ends, ends_only=True)
        merged = entries.drop("_dirty").join(exits, [*keys, "_blk"], "left").withColumn(
            "_exit", F.coalesce("_new", "_exit")
        )
        entries = cut_lineage(
            merged.withColumn("_seen", F.lag("_exit").over(by_block)).select(
                *keys,
                "_blk",
                F.col("_seen").alias("_entry"),
                "_closes",
                (~F.col("_seen").eqNullSafe(F.col("_entry"))).alias("_dirty"),
                "_exit",
            )
        )
        if entries.filter("_dirty").isEmpty():
            break
    final = blocks.join(entries.drop("_dirty", "_exit"), [*keys, "_blk"])
    return cold.unionByName(_run(final, keys, order, carry, step, start, finish, schema))


class HotKeys(NamedTuple):
    """Keys too large for one task: their table (None when there are none) and their rows in all."""

    keys: DataFrame | None
    rows: int


def _own_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys | None, block_rows: int) -> HotKeys:
    """Hot keys to go by: those given, on the columns that they share with keys, or else counted here.

    A table keyed by video alone also serves rows keyed by (video, group): all rows
    of a large video then take the split path, whichever group they are in.
    """
    shared = [k for k in keys if hot is not None and hot.keys is not None and k in hot.keys.columns]
    if hot is None or (hot.keys is not None and not shared):
        hot = find_hot(df, keys, block_rows)
        shared = list(keys)
    return hot if hot.keys is None else HotKeys(hot.keys.select(*shared).distinct(), hot.rows)


def find_hot(df: DataFrame, keys: Sequence[str], block_rows: int = HOT_ROWS, rows: Column | None = None) -> HotKeys:
    """One counting job with map-side partial sums; only its totals reach the driver. `rows` tells how many rows a row stands for."""
    large = df.groupBy(*keys).agg((F.count("*") if rows is None else F.sum(rows)).alias("n")).filter(F.col("n") > block_rows)
    total = large.agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
    return HotKeys(large if total["keys"] else None, int(total["rows"] or 0))


def dense_ids(df: DataFrame, keys: Sequence[str], ordinal: str, alias: str, hot: HotKeys | None = None) -> DataFrame:
    """0-based position of every row within its key by `ordinal`; a hot key is numbered block by block."""
    return neighbours(df, keys, ordinal, total_before={alias: F.lit(1).cast("bigint")}, hot=hot)


def first_per(df: DataFrame, keys: Sequence[str], *ordinal: str | Column) -> DataFrame:
    """First row per key by `ordinal`.

    `row_number() = 1` lets Spark keep one row per key in every map task before
    the shuffle (window group limit), so a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*ordinal)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], k: int, *ordinal: str | Column, rank: str = "rank_no") -> DataFrame:
    """First `k` rows per key by `ordinal`, pruned to k per map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*ordinal)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
