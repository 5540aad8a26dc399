"""Chunk starts and spaced picks by hops over Arrow columns.

One rule covers sentences, time chunks and gaps: behind a picked row i the next
pick is the first later row j that is a hard break, or lies `most` rows on, or is
at least `least` rows on with value[j] >= threshold[i]. Where a chunk that starts
at a row ends depends on that row alone, so the next pick of every row of a batch
comes from one sorted search, and a walk touches the picks only.

A key of ordinary size is one sorted stream. A hot key is cut into blocks. Each
block tells in a small table which pick comes first for every state it can be
entered with, and in what state it is left then; one pass over these tables gives
the state that each block is entered with, and the blocks are walked once. The
number of passes does not depend on the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voxtable.operators.ordered import HOT_ROWS, HotKeys, _own_hot, neighbours
from voxtable.session import cut_lineage

#: A value that no threshold asks for, and a threshold that no value reaches.
LOW, HIGH = -(1 << 62), 1 << 62
FAR = 1 << 40
#: Columns that a walk adds.
MADE = {"picked": T.BooleanType(), "pick_no": T.LongType(), "since": T.LongType(), "held": T.LongType()}


class Rule(NamedTuple):
    """How many rows a chunk has at least before the value counts, and at most."""

    least: int = 1
    most: int | None = None


def first_reaching(value: np.ndarray, threshold: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each i the first j >= start[i] with value[j] >= threshold[i]; len(value) where there is none.

    Ascending values take a sorted search; others skip ahead by maxima of 2^k rows.
    """
    n = len(value)
    if n == 0 or (value[1:] >= value[:-1]).all():
        return np.minimum(np.maximum(np.searchsorted(value, threshold, side="left"), start), n)
    tables = [value]
    while 2 << len(tables) - 1 <= n:
        last, half = tables[-1], 1 << len(tables) - 1
        tables.append(np.maximum(last[:-half], last[half:]))
    at = np.minimum(start, n)
    for k in range(len(tables) - 1, -1, -1):
        table = tables[k]
        inside = at + (1 << k) <= n
        low = np.zeros(len(at), bool)
        low[inside] = table[at[inside]] < threshold[inside]
        at = np.where(low, at + (1 << k), at)
    return at


def next_picks(value: np.ndarray, threshold: np.ndarray, hard: np.ndarray, ends: np.ndarray, rule: Rule) -> np.ndarray:
    """The row picked next behind each picked row; ends[i], the end of i's key, where none is."""
    n = len(value)
    at = np.arange(n)
    key = np.searchsorted(np.unique(ends), ends)
    reach = np.minimum(threshold, HIGH)
    there = value[value > LOW]
    least, wide = (int(there.min()), int(there.max()) - int(there.min()) + 2) if len(there) else (0, 1)
    if int(key.max(initial=0)) * wide < HIGH and wide < HIGH // 2:  # one search for all keys: each key's values lie above those before
        lift = key * np.int64(wide)
        level = np.where(value > LOW, value - least, -1) + lift
        wanted = np.clip(reach - least, 0, wide - 1) + lift  # none of the key's values reaches wide - 1
        found = first_reaching(level, wanted, at + rule.least)
    else:
        found = first_reaching(value, reach, at + rule.least)
    if rule.most is not None:
        found = np.minimum(found, at + rule.most)
    breaks = np.where(hard, at, n)
    later = np.concatenate([np.minimum.accumulate(breaks[::-1])[::-1][1:], [n]])
    return np.minimum(np.minimum(found, later), ends)


def first_pick(value: np.ndarray, hard: np.ndarray, state: tuple[int, int], rule: Rule) -> int:
    """The first pick among rows entered with state (threshold, rows since the last pick, 0 before any); len(value) if none."""
    wanted, since = state
    n = len(value)
    if not since:
        return 0
    best = n
    if (forced := np.flatnonzero(hard)).size:
        best = int(forced[0])
    if rule.most is not None:
        best = min(best, max(0, rule.most - since))
    begin = max(0, rule.least - since)
    if begin < best:
        hit = np.flatnonzero(value[begin:best] >= wanted)
        best = begin + int(hit[0]) if hit.size else best
    return best


class _Walk:
    """The walk along a stream of rows sorted by key: state of the current key between batches."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.key: tuple | None = None
        self.state, self.number = (0, 0), 0

    def step(self, starts: np.ndarray, last_key: tuple, value, threshold, hard, entries=None) -> tuple[np.ndarray, ...]:
        """picked, number, since and held of a batch; starts are the rows where a key begins. entries: state and number that such a row is entered with."""
        n = len(value)
        heads = starts.tolist()
        ends = np.empty(n, np.int64)
        bounds = [*heads, n] if heads and heads[0] == 0 else [0, *heads, n]
        for a, b in zip(bounds, bounds[1:]):
            ends[a:b] = b
        follow = next_picks(value, threshold, hard, ends, self.rule).tolist()
        picked = np.zeros(n, bool)
        number, since, held = np.zeros(n, np.int64), np.arange(n), np.full(n, HIGH)
        for a, b in zip(bounds, bounds[1:]):
            if a or (heads and heads[0] == 0):
                self.state, self.number = entries(a) if entries else ((0, 0), 0)
            i = a + first_pick(value[a:b], hard[a:b], self.state, self.rule)
            if self.state[1]:
                held[a : min(i + 1, b)] = self.state[0]
                since[a:i] += self.state[1] - a
            walk = []
            while i < b:
                walk.append(i)
                i = follow[i]
            if walk:
                picked[walk] = True
                runs = np.diff([*walk, b])
                since[walk[0] : b] -= np.repeat(walk, runs)
                held[walk[0] + 1 : b] = np.repeat(threshold[walk], runs)[: b - walk[0] - 1]
                self.state = (int(threshold[walk[-1]]), b - walk[-1])
            elif self.state[1]:
                self.state = (self.state[0], min(self.state[1] + b - a, FAR))
            number[a:b] = self.number + np.cumsum(picked[a:b])
            self.number = int(number[b - 1])
        self.key = last_key
        return picked, number, since, held


def _ints(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column, missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(batch: pa.RecordBatch, keys: Sequence[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows where a key begins, and the last row's key."""
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        change[1:] |= differ
    change[0] = before is None or tuple(batch.column(k)[0].as_py() for k in keys) != before
    return np.flatnonzero(change), tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)


def _marked(keys: Sequence[str], out: Sequence[str], rule: Rule):
    """Mark the picks of sorted rows; a row where a key begins carries the state that it is entered with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(rule)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last = _rows(batch, keys, walk.key)
            entered = None
            if "_entry" in batch.schema.names:
                column = batch.column("_entry")

                def entered(a, column=column):
                    e = column[a].as_py()
                    return ((e["wanted"], e["since"]), e["number"]) if e else ((0, 0), 0)

            picked, number, since, held = walk.step(starts, last, _ints(batch.column("_v"), LOW), _ints(batch.column("_th"), HIGH), pc.fill_null(batch.column("_hard"), False).to_numpy(zero_copy_only=False), entered)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(picked), pa.array(number), pa.array(since), pa.array(held, mask=held == HIGH)], [*out, *MADE])

    return run


TABLE = "steps array<struct<since bigint,value bigint,wanted bigint,after bigint,number bigint>>, n bigint"
_STEP = pa.struct([(c, pa.int64()) for c in ("since", "value", "wanted", "after", "number")])


def block_table(value: np.ndarray, threshold: np.ndarray, hard: np.ndarray, highest: int, rule: Rule) -> list[tuple[int, int, int, int, int]]:
    """What a block does for every state it can be entered with.

    Rows (since, value, wanted, after, number): entered `since` rows behind a pick, with a
    threshold up to `value` (and above the row before), the block makes `number` picks
    and is left with threshold `wanted`, `after` rows behind the last pick. since is 0
    where it plays no part; `highest` is the highest threshold of all rows in front.
    """
    n = len(value)
    follow = next_picks(value, threshold, hard, np.full(n, n), rule)
    last, count, jump = np.arange(n + 1), np.ones(n + 1, np.int64), np.concatenate([follow, [n]])
    count[n] = 0
    while (jump < n).any():  # doubling: the last pick of the walk from each row, and how many there are
        on = jump < n
        count[on] += count[jump[on]]
        last[on] = last[jump[on]]
        jump = jump[jump]
    forced = np.flatnonzero(hard)
    stop = int(forced[0]) if forced.size else n

    def leave(first: int) -> tuple[int, int, int]:
        q = int(last[first])
        return int(threshold[q]), n - q, int(count[first])

    plays = range(1, rule.most + 1) if rule.most is not None else [0] if rule.least == 1 else range(1, rule.least + 1)
    steps = []
    for since in plays:
        begin = max(0, rule.least - since) if since else 0
        end = stop if rule.most is None else min(stop, max(0, rule.most - since))
        part = value[begin:end]
        if len(part):
            top = np.maximum.accumulate(part)
            records = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]]))
            for r in records.tolist():
                steps.append((since, int(part[r]), *leave(begin + r)))
                if part[r] >= highest:
                    break
        if end < n:
            steps.append((since, HIGH, *leave(end)))
    return steps


def _tables(keys: Sequence[str], rule: Rule):
    """One table per (key, block) of sorted rows."""
    names = [*keys, "_blk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current: tuple | None = None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            v, th = (_ints(table.column(c).combine_chunks(), m) for c, m in (("_v", LOW), ("_th", HIGH)))
            hard = pc.fill_null(table.column("_hard").combine_chunks(), False).to_numpy(zero_copy_only=False)
            highest = table.column("_highest")[0].as_py()
            steps = block_table(v, th, hard, LOW if highest is None else highest, rule)
            rows = [dict(zip(("since", "value", "wanted", "after", "number"), s)) for s in [_from_start(v, th, hard, rule), *steps]]
            return pa.RecordBatch.from_arrays([*[table.column(k).slice(0, 1).combine_chunks() for k in names], pa.array([rows], pa.list_(_STEP)), pa.array([len(v)], pa.int64())], [*names, "steps", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts, last = _rows(batch, names, current)
            cuts = [0, *[s for s in starts.tolist() if s], batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and a in starts:
                    yield close()
                    held.clear()
                held.append(batch.slice(a, b - a))
            current = last
        if held:
            yield close()

    return run


def _from_start(value, threshold, hard, rule: Rule) -> tuple[int, int, int, int, int]:
    """The table's row for a block in front of which nothing was picked: since is -1."""
    n = len(value)
    follow = next_picks(value, threshold, hard, np.full(n, n), rule).tolist()
    i, q, picks = 0, 0, 0
    while i < n:
        i, q, picks = follow[i], i, picks + 1
    return -1, HIGH, int(threshold[q]), n - q, picks


def _entries(keys: Sequence[str], rule: Rule):
    """Tables in order of (key, block) to the state that each block is entered with."""
    whole = rule.most is None and rule.least == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, number = None, (0, 0), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state, number = key, (0, 0), 0
                out.append({"wanted": state[0], "since": state[1], "number": number})
                since = -1 if not state[1] else 0 if whole else min(state[1], rule.least) if rule.most is None else state[1]
                hit = next((s for s in row["steps"] if s["since"] == since and (since < 0 or s["value"] >= state[0])), None)
                if hit:
                    state, number = (hit["wanted"], hit["after"]), number + hit["number"]
                else:
                    state = (state[0], min(state[1] + row["n"], FAR))
            if out:
                kind = pa.struct([("wanted", pa.int64()), ("since", pa.int64()), ("number", pa.int64())])
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("_blk"), pa.array(out, kind)], [*keys, "_blk", "_entry"])

    return run


def hops(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    threshold: Column,
    rule: Rule = Rule(),
    *,
    hard: Column | None = None,
    lag: dict[str, str] | None = None,
    dealt: bool = False,
    hot: HotKeys | None = None,
    block_rows: int = HOT_ROWS,
) -> DataFrame:
    """df with picked; pick_no, the picks of the key up to the row; since, the rows since the last one; held, the threshold in force in front of the row.

    The first row of a key is picked; there held is null.
    `order` must be total within a key. `lag` adds columns of the row before for `hard`
    (then `order` is one integer column); they do not go out. `dealt` says that df comes from
    windows over the keys, so the rows of a key of ordinary size are in one partition. Null values reach nothing,
    null thresholds are never reached, null hard is no break.
    """
    hot = _own_hot(df, keys, hot, block_rows)
    out = df.columns
    rows = neighbours(df, keys, order[0], lag=lag, hot=hot) if lag else df
    rows = rows.select(*out, value.cast("bigint").alias("_v"), threshold.cast("bigint").alias("_th"), (F.lit(False) if hard is None else hard).alias("_hard"))
    fields = [df.schema[c] for c in out]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in MADE.items()]])
    together = rows if (lag or dealt) and hot.keys is None else rows.repartition(*keys)  # windows have dealt the rows out by key already
    if hot.keys is None:
        return together.sortWithinPartitions(*keys, *order).mapInArrow(_marked(list(keys), out, rule), schema)

    cold = rows.join(hot.keys, hot.keys.columns, "left_anti").repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_marked(list(keys), out, rule), schema)
    parts = max(2, -(-hot.rows // block_rows))
    blocks = cut_lineage(rows.join(hot.keys, hot.keys.columns, "left_semi").repartitionByRange(parts, *keys, *order).withColumn("_blk", F.spark_partition_id()))
    names = [*keys, "_blk"]
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    highest = blocks.groupBy(*names).agg(F.max("_th").alias("_h")).select(*names, F.max("_h").over(earlier).alias("_highest"))
    kinds = [T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("_blk", T.IntegerType())]
    dealt = blocks.select(*names, *[c for c in order if c not in names], "_v", "_th", "_hard").join(highest, names).repartition(*names).sortWithinPartitions(*names, *order)
    tables = dealt.mapInArrow(_tables(list(keys), rule), T.StructType(kinds + T._parse_datatype_string(TABLE).fields))
    entry = T.StructType(kinds + T._parse_datatype_string("_entry struct<wanted:bigint,since:bigint,number:bigint>").fields)
    entries = tables.repartition(*keys).sortWithinPartitions(*names).mapInArrow(_entries(list(keys), rule), entry)
    entered = blocks.join(cut_lineage(entries), names).repartition(*names).sortWithinPartitions(*names, *order)
    return cold.unionByName(entered.mapInArrow(_marked(names, out, rule), schema))
