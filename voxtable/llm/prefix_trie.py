"""Shared beginnings of conversations: double-array tries per prefix shard, joined at the nodes that shards have in common.

A turn is known by the first 128 bits of a hash of role and text, so texts never
leave the scan. Turn sequences are cut into bands of 64 turns; the hash of all
bands in front of one names the trie that the band belongs to. Equal bands are
counted before anything is dealt out. The different ones are dealt by range, in
the order of their turns: a chunk of them is a prefix shard. A chunk's turns get
dense ids, its nodes are packed into BASE and CHECK, and a walk over these arrays
gives the nodes and sums them up from the leaves.

Only nodes on a chunk's first or last path, or in front of a further band, can
have members elsewhere. These shared upper nodes bring their ancestors along, and
Spark merges them by their hash and adds their own share to the ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtable.llm.common import stored

#: Turns of a band, the most that one path of a trie has.
BAND = 64
#: A chunk ends with the path that brings it to so many paths or turns.
CHUNK_PATHS, CHUNK_TURNS = 1 << 14, 1 << 17
#: Conversation ids that are written out as one piece before they are hashed.
PIECE_IDS = 1 << 16
#: Every HEAD_EVERY-th conversation lends its first turns, less than HEAD_MOST of them, to those behind it.
HEAD_EVERY, HEAD_MOST = 5, 9
NODE = "hi long, lo long, parent_hi long, parent_lo long, depth long, conv long, parent_conv long, n long, kids long, leaves long, saved long, size long, shared boolean, top boolean, anc_hi array<long>, anc_lo array<long>"
NODE_ARROW = pa.schema([
    *[(c, pa.int64()) for c in "hi lo parent_hi parent_lo depth conv parent_conv n kids leaves saved size".split()],
    ("shared", pa.bool_()), ("top", pa.bool_()), ("anc_hi", pa.list_(pa.int64())), ("anc_lo", pa.list_(pa.int64())),
])


def turn_keys(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (32 hex digits of the hash of role and text) and size, the text's UTF-8 bytes; null role or text is empty.

    Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    return rows.filter("conv_id IS NOT NULL")


def turn_positions(turns: DataFrame) -> DataFrame:
    """Adds pos, the place from 1 on within the conversation: by turn (null first), ties by key. A long conversation is numbered part by part."""
    order = [F.asc_nulls_first("turn"), F.asc("key")]
    parts = stored(turns.repartitionByRange(F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turn-parts")
    by_conv = Window.partitionBy("conv_id").orderBy("part")
    spans = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(by_conv.rowsBetween(Window.unboundedPreceding, -1)))
    # a part's first conversation alone can have begun in an earlier part: a row per part at most
    later = F.broadcast(spans.filter("before IS NOT NULL").select("conv_id", "part", "before"))
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    return parts.withColumn("pos", place.cast("long")).join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, pos, key, size, total), and every conversation with its total, 0 included."""
    turns = stored(turn_positions(turns), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_MOST).alias("h")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    plan = convs.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % HEAD_EVERY).alias("source"))
    plan = plan.join(convs.toDF("source", "source_n"), "source", "left").withColumn("take", F.least("h", F.coalesce("source_n", F.lit(0))))
    plan = stored(plan.select("conv_id", "source", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "plan")
    lent = turns.filter((F.col("pos") < HEAD_MOST) & (F.col("conv_id") % HEAD_EVERY == 0)).withColumnRenamed("conv_id", "source")
    head = lent.join(plan, "source").filter("pos <= take")
    own = turns.join(plan, "conv_id").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("take"))
    columns = ["conv_id", "pos", "key", "size", "total"]
    return head.select(*columns).unionByName(own.select(*columns)), plan.select("conv_id", "total")


def _halves(band: Column, path: Column) -> tuple[Column, Column]:
    """The hash of a path in its band, as two longs."""
    digest = F.sha2(F.concat(F.concat(band.cast("string"), F.lit(":")).cast("binary"), path), 256)
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def _hash(band: int, path: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(b"%d:%b" % (band, path)).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)


def bands(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and band: conv_id, band, hi and lo (hash of the bands in front), path, sizes, is_end, end_hi, end_lo."""
    rows = turns.withColumn("band", F.floor((F.col("pos") - 1) / BAND)).groupBy("conv_id", "band").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "key", "size"))).alias("t"))
    rows = rows.select("conv_id", "band", "total", F.unhex(F.array_join("t.key", "")).alias("path"), F.col("t.size").alias("sizes"))
    empty = convs.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("band"), "total", F.lit(bytearray()).alias("path"), F.array().cast("array<long>").alias("sizes"))
    hi, lo = _halves(F.col("band"), F.col("path"))
    rows = rows.withColumns({"own_hi": hi, "own_lo": lo}).unionByName(empty.withColumns({"own_hi": F.lit(0).cast("long"), "own_lo": F.lit(0).cast("long")}))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    one = rows.filter(F.col("total") <= BAND).withColumns({"hi": zero, "lo": zero})
    more = rows.filter(F.col("total") > BAND).withColumns({k: F.coalesce(F.bit_xor(f"own_{k}").over(before), zero) for k in ("hi", "lo")})
    both = one.unionByName(more).withColumn("is_end", F.col("band") == F.greatest(F.floor((F.col("total") - 1) / BAND), F.lit(0)))
    ends = {f"end_{k}": F.col(k).bitwiseXOR(F.col(f"own_{k}")) for k in ("hi", "lo")}
    return both.withColumns(ends).select("conv_id", "band", "hi", "lo", "path", "sizes", "is_end", "end_hi", "end_lo")


class DoubleArray:
    """A trie in two arrays: the child by code c of the node in slot s lies in slot base[s] + c, where check has s.

    Codes are dense from 1 on; the root lies in slot 0. `next` leads from a slot to a free one at or behind it.
    """

    WIDE = 64

    def __init__(self) -> None:
        self.base, self.check, self.next = [0], [-1], [1]
        self.top = 1

    def free(self, slot: int) -> int:
        nxt = self.next
        while len(nxt) <= slot:
            nxt.append(len(nxt))
            self.base.append(0)
            self.check.append(-1)
        at = slot
        while at < len(nxt) and nxt[at] != at:
            at = nxt[at]
        while slot < at:
            nxt[slot], slot = at, nxt[slot]
        return self.free(at) if at >= len(nxt) else at

    def add(self, parent: int, codes: list[int]) -> int:
        """Place the children of a node: the first base that finds all their slots free, for wide nodes one behind all slots."""
        first, last = codes[0], codes[-1]
        slot = self.free(first + 1 if len(codes) <= self.WIDE else max(self.top, first + 1))
        while any(self.free(slot - first + c) != slot - first + c for c in codes[1:]):
            slot = self.free(slot + 1)
        base = self.base[parent] = slot - first
        for c in codes:
            self.check[base + c] = parent
            self.next[base + c] = base + c + 1
        self.top = max(self.top, base + last + 1)
        return base


def packed(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK of different paths, given as rows of codes (0 behind the end), level by level."""
    trie = DoubleArray()
    state, width = np.zeros(len(codes), np.int64), int(codes.max(initial=0)) + 1
    for j in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > j)
        parents, children = np.divmod(np.unique(state[on] * width + codes[on, j]), width)
        heads = np.flatnonzero(np.diff(parents, prepend=-1))
        stops = [*heads[1:].tolist(), len(parents)]
        parents, children = parents.tolist(), children.tolist()
        for a, b in sorted(zip(heads.tolist(), stops), key=lambda s: s[0] - s[1]):  # wide ones first
            trie.add(parents[a], children[a:b])
        state[on] = np.array(trie.base)[state[on]] + codes[on, j]
    return np.array(trie.base), np.array(trie.check)


def trie_nodes(band: int, root: tuple[int, int], paths: list[bytes], sizes: list, n: list[int], convs: list[int], ends: list[int]) -> list[tuple]:
    """NODE rows of one chunk of a trie. Sums of shared nodes leave out what shared nodes below add."""
    lengths = np.array([len(p) // 16 for p in paths], np.int64)
    depth_most = int(lengths.max(initial=0))
    spread = np.arange(depth_most) < lengths[:, None]
    codes, size_of = np.zeros((len(paths), depth_most), np.int64), np.zeros((len(paths), depth_most), np.int64)
    if depth_most:
        codes[spread] = np.unique(np.frombuffer(b"".join(paths), "V16"), return_inverse=True)[1] + 1  # dense turn ids of this shard
        size_of[spread] = np.concatenate([np.asarray(s, np.int64) for s in sizes if len(s)])
    base, check = packed(codes, lengths)

    counts, convs, ends = np.array(n, np.int64), np.array(convs, np.int64), np.array(ends, np.int64)
    count, size, first, low = (np.zeros(len(check), np.int64) for _ in range(4))
    low[:] = np.iinfo(np.int64).max
    depth = np.full(len(check), -1)
    shared = np.zeros(len(check), bool)
    goes_on = (lengths == BAND) & (counts > ends)  # a further band hangs below
    edge = goes_on.copy()
    edge[[0, -1]] = True
    state = np.zeros(len(paths), np.int64)
    levels = []
    for j in range(depth_most + 1):
        on = np.flatnonzero(lengths >= j)
        if j:
            step = base[state[on]] + codes[on, j - 1]
            if (check[step] != state[on]).any():
                raise AssertionError("CHECK does not lead back to the node")
            state[on] = step
            size[step] = size_of[on, j - 1]
        at = state[on]
        np.add.at(count, at, counts[on])
        np.minimum.at(low, at, convs[on])
        first[at[::-1]] = on[::-1]
        depth[at] = j
        shared[at[edge[on]]] = True
        levels.append(np.unique(at))
    shared[0] = True
    kids, leaves, saved = (np.zeros(len(check), np.int64) for _ in range(3))
    for at in reversed(levels[1:]):
        inner = at[~shared[at]]
        leaves[inner] += kids[inner] == 0
        saved[inner] += (count[inner] - 1) * size[inner]
        for total in (leaves, saved):
            np.add.at(total, check[at], total[at])
        np.add.at(kids, check[inner], 1)
    keys: dict[int, tuple[int, int]] = {0: root}
    out = []
    for j, at in enumerate(levels):
        for s in at.tolist():
            if j:
                hi, lo = _hash(band, paths[first[s]][: 16 * j])
                keys[s] = (root[0] ^ hi, root[1] ^ lo)
            up = int(check[s])
            above = keys[up] if j else (None, None)
            anc: list[tuple[int, int]] | None = None
            if shared[s]:
                anc, a = [], up
                while a >= 0:
                    anc.append(keys[a])
                    a = int(check[a])
            below_band = not j and band > 0  # the node itself is the last one of the band in front
            known = int(low[up]) if j and not shared[up] else None
            out.append((
                *keys[s], *above, band * BAND + j, int(low[s]), known, 0 if below_band else int(count[s]), int(kids[s]), int(leaves[s]), int(saved[s]),
                int(size[s]) if j else None, bool(shared[s]), not j, [x[0] for x in anc] if j and anc else None, [x[1] for x in anc] if j and anc else None,
            ))
    return out


def _chunk_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NODE rows of sorted paths, chunk by chunk."""

    def close(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = []
        for (band, hi, lo), part in groupby(rows, key=itemgetter("band", "hi", "lo")):
            part = list(part)
            found += trie_nodes(band, (hi, lo), *([r[c] for r in part] for c in ("path", "sizes", "n", "conv", "ends")))
        columns = list(zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_ARROW)], schema=NODE_ARROW)

    held, turns = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            turns += len(row["sizes"])
            if len(held) >= CHUNK_PATHS or turns >= CHUNK_TURNS:
                yield from close(held)
                held, turns = [], 0
    if held:
        yield from close(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (hi, lo, conv_id) to comma-joined pieces of a node's ids: hi, lo, first id, text."""
    node, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, ids[0], ",".join(map(str, ids)))], ["hi", "lo", "first", "ids"])

    for batch in batches:
        for hi, lo, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and ((hi, lo) != node or len(ids) >= PIECE_IDS):
                yield piece()
                ids = []
            node = (hi, lo)
            ids.append(conv)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 per node; a node's pieces stream through the hash one by one."""
    node, state = None, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["hi", "lo", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for hi, lo, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (hi, lo) != node:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (hi, lo), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield flush()
    if state is not None:
        out.append((*node, state.hexdigest()))
    if out:
        yield flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of (hi, lo, conv_id). SHA-256 takes its input in order, so a node's ids meet as few large pieces, a stream of text."""
    pieces = ends.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(_pieces, "hi long, lo long, first long, ids string")
    return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(_digests, "hi long, lo long, ends_sha256 string")


def _further_bands(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(hi, lo, all_saved, all_leaves): what lies below each node in front of a further band, over all further bands.

    A band's trie counts once, at its smallest conversation; running sums from the
    last band of each conversation back, added up over a node's conversations, give
    the sum over all that hangs below the node, however many bands deep.
    """
    members = paths.filter("band > 0").select("conv_id", "band", "hi", "lo")
    once = members.groupBy("hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.min("band").alias("band")).join(roots, ["hi", "lo"])
    own = members.join(once.select("conv_id", "band", "trie_saved", "trie_leaves"), ["conv_id", "band"], "left")
    back = Window.partitionBy("conv_id").orderBy(F.desc("band"))
    sums = own.select("hi", "lo", *[F.sum(F.coalesce(f"trie_{c}", F.lit(0))).over(back).alias(c) for c in ("saved", "leaves")])
    return sums.groupBy("hi", "lo").agg(F.sum("saved").alias("all_saved"), F.sum("leaves").alias("all_leaves"))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per different beginning of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Null role or text is
    empty; rows without conv_id are left out; rows of one conv_id and turn stand in
    the order of the hash of role and text, repeated rows are turns of their own.
    Conversations without turns end at the root. An empty table gives no row. Other
    columns are not read.
    """
    turns, convs = rebuilt(turn_keys(conversations))
    paths = stored(bands(turns, convs), "bands")
    different = paths.groupBy("band", "hi", "lo", "path").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.sum(F.col("is_end").cast("long")).alias("ends"))
    order = ["band", "hi", "lo", "path"]
    nodes = stored(different.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunk_nodes, NODE), "nodes")

    merged = nodes.filter("shared").groupBy("hi", "lo").agg(
        *[F.max(c).alias(c) for c in ("depth", "parent_hi", "parent_lo", "size", "anc_hi", "anc_lo")], F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")],
        *[F.sum(F.when(F.col("top") & (F.col("depth") > 0), F.col(c)).otherwise(0)).alias(f"top_{c}") for c in ("leaves", "saved")],
    )
    branches = merged.groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count("*").alias("branches")).filter("hi IS NOT NULL")
    merged = merged.join(branches, ["hi", "lo"], "left").withColumn("kids", F.col("kids") + F.coalesce("branches", F.lit(0))).drop("branches")
    merged = stored(merged.withColumn("own_saved", (F.col("n") - 1) * F.coalesce("size", F.lit(0))).withColumn("own_leaves", (F.col("kids") == 0).cast("long")), "shared")

    each = F.explode(F.arrays_zip(F.col("anc_hi").alias("hi"), F.col("anc_lo").alias("lo")))
    up = merged.select(each.alias("a"), "own_saved", "own_leaves").select("a.hi", "a.lo", "own_saved", "own_leaves")
    below = up.groupBy("hi", "lo").agg(F.sum("own_saved").alias("chain_saved"), F.sum("own_leaves").alias("chain_leaves"))
    summed = merged.join(below, ["hi", "lo"], "left").fillna(0, ["chain_saved", "chain_leaves"])
    deep = paths.filter("band > 0").select("hi", "lo").distinct()
    tries = summed.join(deep, ["hi", "lo"]).select("hi", "lo", "anc_hi", "anc_lo", *[(F.col(f"top_{c}") + F.col(f"chain_{c}")).alias(f"trie_{c}") for c in ("saved", "leaves")])
    tries = stored(tries, "further-tries")
    further = tries.join(_further_bands(paths, tries.select("hi", "lo", "trie_saved", "trie_leaves")), ["hi", "lo"])
    # what hangs below a node in front of a further band counts for the nodes above it in its own band, the band's root included
    extra = further.select(each.alias("a"), "all_saved", "all_leaves").groupBy("a.hi", "a.lo").agg(F.sum("all_saved").alias("more_saved"), F.sum("all_leaves").alias("more_leaves"))
    summed = summed.join(extra, ["hi", "lo"], "left").fillna(0, ["more_saved", "more_leaves"])
    total = lambda c: F.col(c) + F.col(f"own_{c}") + F.col(f"chain_{c}") + F.col(f"more_{c}")
    upper = stored(summed.select("hi", "lo", "parent_hi", "parent_lo", "depth", "conv", F.lit(None).cast("long").alias("parent_conv"), "n", "kids", total("leaves").alias("leaves"), total("saved").alias("saved")), "upper")

    every = nodes.filter("NOT shared").select(*upper.columns).unionByName(upper)
    named = every.filter("parent_conv IS NOT NULL OR parent_hi IS NULL")
    parents = upper.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv").alias("found"))
    others = every.filter("parent_conv IS NULL AND parent_hi IS NOT NULL").join(parents, ["parent_hi", "parent_lo"]).withColumn("parent_conv", F.col("found"))
    every = named.unionByName(others.select(*named.columns))
    digests = end_digests(paths.filter("is_end").select(F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo"), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return every.join(digests, ["hi", "lo"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
