"""Alignment of two tokenizers' tokens: pandas merge_asof per batch, keyed by document.

Both encode space+text. Each distinct unit of a text (white space and the word
behind it) goes to the libraries once per worker; neither has an entry across the
end of a unit, which is checked when the files are loaded. In a batch the starts
of one side look up the token of the other side that covers them, in both
directions; the union of both is all overlapping pairs, and pairs that end
together close a group. A group's tokens are linked, all with all.

How many documents link a pair is counted over the corpus from each document's
different pairs. The most frequent pairs, a bounded table, are broadcast with the
highest count of every id; what a document holds of the others meets its counts
in a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import over_batches, slices, stored, text_column
from voxtable.llm.prefix_counts import ASCII_BLANK, WIDE_BLANK, WIDE_BLANKS, byte_letters

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts aligned together; a longer text is aligned in pieces of so many bytes, cut between units.
GROUP_BYTES = 1 << 20
#: Units kept with their ids, and the longest kept.
KNOWN_UNITS, MOST_IDS = 400_000, 64
#: Links of ordinary groups that are written out at one time; groups with more than MOST_LINKS are counted by different ids.
LINKS, MOST_LINKS = 1 << 20, 1 << 12
#: Different pairs that a worker counts before it sends the counts on, and those that are broadcast.
PAIRS_AT_A_TIME, HEAD_PAIRS = 1 << 21, 1 << 21
#: Bits that hold a pair's code in front of which a document's place stands.
CODE_BITS = 40
#: Marks that no entry of either side has behind a letter (checked on loading).
MARK = np.isin(np.arange(256), list(b".,;:!?"))
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
CUT_BLANK = np.isin(np.arange(256), list(b" \n"))
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class Side:
    """One tokenizer: ids of units in many at a time, and the bytes of each id."""

    def __init__(self, path: str):
        self.many: Callable[[list[str]], list[list[int]]]
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            own = [p for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
            # behind a line feed, which no entry holds, a unit is encoded without the blank that the library puts in front
            self.cuts = not any("\n" in p for p in own)
            self.many = lambda units: [ids[2:] for ids in model.encode(["\n" + u for u in units], num_threads=1)]
            self.one = lambda text: model.encode(text[1:])
            own = [p.replace("▁", " ") for p in own]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            vocabulary, letters = model.get_vocab(with_added_tokens=False), byte_letters()
            self.bytes = [b""] * (max(vocabulary.values()) + 1)
            for t, i in vocabulary.items():
                self.bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
            self.cuts = True  # the pattern cuts there before anything is merged
            self.many = lambda units: [e.ids for e in model.encode_batch_fast(units, add_special_tokens=False)]
            self.one = lambda text: model.encode(text, add_special_tokens=False).ids
            own = []
        across = re.compile(r"[^ \n][ \n]|[A-Za-z][.,;:!?]")
        self.cuts = self.cuts and not any(across.search(p) for p in own)
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.table = pa.array(self.bytes, pa.binary())


class Known:
    """Units met so far with the ids of both sides, in flat arrays."""

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self.units = pa.array([], pa.binary())
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.n = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def ids(self, units: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all units in a row, and the number of each unit's."""
        different = pc.dictionary_encode(units)
        words, of = different.dictionary, different.indices.to_numpy()
        place = pc.fill_null(pc.index_in(words, value_set=self.units), -1).to_numpy(zero_copy_only=False).copy()
        missing = words.filter(pa.array(place < 0))
        if len(missing):
            place[place < 0] = len(self.units) + np.arange(len(missing))
            self.units = pa.concat_arrays([self.units, missing])
            texts = [u.decode() for u in missing.to_pylist()]
            for k, side in enumerate(self.sides):
                found = side.many(texts)
                self.n[k] = np.concatenate([self.n[k], np.array([len(f) for f in found], np.int64)])
                self.flat[k] = np.concatenate([self.flat[k], np.array([i for f in found for i in f], np.int32)])
        out = []
        for k in (0, 1):
            starts, n = (np.cumsum(self.n[k]) - self.n[k])[place], self.n[k][place]
            each = n[of]
            ends = np.cumsum(each)
            out.append((self.flat[k][np.repeat(starts[of] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)], each))
        if len(self.units) > KNOWN_UNITS:  # begin anew with the units just met
            short = np.flatnonzero((self.n[0][place] <= MOST_IDS) & (self.n[1][place] <= MOST_IDS))
            for k in (0, 1):
                starts, n = (np.cumsum(self.n[k]) - self.n[k])[place][short], self.n[k][place][short]
                self.flat[k] = self.flat[k][np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                self.n[k] = n
            self.units = words.take(pa.array(short))
        return out


def unit_ends(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of units: in front of a blank behind a word, and of a mark behind a letter; texts end at bounds."""
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = (CUT_BLANK[raw[1:]] & ~ASCII_BLANK[raw[:-1]]) | (MARK[raw[1:]] & LETTER[raw[:-1]])
    cut[bounds] = True
    return np.flatnonzero(cut)


def overlaps(start: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap, by two merge_asof keyed by document: each start finds the token that covers it."""
    sides = [pd.DataFrame({"at": s, "doc": d, name: np.arange(len(s), dtype=np.int32)}) for s, d, name in zip(start, doc, "ab")]
    one = pd.merge_asof(sides[0], sides[1], on="at", by="doc")
    two = pd.merge_asof(sides[1], sides[0], on="at", by="doc")
    later = start[0][two["a"].to_numpy()] < start[1]  # equal starts were found from the other side
    return np.concatenate([one["a"].to_numpy(), two["a"].to_numpy()[later]]), np.concatenate([one["b"].to_numpy(), two["b"].to_numpy()[later]])


def linked(ids: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray], n: tuple[np.ndarray, np.ndarray], doc: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, times) of the links of groups, sorted, in parts that fit in memory; keys are document << CODE_BITS | a * wide + b."""
    links = n[0] * n[1]
    first_b = np.cumsum(n[1]) - n[1]
    small = links <= MOST_LINKS
    tokens = np.flatnonzero(small[of[0]])
    reach = n[1][of[0][tokens]]
    ends = np.cumsum(reach)
    a = 0
    while a < len(tokens):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LINKS, side="right")))
        some, each = tokens[a:b], reach[a:b]
        at = np.repeat(first_b[of[0][some]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        key = np.sort(np.repeat((doc[of[0][some]] << CODE_BITS) + ids[0][some].astype(np.int64) * wide, each) + ids[1][at])
        head = np.flatnonzero(np.diff(key, prepend=-1))
        yield key[head], np.diff(head, append=len(key))
        a = b
    first_a = np.cumsum(n[0]) - n[0]
    for g in np.flatnonzero(~small).tolist():
        (ua, ca), (ub, cb) = (np.unique(ids[k][f[g] : f[g] + n[k][g]], return_counts=True) for k, f in ((0, first_a), (1, first_b)))
        rows = max(1, LINKS // len(ub))
        for x in range(0, len(ua), rows):
            code = (ua[x : x + rows].astype(np.int64)[:, None] * wide + ub[None, :]).ravel()
            yield (int(doc[g]) << CODE_BITS) + code, (ca[x : x + rows][:, None] * cb[None, :]).ravel()


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of times for each key, in their order."""
    if len(parts) == 1:
        return parts[0]
    key, times = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    return key[head], np.add.reduceat(times, head)


class Aligner:
    def __init__(self, first: str, second: str):
        self.sides = (Side(first), Side(second))
        self.known = Known(self.sides)
        self.cuts = all(s.cuts for s in self.sides)
        self.wide = len(self.sides[1].bytes)
        # every id as text with what may stand behind it: the next of its side, or the end of its side
        self.shown = pa.array([f"{i}{end}".encode() for side, ends in zip(self.sides, (",|", ",;")) for end in ends for i in range(len(side.bytes))], pa.binary())

    def pieces(self, text: bytes) -> list[bytes]:
        """space+text in pieces of about GROUP_BYTES, cut where units end."""
        text = b" " + text
        if len(text) <= GROUP_BYTES or not self.plain(text):
            return [text]
        ends = unit_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        at = [0]
        while at[-1] < len(text):
            k = int(np.searchsorted(ends, at[-1] + GROUP_BYTES))
            at.append(int(ends[min(k, len(ends) - 1)]))
        return [text[a:b] for a, b in zip(at, at[1:])]

    def plain(self, text: bytes) -> bool:
        """Whether units may be encoded one by one: no white space beyond ASCII."""
        return self.cuts and not (any(s in text for s in WIDE_BLANKS) or (b"\xe2\x80" in text and WIDE_BLANK.search(text)))

    def encoded(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts in a row, and each text's number."""
        whole = [i for i, t in enumerate(texts) if not self.plain(t)]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        if not whole:
            ends = unit_ends(raw, bounds)
            units = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            at = np.searchsorted(ends, bounds)
            return [(ids, np.diff(np.concatenate([[0], np.cumsum(n)])[at])) for ids, n in self.known.ids(units)]
        rest = [t for i, t in enumerate(texts) if self.plain(t)]
        common = self.encoded(rest) if rest else [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * 2
        out = []
        for side, (ids, n) in zip(self.sides, common):
            parts = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
            alone = set(whole)
            each = [np.array(side.one(t.decode(errors="replace")), np.int32) if i in alone else next(parts) for i, t in enumerate(texts)]
            out.append((np.concatenate(each), np.array([len(e) for e in each], np.int64)))
        return out

    def align(self, texts: list[bytes]) -> Iterator[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, digest text in parts, and its pairs' codes and times; None if bytes differ."""
        coded = self.encoded(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        joined = []
        for side, (ids, n) in zip(self.sides, coded):
            size = side.sizes[ids]
            total = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])])
            flat = side.table.take(pa.array(ids, pa.int32()))
            data = memoryview(flat.buffers()[2] or b"").cast("B")
            ends = np.cumsum([0, *total.tolist()])
            joined.append([int(total[i]) == len(t) and data[ends[i] : ends[i + 1]] == t for i, t in enumerate(texts)])
        good = np.array(joined[0]) & np.array(joined[1])
        ids, start, end, doc = [], [], [], []
        for side, (found, n) in zip(self.sides, coded):
            of = np.repeat(np.arange(len(texts), dtype=np.int64), n)
            keep = good[of]
            found, of = found[keep], of[keep]
            size = side.sizes[found]
            after = np.cumsum(size)
            shift = np.cumsum(np.where(good, 0, np.diff(bounds)))  # bytes of texts left out so far
            ids.append(found)
            doc.append(of)
            end.append(after + shift[of])
            start.append(after - size + shift[of])
        groups = self.grouped(start, end, doc)
        closes, of = groups
        n = [np.bincount(g, minlength=len(closes)) for g in of]
        group_doc = np.searchsorted(bounds, closes, side="left") - 1
        n_groups = np.bincount(group_doc, minlength=len(texts))
        n_links = np.bincount(group_doc, weights=n[0] * n[1], minlength=len(texts)).astype(np.int64)
        n_tokens = [np.bincount(d, minlength=len(texts)) for d in doc]
        parts = list(linked(tuple(ids), tuple(of), tuple(n), group_doc, self.wide))
        key, times = merged(parts) if parts else (np.zeros(0, np.int64),) * 2
        at = np.searchsorted(key, np.arange(len(texts) + 1) << CODE_BITS)
        code = key & ((1 << CODE_BITS) - 1)
        shown, stops = self.written(ids, of, n, doc, len(texts))
        for i in range(len(texts)):
            s = slice(at[i], at[i + 1])
            yield bool(good[i]), int(n_tokens[0][i]), int(n_tokens[1][i]), int(n_groups[i]), int(n_links[i]), shown[stops[i] : stops[i + 1]], code[s], times[s]

    def grouped(self, start, end, doc) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where groups close, and each token's group."""
        if not len(start[0]) or not len(start[1]):
            return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 2
        a, b = overlaps(tuple(start), tuple(doc))
        closes = np.sort(end[0][a[end[0][a] == end[1][b]]])
        return closes, [np.searchsorted(closes, s, side="right") for s in start]

    def written(self, ids, of, n, doc, texts: int) -> tuple[memoryview, np.ndarray]:
        """The groups of all texts as text, and where each text's ends."""
        sizes = [len(s.bytes) for s in self.sides]
        total = [len(i) for i in ids]
        order, at = np.zeros(sum(total), np.int32), []
        for k in (0, 1):
            last = np.concatenate([np.diff(of[k]) != 0, [True]]) if total[k] else np.zeros(0, bool)
            before = np.cumsum(n[1 - k]) - (n[1 - k] if k == 0 else 0)  # tokens of the other side in front: of earlier groups, and for B of the own group
            place = np.arange(total[k]) + (before[of[k]] if total[k] else 0)
            order[place] = ids[k] + last * sizes[k] + (2 * sizes[0] if k else 0)
            at.append(np.bincount(doc[k], minlength=texts))
        text = self.shown.take(pa.array(order))
        offsets = np.frombuffer(text.buffers()[1], np.int32) if len(text) else np.zeros(1, np.int32)
        return memoryview(text.buffers()[2] or b"").cast("B"), offsets[np.cumsum([0, *(at[0] + at[1]).tolist()])]


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def _row(doc_id, parts: list[tuple]) -> tuple:
    """One document's row from its pieces."""
    if not parts or not all(p[0] for p in parts):
        return doc_id, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    digest = hashlib.sha256()
    for k, p in enumerate(parts):
        digest.update(p[5][: -1 if k + 1 == len(parts) else None])  # the last group has no mark behind it
    if len(parts) == 1:
        code, times = parts[0][6:]
    else:
        code, times = merged([p[6:] for p in parts])
    return doc_id, *(sum(p[k] for p in parts) for k in (1, 2, 3, 4)), digest.hexdigest(), code, times


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _aligned(first: str, second: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    tool = aligner(first, second)

    def rows(texts: list[bytes], held: list[tuple[int, int]], ids: list) -> pa.RecordBatch:
        found = list(tool.align(texts)) if texts else []
        out = [_row(ids[d], found[a:b]) for d, (a, b) in enumerate(held)]
        columns = list(zip(*out))
        arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.int64()) for c in columns[1:5]], pa.array(columns[5]), _lists(list(columns[6])), _lists(list(columns[7]))]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in slices(batches):
        texts, held, ids, size = [], [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pieces = tool.pieces(text) if text else []
            if len(pieces) > 1:  # a long text: piece by piece
                found = [next(tool.align([p])) for p in pieces]
                found = [(*f[:5], bytes(f[5]), *f[6:]) for f in found]
                out = _row(doc_id, found)
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in out[:5]], pa.array([out[5]]), _lists([out[6]]), _lists([out[7]])], names)
                continue
            held.append((len(texts), len(texts) + len(pieces)))
            ids.append(doc_id)
            texts += pieces
            size += len(text)
            if size >= GROUP_BYTES:
                yield rows(texts, held, ids)
                texts, held, ids, size = [], [], [], 0
        if held:
            yield rows(texts, held, ids)


def alignments(docs: DataFrame, first: str | None = None, second: str | None = None, text: str = "text") -> DataFrame:
    """One row per row of docs, with a key `row`, stored: n_a, n_b, n_groups, n_links, groups_sha256, and the different linked id pairs with their times.

    Null and empty texts, and those that a side does not give back byte for byte,
    have no tokens: zeros and an empty groups_sha256. Other columns are not read.
    """
    first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    rows = docs.select(F.col("doc_id").cast("long"), text_column(text)).mapInArrow(partial(_aligned, first, second), ALIGNED)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "alignments")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each pair."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def total() -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
        return code[head], np.add.reduceat(n, head)

    for batch in batches:
        code = batch.column(0).flatten().to_numpy()
        if len(code):
            held.append(np.unique(code, return_counts=True))
            size += len(held[-1][0])
        if size > 2 * PAIRS_AT_A_TIME:
            held = [total()]
            size = len(held[0][0])
            if size > PAIRS_AT_A_TIME:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair linked, stored."""
    return stored(aligned.select("pairs").mapInArrow(_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The pairs with the highest counts, at most `most`: those above the count at which a histogram of counts passes the bound."""
    level = F.least(F.floor(F.log2("n") * 16), F.lit(1023)).cast("int")
    by = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 1024 rows at most
    left, lowest = most, None
    for r in by:
        left -= r["count"]
        if left < 0:
            break
        lowest = r["level"]
    return counts.filter(level >= lowest) if lowest is not None else counts.limit(0)


def _scored(head: tuple[np.ndarray, np.ndarray], best: tuple[np.ndarray, np.ndarray], wide: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """n_best and count_sum of the pairs in the head, and the places of the others."""
    lists = batch.column(1)
    code, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(head[0], code), max(0, len(head[0]) - 1))
    known = head[0][at] == code if len(head[0]) else np.zeros(len(code), bool)
    n = np.where(known, head[1][at], 0) if len(head[0]) else np.zeros(len(code), np.int64)
    high = best[1][np.searchsorted(best[0], code // wide)] if len(code) else n
    sums = [np.zeros(batch.num_rows, np.int64) for _ in "bs"]
    np.add.at(sums[0], row, times * (known & (n == high)))
    np.add.at(sums[1], row, times * n)
    rest = ~known
    ends = np.searchsorted(row[rest], np.arange(batch.num_rows + 1)).astype(np.int32)
    others = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[rest])) for x in (code, times)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *others], ["row", "n_best", "count_sum", "pairs", "times"])


def align_corpus(docs: DataFrame, first: str | None = None, second: str | None = None, head_pairs: int = HEAD_PAIRS, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of docs; each row counts as a document of its own.

    See alignments() for texts without tokens. An empty table gives no rows.
    """
    second = second or public_tokenizers.path(SECOND)
    wide = len(Side(second).bytes)
    aligned = alignments(docs, first, second, text)
    counts = pair_counts(aligned)
    id_a = F.floor(F.col("pair") / wide)
    best = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("high"))  # a row per id of the vocabulary at most
    table = best.orderBy("a").toArrow()
    high = tuple(table.column(c).to_numpy() for c in ("a", "high"))
    table = frequent(counts, head_pairs).orderBy("pair").toArrow()
    head = tuple(table.column(c).to_numpy() for c in ("pair", "n"))
    shape = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    scored = stored(aligned.select("row", "pairs", "times").mapInArrow(over_batches(partial(_scored, head, high, wide)), shape), "scored")
    others = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = others.join(counts, "pair").join(F.broadcast(best), F.floor(F.col("pair") / wide) == F.col("a"))
    rare = met.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("high"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    out = aligned.join(scored.select("row", "n_best", "count_sum"), "row").join(rare, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[(F.col(c) + F.coalesce(r, F.lit(0))).alias(c) for c, r in (("n_best", "rare_best"), ("count_sum", "rare_sum"))], "groups_sha256")
