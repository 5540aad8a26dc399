"""Token counts of every prefix of a text, by dynamic programming over a byte-level BPE's merges.

The last token of a prefix's encoding is the one vocabulary entry t that ends
there and is stable behind the last token of the prefix in front of it; the
count is that prefix's count plus one. So one pass over a text gives the exact
count of all its prefixes. The counts are stored as differences, two bytes per
code point, and answer truncation and budget questions without encoding again.
"""

from __future__ import annotations

import array
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import over_batches, stored, text_column

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: White space as the library's pattern reads it (fixed values).
BLANK = "\t-\r \x85\xa0  -     　"
#: A run of white space with the word behind it: the pattern cuts no piece across the end of one.
UNIT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
CUT = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")
#: Units of Latin letters with one mark behind at most, which need no pattern to be cut.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)")
#: Endings that the pattern cuts off as pieces of their own (fixed values).
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
#: White space beyond ASCII in UTF-8 (fixed values); the general punctuation block needs a closer look.
WIDE_BLANKS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
WIDE_BLANK = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
ASCII_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Texts of about so many bytes are taken together; units kept, and the longest kept.
GROUP_BYTES, KNOWN_UNITS, MOST_CHARS = 1 << 23, 1_000_000, 64
CHUNK_CHARS = 1 << 20
CACHED_UNITS, CACHED_CORES = 50_000, 300_000
CACHED_PAIRS = 400_000
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one tokenizer file. Tokens are numbered by when their merge comes: bytes first, then by rank."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_bytes = [t.encode() for t in self.special]
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = byte_letters()
        raw = [bytes([b]) for b in range(256)]
        self.number = {b: i for i, b in enumerate(raw)}
        self.right, self.left = [[i] for i in range(256)], [[i] for i in range(256)]
        self.merged: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        parts: list[tuple[int, int] | None] = [None] * 256
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (self.number[bytes(letters[c] for c in x)] for x in (a, b))
            n = len(raw)
            raw.append(raw[a] + raw[b])
            parts.append((a, b))
            self.number.setdefault(raw[n], n)
            self.merged[a << 20 | b] = n
            self.right.append([*self.right[b], n])
            self.left.append([*self.left[a], n])
        for n, made in enumerate(parts):  # an entry that its own bytes don't encode to never ends a prefix
            if made and self._first_crossing(*made) != made:
                self.number.pop(raw[n], None)
        self.tails = {t[i:]: -1 for t in self.number for i in range(1, len(t))} | self.number  # all ends of entries; -1: no entry itself
        self.units: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known = pa.array([b""], pa.binary())  # units of texts with ASCII white space only, and their differences
        self.flat, self.sizes = np.zeros(0, "<i2"), np.zeros(1, np.int64)

    def _first_crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """Which part of a merges with which part of b first, when a's bytes stand before b's; None if none does."""
        xs, ys = self.right[a], self.left[b]
        i = j = 0
        while True:
            across = self.merged.get(xs[i] << 20 | ys[j], NEVER)
            grows_left = xs[i + 1] if i + 1 < len(xs) else NEVER
            grows_right = ys[j + 1] if j + 1 < len(ys) else NEVER
            if across < grows_left and across <= grows_right:
                return xs[i], ys[j]
            if grows_left == grows_right == NEVER:
                return None
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def _stable(self, key: int) -> bool:
        """Whether the two tokens of the key stay as they are side by side."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self._first_crossing(key >> 20, key & 0xFFFFF) is None
        return known

    def piece(self, text: str) -> list[int]:
        """Counts of the piece's prefixes, one for each code point, from 1 on."""
        raw = text.encode()
        number, stable, known = self.tails.get, self._stable, self.pairs.get
        counts, last = [0], [0]
        for i in range(1, len(raw) + 1):
            k = i - 1
            while (n := number(raw[k:i])) is not None:
                if n >= 0:
                    if not k:
                        break
                    if (ok := known(key := last[k] | n)) is None:
                        ok = stable(key)
                    if ok:
                        break
                k -= 1
                if k < 0:
                    raise ValueError("the merges don't encode this prefix")
            else:
                raise ValueError("the merges don't encode this prefix")
            counts.append(counts[k] + 1)
            last.append(n << 20)
        if len(raw) == len(text):
            return counts[1:]
        return [c for i, c in enumerate(counts) if i and (i == len(raw) or raw[i] & 0xC0 != 0x80)]

    def _unit(self, unit: str) -> bytes:
        """Count differences of a unit's prefixes, 16 bits each."""
        if m := PLAIN.fullmatch(unit):
            if (known := self.cores.get(m[1])) is None:
                if len(self.cores) >= CACHED_CORES:
                    self.cores.clear()
                counts = self.piece(m[1])
                known = self.cores[m[1]] = array.array("h", map(int.__sub__, counts, [0, *counts])).tobytes()
            return known + b"\1\0" if m[2] else known
        else:
            blanks = len(unit) - len(unit.lstrip("\t\n\x0b\x0c\r \x85\xa0                　"))
            counts = self.piece(unit[:blanks]) if blanks else []
            if blanks < len(unit):
                done = counts[blanks - 2] if blanks > 1 else 0  # the last blank goes with, or stands before, the word
                found: list[int] = []
                for _, (a, b) in self.cut(unit[max(0, blanks - 1) :]):
                    piece = unit[max(0, blanks - 1) :][a:b]
                    inner = self.piece(piece)
                    if piece in CONTRACTIONS:
                        inner[:-1] = range(1, len(piece))
                    found += [done + c for c in inner]
                    done += inner[-1]
                counts += found[1:] if blanks else found
        return np.diff(np.array([0, *counts], np.int64)).astype("<i2").tobytes()

    def _plain(self, text: str) -> Iterator[bytes]:
        start = 0
        while start < len(text):
            m = CUT.search(text, start + CHUNK_CHARS) if len(text) - start > CHUNK_CHARS else None
            end = m.start() if m else len(text)
            units = UNIT.findall(text, start, end)
            cache = self.units
            fresh = {}
            for unit in set(units).difference(cache):
                known = self.old.get(unit) or self._unit(unit)
                (cache if len(unit) <= 32 else fresh)[unit] = known
            yield b"".join([cache[u] if u in cache else fresh[u] for u in units] if fresh else map(cache.__getitem__, units))
            if len(cache) > CACHED_UNITS:
                self.old, self.units = cache, {}
            start = end

    def differences(self, text: str) -> np.ndarray:
        """For each code point, by how much the prefix that ends with it counts more than the one before."""
        if not self.special or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(self._plain(text)), "<i2")
        out, start = [], 0
        for m in self.special_re.finditer(text):
            inside = np.frombuffer(b"".join(self._plain(text[start : m.end() - 1])), "<i2")
            # only the whole string is one special token; what stands before it is then cut off there
            out += [inside, np.array([1 - int(inside[m.start() - start :].sum())], "<i2")]
            start = m.end()
        return np.concatenate([*out, np.frombuffer(b"".join(self._plain(text[start:])), "<i2")])


    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Differences of texts without special strings, whose only white space is ASCII: Arrow finds the different units."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        blank = ASCII_BLANK[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[bounds] = True
        offsets = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
        different = pc.dictionary_encode(units)
        words = different.dictionary
        place = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        missing = words.filter(pa.array(place < 0))
        if len(missing):
            place[place < 0] = len(self.known) + np.arange(len(missing))
            more = [np.frombuffer(self._unit(w.decode(errors="replace")), "<i2") for w in missing.to_pylist()]
            self.known = pa.concat_arrays([self.known, missing])
            self.flat, self.sizes = np.concatenate([self.flat, *more]), np.concatenate([self.sizes, [len(m) for m in more]])
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place]
        of = different.indices.to_numpy()
        ends = np.cumsum(sizes[of])
        shift = (starts[of] - (ends - sizes[of])).astype(np.int32)  # a group's places fit 32 bits
        out = self.flat[np.repeat(shift, sizes[of]) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        stops = np.concatenate([[0], ends])[np.searchsorted(offsets, bounds)]
        if len(self.known) > KNOWN_UNITS or len(self.flat) > 16 * KNOWN_UNITS:  # begin anew with the units just met
            short = np.flatnonzero(sizes <= MOST_CHARS)
            take = np.repeat(starts[short] - (np.cumsum(sizes[short]) - sizes[short]), sizes[short]) + np.arange(int(sizes[short].sum()))
            self.known, self.flat, self.sizes = words.take(pa.array(short)), self.flat[take], sizes[short]
        return np.split(out, stops[1:-1])

    def all_differences(self, texts: list[bytes]) -> list[np.ndarray]:
        """As differences() of each text; texts of the common kind are taken together."""
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special_bytes) or any(s in text for s in WIDE_BLANKS) or (b"\xe2\x80" in text and WIDE_BLANK.search(text)):
                out[i] = self.differences(text.decode(errors="replace"))
                continue
            group.append(i)
            held += len(text)
            if held >= GROUP_BYTES:
                for k, found in zip(group, self._together([texts[k] for k in group])):
                    out[k] = found
                group, held = [], 0
        if group:
            for k, found in zip(group, self._together([texts[k] for k in group])):
                out[k] = found
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _counted(path: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column(1).to_pylist()
    diffs = counter(path).all_differences(texts)
    total = [int(d.sum(dtype=np.int64)) for d in diffs]
    arrays = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(total, pa.int64()), pa.array([d.tobytes() for d in diffs], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "differences"])


def prefix_counts(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, differences (two bytes a code point, little-endian).

    The running sum of differences is the token count of each prefix, as the file's
    own library gives it without added tokens; special strings are one token each.
    Null is empty and has no prefix but the empty one. Other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.select(F.col("doc_id").cast("long"), text_column(text)).mapInArrow(over_batches(partial(_counted, path)), "doc_id long, n_bytes long, n_tokens long, differences binary")


def _fitting(limit: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    fits = []
    for d in batch.column(3):
        counts = np.cumsum(np.frombuffer(d.as_py(), "<i2"), dtype=np.int64)
        within = np.flatnonzero(counts <= limit)
        fits.append(int(within[-1]) + 1 if len(within) else 0)
    total = batch.column(2)
    over = [n > limit for n in total.to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), total, pa.array(over), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])


def within_budget(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """From stored counts: n_tokens, over_limit, and fit_chars, the code points of the longest prefix of at most limit tokens."""
    return counts.select("doc_id", "n_bytes", "n_tokens", "differences").mapInArrow(over_batches(partial(_fitting, limit)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def count_corpus(docs: DataFrame, limit: int = LIMIT, path: str | None = None, text: str = "text") -> DataFrame:
    """Store every prefix's count, then answer the budget question from the stored table."""
    return within_budget(stored(prefix_counts(docs, path, text), "prefix-counts"), limit)
