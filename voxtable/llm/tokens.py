"""Token ids of documents by a tokenizer file that drops white space, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import give_back, over_batches, text_column

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words kept with their ids; when there are more, only those of the latest texts stay. Words of many ids are not among them.
KNOWN_WORDS, MOST_IDS = 1_000_000, 64
#: Bytes of texts whose words are looked up together.
GROUP_BYTES = 1 << 22
#: UTF-8 of a to z and of the letters from U+00C0 to U+024F, but for the one whose lower case is two characters.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")


#: Marks that are a piece of their own behind a letter or digit and before white space.
MARK = np.isin(np.arange(256), list(b".,;:!?"))
PLAIN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def apart(text: bytes, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lower-cased text with a space in front of such marks, which changes no id and makes words meet again; the bounds moved along."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(MARK[raw])
    at = at[at > 1]
    before = raw[at - 1]
    accented = (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7) & (raw[at - 2] == 0xC3)
    ends = at + 1 == len(raw)
    behind = raw[np.minimum(at + 1, len(raw) - 1)]
    at = at[(PLAIN[before] | accented) & (ends | BLANK[behind])]
    return (np.insert(raw, at, 32).tobytes() if len(at) else text), bounds + np.searchsorted(at, bounds)


class WordEncoder:
    """The library's ids of texts. A word's ids don't depend on what stands around its white space, so they are kept.

    Many texts are taken together: Arrow cuts them into words and finds the
    different ones and those that are known; only new words go to the library, and
    an indexed read puts the ids together. The known words and their ids are flat
    arrays, so a million of them take little room.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.many = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = pa.array([b""], pa.binary())
        self.flat, self.sizes = np.zeros(0, f"<u{self.width}"), np.zeros(1, np.int64)

    def _each(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.many([w.decode(errors="replace") for w in words], add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words of lower-case letters, in one call; word by word where the ends don't fit."""
        ids = np.array(self.many([b" ".join(words).decode()], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words):
            return ids, np.diff(ends, prepend=0)
        found = self._each(words)
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)

    def _new(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words in another order, their ids and sizes."""
        plain, other = [], []
        for w in words.to_pylist():
            (plain if w.isalpha() or LETTERS.fullmatch(w) else other).append(w)
        ids, sizes = self._letters(plain) if plain else (np.zeros(0, self.flat.dtype), np.zeros(0, np.int64))
        more = self._each(other)
        return pa.array([*plain, *other], pa.binary()), np.concatenate([ids, *more]), np.concatenate([sizes, np.array([len(m) for m in more], np.int64)])

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts, none with a special token's string."""
        text, bounds = apart(b"\n".join([*texts, b""]).lower(), np.cumsum([0, *[len(t) + 1 for t in texts]]))
        cut = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)]))
        counts = np.diff(cut.offsets.to_numpy())
        different = pc.dictionary_encode(cut.values.view(pa.binary()))
        words = different.dictionary
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).copy()
        missing = words.filter(pa.array(place < 0))
        if len(missing):
            more, ids, sizes = self._new(missing)
            place[place < 0] = len(self.words) + pc.index_in(missing, value_set=more).to_numpy()
            self.words = pa.concat_arrays([self.words, more])
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        starts = (np.cumsum(self.sizes) - self.sizes)[place]
        sizes = self.sizes[place]
        of = different.indices.to_numpy()
        size, ends = sizes[of], np.cumsum(sizes[of])
        total = int(ends[-1]) if len(ends) else 0
        shift = (starts[of] - (ends - size)).astype(np.int32)  # a group's places fit 32 bits
        ids = self.flat[np.repeat(shift, size) + np.arange(total, dtype=np.int32)]
        stops = np.concatenate([[0], ends])[np.cumsum(counts)] * self.width
        raw = ids.tobytes()
        if len(self.words) > KNOWN_WORDS or len(self.flat) > 8 * KNOWN_WORDS:  # begin anew with the words just met
            short = np.flatnonzero((sizes <= MOST_IDS))
            take = np.repeat(starts[short] - (np.cumsum(sizes[short]) - sizes[short]), sizes[short]) + np.arange(int(sizes[short].sum()))
            self.words, self.flat, self.sizes = words.take(pa.array(short)), self.flat[take], sizes[short]
        return [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned ids of `width` bytes of each text."""
        out: list[bytes] = [b""] * len(texts)
        group: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if b"<|" in text:  # may hold a special token, which must not be changed or cut
                out[i] = self._each([text])[0].tobytes()
                continue
            group.append(i)
            held += len(text)
            if held >= GROUP_BYTES or i + 1 == len(texts):
                for k, ids in zip(group, self._together([texts[k] for k in group])):
                    out[k] = ids
                group, held = [], 0
        if group:
            for k, ids in zip(group, self._together([texts[k] for k in group])):
                out[k] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def forget() -> None:
    """Drop this worker's encoders with their words: later stages run in the same worker and need the room."""
    encoder.cache_clear()
    give_back()


def document_ids(path: str, end_id: int | None, texts: list[bytes]) -> tuple[list[bytes], int]:
    """All ids of each text, with the end id behind them, and the bytes of one id: two where the vocabulary allows it."""
    known = encoder(path)
    end = b"" if end_id is None else end_id.to_bytes(known.width, "little")
    return [ids + end for ids in known.encode_all(texts)], known.width


def wide(ids: bytes, width: int) -> bytes:
    """Ids as unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _encoded(path: str, end_id: int | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    give_back()
    ids, width = document_ids(path, end_id, batch.column(1).to_pylist())
    arrays = [batch.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "width", "ids"])


def token_table(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, width, ids (binary, unsigned, little-endian, width bytes each, end id last). Null is empty."""
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.select(F.col("doc_id").cast("long"), text_column(text)).mapInArrow(over_batches(partial(_encoded, path, end_id)), "doc_id long, n_tokens long, width int, ids binary")
