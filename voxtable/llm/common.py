"""What the operators share: stored intermediates, byte-level words, folds and Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.session import shared_folder

#: ASCII white space, as the contracts write it: \x20 and \x09-\x0D. bytes.split() cuts at exactly these.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of a text that are turned into Python words at one time.
CHUNK = 1 << 22


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/corpus/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(bytearray()))


def fold_column(parts: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % parts


def fold(doc_id, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def chunks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text in pieces of about size bytes, cut in front of ASCII white space only."""
    start, end = 0, len(text)
    while end - start > size:
        cut = min((p for p in (text.find(b, start + size) for b in (bytes([c]) for c in SPACE)) if p >= 0), default=end)
        yield text[start:cut]
        start = cut
    yield text[start:end]


def give_back() -> None:
    """Freed memory goes to the system: a worker lives on beside the executor's heap, and the allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


#: Rows that a worker takes at one time; an Arrow batch may have more.
SLICE_ROWS = 2500


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows; freed memory goes back in between."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def over_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = SLICE_ROWS):
    """A mapInArrow function from one that maps a batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return run
