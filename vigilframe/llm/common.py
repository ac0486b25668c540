"""Shared helpers: tables, stable intermediate results, and words of whole Arrow columns as numpy arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.operators.loops import shared_dir

# Bytes of text that one numpy pass takes; a longer single text is one pass of its own.
PASS_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACED = np.ones(256, dtype=bool)
_SPACED[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: computed once, and a lost executor costs no more than a reread."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % folds


def pieces(batch: pa.RecordBatch, column: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold at most ``limit`` bytes, or one row."""
    ends = flat(batch.column(batch.schema.get_field_index(column)))[1]
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield batch.slice(row, min(stop, rows) - row)
        row = min(stop, rows)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each starts (one more entry for the end). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return _LOWER[data]


class Words:
    """Words of many texts. ``start``/``end``: byte places; ``per_text``: words of each text; ``first``: index of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alnum: bool):
        inside = (_ALNUM if alnum else _SPACED)[data]
        n = len(data)
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.data = data
        self.start = np.flatnonzero(inside & (~before | fresh[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        bounds = np.searchsorted(self.start, offsets)
        self.first, self.per_text = bounds[:-1], np.diff(bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_text)), self.per_text)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word that depends on its bytes only."""
        return spans_hash(self.data, self.start, self.end)


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(n, 2).bit_length()
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size > 8 * PASS_BYTES:  # one unusually long text: not kept
            return have
        _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, len(data))[: len(data)], out=sums[1:])
    return sums


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    if sums is None:
        sums = prefix_hash(data)
    body = (sums[end] - sums[start]) * powers(_INVERSE, len(data) + 1)[start]
    return mixed(body + (end - start).astype(np.uint64))


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + n]
    return mixed(total)


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its stage, beside those of the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it sees to that itself
        pass


def released(function: Callable) -> Callable:
    """``function`` over batches, which leaves no freed memory behind when it has ended."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            trim()

    return run
