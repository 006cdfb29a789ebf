"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir`` (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's shared checkpoint folder and read it
    from there, so that later passes and lost executors recompute nothing.

    Shuffle files of earlier passes are removed once the driver collects its
    garbage, and Python lets go of the plans that use them; both are asked to
    here, as rounds of passes would pile the files up."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def id_hash(col: str | Column) -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"),
                              F.lit("null")).cast("binary"))


def release() -> None:
    """Give freed memory back to the system: an idle Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20
                 ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into pieces of about ``max_bytes`` of ``column``.

    Yields (piece, buffer, offsets): the UTF-8 bytes of the column as one
    uint8 array and ``len(piece) + 1`` offsets into it; a null text has no
    bytes. A single longer text is a piece of its own. Behind the last piece
    the worker's freed memory is released.
    """
    try:
        for batch in batches:
            if batch.num_rows:
                yield from _cut(batch, column, max_bytes)
    finally:
        release()


def _cut(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8))
    cuts, start, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > max_bytes:
            cuts.append((start, i))
            start, held = i, 0
        held += n
    cuts.append((start, len(col)))
    for a, b in cuts:
        part = col.slice(a, b - a)
        offs = np.frombuffer(part.buffers()[1], np.int64, b - a + 1, (part.offset) * 8)
        data = part.buffers()[2]
        buf = (np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and offs[-1] > offs[0]
               else np.zeros(0, np.uint8))
        offs = offs - offs[0]
        if part.null_count:  # a null slot may still span bytes
            valid = np.asarray(part.is_valid())
            lens = np.diff(offs)
            if lens[~valid].any():
                keep = np.repeat(valid, lens)
                buf = buf[keep]
                offs = np.concatenate([[0], np.cumsum(np.where(valid, lens, 0))])
        yield batch.slice(a, b - a), buf, offs


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche 64-bit finalizer (wrapping uint64 arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: odd multiplier of the polynomial hashes
BASE = 0x9E3779B97F4A7C55


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for ``i < n``."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial hash of ``values[s:e]`` for every range, from prefix sums.

    ``sum(values[i] * base**(i - s))`` modulo 2**64, finalized: equal content
    gives equal hashes wherever it stands. ``base`` is odd.
    """
    n = len(values)
    pre = np.zeros(n + 1, np.uint64)
    pre[1:] = powers(base, n)
    pre[1:] *= values
    np.cumsum(pre, out=pre)
    h = pre[ends] - pre[starts]
    del pre  # eight times the text: not held beside the next array
    h *= powers(pow(base, -1, 1 << 64), n + 1)[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes that never cross a text's end.

    ``is_word`` is a 256-entry boolean table. Returns (starts, ends, doc) of
    every run, in order.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = m[inner]
    starts = np.flatnonzero(first)
    last = m.copy()
    last[:-1] &= ~m[1:]
    last[inner - 1] = m[inner - 1]
    ends = np.flatnonzero(last) + 1
    doc = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, doc
