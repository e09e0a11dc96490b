"""Shared pieces: intermediates in the scratch folder, folds, batches, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.iterate import components as connected_components
from trailweave.operators.iterate import discard, scratch_path
from trailweave.operators.iterate import settled as materialize

__all__ = ["binary_list", "connected_components", "crc", "discard", "fold_of", "materialize", "open_fs", "released", "scratch_path", "slices", "small_or_shuffled", "word_hashes"]

#: A side is broadcast only when it has at most so many rows; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Words whose hashes a worker keeps, about.
CACHED_WORDS = 200_000
_WORDS: dict[bytes, int] = {}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that Python workers can use for a shared folder, and the path in it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds


def binary_list(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, through one cache of bounded size in a worker."""
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    get, out = _WORDS.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, "u8")


def released() -> None:
    """Give memory that is free back to the system; a worker that is reused keeps no more than it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int = 256, limit: int = 4 << 20):
    """Cut a batch so that one slice holds few rows and, but for single rows, few bytes."""
    sizes = [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            for i, n in enumerate(pc.binary_length(column).to_pylist()):
                sizes[i] += n or 0
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or total + n > limit):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
