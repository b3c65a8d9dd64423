"""Helpers shared by the operators: the library's storage, and vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import delete, fewer, keep, shared_dir

__all__ = ["SPACES", "WORD", "ascii_lower", "delete", "fewer", "keep", "mix", "run_hashes", "shared_dir", "small_batches", "text_chunks", "word_hashes"]

#: The ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = "67108864b"  # its default


def small_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches in its session get 4 MB at most, unless the session has a bound of its own.

    A batch is held several times over on its way through a worker, by each of an executor's tasks.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == _SPARKS_OWN:
        conf.set(_BATCH, "4m")
    return df


# ---- vectorised words -------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[list(SPACES)] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.ones(64, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n or _POWERS[1] == 1:
        p = np.full(max(n, 64), _ODD, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def text_chunks(column: pa.Array, most: int = 1 << 19):
    """Splits an Arrow string column into runs of rows of about `most` bytes.

    Yields (first row, row after the last, bytes, offsets into them); nulls are empty. One text
    longer than `most` makes a run of its own.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in texts laid end to end, and the first word of each text (n+1 numbers)."""
    return run_hashes(_LOWER[data] if lower else data, offsets, _WORD.view(np.uint8))


def run_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, of the longest runs of bytes of one class; class 0 separates."""
    kind = classes[data]
    if not kind.any():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.empty(len(data), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    inner = offsets[:-1]
    start[inner[inner < len(data)]] = True
    inside = kind != 0
    start &= inside
    at = np.flatnonzero(start)
    packed = data[inside]
    begin = np.flatnonzero(start[inside])
    lengths = np.diff(np.append(begin, len(packed)))
    place = np.arange(len(packed)) - np.repeat(begin, lengths)
    values = (packed.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64)), np.searchsorted(at, offsets)
