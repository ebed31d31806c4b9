"""Numpy views of Arrow text columns, shared by the text operators.

Texts stay one UTF-8 byte buffer with offsets; a batch is cut into slices of a few MB, so that the
working arrays of a task stay small however many rows or bytes Spark hands over at a time.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 19
#: Frees what operators remember in a Python worker.
releases: list[Callable[[], None]] = []
_MUL = 0x9E3779B97F4A7C15
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
_task: list[int] = []
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, ...)`` with texts going to Python a few MB at a time, unless the session says otherwise.

    Spark's own bound, 64 MB a batch, is held twice by the executor and once by the worker.
    """

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        if spark.conf.get(_BATCH, None) is None:
            spark.conf.set(_BATCH, _BATCH_BYTES)
        return query(spark, *args)

    return run


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back(keeps: bool = False) -> None:
    """At a task's start, returns freed memory to the machine, and unless ``keeps`` holds what operators remember.

    Workers outlive tasks and stages: an executor's memory is the sum of what its workers hold on to.
    """
    task = TaskContext.get()
    now = [task.taskAttemptId()] if task else []
    if now == _task:
        return
    _task[:] = now
    if not keeps:
        for release in releases:
            release()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = at[0]
    if column.null_count:
        size = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if (size != np.diff(at)).any():  # a null that still has bytes below it
            return utf8(column.fill_null(""))
    return whole[first : at[-1]], at - first


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about ``limit`` bytes of ``column`` (one row at least).

    What earlier tasks left in this worker is freed first, but for the memories of operators if ``keeps`` holds.
    """
    give_back(keeps)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: One 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


releases.append(_powers.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the rolling base modulo 2^64, and their inverses; kept for the next call."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        if n > 16 * SLICE_BYTES:  # one very long text: not kept
            return out[0][: n + 1], out[1][: n + 1]
        _powers[:] = out
    return _powers[0][: n + 1], _powers[1][: n + 1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit rolling hashes of data[start:end], the same for equal bytes at any place."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Spans of up to so many bytes are hashed together, 8 bytes at a time; longer ones one by one.
_CHUNKED = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] that follow no algebra: no kind of text makes different spans meet.

    (A polynomial modulo 2^64, as in ``range_hashes``, gives some pairs of strings of 512 bytes and more one value
    whatever its base.) For spans that do not overlap, such as words and lines: each byte is read once.
    """
    size = ends - starts
    out = mixed(size.astype(np.uint64) * np.uint64(_MUL) + np.uint64(_BASE))
    if len(data):
        padded = np.append(data, np.zeros(8, np.uint8))
        eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))  # the 8 bytes from each place on
        left = np.flatnonzero((size > 0) & (size <= _CHUNKED))
        at = 0
        while len(left):
            rest = np.minimum(size[left] - at, 8).astype(np.uint64)
            chunk = eight[starts[left] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
            out[left] = mixed((out[left] ^ chunk) * np.uint64(_MUL) + np.uint64(at + 1))
            at += 8
            left = left[size[left] > at]
    for k in np.flatnonzero(size > _CHUNKED):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def first_bytes(offsets: np.ndarray, n: int) -> np.ndarray:
    """Marks the first byte of each text that has one."""
    out = np.zeros(n + 1, bool)
    out[offsets[:-1]] = True
    out[n] = True
    return out


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``member`` holds, cut where a text ends."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = first_bytes(offsets, n)[:n]
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (edge | ~before))
    after = np.zeros(n, bool)
    after[:-1] = member[1:] & ~edge[1:]
    return starts, np.flatnonzero(member & ~after) + 1


def owners(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The row of the text in which each place lies."""
    return np.searchsorted(offsets, places, "right") - 1


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n consecutive word hashes; shorter than ``words`` by n - 1."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(_BASE) + words[k : k + size]
    return mixed(out)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
