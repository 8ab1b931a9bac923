"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the ASCII white space [\x20\x09-\x0D], which bytes.split() also uses
ASCII_SPACE = "\t\n\x0b\x0c\r "

#: A key that holds at least 1/HOT_SHARE of all rows is hot. There are at most HOT_SHARE such keys, so they may be broadcast.
HOT_SHARE = 4096


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, or ``base`` with underscores, such that no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def plain_names(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The table with all columns but ``keep`` called c0, c1, ..., so that a table made from it can have any other names."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else f"c{k}") for k, c in enumerate(df.columns)])


def own_names(df: DataFrame, like: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns of ``like`` from a table made from ``plain_names(like)``."""
    return df.select(*[F.col(c if c in keep else f"c{k}").alias(c) for k, c in enumerate(like.columns)])


def shuffle_width(df: DataFrame) -> int:
    """Partitions of a shuffle; operators deal packed rows to as many buckets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; a null is the empty text."""
    for text in column:
        yield (text.as_py() or "").encode()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, for work that needs several times the memory of its rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def release() -> None:
    """Give the memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the task's worker, which waits for its next task, holds no freed memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def texts(column: pa.Array) -> list[str]:
    """The texts; a null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_of(covered: np.ndarray) -> np.ndarray:
    """Maximal runs of true as rows (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places lie in one of the runs."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + lengths, n), -1)
    return np.cumsum(steps[:n]) > 0


#: Rows of one kind on their way to a bucket, packed into one value.
PACKED = "bucket int, payload binary"


def pack_rows(bucket: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Structured rows packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bounds = rows[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
    return pa.record_batch(
        [pa.array(used, pa.int32()), pa.array([rows[bounds[b] : bounds[b + 1]].tobytes() for b in used], pa.binary())], ["bucket", "payload"]
    )


def unpack_rows(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    """All rows of a task's buckets."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(raw, kind) for b in batches for raw in b.column("payload").to_pylist())])


def group_starts(rows: np.ndarray, keys: tuple[str, ...]) -> np.ndarray:
    """First row of each run of equal keys."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= rows[k][1:] != rows[k][:-1]
    return np.flatnonzero(new)
