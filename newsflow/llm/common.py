"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import materialize

FILES_PER_CORE = 4


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for tables that follow a shuffle: no more than a few
    files per core of the cluster, however many shuffle partitions there are."""
    return materialize(df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism), name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that the table does not use (Spark
    compares names without case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def key_runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Cut sorted batches so that every batch given out holds whole runs of
    equal (non-NULL, integer) keys. What is held over is one run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[0].as_py() == k[-1]:
            held.append(batch)  # one run over all of it
            continue
        cut = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
        if held or cut:
            yield joined([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    batches = [b for b in batches if b.num_rows] or batches[:1]
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def utf8_of(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL as empty."""
    a = batch_column.fill_null("") if batch_column.null_count else batch_column
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    if data is None or not len(a):
        return np.empty(0, np.uint8), offsets - offsets[:1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


_OWNER: list = [None, {}]


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as this Python worker runs tasks of one
    operator: workers are reused, and what another operator kept is dropped."""
    if _OWNER[0] != owner:
        _OWNER[0], _OWNER[1] = owner, {}
        pa.default_memory_pool().release_unused()
    return _OWNER[1]
