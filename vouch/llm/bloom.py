"""Bloom filters over 64-bit hashes, built by segments in tasks and broadcast whole.

A filter has SLOTS_PER_ROW slots for each row, and MOST_SLOTS at most (32 MiB when broadcast): with more rows it lets
more through, and what it lets through is always checked again, so its size never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import arrow_schema

#: Filter slots for each row, how many of them a row sets, and the slots of a filter at most (one bit each).
SLOTS_PER_ROW, PROBES, MOST_SLOTS = 16, 3, 1 << 28
SEGMENT = 1 << 16
#: Rows whose slots a task gathers before it sends them, by segment.
MARKED = 1 << 18
_SEGMENT_DDL = "segment int, slots binary, again binary"


def _slots(h: np.ndarray, mask: int) -> np.ndarray:
    """PROBES slots of each hash, a row each (double hashing)."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) & np.uint64(mask)).astype(np.int64) for i in range(PROBES)])


def _mark(mask: int):
    schema = arrow_schema(_SEGMENT_DDL)

    def marks(h: np.ndarray) -> pa.RecordBatch:
        # a row that names a slot twice still counts once there
        rows = np.sort(_slots(h, mask), axis=0)
        fresh = np.vstack([np.ones((1, rows.shape[1]), bool), rows[1:] != rows[:-1]])
        slots, counts = np.unique(rows[fresh], return_counts=True)
        segments, starts = np.unique(slots // SEGMENT, return_index=True)
        within = (slots % SEGMENT).astype(np.uint16)
        ends = np.append(starts[1:], len(slots))
        columns = [
            pa.array(segments.astype(np.int32)),
            pa.array([within[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            pa.array([within[a:b][counts[a:b] > 1].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        ]
        return pa.record_batch(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            n += len(batch)
            if n >= MARKED:
                yield marks(np.concatenate(held))
                held, n = [], 0
        if n:
            yield marks(np.concatenate(held))

    return run


def _merge(least: int):
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(SEGMENT, np.uint8)
        for slots, again in zip(part["slots"], part["again"], strict=True):
            for found in (slots, again):
                at = np.frombuffer(found, np.uint16)
                counts[at] = np.minimum(counts[at] + 1, 2)
        return pd.DataFrame({"segment": [part["segment"].iloc[0]], "marked": [np.packbits(counts >= least).tobytes()]})

    return merge


def marked(hashes: DataFrame, n_rows: int, least: int = 1, most_slots: int = MOST_SLOTS) -> Callable[[Column], Column]:
    """A test of hashes (the one column of the table, without nulls): false only for those that fewer than `least` (1 or 2) rows have."""
    n_slots = min(max(SEGMENT, 1 << (max(1, n_rows) * SLOTS_PER_ROW - 1).bit_length()), max(SEGMENT, most_slots))
    marks = hashes.mapInArrow(_mark(n_slots - 1), _SEGMENT_DDL)
    merged = marks.groupBy("segment").applyInPandas(_merge(least), "segment int, marked binary")
    bits = np.zeros(n_slots // 8, np.uint8)  # MOST_SLOTS / 8 bytes at most, at any input size
    for row in merged.collect():  # one job, where an iterator takes one for each partition
        bits[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.marked, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        slots = _slots(h.to_numpy(), n_slots - 1)
        return pd.Series(((shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=0))

    return probe


def without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose key (64 bits, never null) and doc_id stand in `dropped` (key, doc_id: a written table).

    Only rows that may be there are shuffled; the others pass straight through.
    """
    maybe = marked(dropped.select("key"), dropped.count())(key)
    named = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), maybe.alias("maybe"))
    asked = named.filter("maybe").alias("a")
    left = asked.join(dropped.alias("d"), (F.col("a.key") == F.col("d.key")) & F.col("a.row.doc_id").eqNullSafe(F.col("d.doc_id")), "left_anti")
    return left.select("row.*").unionByName(named.filter(~F.col("maybe")).select("row.*"))
