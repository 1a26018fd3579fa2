"""What the training-data operators share: tables, the shared folder, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.session import ensure_package
from vouch.sources.stored import shared_folder

#: White space of the word rule: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: Rows that are worth a task of their own where a table is written whose size is known, and tasks at least.
ROWS_A_TASK, LEAST_TASKS = 1 << 16, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns can have any name."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def written(df: DataFrame, name: str, codec: str | None = None, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation. codec: Parquet's, else the session's.

    rows: about how many there are, where that is known; then a small table is not written in as many files as a shuffle has
    partitions. The number of tasks grows with it.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, math.ceil(rows / ROWS_A_TASK)))
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, least: int = 100, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups (written tables; groups have one row for each key, with the number of its rows).

    Groups of more than a thousandth of all rows are broadcast, as there are a thousand at most, so no task gets a large
    group; the others are joined by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > max(least, total / 1000)
    hot, key = groups.filter(is_hot), [key] if isinstance(key, str) else key
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(~is_hot), key, how))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose column holds about `most` bytes at most; a longer value stands alone."""
    values = batch.column(batch.schema.get_field_index(column))
    ends = offsets(values)[1:]
    at, n = 0, len(batch)
    while at < n:
        before = ends[at - 1] if at else offsets(values)[0]
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run (for mapInArrow), after which the Python worker gives freed memory back: workers idle on beside those of later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return tidied


def offsets(values: pa.Array) -> np.ndarray:
    """The byte offsets of a string or binary array, one more than it has values."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    raw = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32) if values.buffers()[1] else np.zeros(1, np.int64)
    return raw[values.offset : values.offset + len(values) + 1].astype(np.int64)


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the values, concatenated, and the offset at which each begins (and the last ends)."""
    at = offsets(values)
    data = np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]] if len(values) and values.buffers()[2] else np.zeros(0, np.uint8)
    return data, at - at[0]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
