"""What the operators of this subpackage share: stored tables, folds and text buffers of Arrow batches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that vectorised code takes at once; a longer document is a piece of its own.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse's."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/llm"


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once for each Python worker and kept for its later tasks."""
    shelf = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in shelf:
        shelf[name] = make()
    return shelf[name]


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) that depends on nothing but the values of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def text_buffer(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch and where each begins (one entry more than rows); null is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, places.astype(np.int64)


def row_ranges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` in total size; every range has at least one row."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) over a batch, about ``limit`` bytes at a time."""
    data, places = text_buffer(batch, column)
    for i, j in row_ranges(np.diff(places), limit):
        yield i, j, data[places[i] : places[j]], places[i : j + 1] - places[i]


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that is no column yet."""
    while name in columns:
        name += "_"
    return name


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: object) -> pa.RecordBatch:
    """The ``keep`` columns of a batch and new ones."""
    arrays = {name: batch.column(name) for name in keep}
    arrays.update({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in new.items()})
    return pa.RecordBatch.from_pydict(arrays)
