"""Arrow batches inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows and bytes (or list items) that a worker takes at a time; a longer row comes alone.
STEP_ROWS, STEP_SIZE = 256, 1_000_000


def small_batches(batch: pa.RecordBatch, column: str, rows: int = STEP_ROWS, size: int = STEP_SIZE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that are small in rows and in what the column (string, binary or list) holds."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    begin, total = 0, 0
    for k, n in enumerate(pc.fill_null(length(values), 0).to_pylist()):
        if k > begin and (total + n > size or k - begin >= rows):
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if batch.num_rows:
        yield batch.slice(begin)


def flat_text(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins (with the end at last); null is empty."""
    values = pc.fill_null(values, "")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], names=[*kept, *columns])


def wider(df: DataFrame, extra: list[T.StructField]) -> T.StructType:
    """The schema with the extra fields at its end, in place of fields of the same names."""
    names = {f.name for f in extra}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *extra])
