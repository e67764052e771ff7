"""Arrow functions over tables whose columns may have any names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow, which resolves input columns by name and so can't take names with dots: they go in by number, and run sees their own names."""
    names = rows.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return numbered(rows).mapInArrow(renamed, schema)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with columns _0, _1 and so on, for the same reason."""
    return rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])
