"""Where models are plugged in: a model is loaded once a task and run over rows; a row that fails gives its error, never a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxframe.workspace import small_batches

#: Results of the kinds of models.
SEGMENTS = "idx long, text string, seg_start double, seg_end double"
TURNS = "speaker int, t_start double, t_end double"
SAMPLES = "samples array<float>"
VECTOR = "vector array<float>"


def infer(rows: DataFrame, key: list[str], load: Callable[[], Callable[[dict[str, Any]], list[dict[str, Any]]]], result: str, batch: int = 16) -> DataFrame:
    """key, the result's columns, error: load() gives a function from a row, as a dict, to result rows.

    A row whose model raises gives one row with the error and nulls; a row without results gives none.
    """
    kept = rows.select(*key).schema
    own = T.StructType.fromDDL(result)
    schema = T.StructType([*kept.fields, *[T.StructField(f.name, f.dataType) for f in own.fields], T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            out = []
            for row in b.to_pylist():
                at = {k: row[k] for k in key}
                try:
                    model = model or load()
                    out += [at | r | {"error": None} for r in model(row)]
                except Exception as e:  # isolates the file, as the caller sees its error
                    out.append(at | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in out], arrow)

    small_batches(rows.sparkSession, batch)
    return rows.mapInArrow(run, schema)
