"""Windows over the samples of recordings that come in chunks, and the analysis of reference clips from them.

Windows cross chunks. A recording is cut into cells, each a fixed number of windows, and a chunk sends each cell the samples that the cell's windows hold: a cell has its own samples and a halo of
the next ones. A recording of any length is so spread over tasks, a task holds a cell, and the windows are the same however the chunks are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators import inference, levels
from voxframe.workspace import write_table

#: Windows that begin in a cell, at least.
CELL = 8


def windows_of(chunks: DataFrame, key: str, width: int, hop: int) -> DataFrame:
    """key, begin (first sample), samples of each whole window; a recording of one window or less has one window of what is there. chunks: key, first (place of its first sample), samples.

    Null and empty chunks hold nothing, and a recording without samples has no window. A chunk that is missing or comes twice is an error.
    """
    if width < 1 or hop < 1:
        raise ValueError("windows and hops of one sample or more")
    cell = hop * max(CELL, -(-width // hop))
    extent = cell - hop + width  # from the cell's first sample to the end of its last window
    a, b = F.col("first"), F.col("first") + F.size("samples")
    rows = chunks.where(F.size("samples") > 0).select(F.col(key).alias("_key"), F.col("first").cast("long").alias("first"), "samples")
    low, high = F.greatest(F.floor((a - extent) / cell) + 1, F.lit(0)), F.floor((b - 1) / cell)
    rows = rows.select("*", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))).alias("_cell"))
    start, end = F.greatest(a, F.col("_cell") * cell), F.least(b, F.col("_cell") * cell + extent)
    part = F.slice("samples", (start - a + 1).cast("int"), (end - start).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(start.alias("at"), part.alias("x"))))
    cells = rows.where(start < end).groupBy("_key", "_cell").agg(parts.alias("_parts")).select("_key", (F.col("_cell") * cell).alias("_at"), "_parts", F.flatten(F.transform("_parts", lambda p: p["x"])).alias("_x"))
    last = F.element_at("_parts", -1)
    whole = (F.element_at("_parts", 1)["at"] == F.col("_at")) & (last["at"] + F.size(last["x"]) == F.col("_at") + F.size("_x"))
    checked = F.when(whole, F.sequence(F.lit(0), F.lit(cell - hop), F.lit(hop))).otherwise(F.raise_error(F.concat(F.lit("a chunk is missing or comes twice: "), F.col("_key").cast("string"))).cast("array<int>"))
    found = cells.select("_key", "_at", "_x", F.explode(checked).alias("_off"))
    found = found.select(F.col("_key").alias(key), (F.col("_at") + F.col("_off")).alias("begin"), F.slice("_x", F.col("_off") + 1, F.lit(width)).alias("samples"))
    return found.where((F.size("samples") == width) | (F.col("begin") == 0))


def rms_of(samples: Column | str) -> Column:
    """The root of the mean square of an array."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.size(samples))


def analyse(chunks: DataFrame, key: str, load: Callable[[], Callable[[dict], list[dict]]], *, rate: int = 16_000, window: float = 4.0, hop: float = 2.0, least: float = levels.LEAST_SPEECH, coherent: float = levels.COHERENT) -> DataFrame:
    """key, windows, duration, coherence, usable, problem of each recording, as levels.analyse_clips, with the problem "empty" where there are no samples. chunks are as in windows_of, at this rate.

    Only windows at or above their recording's gate come to the model, which gives rows with a vector (inference.VECTOR); a window whose model fails counts as not embedded. Windows
    are written once, as levels, gates and model read them.
    """
    spans = windows_of(chunks, key, int(window * rate), int(hop * rate)).withColumnRenamed(key, "clip")
    spans = write_table(spans.select("clip", "begin", "samples", rms_of("samples").alias("level")), "windows")
    loud = spans.join(levels.gates(spans.select("clip", "level"), "clip").select("clip", "gate"), "clip").where(F.col("level") >= F.col("gate"))
    vectors = inference.infer(loud.select("clip", "begin", "samples"), ["clip", "begin"], load, inference.VECTOR)
    vectors = vectors.select("clip", "begin", F.col("vector").cast("array<double>").alias("vector"))
    bare = spans.select("clip", "begin", (F.col("begin") / rate).alias("start"), ((F.col("begin") + F.size("samples")) / rate).alias("end"), "level")
    embedded = write_table(bare.join(vectors, ["clip", "begin"], "left").drop("begin"), "embedded")
    found = levels.analyse_clips(embedded, window=window, hop=hop, least=least, coherent=coherent).withColumnRenamed("clip", key)
    none = chunks.select(key).distinct().join(found, key, "left_anti")
    empty = none.select(key, *[F.lit(x).cast(found.schema[c].dataType).alias(c) for c, x in (("windows", 0), ("duration", 0.0), ("coherence", 0.0), ("usable", False), ("problem", "empty"))])
    return found.unionByName(empty)
