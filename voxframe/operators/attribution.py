"""Who speaks: interval overlap of segments with diarized turns, and folding of runs of one speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import local_label
from voxframe.functions.vectors import overlap

#: Seconds of a bin of the interval join. Places to which sums of seconds are rounded where their order decides, so that equal sums tie in whatever order they were added.
BIN, PLACES = 60.0, 6


def _binned(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(start), F.col(end)) / BIN))))


def overlaps(pieces: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the speaker with most overlap (ties: the lowest), of pieces with p_start, p_end in the same file.

    Both sides are cut into bins, so a long file is spread over tasks; a pair is counted in the bin where its common part begins.
    """
    p = _binned(pieces.select("file_id", *keys, "p_start", "p_end"), "p_start", "p_end")
    t = _binned(turns.select("file_id", "speaker", "t_start", "t_end"), "t_start", "t_end")
    both = p.join(t, ["file_id", "_bin"]).where((F.col("t_start") < F.col("p_end")) & (F.col("t_end") > F.col("p_start")) & (F.col("_bin") == F.floor(F.greatest("t_start", "p_start") / BIN)))
    weight = both.groupBy("file_id", *keys, "speaker").agg(F.sum(overlap(F.col("p_start"), F.col("p_end"), F.col("t_start"), F.col("t_end"))).alias("w"))
    return weight.groupBy("file_id", *keys).agg(F.max_by("speaker", F.struct(F.round("w", PLACES), -F.col("speaker"))).alias("speaker"))


def assign_speakers(segments: DataFrame, turns: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """file_id, idx, label: words vote first, by seconds; segments none of whose words overlap a turn are matched whole."""
    whole = overlaps(segments.select("file_id", "idx", F.col("seg_start").alias("p_start"), F.col("seg_end").alias("p_end")), turns, ["idx"])
    if words is None:
        return whole.select("file_id", "idx", local_label(F.col("speaker")).alias("label"))
    w = words.select("file_id", "idx", F.col("w_start").alias("p_start"), F.col("w_end").alias("p_end"))
    by_word = overlaps(w, turns, ["idx"])
    both = by_word.unionByName(whole.join(by_word, ["file_id", "idx"], "left_anti"))
    return both.select("file_id", "idx", local_label(F.col("speaker")).alias("label"))


def fold_runs(segments: DataFrame, key: str) -> DataFrame:
    """file_id, block, speaker, start, body: runs of one speaker by idx; empty texts join a run and never begin a block."""
    by = Window.partitionBy("file_id").orderBy("idx")
    new = F.when(F.lag(key).over(by).eqNullSafe(F.col(key)), 0).otherwise(1)
    runs = segments.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by)).where(F.col("text") != "")
    blocks = runs.groupBy("file_id", "_run").agg(F.first(key).alias("speaker"), F.min_by("seg_start", "idx").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("body"))
    return blocks.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("_run")).alias("block"), "speaker", "start", "body")
