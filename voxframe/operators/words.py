"""Words of recognised speech: tokens joined to words, their times, their confidence, and numbers of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The mark with which a token begins a word (U+2581). Fixed value.
MARK = "▁"


def from_tokens(tokens: DataFrame, keys: list[str], segment_end: str = "seg_end") -> DataFrame:
    """keys, w_pos, text, w_start, w_end, probability: from rows keys, pos, token, t_start, t_end, probability and the segment's end.

    A marked token begins a word, and so does the first; others are appended. Empty tokens and marks alone are passed over. A word has its
    tokens' lowest probability and latest end; if that isn't after its start, the next word's start, for the last word the segment's end.
    """
    by = Window.partitionBy(*keys).orderBy("pos")
    bare = F.when(F.startswith("token", F.lit(MARK)), F.substring("token", 2, 1 << 30)).otherwise(F.col("token"))
    rows = tokens.withColumn("_bare", bare).where("_bare <> ''")
    rows = rows.withColumn("_w", F.sum(F.when(F.startswith("token", F.lit(MARK)), 1).otherwise(0)).over(by))
    rows = rows.withColumn("_w", F.col("_w") - F.first("_w").over(by))
    piece = F.struct("pos", F.col("_bare").alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "")
    words = rows.groupBy(*keys, F.col("_w").alias("w_pos")).agg(joined.alias("text"), F.min_by("t_start", "pos").alias("w_start"), F.max("t_end").alias("w_end"), F.min("probability").alias("probability"), F.max(segment_end).alias("_end"))
    return fill_ends(words, keys, "_end").drop("_end")


def fill_ends(words: DataFrame, keys: list[str], segment_end: str) -> DataFrame:
    """Words with ends: where w_end isn't after w_start, the next word's start, or the segment's end."""
    nxt = F.lead("w_start").over(Window.partitionBy(*keys).orderBy("w_pos"))
    return words.withColumn("w_end", F.when(F.col("w_end") <= F.col("w_start"), F.coalesce(nxt, F.col(segment_end))).otherwise(F.col("w_end")))


def confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, confidence: the mean probability of a segment's words."""
    return words.groupBy(*keys).agg(F.avg("probability").alias("confidence"))


def renumber(segments: DataFrame, gaps: bool) -> DataFrame:
    """Segments with text, numbered anew from 0 in a file by idx; with gaps the segments left out are counted."""
    number = (F.row_number().over(Window.partitionBy("file_id").orderBy("idx")) - 1).cast("long")
    if gaps:
        return segments.withColumn("idx", number).where("text <> ''")
    return segments.where("text <> ''").withColumn("idx", number)


def padded(start: Column, end: Column, length: Column, pad: float = 0.3) -> tuple[Column, Column]:
    """A chunk's bounds with some time before and after, inside the recording."""
    return F.greatest(start - pad, F.lit(0.0)), F.least(end + pad, length)
