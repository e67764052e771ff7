"""From probe reports to jobs: what a media file holds, how many tracks it is read as, whether its voices are isolated first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import trim

# Defaults of the decisions. Fixed values.
MAX_CHANNELS, INDEPENDENCE, NOISY = 8, 0.35, 0.28


def probe(reports: DataFrame) -> DataFrame:
    """path, codec, sample_rate, channels, layout, duration, error: from rows path, report (key=value lines).

    Lines without = and values N/A are passed over. The first duration is the stream's and wins if above 0, the last of the others is the
    container's. Numbers that can't be read count as 0, channels as 1 at least. Without a codec the error says so.
    """
    line = F.transform(F.split(F.coalesce("report", F.lit("")), "\n", -1), trim)
    pairs = F.transform(F.filter(line, lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    rows = reports.select("path", F.filter(pairs, lambda p: p["v"] != "N/A").alias("p"))

    def values(key: str) -> Column:
        return F.transform(F.filter("p", lambda x: x["k"] == key), lambda x: x["v"])

    def number(value: Column) -> Column:
        return F.coalesce(F.regexp_extract(value, r"^\s*([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))

    def last(key: str) -> Column:
        return F.try_element_at(values(key), F.lit(-1))

    times = F.transform(values("duration"), number)
    stream, container = F.coalesce(F.try_element_at(times, F.lit(1)), F.lit(0.0)), F.when(F.size(times) > 1, F.element_at(times, -1)).otherwise(0.0)
    codec = last("codec_name")
    return rows.select("path", codec.alias("codec"), number(last("sample_rate")).cast("int").alias("sample_rate"), F.greatest(F.lit(1), number(last("channels")).cast("int")).alias("channels"), F.coalesce(last("channel_layout"), F.lit("")).alias("layout"), F.when(stream > 0, stream).otherwise(container).alias("duration"), F.when(codec.isNull(), "no audio stream").alias("error"))


def looks_multitrack(channels: Column, layout: Column) -> Column:
    """Two channels or more, and a layout that is empty, stereo or unknown."""
    return (channels >= 2) & F.coalesce(layout, F.lit("")).isin("", "stereo", "unknown")


def expand_tracks(files: DataFrame, split: bool = True, max_channels: int = MAX_CHANNELS, independence: float = INDEPENDENCE) -> DataFrame:
    """A row a track (track, track_count) for files with channels, layout, correlation: split where channels are independent microphones."""
    apart = F.lit(split) & looks_multitrack(F.col("channels"), F.col("layout")) & (F.col("channels") <= max_channels) & F.coalesce(F.col("correlation") < independence, F.lit(False))
    rows = files.withColumn("track_count", F.when(apart, F.col("channels")).otherwise(1).cast("int"))
    return rows.withColumn("track", F.explode(F.sequence(F.lit(0), F.col("track_count") - 1)))


def isolate(mode: Column, floor: Column, healthy: Column, threshold: float = NOISY) -> Column:
    """Whether voices are isolated: never without a working separator, always if asked, else where the noise floor is high."""
    return healthy & (mode != "never") & ((mode == "always") | (floor >= threshold))
