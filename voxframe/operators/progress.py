"""State of runs from their events: rows of the queue, percents, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.operators import scans

# Stages in order, and levels of the log. Fixed values.
STAGES = ("queued", "probing", "extracting", "isolating", "transcribing", "diarizing", "embedding", "resolving", "writing", "done", "failed", "skipped")
LEVELS = ("debug", "info", "warn", "error")
#: Lines of the log that are kept on show. Fixed value.
TAIL = 5000


def _name(number: Column, names: tuple[str, ...], other: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), number.cast("int")), F.lit(other))


def stage_name(number: Column) -> Column:
    return _name(number, STAGES, "unknown")


def level_name(number: Column) -> Column:
    return _name(number, LEVELS, "info")


def at_level(log: DataFrame, least: str, level: str = "level") -> DataFrame:
    """Lines of a level (a number) or above."""
    return log.where(F.col(level) >= LEVELS.index(least))


def tail(log: DataFrame, order: str, n: int = TAIL) -> DataFrame:
    """The last n lines, the latest first."""
    return log.orderBy(F.desc(order)).limit(n)


def running(finished: DataFrame, key: str, order: str, seconds: str) -> DataFrame:
    """key, order, files, seconds so far after each file."""
    return scans.running(finished.select(key, order, seconds), key, [order], {"files": F.lit(1).cast("long"), "_seconds": seconds}).select(key, order, "files", F.col("_seconds").alias("seconds"))


def percent(stage: Column, fraction: Column) -> Column:
    """0 to 100 of a file by the number of its stage and the fraction of it (below 0: not known); 100 only when it is over."""
    first, last, over = STAGES.index("probing"), STAGES.index("writing"), [STAGES.index("done"), STAGES.index("skipped")]
    base = F.least(stage, F.lit(last)) - first + F.when(fraction >= 0, F.least(fraction, F.lit(1.0))).otherwise(0.0)
    shown = F.floor(base / float(last - first + 1) * 100 + 0.5)
    return F.when(stage.isin(over), 100).when(stage < first, 0).otherwise(F.least(F.greatest(shown, F.lit(0)), F.lit(99))).cast("int")


def run_percent(audio: Column, audio_total: Column, files: Column, files_total: Column) -> Column:
    """0 to 100 of a run by seconds of audio, else by files."""
    share = F.when(audio_total > 0, audio / audio_total).when(files_total > 0, files / files_total).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(share * 100 + 0.5))).cast("int")


def queue_name(path: Column, track: Column, tracks: Column) -> Column:
    """The file's name, or the path if it has none, with the track where there are several."""
    name = F.substring_index(path, "/", -1)
    return F.concat(F.when(name == "", path).otherwise(name), F.when(tracks > 1, F.format_string(" [track %d/%d]", track + 1, tracks)).otherwise(""))


def queue_states(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, stage, fraction, failed of rows key, order, kind (started, stage, finished), stage, fraction.

    The last stage or finish holds; a finish clears the fraction (-1). A failure stays until the file is started again.
    """
    told, fails = F.col("kind") != "started", F.col("stage") == "failed"
    last = events.groupBy(key).agg(F.max_by(F.when(told, F.struct("stage", F.when(F.col("kind") == "finished", -1.0).otherwise(F.col("fraction")).alias("fraction"))), F.when(told, F.col(order))).alias("s"), F.max(F.when(F.col("kind") == "started", F.col(order))).alias("_start"), F.max(F.when(told & fails, F.col(order))).alias("_fail"))
    stage = F.coalesce("s.stage", F.when(F.col("_start").isNotNull(), "probing").otherwise("queued"))
    failed = F.col("_fail").isNotNull() & (F.col("_start").isNull() | (F.col("_fail") > F.col("_start")))
    return last.select(key, stage.alias("stage"), F.coalesce("s.fraction", F.lit(-1.0)).alias("fraction"), failed.alias("failed"))


def run_totals(files: DataFrame, elapsed: Column) -> DataFrame:
    """One row: done, failed, skipped, audio, realtime, of rows status, duration; audio counts files that are done."""
    done = F.col("status") == "done"
    seconds = F.coalesce(F.sum(F.when(done, F.col("duration"))), F.lit(0.0))
    return files.agg(F.count_if(done).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), seconds.alias("audio"), F.when(elapsed > 0, seconds / elapsed).otherwise(0.0).alias("realtime"))
