"""The event log of runs as a stream: the latest state of each file, and batches handled in order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxframe.operators import scans
from voxframe.operators.joins import spread_join
from voxframe.workspace import new_path, write_table


#: An event of a run: its kind, and what that kind tells; the rest is null. Kinds: discovered, started, stage, segment, labelled, resolved, finished, progress, log,
#: download, run_finished.
SCHEMA = (
    "event_id long, at double, kind string, file_id long, path string, track int, stage string, fraction double, detail string, idx long, text string, "
    "seg_start double, seg_end double, local_label string, global_id long, similarity double, error string, wall_seconds double, audio_seconds double, outputs array<string>, "
    "files_done int, files_total int, files_failed int, files_skipped int, audio_done double, audio_total double, realtime double, level int, bytes_done long, bytes_total long, cancelled boolean"
)


def joined_lines(pieces: DataFrame, source: str, order: str) -> DataFrame:
    """source, line (from 0), text, open: lines put together from pieces of text that cut them anywhere; white space about them goes, empty ones are left out. The last
    one is open if no line end has come yet. Pieces of a source are joined in order: a prefix count of line ends, in ranges side by side, deals them to lines, so no text is gathered whole. A null source has none."""
    rows = pieces.select(source, order, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_k", "_part"))
    rows = scans.running(rows, source, [order, "_k"], {"line": F.when(F.col("_k") > 0, 1).otherwise(0)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_k", F.col("_part").alias("t")))), lambda x: x["t"]), "")
    lines = write_table(rows.groupBy(source, "line").agg(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("text")), "lines")
    last = lines.groupBy(source).agg(F.max("line").alias("_last"), F.count("*").alias("_n"))
    return spread_join(lines.where("text <> ''"), last, source, "_n", lines.count()).select(source, "line", "text", (F.col("line") == F.col("_last")).alias("open"))


def read_log(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files below path, in order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def latest(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key and the columns of its last event, as a running aggregate (or on a batch)."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    return last.select(key, "_last.*")


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs the stream over all that is there, a batch at a time and in order, then stops; its checkpoint is in the shared folder, or where it is told to be: then a later call goes on from there."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint or new_path(spark, "stream")).trigger(availableNow=True)
    writer.start().awaitTermination()


def latest_snapshot(spark: SparkSession, path: str, schema: StructType, key: str, order: str, columns: list[str]) -> DataFrame:
    """The state after the whole log has passed through the running aggregate."""
    where = new_path(spark, "latest")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{where}/{number}")
        state["at"] = number

    state = {"at": None}
    drain(latest(read_log(spark, path, schema), key, order, columns), keep, "complete")
    return spark.read.parquet(f"{where}/{state['at']}")
