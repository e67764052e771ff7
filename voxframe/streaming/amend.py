"""Transcripts that are shown first and amended later: text comes as it is recognised, labels and identities when the file has been diarized and resolved.

State is kept by file: what was said under each idx, who each label is, and how many events have come. An event changes the rows it concerns and these are emitted, each with its revision, the highest
event_id that has shaped it; of two events about one thing the one with the higher event_id holds, so events may come in any order. A file's state is dropped once its last event has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voxframe.streaming.events import drain
from voxframe.workspace import new_path

#: Rows emitted. global_id and similarity are null while the label's identity is unknown.
ROWS = "file_id long, idx long, text string, seg_start double, seg_end double, local_label string, global_id long, similarity double, revision long"
#: Of an event: which it is, and what it tells. The idx of finished is how many events of the file there are beside it (null: no more will come).
COLUMNS = ["file_id", "event_id", "kind", "idx", "text", "seg_start", "seg_end", "local_label", "global_id", "similarity"]
KINDS = ("segment", "labelled", "resolved", "finished")


def _none(x: object) -> object:
    return None if x is None or x != x else x


class Amender(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getMapState("said", "idx long", "event_id long, text string, seg_start double, seg_end double, label_event long, local_label string")
        self.who = handle.getMapState("who", "local_label string", "event_id long, global_id long, similarity double")
        self.seen = handle.getValueState("seen", "n long, awaited long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, awaited = self.seen.get() if self.seen.exists() else (0, None)
        said: dict[int, tuple] = {}
        who: dict[str, tuple] = {}
        before: dict[int, tuple | None] = {}
        moved: set[str] = set()

        def spoken(i: int) -> tuple:
            if i not in said:
                said[i] = self.said.getValue((i,)) if self.said.containsKey((i,)) else (None, None, None, None, None, None)
            return said[i]

        def known(label: str | None) -> tuple:
            if label is None:
                return (None, None, None)
            if label not in who:
                who[label] = self.who.getValue((label,)) if self.who.containsKey((label,)) else (None, None, None)
            return who[label]

        def shown(i: int) -> tuple | None:
            event, text, start, end, by, label = spoken(i)
            if event is None:
                return None
            named, g, sim = known(label)
            return (key[0], i, text, start, end, label, g, sim, max(x for x in (event, by, named) if x is not None))

        for frame in rows:
            for e in frame.sort_values("event_id").itertuples(index=False):
                i, label = (None if e.idx != e.idx or e.idx is None else int(e.idx)), _none(e.local_label)
                if e.kind == "finished":
                    awaited = i if i is not None else n
                    continue
                n += 1
                if e.kind == "resolved":
                    if label not in moved:  # once a batch: all rows of the label, as they were
                        for (j,), row in list(self.said.iterator()):
                            said.setdefault(j, row)
                        for j, row in said.items():
                            if row[5] == label:
                                before.setdefault(j, shown(j))
                        moved.add(label)
                    if (known(label)[0] or -1) < e.event_id:
                        who[label] = (int(e.event_id), None if _none(e.global_id) is None else int(e.global_id), _none(e.similarity))
                        self.who.updateValue((label,), who[label])
                    continue
                row = spoken(i)
                before.setdefault(i, shown(i))
                if e.kind == "segment" and (row[0] or -1) < e.event_id:
                    row = (int(e.event_id), _none(e.text), _none(e.seg_start), _none(e.seg_end), row[4], row[5] if row[4] is not None else label)
                elif e.kind == "labelled" and (row[4] or -1) < e.event_id:
                    row = (*row[:4], int(e.event_id), label)
                said[i] = row
                self.said.updateValue((i,), row)
        for label in moved:
            for j, row in said.items():
                if row[5] == label:
                    before.setdefault(j, None)
        out = [now for i, old in before.items() if (now := shown(i)) is not None and now != old]
        if awaited is not None and n >= awaited:
            for state in (self.said, self.who, self.seen):
                state.clear()
        else:
            self.seen.update((n, awaited))
        names = [c.split()[0] for c in ROWS.split(", ")]
        frame = pd.DataFrame(out, columns=names, dtype=object).astype({"file_id": "int64", "idx": "int64", "revision": "int64"})
        yield frame.astype({"global_id": "Int64", "seg_start": "float64", "seg_end": "float64", "similarity": "float64"})

    def close(self) -> None:
        pass


def amended(log: DataFrame) -> DataFrame:
    """The stream of rows (ROWS) that a stream of events (streaming.events.SCHEMA, or COLUMNS of it) changes. Needs the state store that keeps maps, which it asks the session for."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.select(*COLUMNS).where(F.col("kind").isin(*KINDS) & F.col("file_id").isNotNull())
    return rows.groupBy("file_id").transformWithStateInPandas(Amender(), ROWS, "Update", "None")


def follow(log: DataFrame, path: str) -> None:
    """Handles all events that are there and adds the changed rows below path, a folder a batch: one that is repeated after a failure writes the same folder again."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    drain(amended(log), keep, "update", f"{path}/checkpoint")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """The rows as they stand after what follow() has handled: of each file_id and idx the last revision."""
    rows = spark.read.schema(f"{ROWS}, batch long").parquet(f"{path}/rows")
    last = F.row_number().over(Window.partitionBy("file_id", "idx").orderBy(F.desc("revision"), F.desc("batch")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "batch")


def after_all(events: DataFrame) -> DataFrame:
    """The same rows from a whole log in a batch."""
    of = [events.where(F.col("kind") == k) for k in KINDS[:3]]
    said = of[0].groupBy("file_id", "idx").agg(F.max_by(F.struct("text", "seg_start", "seg_end", F.col("local_label").alias("own")), "event_id").alias("s"), F.max("event_id").alias("_a"))
    labels = of[1].groupBy("file_id", "idx").agg(F.max_by(F.struct(F.col("local_label").alias("l")), "event_id").alias("l"), F.max("event_id").alias("_b"))
    who = of[2].groupBy("file_id", "local_label").agg(F.max_by(F.struct("global_id", "similarity"), "event_id").alias("w"), F.max("event_id").alias("_c"))
    rows = said.join(labels, ["file_id", "idx"], "left").withColumn("local_label", F.when(F.col("_b").isNotNull(), F.col("l.l")).otherwise(F.col("s.own")))
    rows = rows.join(who, ["file_id", "local_label"], "left")
    return rows.select("file_id", "idx", "s.text", "s.seg_start", "s.seg_end", "local_label", "w.global_id", "w.similarity", F.greatest("_a", "_b", "_c").alias("revision"))


def followed(spark: SparkSession, events: DataFrame, batches: int = 3) -> DataFrame:
    """after_all by way of the stream: the events are written in files that come one after another."""
    where = new_path(spark, "amend")
    events.select(*COLUMNS).withColumn("_file", F.pmod(F.xxhash64("event_id"), F.lit(batches))).repartition(batches, "_file").drop("_file").write.parquet(f"{where}/log")
    follow(spark.readStream.schema(events.select(*COLUMNS).schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/log"), where)
    return transcript(spark, where)
