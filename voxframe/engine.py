"""The store of a speech corpus and the verbs that work on it.

A store is a folder that all executors share. Every change writes the tables it touches and then a mark that names the files of all
tables, so readers see a whole version or the one before, and earlier versions can be read. Tables by file lie in parts, and a change of some files
writes their parts only. Verbs that only read return DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions import text
from voxframe.operators import arrival, attribution, identity, ingest, levels, matching, render, sampled, store
from voxframe.sources import models
from voxframe.sources.config import Settings
from voxframe.workspace import write_table

TABLES = {
    "files": "id long, path string, track int, track_count int, size long, mtime double, status string, duration double, language string, error string",
    "segments": "file_id long, idx long, text string, seg_start double, seg_end double, local_label string, global_id long, avg_logprob float, no_speech float, words array<struct<start:float,end:float,probability:float,text:string>>",
    "locals": "id long, file_id long, label string, centroid array<double>, total_dur double, n_segments long, global_id long, similarity double",
    "identities": "id long, name string, notes string, enrolled boolean, centroid array<double>",
    "clips": "id long, global_id long, source string, duration double, centroid array<double>",
    "dismissed": "low long, high long",
    "outputs": "file_id long, format string, path string",
}
#: Tables that lie in parts, and by what.
KEYS = {"files": "id", "segments": "file_id", "locals": "file_id", "outputs": "file_id"}


def _filled(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns])


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None) -> None:
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self._runs: dict[str, Event] = {}
        if store.last_version(spark, self.root) is None:
            self._commit(**{k: spark.createDataFrame([], v) for k, v in TABLES.items()})

    def tables(self, version: int | None = None, parts: list[int] | None = None) -> dict[str, DataFrame]:
        """The store's tables; with parts, those by file have just these parts. Columns that a store of an older form lacks are null."""
        found = store.current(self.spark, self.root, version, None if parts is None else dict.fromkeys(KEYS, parts))
        return {k: _filled(v, self.spark.createDataFrame([], TABLES[k]).schema) if k in TABLES else v for k, v in found.items()}

    def _commit(self, parts: list[int] | None = None, **changed: DataFrame) -> None:
        """With parts, of the tables by file just these parts are written."""
        rows = {k: v.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], TABLES[k]).schema]) for k, v in changed.items()}
        store.commit(rows, self.root, KEYS, None if parts is None else dict.fromkeys(KEYS, parts))

    # --- reading

    def speakers(self) -> DataFrame:
        x = self.tables()
        return identity.report(x["identities"], x["locals"], x["clips"]).orderBy(F.desc("enrolled"), F.desc("total_dur"), "id")

    def enrollments(self, who: int | None = None) -> DataFrame:
        rows = self.tables()["clips"].orderBy("global_id", "id")
        return rows if who is None else rows.where(F.col("global_id") == who)

    def dupes(self, low: float | None = None, high: float | None = None) -> DataFrame:
        x, s = self.tables(), self.settings
        found = identity.duplicate_candidates(x["identities"], x["locals"], x["dismissed"], s.review_threshold if low is None else low, s.match_threshold if high is None else high)
        return found.orderBy(F.desc("similarity"), "left_id", "right_id")

    def search(self, needle: str) -> DataFrame:
        """Segments with the words in their speaker or text, whatever the case of letters."""
        return render.search(self._shown(), needle)

    def _shown(self) -> DataFrame:
        x = self.tables()
        return identity.shown(x["segments"], x["identities"])

    def table_of(self, what: str) -> DataFrame:
        """Rows of a table as it is shown: speakers, enrollments, dupes, models, or the counts that clear() would delete."""
        if what == "speakers":
            n = F.when(F.col("enrolled"), F.concat(F.col("n_clips").cast("string"), F.when(F.col("n_clips") == 1, " clip").otherwise(" clips"))).otherwise("-")
            return self.speakers().select("id", F.col("display").alias("name"), n.alias("enrolled"), F.col("n_files").alias("files"), F.col("n_locals").alias("clips"), text.duration(F.col("total_dur")).alias("speech"))
        if what == "enrollments":
            who = self.speakers().where("enrolled").select(F.col("id").alias("global_id"), "display")
            return self.enrollments().join(who, "global_id").select("global_id", "display", F.col("id").alias("clip"), text.fixed(F.col("duration"), 1).alias("seconds"), "source").orderBy("global_id", "clip")
        if what == "dupes":
            names = self.speakers().select("id", "display")
            left, right = (names.select(F.col("id").alias(f"{k}_id"), F.col("display").alias(k)) for k in ("left", "right"))
            return self.dupes().join(left, "left_id").join(right, "right_id").select(text.fixed(F.col("similarity"), 3).alias("similarity"), "left_id", "left", "right_id", "right").orderBy(F.desc("similarity"), "left_id", "right_id")
        if what == "models":
            use = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in models.USES.items() for x in kv]), F.col("kind")), F.lit("voiceprint"))
            return models.catalogue(self.spark).select("name", use.alias("kind"), F.expr("n_bytes div 1000000").alias("megabytes"))
        x = self.tables()
        return store.counts(x["files"], x["segments"], x["identities"], x["clips"]).select("files", "segments", "speakers", "named")

    # --- plans of runs, from the settings

    def tracks(self, media: DataFrame) -> DataFrame:
        """A row a track of media (channels, layout, correlation)."""
        s = self.settings
        return ingest.expand_tracks(media, s.split_channels, s.max_split_channels, s.channel_independence)

    def isolation(self, media: DataFrame) -> DataFrame:
        """media with isolate, from noise_floor and healthy (whether the separator works)."""
        s = self.settings
        return media.withColumn("isolate", ingest.isolate(F.lit(s.isolate.lower()), F.coalesce("noise_floor", F.lit(0.0)), F.col("healthy"), s.isolate_auto_threshold))

    def voices(self, turns: DataFrame) -> DataFrame:
        """file_id, label, centroid, total_dur, n_segments from turns with vectors."""
        s = self.settings
        found = identity.voiceprints(turns, most=s.embed_max_segments, least=s.embed_min_segment)
        return found.select("file_id", text.local_label(F.col("speaker")).alias("label"), "centroid", "total_dur", "n_segments")

    def clips(self, spans: DataFrame) -> DataFrame:
        """Analysis of reference clips from their windows; windows overlap by half."""
        s = self.settings
        return levels.analyse_clips(spans, window=s.enroll_window, hop=s.enroll_window / 2, least=s.enroll_min_clip)

    def recorded_clips(self, chunks: DataFrame, load: Callable[[], Callable[[dict], list[dict]]]) -> DataFrame:
        """The same from samples: clip, first, samples at 16 kHz; load() gives the voiceprint model."""
        s = self.settings
        return sampled.analyse(chunks, "clip", load, window=s.enroll_window, hop=s.enroll_window / 2, least=s.enroll_min_clip)

    def paths(self, fmt: str, roots: list[str]) -> DataFrame:
        """file_id, path (below out_dir) of each file's transcript; with mirror_tree the folders below the roots that the inputs share are kept."""
        files = self.tables()["files"]
        root = F.lit(None).cast("string")
        if self.settings.mirror_tree and roots:
            shared = self.spark.createDataFrame([(roots,)], "p array<string>").select(text.common_root(F.transform("p", lambda x: F.concat(x, F.lit("/x"))))).head()[0]
            root = F.lit(shared or None).cast("string")
        at = text.output_path(F.lit("."), F.col("path"), F.col("track"), F.col("track_count"), F.lit(fmt), root if self.settings.mirror_tree and roots else None)
        return files.select(F.col("id").alias("file_id"), F.substring(at, 3, 1 << 20).alias("path"))

    # --- runs

    def enqueue(self, seen: DataFrame) -> DataFrame:
        """path, track, action of the files seen (path, track, track_count, size, mtime, duration, language); new and changed ones are stored as pending."""
        x = self.tables()["files"]
        found = store.classify_files(x, seen).where(F.lit(self.settings.overwrite) | (F.col("action") != "same"))
        todo = seen.join(found, ["path", "track"])
        known = todo.join(x.select("path", "track", "id"), ["path", "track"], "left").withColumn("status", F.lit("pending")).withColumn("error", F.lit(""))
        fresh = store.mint(x, known.where("id is null").drop("id"), ["path", "track"])
        cols = x.columns
        changed = write_table(known.where("id is not null").select(*cols).unionByName(fresh.select(*cols)), "changed")
        parts = store.buckets_of(changed, "id")
        kept = self.tables(parts=parts)["files"].join(changed.select("id"), "id", "left_anti")
        self._commit(parts, files=kept.select(*cols).unionByName(changed))
        return self.tables()["files"].where("status = 'pending'").join(found, ["path", "track"])

    def add(self, segments: DataFrame, voices: DataFrame) -> None:
        """Stores the results of files: segments (as the table, without global_id; avg_logprob, no_speech and words may be left out) and voices (file_id, label, centroid, total_dur, n_segments).

        Their former rows go. The voices are matched against the store as it was before, then segments take their speakers' identities.
        """
        self._add(segments, voices, False)

    def add_in_order(self, segments: DataFrame, voices: DataFrame) -> None:
        """As add() of one file after another in order of their ids, the order of arrival: each is matched against the store that the ones before have left. All files come with one
        commit, and the work is split by who depends on whom (operators.arrival); what arrives later comes with the next call (streaming.events.drain)."""
        self._add(write_table(segments, "segments"), write_table(voices, "voices"), True)

    def _add(self, segments: DataFrame, voices: DataFrame, in_order: bool) -> None:
        x, s = self.tables(), self.settings
        files = write_table(segments.select("file_id").distinct(), "added")
        parts = store.buckets_of(files, "file_id")
        own_parts = self.tables(parts=parts)
        ids = x["identities"]
        blank = voices.withColumn("global_id", F.lit(None).cast("long")).withColumn("similarity", F.lit(None).cast("double"))
        others = x["locals"].join(files, "file_id", "left_anti")
        new = write_table(store.mint(x["locals"], blank, ["file_id", "label"]), "voices")
        options = {"enrol": s.enroll_match_threshold, "match": s.match_threshold, "floor": s.min_speaker_speech, "collapse": s.enroll_collapse}
        known, clips = identity.with_vectors(ids), identity.with_vectors(x["clips"])
        if in_order:
            found, moved = arrival.resolve_in_order(new, known, clips, x["locals"].select("file_id", "global_id"), **options)
            moved = write_table(moved, "moved")
        else:
            found = matching.resolve_batch(new, known, clips, **options).drop("file_id").withColumn("minted_by", F.when(F.col("outcome") == "mint", F.col("local_id")))
        found = write_table(found.withColumnRenamed("local_id", "id"), "resolved")
        minted = store.mint(ids, found.where("outcome = 'mint'").select(F.col("id").alias("minted_by")), ["minted_by"])
        minted = write_table(minted.select("minted_by", F.col("id").alias("_fresh")), "minted")
        placed = new.drop("global_id", "similarity").join(found, "id").join(minted, "minted_by", "left")
        placed = placed.withColumn("global_id", F.coalesce("_fresh", "global_id")).withColumn("similarity", F.when(F.col("outcome") == "mint", 1.0).otherwise(F.col("similarity")))
        placed = write_table(placed, "placed")
        own = placed.where("outcome = 'mint'").select(F.col("global_id").alias("id"), F.lit("").alias("name"), F.lit("").alias("notes"), F.lit(False).alias("enrolled"), "centroid")
        if in_order:
            folded = moved.join(minted, "minted_by", "left").select(F.coalesce("_fresh", "global_id").alias("id"), "centroid")
        else:
            n = others.where("global_id is not null").groupBy("global_id").agg(F.count("*").cast("double").alias("w"))
            matched = placed.where("outcome = 'inferred'").select("global_id", "centroid", F.lit(1.0).alias("w"))
            before = ids.select(F.col("id").alias("global_id"), "centroid").join(n, "global_id", "left").withColumn("w", F.greatest(F.lit(1.0), F.coalesce("w", F.lit(1.0)))).join(matched.select("global_id").distinct(), "global_id", "left_semi")
            folded = identity.centroid_arrays(before.unionByName(matched), "global_id", "centroid", "w").withColumnRenamed("global_id", "id")
        known_columns = _filled(segments, x["segments"].drop("global_id").schema)
        said = known_columns.join(placed.select("file_id", F.col("label").alias("local_label"), "global_id"), ["file_id", "local_label"], "left")
        self._commit(
            parts,
            identities=store.update(ids.unionByName(own), folded, "id", ["centroid"]),
            locals=own_parts["locals"].join(files, "file_id", "left_anti").unionByName(placed.select(*x["locals"].columns)),
            segments=own_parts["segments"].join(files, "file_id", "left_anti").unionByName(said.select(*x["segments"].columns)),
            files=store.update(own_parts["files"], files.select(F.col("file_id").alias("id"), F.lit("done").alias("status"), F.lit("").alias("error")), "id", ["status", "error"]),
        )

    def fail(self, failed: DataFrame) -> None:
        """Notes files that a run couldn't do (id, error): their status and the reason; what is stored of them stays. The next enqueue() takes them up again."""
        failed = write_table(failed.groupBy("id").agg(F.min("error").alias("error"), F.lit("failed").alias("status")), "failed")
        parts = store.buckets_of(failed, "id")
        self._commit(parts, files=store.update(self.tables(parts=parts)["files"], failed, "id", ["status", "error"]))

    def finish(self, roots: list[str] | None = None) -> dict[str, int]:
        """After a batch: clusters anew if the settings say so and, if anything moved, renders the files that have outputs again. Number of locals moved, of files rendered."""
        if not self.settings.recluster_after_batch:
            return {"moved": 0, "rendered": 0}
        before = write_table(self.tables()["locals"].select("id", F.col("global_id").alias("_g")), "before")
        self.recluster()
        moved = self.tables()["locals"].join(before, "id").where(~F.col("global_id").eqNullSafe(F.col("_g"))).count()
        rendered = 0
        if moved:
            outputs = write_table(self.tables()["outputs"], "outputs")
            for (fmt,) in outputs.select("format").distinct().orderBy("format").collect():  # a handful of formats
                rendered += self.render(fmt, outputs.where(F.col("format") == fmt).select("file_id", "path")).count()
        return {"moved": moved, "rendered": rendered}

    @contextmanager
    def run(self, name: str) -> Iterator[None]:
        """What is done inside, by this thread, can be cancelled by name from another."""
        ended = self._runs[name] = Event()
        context = self.spark.sparkContext
        context.setJobGroup(self._group(name), name, interruptOnCancel=True)
        try:
            yield
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(key, None)
            ended.set()

    def _group(self, name: str) -> str:
        return f"voxframe {self.root} {name}"

    def begin(self, files: DataFrame) -> None:
        """Notes that the files (id) are being worked on."""
        parts = store.buckets_of(files, "id")
        changed = files.select("id", F.lit("transcribing").alias("status"), F.lit("").alias("error"))
        self._commit(parts, files=store.update(self.tables(parts=parts)["files"], changed, "id", ["status", "error"]))

    def cancel(self, name: str) -> int:
        """Stops the jobs of a run and returns the files that were in flight to the queue; their number. As a change shows only when it is whole, the store is that of the last one."""
        ended = self._runs.get(name)
        while ended and not ended.wait(0.2):  # a job that begins after the others were stopped is stopped, too
            self.spark.sparkContext.cancelJobGroup(self._group(name))
        return self.requeue()

    def requeue(self) -> int:
        """Returns files that a cancelled run left between pending and done to the queue; their number."""
        files = self.tables()["files"]
        left = files.where(~F.col("status").isin("pending", "done", "failed", "skipped"))
        n = left.count()
        if n:
            parts = store.buckets_of(left, "id")
            self._commit(parts, files=store.update(self.tables(parts=parts)["files"], left.select("id", F.lit("pending").alias("status")), "id", ["status"]))
        return n

    def backup(self, dest: str) -> int:
        return store.backup(self.spark, self.root, dest, KEYS)

    def rollback(self, version: int) -> int:
        return store.rollback(self.spark, self.root, version)

    def recluster(self) -> None:
        """Clusters all voices anew; identities left without use go."""
        x, s = self.tables(), self.settings
        moved = write_table(matching.recluster(x["identities"], x["locals"], threshold=s.cluster_threshold, floor=s.min_speaker_speech), "moved")
        placed = write_table(store.update(x["locals"], moved.select("id", "global_id", "similarity"), "id", ["global_id", "similarity"]), "locals")
        weights = placed.join(moved.select("id"), "id", "left_semi").select("global_id", "centroid", F.greatest(F.lit(1.0), F.col("total_dur")).alias("w"))
        centre = identity.centroid_arrays(weights, "global_id", "centroid", "w").withColumnRenamed("global_id", "id")
        ids = x["identities"]
        fresh = centre.join(ids.select("id"), "id", "left_anti").select("id", F.lit("").alias("name"), F.lit("").alias("notes"), F.lit(False).alias("enrolled"), "centroid")
        ids = store.update(ids, centre, "id", ["centroid"]).unionByName(fresh)
        self._commit(identities=ids.join(identity.unused(ids, placed).select("id"), "id", "left_anti"), locals=placed, segments=identity.relabelled(x["segments"], placed))

    def render(self, fmt: str, paths: DataFrame | None = None, all_files: bool = False) -> DataFrame:
        """file_id, body of the files that are done (or all) and have segments; with paths (file_id, path) they are written below the settings' out_dir and recorded."""
        x, fmt = self.tables(), fmt.lower()
        files = x["files"].where(F.lit(all_files) | (F.col("status") == "done")).withColumnRenamed("id", "file_id")
        rows = self._shown().join(files.select("file_id"), "file_id", "left_semi")
        head = files.join(rows.select("file_id").distinct(), "file_id", "left_semi").withColumn("source", F.col("path")).withColumn("model", F.lit(self.settings.model))
        if fmt == "json":
            body = render.json(rows, head)
        elif fmt == "md":
            body = render.markdown(attribution.fold_runs(rows.withColumn("_key", F.coalesce("label", F.lit(""))), "_key"), head.withColumn("source", F.substring_index("path", "/", -1)))
        else:
            body = render.render(rows, fmt)
        if paths is None:
            return body
        if not self.settings.out_dir:
            raise ValueError("out_dir must be set to write transcripts")
        written = write_table(render.write_files(body, paths, self.settings.out_dir), "written")
        parts = store.buckets_of(written, "file_id")
        out = self.tables(parts=parts)["outputs"].join(written.select("file_id", F.lit(fmt).alias("format")), ["file_id", "format"], "left_anti").select(*x["outputs"].columns)
        self._commit(parts, outputs=out.unionByName(written.select("file_id", F.lit(fmt).alias("format"), "path")))
        return written

    # --- identities

    def name(self, who: int, name: str) -> None:
        self._set(who, "name", name)

    def notes(self, who: int, notes: str) -> None:
        self._set(who, "notes", notes)

    def _set(self, who: int, column: str, value: str) -> None:
        ids = self.tables()["identities"]
        self._known(ids, who)
        self._commit(identities=ids.withColumn(column, F.when(F.col("id") == who, F.lit(value)).otherwise(F.col(column))))

    @staticmethod
    def _known(ids: DataFrame, *wanted: int) -> None:
        found = {r.id for r in ids.where(F.col("id").isin(*wanted)).select("id").collect()}
        if missing := sorted(set(wanted) - found):
            raise ValueError(f"no speaker {missing[0]}")

    def merge(self, source: int, into: int) -> None:
        x = self.tables()
        self._known(x["identities"], source, into)
        if source == into:
            return
        parts = store.buckets_of(x["locals"].where(F.col("global_id") == source), "file_id")
        own = self.tables(parts=parts)
        ids, loc, clips, dis = identity.merge_identities(x["identities"], own["locals"], x["clips"], x["dismissed"], source, into)
        only = clips.where(F.col("global_id") == into)
        ids = ids.where(F.col("id") != into).unionByName(identity.refresh_enrolment(ids.where(F.col("id") == into), only))
        self._commit(parts, identities=ids, locals=loc, clips=clips, dismissed=dis, segments=identity.merge(own["segments"], source, into))

    def split(self, local_id: int) -> None:
        """Gives a local an identity of its own; just the part of its file is written."""
        x = self.tables()
        parts = store.buckets_of(x["locals"].where(F.col("id") == local_id), "file_id")
        if not parts:
            raise ValueError(f"no local {local_id}")
        ids, moved = identity.split_local(x["identities"].select("id", "name", "enrolled", "centroid"), x["locals"], local_id)
        ids = ids.join(x["identities"].select("id", "notes"), "id", "left")
        own = self.tables(parts=parts)
        new = write_table(moved.where(F.col("id") == local_id).select("id", "global_id", F.lit(1.0).alias("similarity")), "split")
        loc = store.update(own["locals"], new, "id", ["global_id", "similarity"])
        self._commit(parts, identities=ids, locals=loc, segments=identity.relabelled(own["segments"], loc))

    def enroll(self, who: str, source: str, centroid: list[float], duration: float) -> None:
        """Adds a clip to the identity named, or to a new one of that name; ValueError if the name has several bearers or the id none."""
        x = self.tables()
        asked = self.spark.createDataFrame([(who,)], "who string")
        found = identity.resolve_targets(asked, x["identities"]).head()
        if found.action == "error":
            raise ValueError(f"no single speaker {who}")
        ids, at = x["identities"], found.id
        if found.action == "create":
            at = ids.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).head()[0]
            ids = ids.unionByName(self.spark.createDataFrame([(at, who, "", True, centroid)], ids.schema))
        clip = store.mint(x["clips"], self.spark.createDataFrame([(at, source, float(duration), centroid)], "global_id long, source string, duration double, centroid array<double>"), ["source"])
        self._commit_clips(ids, x["clips"].unionByName(clip.select(*x["clips"].columns)), at)

    def unenroll(self, who: int) -> None:
        x = self.tables()
        self._commit_clips(x["identities"], x["clips"].where(F.col("global_id") != who), who)

    def _commit_clips(self, ids: DataFrame, clips: DataFrame, who: int) -> None:
        one = identity.refresh_enrolment(ids.where(F.col("id") == who), clips.where(F.col("global_id") == who))
        self._commit(identities=ids.where(F.col("id") != who).unionByName(one), clips=clips)

    def dismiss(self, a: int, b: int) -> None:
        self._commit(dismissed=store.dismiss(self.tables()["dismissed"], self.spark.createDataFrame([(a, b)], "a long, b long")))

    def undismiss(self, a: int, b: int) -> None:
        self._commit(dismissed=store.undismiss(self.tables()["dismissed"], self.spark.createDataFrame([(a, b)], "a long, b long")))

    def clear(self) -> None:
        self._commit(**{k: self.spark.createDataFrame([], v) for k, v in TABLES.items()})
