"""Queries that run the engine's verbs on a store made of the fixtures, and sources and sinks of media, models and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.engine import KEYS, TABLES, Engine, _filled
from voxframe.operators import identity, sampled, store
from voxframe.plans import catalog
from voxframe.plans import fixtures as fx
from voxframe.plans.registry import query
from voxframe.sources import models, wav, wavsource
from voxframe.streaming import events
from voxframe.workspace import new_path

GS, ENR = (fx.VP, fx.LOC, fx.GS), (fx.VP, fx.LOC, fx.GS, fx.ENR)
NAMED = "nm AS (SELECT s.file_id, s.idx, s.text, coalesce(CASE WHEN g.name <> '' THEN g.name ELSE printf('SPEAKER_%04d', g.id) END, s.local_label) AS label FROM seg s LEFT JOIN loc l ON l.file_id = s.file_id AND l.label = s.local_label LEFT JOIN gs g ON g.id = l.global_id)"


def _engine(s: SparkSession, d: str, voices: bool = True, **changed: DataFrame) -> Engine:
    """A store of the fixtures; without voices no file has been added yet."""
    loc, root, e = fx.loc(s, d), new_path(s, "store"), fx.enr(s, d)
    rows = {
        "files": fx.files(s, d).withColumn("id", F.col("doc_id")).withColumn("track_count", F.lit(1)).withColumn("duration", F.col("size").cast("double")).withColumn("language", F.lit("en")),
        "segments": identity.relabelled(fx.seg(s, d), loc),
        "locals": loc.withColumn("n_segments", F.lit(1)).withColumn("similarity", F.lit(1.0)),
        "identities": fx.gs(s, d).withColumn("notes", F.lit("")),
        "clips": e.withColumn("source", F.concat(F.lit("clip "), F.col("id").cast("string"))),
    } | changed
    empty = ["dismissed", "outputs"] + ([] if voices else ["segments", "locals"])
    tables = {k: s.createDataFrame([], v) if k in empty else _filled(rows[k], (schema := s.createDataFrame([], v).schema)).select(*[F.col(f.name).cast(f.dataType) for f in schema]) for k, v in TABLES.items()}
    store.commit(tables, root, KEYS)
    return Engine(s, root)


@query("rn7_store_rendered", "SELECT file_id, string_agg(label || ': ' || text || chr(10), '' ORDER BY idx) AS body FROM nm JOIN fl ON doc_id = file_id AND status = 'done' WHERE text <> '' GROUP BY file_id", (fx.SEG, fx.FILES, *GS, NAMED))
def _(s, d):
    return _engine(s, d).render("txt")


@query("sk10_store_enrolled", "SELECT 8 AS global_id, 'Person 8' AS display, (SELECT max(id) + 1 FROM enr) AS id, 9::DOUBLE AS duration, true AS enrolled UNION ALL SELECT (SELECT max(id) + 1 FROM gs), 'Somebody', (SELECT max(id) + 2 FROM enr), 4::DOUBLE, true", ENR)
def _(s, d):
    e, v = _engine(s, d), [1.0] + [0.0] * 63
    e.enroll("person 8", "new", v, 9.0)
    e.enroll("Somebody", "new", v, 4.0)
    who = e.speakers().select(F.col("id").alias("global_id"), "display", "enrolled")
    return e.enrollments().where("source = 'new'").join(who, "global_id").select("global_id", "display", "id", "duration", "enrolled")


@query("sk17_store_unenrolled", "SELECT gs.id, enrolled AND gs.id <> 5 AS enrolled, (SELECT count(*) FROM enr WHERE global_id = gs.id AND global_id <> 5) AS n_clips FROM gs", ENR)
def _(s, d):
    e = _engine(s, d)
    e.unenroll(5)
    return e.speakers().select("id", "enrolled", "n_clips")


@query("id9_store_merged", ", l AS (SELECT CASE WHEN global_id = 8 THEN 12 ELSE global_id END AS g, total_dur FROM loc), e AS (SELECT CASE WHEN global_id = 8 THEN 12 ELSE global_id END AS g FROM enr) SELECT gs.id, CASE WHEN name <> '' THEN name ELSE printf('SPEAKER_%04d', gs.id) END AS display, (SELECT count(*) FROM l WHERE g = gs.id) AS n_locals, (SELECT count(*) FROM e WHERE g = gs.id) AS n_clips FROM gs WHERE id <> 8", ENR)
def _(s, d):
    e = _engine(s, d)
    e.merge(8, 12)
    return e.speakers().select("id", "display", "n_locals", "n_clips")


@query("id12_store_split", "SELECT file_id, idx, CASE WHEN l.id = 45 THEN (SELECT max(id) + 1 FROM gs) ELSE global_id END AS global_id FROM (SELECT s.file_id, s.idx, l.id, l.global_id FROM seg s LEFT JOIN loc l ON l.file_id = s.file_id AND l.label = s.local_label) l", (fx.SEG, *GS))
def _(s, d):
    e = _engine(s, d)
    e.split(45)
    return e.tables()["segments"].select("file_id", "idx", "global_id")


@query("sk22_store_cleared", "SELECT 0 AS files, 0 AS segments, 0 AS speakers, 0 AS named")
def _(s, d):
    e = _engine(s, d)
    e.clear()
    return e.table_of("clear")


@query("id7_store_added", ", mi AS (SELECT local_id, (SELECT max(id) FROM gs) + row_number() OVER (ORDER BY local_id) AS g FROM rs WHERE outcome = 'mint') SELECT rs.local_id + 1 AS id, rs.file_id, coalesce(global_id, g) AS global_id, CASE WHEN g IS NOT NULL THEN 1 ELSE similarity END AS similarity FROM rs LEFT JOIN mi ON mi.local_id = rs.local_id", (*ENR, catalog.RESOLVED))
def _(s, d):
    e, v = _engine(s, d, False), fx.heard(s, d)
    said = v.groupBy("file_id").agg(F.min("label").alias("local_label")).select("file_id", F.lit(0).cast("long").alias("idx"), F.lit("hello").alias("text"), F.lit(0.0).alias("seg_start"), F.lit(1.0).alias("seg_end"), "local_label")
    e.add(said, v.select("file_id", "label", "centroid", "total_dur", F.lit(1).cast("long").alias("n_segments")))
    return e.tables()["locals"].select("id", "file_id", "global_id", F.round("similarity", 6).alias("similarity"))


@query("st4_after_a_batch", "SELECT count(*) FILTER (reassigned) AS moved FROM rc", catalog.RECLUSTER)
def _(s, d):
    return s.createDataFrame([(_engine(s, d).finish()["moved"],)], "moved long")


@query("st6_requeued", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 4 THEN 'pending' ELSE status END AS status FROM fl", (fx.FILES,))
def _(s, d):
    files = fx.files(s, d).withColumn("status", F.when(F.col("doc_id") % 5 == 4, "transcribing").otherwise(F.col("status")))
    files = files.withColumn("id", F.col("doc_id")).withColumn("track_count", F.lit(1)).withColumn("duration", F.lit(0.0)).withColumn("language", F.lit(""))
    e = _engine(s, d, files=files)
    e.requeue()
    return e.tables()["files"].select("id", "status")


@query("sk23_store_backup", "SELECT (SELECT count(*) FROM fl) AS files, (SELECT count(*) FROM seg) AS segments, (SELECT count(*) FROM gs) AS speakers, (SELECT count(*) FROM gs WHERE name <> '') AS named", (fx.FILES, fx.SEG, *GS))
def _(s, d):
    e, at = _engine(s, d), new_path(s, "backup")
    e.backup(at)
    e.clear()
    return Engine(s, at).table_of("clear")


@query("sc18_models", f"SELECT * FROM (VALUES {', '.join(str(m[:3]) for m in models.CATALOGUE)}) t(name, kind, n_bytes) WHERE kind = 'whisper' AND lower(name) = 'large-v3'")
def _(s, d):
    return models.find_model(models.catalogue(s), "Large-V3", "whisper").select("name", "kind", "n_bytes")


@query("st9_log_lines", ", p AS (SELECT file_id, idx, unnest(string_split(text || chr(10) || '  ', chr(10))) AS t, generate_subscripts(string_split(text || chr(10) || '  ', chr(10)), 1) - 1 AS line FROM seg) SELECT file_id, idx, line, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS text FROM p WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> ''", (fx.SEG,))
def _(s, d):
    whole = F.concat("text", F.lit("\n  "))
    starts = F.explode(F.sequence(F.lit(0), F.floor(F.length(whole) / 7).cast("int")))
    pieces = fx.seg(s, d).select(F.struct("file_id", "idx").alias("source"), whole.alias("t"), starts.alias("n")).select("source", "n", F.expr("substr(t, n * 7 + 1, 7)").alias("text"))
    return events.joined_lines(pieces, "source", "n").select("source.file_id", "source.idx", "line", "text")


# --- recordings: the events of a twentieth of the users, one sample an event, 8 kHz

REC = "rec AS (SELECT user_id % 20 AS part, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS pos, floor(least(value / 1000, 1) * 32767 + 0.5)::BIGINT AS code FROM events)"


def _recordings(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    """What write_files says, and the folder of the files written."""
    e, root = fx.table(s, d, "events").withColumn("part", F.col("user_id") % 20), new_path(s, "wav")
    rows = e.select("part", "event_id", F.least(F.col("value") / 1000, F.lit(1.0)).alias("x"), ((F.row_number().over(Window.partitionBy("part").orderBy("event_id")) - 1) / 64).cast("int").alias("chunk"))
    samples = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda r: r["x"])
    chunks = rows.groupBy("part", "chunk").agg(samples.alias("samples")).select(F.concat(F.col("part").cast("string"), F.lit(".wav")).alias("path"), "chunk", F.lit(8000).alias("rate"), "samples")
    return wav.write_files(chunks, root), root


def _part() -> F.Column:
    return F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("part")


def _codes(rows: DataFrame) -> DataFrame:
    at = rows.select(_part(), "first", F.posexplode("samples").alias("k", "x"))
    return at.select("part", (F.col("first") + F.col("k")).alias("pos"), F.round(F.col("x").cast("double") * 32768).cast("long").alias("code"))


@query("sk26_wav_written", "SELECT part, 44 + 2 * count(*) AS n_bytes FROM rec GROUP BY part", (REC,))
def _(s, d):
    return _recordings(s, d)[0].select(_part(), "n_bytes")


@query("sc6_wav_samples", "SELECT part, pos, code FROM rec", (REC,))
def _(s, d):
    return _codes(wavsource.read(s, _recordings(s, d)[1], seconds=0.01, partition_bytes=4096).where("channel = 0"))


@query("sc4_wav_range", "SELECT part, pos - 10 AS pos, code FROM rec WHERE pos BETWEEN 10 AND 39", (REC,))
def _(s, d):
    return _codes(wavsource.read(s, _recordings(s, d)[1], channel=0, start=10 / 8000, end=40 / 8000))


@query("sc5_wav_heads", "SELECT part, 8000 AS rate, 1 AS channels, count(*) AS frames, count(*) / 8000::DOUBLE AS duration FROM rec GROUP BY part", (REC,))
def _(s, d):
    heads = wavsource.read(s, _recordings(s, d)[1], samples=False)
    return heads.select(_part(), "rate", "channels", "frames", (F.col("frames") / F.col("rate")).alias("duration"))


WIN = """wb AS (SELECT part, unnest(CASE WHEN count(*) <= 16 THEN [0] ELSE range(0, count(*) - 16 + 1, 8) END) AS a FROM rec GROUP BY part),
wq AS (SELECT part, a, (pos - a) // 4 AS q, sum((code / 32768::DOUBLE) ** 2) AS e, count(*) AS n FROM wb JOIN rec USING (part) WHERE pos >= a AND pos < a + 16 GROUP BY ALL),
wl AS (SELECT part, a, sum(n) AS n, sqrt(sum(e) / sum(n)) AS level, list(e ORDER BY q) AS v FROM wq GROUP BY part, a)"""


@query("wn3_sample_windows", "SELECT part, a AS begin, n::BIGINT AS n, round(level, 6) AS level FROM wl", (REC, WIN))
def _(s, d):
    chunks = wavsource.read(s, _recordings(s, d)[1], seconds=0.01).where("channel = 0").select(_part(), "first", "samples")
    found = sampled.windows_of(chunks, "part", 16, 8)
    return found.select("part", "begin", F.size("samples").cast("long").alias("n"), F.round(sampled.rms_of("samples"), 6).alias("level"))


def quarters():
    """A stand-in for a voiceprint model: the energies of a window's quarters."""
    return lambda row: [{"vector": [sum(x * x for x in row["samples"][k : k + 4]) for k in range(0, len(row["samples"]), 4)]}]


SAMPLED = """ld AS (SELECT part, count(*) AS n, coalesce((list_sort(list(level) FILTER (level >= 2e-4)))[floor((count(*) FILTER (level >= 2e-4) - 1) * 0.9::DOUBLE)::INT + 1], 0) AS loud FROM wl GROUP BY part),
kp AS (SELECT wl.part, a, wl.n AS size, v, ld.n FROM wl JOIN ld USING (part) WHERE level >= greatest(loud * 0.12::DOUBLE, 2e-4)),
cx AS (SELECT part, pos, avg(x) AS x FROM (SELECT part, unnest(range(len(v))) AS pos, unnest(v) AS x FROM kp) GROUP BY ALL), cc AS (SELECT part, list(x ORDER BY pos) AS c FROM cx GROUP BY part),
an AS (SELECT part, count(*) AS windows, sum(size) / 8 * CASE WHEN any_value(n) > 1 THEN 0.5::DOUBLE ELSE 1 END AS duration, CASE WHEN count(*) = 1 THEN 1 ELSE least(1, min(list_cosine_similarity(v, c))) END AS coherence FROM kp JOIN cc USING (part) GROUP BY part)"""


@query("id20_clips_from_samples", "SELECT part, windows, round(duration, 6) AS duration, round(coherence, 4) AS coherence, duration >= 3 AS usable, CASE WHEN duration < 3 THEN 'short' WHEN windows > 1 AND coherence < 0.72 THEN 'mixed' ELSE '' END AS problem FROM an", (REC, WIN, SAMPLED))
def _(s, d):
    chunks = wavsource.read(s, _recordings(s, d)[1], seconds=0.01).where("channel = 0").select(_part(), "first", "samples")
    found = sampled.analyse(chunks, "part", quarters, rate=8, window=2.0, hop=1.0)
    return found.withColumn("duration", F.round("duration", 6)).withColumn("coherence", F.round("coherence", 4))
