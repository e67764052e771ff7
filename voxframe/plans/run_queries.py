"""Queries of ingest, words, levels and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions import text as t
from voxframe.functions import vectors as v
from voxframe.operators import identity, ingest, levels, progress, words
from voxframe.plans import fixtures as fx
from voxframe.plans.registry import query

# --- ingest


def _media(s: SparkSession, d: str) -> DataFrame:
    """path, channels, layout, correlation, floor, mode, healthy of made-up files, one a document."""
    i = F.col("doc_id")
    return fx.table(s, d, "documents").select("doc_id", (i % 10).cast("int").alias("channels"), F.element_at(F.array(*[F.lit(x) for x in ("", "stereo", "5.1", "unknown")]), (i % 4 + 1).cast("int")).alias("layout"), (i % 7 / 10.0).alias("correlation"), (i % 11 / F.lit(20.0)).alias("floor"), F.element_at(F.array(*[F.lit(x) for x in ("auto", "always", "never")]), (i % 3 + 1).cast("int")).alias("mode"), (i % 5 != 0).alias("healthy"))


MEDIA = "md AS (SELECT doc_id, (doc_id % 10)::INT AS channels, (['', 'stereo', '5.1', 'unknown'])[doc_id % 4 + 1] AS layout, (doc_id % 7) / 10::DOUBLE AS correlation, (doc_id % 11) / 20::DOUBLE AS floor, (['auto', 'always', 'never'])[doc_id % 3 + 1] AS mode, doc_id % 5 <> 0 AS healthy FROM documents)"


@query("sc3_probe", "SELECT '/in/' || doc_id AS path, CASE WHEN doc_id % 9 > 0 THEN 'pcm_' || lang END AS codec, CASE WHEN doc_id % 4 > 0 THEN (8000 * (doc_id % 4))::INT ELSE 0 END AS sample_rate, greatest(1, doc_id % 3)::INT AS channels, CASE WHEN doc_id % 2 > 0 THEN 'stereo' ELSE '' END AS layout, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 5) / 2::DOUBLE ELSE doc_id / 4::DOUBLE END AS duration, CASE WHEN doc_id % 9 = 0 THEN 'no audio stream' END AS error FROM documents")
def _(s, d):
    i = F.col("doc_id")

    def line(key, value, known=None):
        return F.concat(F.lit(f" {key}="), value if known is None else F.when(known, value).otherwise("N/A"), F.lit("\r\n"))

    report = F.concat(F.lit("[STREAM]\n"), F.when(i % 9 > 0, line("codec_name", F.concat(F.lit("pcm_"), "lang"))).otherwise(""), line("sample_rate", (8000 * (i % 4)).cast("string"), i % 4 > 0), line("channels", (i % 3).cast("string")), line("channel_layout", F.lit("stereo"), i % 2 > 0), line("duration", (i % 5 / 2.0).cast("string")), line("duration", (i / 4.0).cast("string")))
    return ingest.probe(fx.table(s, d, "documents").select(F.concat(F.lit("/in/"), i.cast("string")).alias("path"), report.alias("report")))


@query("pf10_multitrack", "SELECT doc_id, channels >= 2 AND layout IN ('', 'stereo', 'unknown') AS multitrack FROM md", (MEDIA,))
def _(s, d):
    return _media(s, d).select("doc_id", ingest.looks_multitrack(F.col("channels"), F.col("layout")).alias("multitrack"))


@query("pf11_tracks", ", n AS (SELECT *, CASE WHEN channels BETWEEN 2 AND 8 AND layout IN ('', 'stereo', 'unknown') AND correlation < 0.35 THEN channels ELSE 1 END AS track_count FROM md) SELECT doc_id, track_count, unnest(range(track_count))::INT AS track FROM n", (MEDIA,))
def _(s, d):
    return ingest.expand_tracks(_media(s, d)).select("doc_id", "track_count", "track")


@query("pf12_isolation", "SELECT doc_id, healthy AND mode <> 'never' AND (mode = 'always' OR floor >= 0.28) AS isolate FROM md", (MEDIA,))
def _(s, d):
    return _media(s, d).select("doc_id", ingest.isolate(F.col("mode"), F.col("floor"), F.col("healthy")).alias("isolate"))


# --- words

TOK = """tk AS (SELECT item_id, unnest(range(0, length(text), 3)) // 3 AS pos, text FROM benchmark),
tok AS (SELECT item_id, pos, replace(substr(text, (pos * 3 + 1)::INT, 3), ' ', '▁') AS token, pos / 8::DOUBLE AS t_start, (pos + pos % 2) / 8::DOUBLE AS t_end, 0.5 + (pos % 50) / 128::DOUBLE AS probability FROM tk)"""


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens of three letters, timed by their place; every other one has no length."""
    b = fx.table(s, d, "benchmark").where("length(text) > 0").select("item_id", "text", F.explode(F.expr("sequence(0L, cast((length(text) - 1) div 3 as long))")).alias("pos"))
    return b.select("item_id", "pos", F.replace(F.expr("substr(text, cast(pos * 3 + 1 as int), 3)"), F.lit(" "), F.lit(words.MARK)).alias("token"), (F.col("pos") / 8.0).alias("t_start"), ((F.col("pos") + F.col("pos") % 2) / 8.0).alias("t_end"), (0.5 + F.col("pos") % 50 / 128.0).alias("probability"), F.lit(1e6).alias("seg_end"))


WORDS = """, a AS (SELECT *, starts_with(token, '▁') AS st FROM tok WHERE token NOT IN ('', '▁')), b AS (SELECT *, sum(st::INT) OVER (PARTITION BY item_id ORDER BY pos) AS w FROM a), c AS (SELECT *, w - first(w) OVER (PARTITION BY item_id ORDER BY pos) AS w_pos FROM b),
g AS (SELECT item_id, w_pos, string_agg(CASE WHEN st THEN substr(token, 2) ELSE token END, '' ORDER BY pos) AS text, arg_min(t_start, pos) AS w_start, max(t_end) AS e, min(probability) AS probability FROM c GROUP BY ALL)
"""


@query("wn5_words_from_tokens", WORDS + "SELECT item_id, w_pos::BIGINT AS w_pos, text, w_start, CASE WHEN e <= w_start THEN coalesce(lead(w_start) OVER (PARTITION BY item_id ORDER BY w_pos), 1e6::DOUBLE) ELSE e END AS w_end, probability FROM g", (TOK,))
def _(s, d):
    return words.from_tokens(_tokens(s, d), ["item_id"])


@query("ag15_segment_confidence", WORDS + "SELECT item_id, round(avg(probability), 6) AS confidence FROM g GROUP BY item_id", (TOK,))
def _(s, d):
    return words.confidence(words.from_tokens(_tokens(s, d), ["item_id"]), ["item_id"]).withColumn("confidence", F.round("confidence", 6))


_BLANK = "b AS (SELECT file_id, idx, CASE WHEN idx % 5 = 3 THEN '' ELSE text END AS text FROM seg)"


@query("wn6_renumbered_segments", "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS idx, text, false AS gaps FROM b WHERE text <> '' UNION ALL SELECT file_id, i, text, true FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS i FROM b) WHERE text <> ''", (fx.SEG, _BLANK))
def _(s, d):
    rows = fx.seg(s, d).select("file_id", "idx", F.when(F.col("idx") % 5 == 3, "").otherwise(F.col("text")).alias("text"))
    return words.renumber(rows, False).withColumn("gaps", F.lit(False)).unionByName(words.renumber(rows, True).withColumn("gaps", F.lit(True)))


# --- levels; the events of a user by time stand for samples, 4 a frame

SMP = "smp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value FROM events), en AS (SELECT user_id, pos // 4 AS frame, avg(abs(value)) AS energy FROM smp GROUP BY ALL HAVING count(*) = 4)"


def _energy(s: SparkSession, d: str, key: str = "user_id") -> DataFrame:
    e = fx.table(s, d, "events").select(F.expr(key).cast("long").alias("user_id"), "event_id", "value")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return levels.frame_energy(e.withColumn("pos", pos), "user_id", "pos", "value", 4)


@query("ag12_frame_energy", "SELECT user_id, frame, round(energy, 6) AS energy FROM en", (SMP,))
def _(s, d):
    return _energy(s, d).select("user_id", F.col("frame").cast("long").alias("frame"), F.round("energy", 6).alias("energy"))


_COARSE = SMP.replace("events)", "(SELECT user_id % 20 AS user_id, event_id, value FROM events))")


@query("fn28_noise_floor", "SELECT user_id, round(CASE WHEN count(*) < 20 THEN 0 WHEN (list_sort(list(energy)))[count(*) // 2 + 1] <= 1e-6 THEN 1 ELSE least(1::DOUBLE, (list_sort(list(energy)))[count(*) // 10 + 1] / (list_sort(list(energy)))[count(*) // 2 + 1]) END, 6) AS floor FROM en GROUP BY user_id", (_COARSE,))
def _(s, d):
    return levels.noise_floor(_energy(s, d, "user_id % 20"), "user_id").withColumn("floor", F.round("floor", 6))


@query("fn29_gates", "SELECT user_id, round(coalesce((list_sort(list(energy) FILTER (energy >= 2e-4)))[floor((count(*) FILTER (energy >= 2e-4) - 1) * 0.9::DOUBLE)::INT + 1], 0), 6) AS loud FROM en GROUP BY user_id", (_COARSE,))
def _(s, d):
    return levels.gates(_energy(s, d, "user_id % 20"), "user_id", "energy").select("user_id", F.round("loud", 6).alias("loud"))


CLIP = """sp AS (SELECT id // 6 AS clip, (id % 6 * 2)::DOUBLE AS a, (id % 6 * 2 + 4)::DOUBLE AS b, CASE WHEN id % 17 = 0 THEN 1e-5::DOUBLE ELSE (id % 13 + 1) / 16::DOUBLE END AS level, centroid FROM vp),
ld AS (SELECT clip, count(*) AS n, coalesce((list_sort(list(level) FILTER (level >= 2e-4)))[floor((count(*) FILTER (level >= 2e-4) - 1) * 0.9::DOUBLE)::INT + 1], 0) AS loud FROM sp GROUP BY clip),
kp AS (SELECT sp.*, n FROM sp JOIN ld USING (clip) WHERE level >= greatest(loud * 0.12::DOUBLE, 2e-4)),
cx AS (SELECT clip, pos, avg(x) AS x FROM (SELECT clip, unnest(range(64)) AS pos, unnest(centroid) AS x FROM kp) GROUP BY ALL), cc AS (SELECT clip, list(x ORDER BY pos) AS c FROM cx GROUP BY clip),
an AS (SELECT kp.clip, count(*) AS windows, sum(b - a) * CASE WHEN any_value(n) > 1 THEN 0.5::DOUBLE ELSE 1 END AS duration, CASE WHEN count(*) = 1 THEN 1 ELSE least(1, min(list_cosine_similarity(centroid, c))) END AS coherence FROM kp JOIN cc USING (clip) GROUP BY kp.clip)"""


@query("id20_clip_analysis", "SELECT clip, windows, duration, round(coherence, 6) AS coherence, duration >= 3 AS usable, CASE WHEN duration < 3 THEN 'short' WHEN windows > 1 AND coherence < 0.72 THEN 'mixed' ELSE '' END AS problem FROM an", (fx.VP, CLIP))
def _(s, d):
    i = F.col("id")
    spans = fx.vp(s, d).select(F.expr("id div 6").alias("clip"), (i % 6 * 2).cast("double").alias("start"), (i % 6 * 2 + 4).cast("double").alias("end"), F.when(i % 17 == 0, 1e-5).otherwise((i % 13 + 1) / 16.0).alias("level"), F.col("centroid").alias("vector"))
    return levels.analyse_clips(spans).withColumn("coherence", F.round("coherence", 6))


@query("ag10_clip_coherence", "SELECT clip, round(coherence, 6) AS coherence FROM an WHERE windows > 1", (fx.VP, CLIP))
def _(s, d):
    i = F.col("id")
    spans = fx.vp(s, d).select(F.expr("id div 6").alias("clip"), F.lit(0.0).alias("start"), F.lit(4.0).alias("end"), F.when(i % 17 == 0, 1e-5).otherwise((i % 13 + 1) / 16.0).alias("level"), F.col("centroid").alias("vector"))
    return levels.analyse_clips(spans).where("windows > 1").select("clip", F.round("coherence", 6).alias("coherence"))


@query("ag21_usable_clips", "SELECT global_id, count(*) FILTER (duration >= 3) AS usable, coalesce(sum(duration) FILTER (duration >= 3), 0::DOUBLE) AS seconds FROM enr GROUP BY global_id", (fx.VP, fx.ENR))
def _(s, d):
    return levels.usable_clips(fx.enr(s, d))


# --- progress

EVL = "ev AS (SELECT event_id, user_id % 40 AS file_id, event_type, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'finished' ELSE 'stage' END AS kind, CASE event_type WHEN 'view' THEN 'transcribing' WHEN 'click' THEN 'diarizing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'writing' END AS stage, value / 100 AS fraction FROM events)"


def _log(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "signup", "started").when(e == "purchase", "finished").otherwise("stage")
    stage = F.when(e == "view", "transcribing").when(e == "click", "diarizing").when(e == "purchase", "done").when(e == "error", "failed").otherwise("writing")
    return fx.table(s, d, "events").select("event_id", (F.col("user_id") % 40).alias("file_id"), kind.alias("kind"), stage.alias("stage"), (F.col("value") / 100).alias("fraction"))


@query("wn10_queue_states", "SELECT file_id, coalesce(arg_max(stage, event_id) FILTER (kind <> 'started'), 'probing') AS stage, coalesce(arg_max(CASE WHEN kind = 'finished' THEN -1 ELSE fraction END, event_id) FILTER (kind <> 'started'), -1) AS fraction, coalesce(max(event_id) FILTER (kind <> 'started' AND stage = 'failed') > coalesce(max(event_id) FILTER (kind = 'started'), -1), false) AS failed FROM ev GROUP BY file_id", (EVL,))
def _(s, d):
    return progress.queue_states(_log(s, d), "file_id", "event_id")


_STAGES = "[" + ", ".join(f"'{x}'" for x in progress.STAGES) + "]"


@query("fn22_stage_names", f"SELECT event_id, coalesce(({_STAGES})[event_id % 14 + 1], 'unknown') AS stage, coalesce((['debug', 'info', 'warn', 'error'])[event_id % 5 + 1], 'info') AS level FROM events")
def _(s, d):
    i = F.col("event_id")
    return fx.table(s, d, "events").select("event_id", progress.stage_name(i % 14).alias("stage"), progress.level_name(i % 5).alias("level"))


@query("fn23_percent", ", p AS (SELECT event_id, event_id % 12 AS st, value / 40 - 1 AS fr FROM events) SELECT event_id, CASE WHEN st IN (9, 11) THEN 100 WHEN st < 1 THEN 0 ELSE least(greatest(floor((least(st, 8) - 1 + CASE WHEN fr >= 0 THEN least(fr, 1) ELSE 0 END) / 8::DOUBLE * 100 + 0.5), 0), 99) END::INT AS percent FROM p".replace(", p AS", "WITH p AS", 1))
def _(s, d):
    return fx.table(s, d, "events").select("event_id", progress.percent(F.col("event_id") % 12, F.col("value") / 40 - 1).alias("percent"))


@query("fn24_run_percent", "SELECT event_id, greatest(0, least(100, floor(100 * CASE WHEN event_id % 3 > 0 THEN value / ((event_id % 3) * 60) WHEN user_id % 4 > 0 THEN (event_id % 5) / (user_id % 4)::DOUBLE ELSE 0 END + 0.5)))::INT AS percent FROM events")
def _(s, d):
    e, u = F.col("event_id"), F.col("user_id")
    return fx.table(s, d, "events").select("event_id", progress.run_percent(F.col("value"), e % 3 * 60, e % 5, u % 4).alias("percent"))


@query("fn25_queue_names", "SELECT path, string_split(path, '/')[-1] || CASE WHEN doc_id % 3 > 0 THEN ' [track ' || (doc_id % 3) || '/' || (doc_id % 3 + 1) || ']' ELSE '' END AS shown FROM fl", (fx.FILES,))
def _(s, d):
    i = F.col("doc_id") % 3
    return fx.files(s, d).select("path", progress.queue_name(F.col("path"), i - 1, i + 1).alias("shown"))


@query("ag20_run_totals", "SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, sum(size) FILTER (status = 'done')::DOUBLE AS audio, sum(size) FILTER (status = 'done') / 64::DOUBLE AS realtime FROM fl", (fx.FILES,))
def _(s, d):
    return progress.run_totals(fx.files(s, d).withColumn("duration", F.col("size").cast("double")), F.lit(64.0))


@query("pf15_log_level", "SELECT event_id, (['debug', 'info', 'warn', 'error'])[user_id % 4 + 1] AS level FROM events WHERE user_id % 4 >= 2")
def _(s, d):
    log = fx.table(s, d, "events").select("event_id", (F.col("user_id") % 4).alias("level"))
    return progress.at_level(log, "warn").select("event_id", progress.level_name(F.col("level")).alias("level"))


@query("so6_log_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 5000")
def _(s, d):
    return progress.tail(fx.table(s, d, "events").select("event_id", "event_type"), "event_id")


# --- paths and vectors


@query("fn20_mirrored_paths", "SELECT path, '/out/' || CASE WHEN starts_with(path, '/in/') THEN string_split(path, '/')[3] || '/' ELSE '' END || regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') || CASE WHEN doc_id % 3 > 0 THEN '.track' || (doc_id % 3) ELSE '' END || '.srt' AS out FROM fl", (fx.FILES,))
def _(s, d):
    i = F.col("doc_id") % 3
    return fx.files(s, d).select("path", t.output_path(F.lit("/out"), F.col("path"), i - 1, i + 1, F.lit("SRT"), F.lit("/in")).alias("out"))


@query("fn21_common_roots", "SELECT doc_id % 10 AS part, CASE WHEN count(DISTINCT source) = 1 THEN '/in/' || any_value(source) ELSE '/in' END AS root FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(s, d):
    rows = fx.files(s, d).where("path is not null").groupBy((F.col("doc_id") % 10).alias("part"))
    # the least and the greatest path share what all share
    return rows.agg(F.array(F.min("path"), F.max("path")).alias("p")).select("part", t.common_root(F.col("p")).alias("root"))


@query("fn17_normalised", ", x AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE * 3 AS x FROM embeddings) SELECT vec_id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 5) AS x FROM x".replace(", x AS", "WITH x AS", 1))
def _(s, d):
    e = fx.table(s, d, "embeddings").select("vec_id", v.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("fn19_canonical_pairs", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem")
def _(s, d):
    low, high = v.canonical_pair(F.col("l_partkey"), F.col("l_suppkey"))
    return fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"))


@query("pf3_local_labels", "SELECT file_id, speaker, printf('speaker_%02d', speaker) AS label FROM trn", (fx.SEG, fx.TRN))
def _(s, d):
    return fx.trn(s, d).select("file_id", "speaker", t.local_label(F.col("speaker")).alias("label"))


VOICE = """tv AS (SELECT file_id, (id % 2)::INT AS speaker, (id * 10)::DOUBLE AS t_start, id * 10 + CASE WHEN file_id % 3 = 0 THEN 0.5::DOUBLE + (id % 4) / 4::DOUBLE ELSE total_dur / 4 END AS t_end, centroid FROM vp),
td AS (SELECT *, t_end - t_start AS dur, max(t_end - t_start) OVER (PARTITION BY file_id, speaker) AS top, sum(t_end - t_start) OVER (PARTITION BY file_id, speaker) AS total_dur FROM tv),
tc AS (SELECT * FROM td WHERE dur >= CASE WHEN top >= 3 THEN 3 ELSE 0.6 END QUALIFY row_number() OVER (PARTITION BY file_id, speaker ORDER BY dur DESC, t_start) <= 8),
tn AS (SELECT file_id, speaker, count(*) AS n_segments, any_value(total_dur) AS total_dur FROM tc GROUP BY ALL),
tx AS (SELECT file_id, speaker, pos, sum(x * dur) / sum(dur) AS x FROM (SELECT file_id, speaker, dur, unnest(range(64)) AS pos, unnest(centroid) AS x FROM tc) GROUP BY ALL)"""


@query("id18_voiceprints", "SELECT file_id, speaker, n_segments, total_dur, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY file_id, speaker)), 6) AS x FROM tx JOIN tn USING (file_id, speaker)", (fx.VP, VOICE))
def _(s, d):
    i = F.col("id")
    length = F.when(F.col("file_id") % 3 == 0, 0.5 + i % 4 / 4.0).otherwise(F.col("total_dur") / 4)
    turns = fx.vp(s, d).select("file_id", (i % 2).cast("int").alias("speaker"), (i * 10).cast("double").alias("t_start"), (i * 10 + length).alias("t_end"), F.col("centroid").alias("vector"))
    return identity.voiceprints(turns).select("file_id", "speaker", "n_segments", "total_dur", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))
