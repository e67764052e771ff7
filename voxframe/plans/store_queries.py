"""Queries of the store: lookups, changes, identities, and transcripts as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions import text as t
from voxframe.operators import attribution, identity, matching, render, store
from voxframe.operators.similarity import near_identities, pairs_above
from voxframe.plans import fixtures as fx
from voxframe.plans.registry import query
from voxframe.sources import config, wav
from voxframe.workspace import new_path

VP, LOC, GS, ENR = (fx.VP,), (fx.VP, fx.LOC), (fx.VP, fx.LOC, fx.GS), (fx.VP, fx.LOC, fx.GS, fx.ENR)

# --- lookups


@query("sc1_discovered_paths", "SELECT DISTINCT path FROM (SELECT path FROM fl UNION ALL SELECT path FROM scan) WHERE ends_with(path, '.wav') ORDER BY path", (fx.FILES, fx.SCAN))
def _(s, d):
    return wav.media_paths(fx.files(s, d).select("path").union(fx.scan(s, d).select("path")))


@query("sc8_file", "SELECT path, track, size, mtime, status FROM fl WHERE doc_id = 17", (fx.FILES,))
def _(s, d):
    return fx.files(s, d).where("doc_id = 17").select("path", "track", "size", "mtime", "status")


@query("sc10_speakers_of_file", "SELECT id, label, total_dur, global_id FROM loc WHERE file_id = 4 ORDER BY label", LOC)
def _(s, d):
    return fx.loc(s, d).where("file_id = 4").select("id", "label", "total_dur", "global_id").orderBy("label")


@query("sc12_clips_of_identity", "SELECT id, duration FROM enr WHERE global_id = 10 ORDER BY id", ENR)
def _(s, d):
    return fx.enr(s, d).where("global_id = 10").select("id", "duration").orderBy("id")


OUT = "ou AS (SELECT user_id AS file_id, event_type AS format, '/out/' || event_id AS path, event_id FROM events)"


def _outputs(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("format"), F.concat(F.lit("/out/"), F.col("event_id").cast("string")).alias("path"), "event_id")


@query("sc15_outputs_of_file", "SELECT format, arg_max(path, event_id) AS path FROM ou WHERE file_id = (SELECT min(user_id) FROM events) GROUP BY format ORDER BY format", (OUT,))
def _(s, d):
    rows = _outputs(s, d)
    one = rows.join(rows.agg(F.min("file_id").alias("file_id")), "file_id")
    return store.last_wins(one, ["file_id", "format"], F.col("event_id")).select("format", "path").orderBy("format")


DIS = "di AS (SELECT DISTINCT id % 50 AS low, id % 50 + 1 + id % 7 AS high FROM vp)"


def _dismissed(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return store.dismiss(s.createDataFrame([], "low long, high long"), fx.vp(s, d).select((i % 50 + 1 + i % 7).alias("a"), (i % 50).alias("b")))


@query("sc16_dismissed_pairs", "SELECT low, high FROM di ORDER BY low, high", (fx.VP, DIS))
def _(s, d):
    return _dismissed(s, d).orderBy("low", "high")


@query("sc17_columns", "SELECT column_name AS name, column_name IN ('text', 'lang') AS wanted FROM (DESCRIBE documents)")
def _(s, d):
    docs = fx.table(s, d, "documents")
    return store.columns(docs).withColumn("wanted", F.col("name").isin(*[c for c in ("text", "lang", "nothing") if store.has_column(docs, c)]))


@query("pf13_enrolled_only", "SELECT id, name FROM gs WHERE enrolled", GS)
def _(s, d):
    return identity.enrolled(fx.gs(s, d)).select("id", "name")


@query("pf5_missing_centroids", "SELECT id FROM vp WHERE id % 9 > 1", VP)
def _(s, d):
    rows = fx.vp(s, d).withColumn("centroid", F.when(F.col("id") % 9 > 1, F.col("centroid")).when(F.col("id") % 9 == 1, F.array().cast("array<double>")))
    return identity.with_vectors(rows).select("id")


@query("pf14_targets", ", q AS (SELECT unnest(['20', '007', '9999', 'person 8', 'PERSON 12', 'Nobody', 'person 4', '']) AS who), n AS (SELECT * FROM gs UNION ALL SELECT 1004, 'Person 4', false, NULL), m AS (SELECT who, count(n.id) AS c, min(n.id) AS id FROM q LEFT JOIN n ON CASE WHEN regexp_full_match(who, '[0-9]+') THEN n.id = TRY_CAST(who AS BIGINT) ELSE lower(n.name) = lower(who) END GROUP BY who) SELECT who, CASE WHEN c = 1 THEN 'join' WHEN c = 0 AND NOT regexp_full_match(who, '[0-9]+') THEN 'create' ELSE 'error' END AS action, CASE WHEN c = 1 THEN id END AS id FROM m", GS)
def _(s, d):
    asked = s.createDataFrame([(x,) for x in ("20", "007", "9999", "person 8", "PERSON 12", "Nobody", "person 4", "")], "who string")
    more = s.createDataFrame([(1004, "Person 4")], "id long, name string")
    return identity.resolve_targets(asked, fx.gs(s, d).select("id", "name").unionByName(more))


# --- changes


@query("sk3_file_meta", "SELECT path, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS channels FROM fl", (fx.FILES,))
def _(s, d):
    f = fx.files(s, d).select("path", "doc_id", F.lit(1).alias("channels"))
    return store.update(f, f.where("doc_id % 3 = 0").select("path", F.lit(2).alias("channels")), "path", ["channels"]).select("path", "channels")


@query("sk7_put_locals", ", st AS (SELECT id, file_id, label, total_dur, id % 4 AS n_segments, global_id, 0.75::DOUBLE AS similarity FROM loc WHERE id % 3 > 0), fr AS (SELECT file_id, label, total_dur + 1 AS total_dur, 9 AS n_segments FROM loc WHERE id % 4 < 2), nw AS (SELECT * FROM fr ANTI JOIN st USING (file_id, label)) SELECT id, st.file_id, st.label, coalesce(fr.total_dur, st.total_dur) AS total_dur, coalesce(fr.n_segments, st.n_segments)::BIGINT AS n_segments, global_id, similarity FROM st LEFT JOIN fr ON fr.file_id = st.file_id AND fr.label = st.label UNION ALL SELECT (SELECT max(id) FROM st) + row_number() OVER (ORDER BY file_id, label), file_id, label, total_dur, n_segments, NULL, NULL FROM nw", LOC)
def _(s, d):
    rows = fx.loc(s, d).select("id", "file_id", "label", "centroid", "total_dur", (F.col("id") % 4).alias("n_segments"), "global_id", F.lit(0.75).alias("similarity"))
    none = F.lit(None)
    fresh = rows.where("id % 4 < 2").select("file_id", "label", "centroid", (F.col("total_dur") + 1).alias("total_dur"), F.lit(9).cast("long").alias("n_segments"), none.cast("long").alias("global_id"), none.cast("double").alias("similarity"))
    return store.put_locals(rows.where("id % 3 > 0"), fresh).drop("centroid")


@query("sk9_minted_identities", "SELECT id AS local_id, (SELECT max(id) FROM gs) + row_number() OVER (ORDER BY file_id, label) AS id FROM loc WHERE total_dur > 20", GS)
def _(s, d):
    rows = fx.loc(s, d).where("total_dur > 20").select(F.col("id").alias("local_id"), "file_id", "label")
    return store.mint(fx.gs(s, d), rows, ["file_id", "label"]).select("local_id", "id")


@query("sk12_renamed_identities", "SELECT id, CASE WHEN id % 6 = 0 THEN 'Guest ' || id ELSE name END AS name FROM gs", GS)
def _(s, d):
    g = fx.gs(s, d).select("id", "name")
    return store.update(g, g.where("id % 6 = 0").select("id", F.concat(F.lit("Guest "), F.col("id").cast("string")).alias("name")), "id", ["name"])


@query("sk16_refreshed_usage", "SELECT gs.id, count(l.id) AS n_locals, coalesce(sum(l.total_dur), 0) AS total_dur FROM gs LEFT JOIN (SELECT * FROM loc WHERE global_id % 3 > 0) l ON l.global_id = gs.id GROUP BY gs.id", GS)
def _(s, d):
    return identity.report(fx.gs(s, d), fx.loc(s, d).where("global_id % 3 > 0"), fx.enr(s, d)).select("id", "n_locals", "total_dur")


@query("sk18_deleted_clips", "SELECT global_id, count(*) AS n FROM enr WHERE id % 4 > 0 AND global_id <> 20 GROUP BY global_id", ENR)
def _(s, d):
    clips = fx.enr(s, d).select("id", "global_id")
    left = store.delete(store.delete(clips, clips.where("id % 4 = 0").select("id"), "id"), clips.where("global_id = 20").select("global_id").distinct(), "global_id")
    return left.groupBy("global_id").agg(F.count("*").alias("n"))


@query("sk20_undismissed_pairs", "SELECT low, high FROM di WHERE low % 3 > 0", (fx.VP, DIS))
def _(s, d):
    rows = _dismissed(s, d)
    return store.undismiss(rows, rows.where("low % 3 = 0").select(F.col("high").alias("a"), F.col("low").alias("b")))


@query("sk25_cascade", "SELECT 'files' AS kind, count(*) AS n FROM (SELECT DISTINCT file_id FROM loc) WHERE file_id % 4 > 0 UNION ALL SELECT 'locals', count(*) FROM loc WHERE file_id % 4 > 0 UNION ALL SELECT 'unowned', count(*) FROM loc WHERE file_id % 4 > 0 AND global_id % 5 = 0", LOC)
def _(s, d):
    loc = fx.loc(s, d).select("id", "file_id", "global_id")
    files = loc.select(F.col("file_id").alias("id")).distinct()
    left = store.cascade(files, {"locals": loc}, files.where("id % 4 = 0"))
    gone = loc.where("global_id % 5 = 0").select(F.col("global_id").alias("id"))
    unowned = store.forget(left["locals"], gone).where("global_id is null")
    parts = [("files", left["files"]), ("locals", left["locals"]), ("unowned", unowned)]
    out = [rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, rows in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("sk24_committed_version", "SELECT file_id, count(*) AS n FROM loc WHERE file_id % 2 = 0 GROUP BY file_id", LOC)
def _(s, d):
    root, loc = new_path(s, "store"), fx.loc(s, d).select("id", "file_id")
    store.commit({"locals": loc}, root)
    store.commit({"locals": store.current(s, root)["locals"].where("file_id % 2 = 0")}, root)
    return store.current(s, root)["locals"].groupBy("file_id").agg(F.count("*").alias("n"))


@query("jn12_aligned_labels", ", n AS (SELECT file_id, idx, 'x' || idx % 2 AS local_label FROM seg WHERE file_id % 3 = 0 OR (file_id % 3 = 1 AND idx > 0)) SELECT file_id, idx, local_label FROM n UNION ALL SELECT file_id, idx, local_label FROM seg ANTI JOIN n USING (file_id)", (fx.SEG,))
def _(s, d):
    old = fx.seg(s, d).select("file_id", "idx", "local_label")
    new = old.where("file_id % 3 = 0 or (file_id % 3 = 1 and idx > 0)").select("file_id", "idx", F.concat(F.lit("x"), (F.col("idx") % 2).cast("string")).alias("local_label"))
    return store.align_or_replace(old, new, ["local_label"])


# --- identities


@query("pf2_speaker_labels", "SELECT s.file_id, s.idx, coalesce(CASE WHEN g.name <> '' THEN g.name ELSE printf('SPEAKER_%04d', g.id) END, s.local_label) AS label FROM seg s LEFT JOIN loc l ON l.file_id = s.file_id AND l.label = s.local_label LEFT JOIN (SELECT * FROM gs WHERE id % 7 > 0) g ON g.id = l.global_id", (fx.SEG, *GS))
def _(s, d):
    rows = identity.relabelled(fx.seg(s, d).select("file_id", "idx", "local_label"), fx.loc(s, d))
    return identity.shown(rows, fx.gs(s, d).where("id % 7 > 0")).select("file_id", "idx", "label")


@query("pf16_merge_direction", ", f AS (SELECT global_id, count(DISTINCT file_id) AS n FROM loc GROUP BY 1), p AS (SELECT a.id AS left_id, b.id AS right_id, a.name <> '' AS ln, b.name <> '' AS rn, coalesce(fa.n, 0) AS lf, coalesce(fb.n, 0) AS rf FROM gs a JOIN gs b ON b.id = a.id + 3 LEFT JOIN f fa ON fa.global_id = a.id LEFT JOIN f fb ON fb.global_id = b.id) SELECT left_id, right_id, CASE WHEN (rn AND NOT ln) OR (rn = ln AND rf > lf) THEN right_id ELSE left_id END AS into_id FROM p", GS)
def _(s, d):
    r = identity.report(fx.gs(s, d), fx.loc(s, d), fx.enr(s, d)).select("id", "display", "n_files")
    a = r.select(F.col("id").alias("left_id"), F.col("display").alias("ld"), F.col("n_files").alias("lf"))
    b = r.select((F.col("id") - 3).alias("left_id"), F.col("id").alias("right_id"), F.col("display").alias("rd"), F.col("n_files").alias("rf"))
    return a.join(b, "left_id").select("left_id", "right_id", identity.merge_into(*[F.col(c) for c in ("left_id", "ld", "lf", "right_id", "rd", "rf")]).alias("into_id"))


@query("ag7_files_of_identities", "SELECT global_id, list_sort(list(DISTINCT file_id))::VARCHAR AS files FROM loc GROUP BY global_id", LOC)
def _(s, d):
    ids = F.array_join(F.col("files").cast("array<string>"), ", ")
    return identity.files_of(fx.loc(s, d)).select("global_id", F.concat(F.lit("["), ids, F.lit("]")).alias("files"))


@query("ag9_named_by_speech", "SELECT gt, global_id FROM loc JOIN gs ON gs.id = global_id AND name <> '' QUALIFY row_number() OVER (PARTITION BY gt ORDER BY total_dur DESC, loc.id) = 1", GS)
def _(s, d):
    named = fx.gs(s, d).select(F.col("id").alias("global_id"), (F.col("name") != "").alias("named"))
    return matching.by_name(fx.loc(s, d).join(named, "global_id"), "gt").withColumnRenamed("by_name", "global_id")


@query("ag17_cluster_totals", "SELECT gt, count(*) AS members, sum(total_dur) AS total_dur FROM vp GROUP BY gt", VP)
def _(s, d):
    return identity.cluster_totals(fx.vp(s, d), "gt")


@query("id1_enrolled_profiles", "SELECT global_id, count(*) AS clips, sum(duration) AS seconds FROM enr WHERE id % 10 > 0 GROUP BY global_id", ENR)
def _(s, d):
    return identity.profiles(fx.enr(s, d).withColumn("centroid", F.when(F.col("id") % 10 > 0, F.col("centroid")).otherwise(F.array().cast("array<double>"))))


@query("id8_folded_centroids", ", u AS (SELECT global_id, count(*) AS n, sum(total_dur) AS d FROM loc GROUP BY 1), m AS (SELECT (id + 3) % " + fx.N + " + 1 AS id, centroid, total_dur FROM vp WHERE total_dur >= 8), j AS (SELECT gs.id, coalesce(n, 0) AS n, coalesce(d, 0) AS d, gs.centroid AS c, m.centroid AS o, m.total_dur AS t FROM gs LEFT JOIN u ON u.global_id = gs.id LEFT JOIN m ON m.id = gs.id), x AS (SELECT id, CASE WHEN o IS NULL THEN n ELSE n + 1 END AS n_locals, d + coalesce(t, 0) AS total_dur, unnest(range(64)) AS pos, unnest([CASE WHEN o IS NULL THEN c[i] ELSE (c[i] * greatest(n, 1) + o[i]) / (greatest(n, 1) + 1) END for i in range(1, 65)]) AS x FROM j) SELECT id, n_locals, total_dur, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM x", GS)
def _(s, d):
    r = identity.report(fx.gs(s, d), fx.loc(s, d), fx.enr(s, d)).select("id", "n_locals", "total_dur")
    found = fx.vp(s, d).where("total_dur >= 8").select(((F.col("id") + 3) % fx.voices(s, d) + 1).alias("global_id"), "centroid", "total_dur")
    return identity.fold(fx.gs(s, d).select("id", "centroid").join(r, "id"), found).select("id", "n_locals", "total_dur", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("id11_enrolment_flags", "SELECT id, id IN (SELECT global_id FROM enr WHERE id % 3 > 0) AS enrolled FROM gs", ENR)
def _(s, d):
    return identity.refresh_enrolment(fx.gs(s, d), fx.enr(s, d).where("id % 3 > 0")).select("id", "enrolled")


@query("se2_shared_file_pairs", "SELECT a.id AS a, b.id AS b, len(list_intersect(fa.f, fb.f)) > 0 AS shared, len(list_distinct(list_concat(fa.f, fb.f))) AS files FROM gs a JOIN gs b ON b.id = a.id + 5 JOIN (SELECT global_id, list(DISTINCT file_id) AS f FROM loc GROUP BY 1) fa ON fa.global_id = a.id JOIN (SELECT global_id, list(DISTINCT file_id) AS f FROM loc GROUP BY 1) fb ON fb.global_id = b.id", GS)
def _(s, d):
    pairs = fx.gs(s, d).select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    return identity.compare_files(fx.loc(s, d), pairs)


@query("se4_unknown_keys", f"SELECT DISTINCT key FROM (SELECT source AS key FROM documents UNION ALL SELECT ({list(config.KEYS)})[doc_id % {len(config.KEYS)} + 1] FROM documents UNION ALL SELECT upper('model')) WHERE key NOT IN (SELECT unnest({list(config.KEYS)}))")
def _(s, d):
    doc = fx.table(s, d, "documents")
    known = F.element_at(F.array(*[F.lit(k) for k in config.KEYS]), (F.col("doc_id") % len(config.KEYS) + 1).cast("int"))
    keys = doc.select(F.col("source").alias("key")).union(doc.select(known)).union(s.createDataFrame([("MODEL",)], "key string"))
    return config.unknown_keys(keys)


@query("jn3_near_clips", "SELECT l.id AS local_id, e.global_id, round(max(list_cosine_similarity(l.centroid, e.centroid)), 6) AS similarity FROM vp l, enr e GROUP BY ALL HAVING max(list_cosine_similarity(l.centroid, e.centroid)) >= 0.55", ENR)
def _(s, d):
    near = near_identities(fx.vp(s, d), fx.enr(s, d), 0.55)
    return near.select("local_id", "global_id", F.round("similarity", 6).alias("similarity"))


@query("id15_review_band", "SELECT a.id AS a, b.id AS b FROM vp a JOIN vp b ON a.id < b.id AND a.file_id <> b.file_id WHERE list_cosine_similarity(a.centroid, b.centroid) >= 0.5 AND list_cosine_similarity(a.centroid, b.centroid) < 0.65", VP)
def _(s, d):
    rows = fx.vp(s, d).select("id", "file_id", F.col("centroid").alias("v"))
    return pairs_above(rows, 0.5, 0.65, F.array("file_id"), lambda x, y: x[..., 0] != y[..., 0]).select("a", "b")


# --- transcripts


@query("sk28_transcript_files", ", x AS (SELECT file_id, string_agg(local_label || ': ' || text || chr(10), '' ORDER BY idx) AS body FROM seg WHERE text <> '' GROUP BY file_id) SELECT file_id, strlen(body) AS n_bytes, md5(body) AS md5 FROM x", (fx.SEG,))
def _(s, d):
    root = new_path(s, "transcripts")
    bodies = render.render(fx.seg(s, d).withColumnRenamed("local_label", "label"), "txt")
    paths = bodies.select("file_id", t.output_path(F.lit("out"), F.concat(F.lit("/in/"), F.col("file_id").cast("string"), F.lit(".wav")), F.lit(0), F.lit(1), F.lit("TXT")).alias("path"))
    render.write_files(bodies, paths, root).write.format("noop").mode("overwrite").save()
    back = s.read.format("binaryFile").load(f"{root}/out/*.txt")
    return back.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("file_id"), F.col("length").alias("n_bytes"), F.md5("content").alias("md5"))


@query("rn8_rerendered", "SELECT count(DISTINCT s.file_id) AS n FROM seg s JOIN (SELECT doc_id FROM fl WHERE status = 'done') f ON f.doc_id = s.file_id", (fx.SEG, fx.FILES))
def _(s, d):
    done = fx.files(s, d).where("status = 'done'").select(F.col("doc_id").alias("file_id"))
    rows = fx.seg(s, d).join(done, "file_id", "left_semi").withColumnRenamed("local_label", "label")
    return render.render(rows, "srt").agg(F.count("*").alias("n"))


@query("rn5_markdown_head", ", x AS (SELECT file_id, max(seg_end) AS d FROM seg GROUP BY file_id) SELECT file_id, '# talk ' || file_id || chr(10) || chr(10) || CASE WHEN file_id % 2 > 0 THEN 'Track 1 of 2  ' || chr(10) ELSE '' END || 'Duration: ' || CASE WHEN floor(d + 0.5)::BIGINT >= 3600 THEN printf('%dh %02dm', floor(d + 0.5)::BIGINT // 3600, floor(d + 0.5)::BIGINT % 3600 // 60) WHEN floor(d + 0.5)::BIGINT >= 60 THEN printf('%dm %02ds', floor(d + 0.5)::BIGINT // 60, floor(d + 0.5)::BIGINT % 60) ELSE printf('%ds', floor(d + 0.5)::BIGINT) END || '  ' || chr(10) || 'Language: en  ' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS head FROM x", (fx.SEG,))
def _(s, d):
    seg = fx.seg(s, d)
    files = seg.groupBy("file_id").agg(F.max("seg_end").alias("duration")).select("file_id", F.concat(F.lit("talk "), F.col("file_id").cast("string")).alias("source"), F.lit(0).alias("track"), F.when(F.col("file_id") % 2 > 0, 2).otherwise(1).alias("track_count"), "duration", F.lit("en").alias("language"), F.lit(None).cast("string").alias("model"))
    body = render.markdown(attribution.fold_runs(seg, "local_label"), files)
    return body.select("file_id", F.concat(F.substring_index("body", "---\n\n", 1), F.lit("---\n\n")).alias("head"))


@query("rn9_speaker_table", "SELECT id, printf('%-6d%-16s%6.1f', id, CASE WHEN name <> '' THEN name ELSE printf('SPEAKER_%04d', id) END, (SELECT coalesce(sum(total_dur), 0) FROM loc WHERE global_id = gs.id) / 64) AS line FROM gs", GS)
def _(s, d):
    r = identity.report(fx.gs(s, d), fx.loc(s, d), fx.enr(s, d))
    return r.select("id", F.concat(F.format_string("%-6d%-16s", "id", "display"), t.fixed(F.col("total_dur") / 64, 1, 6)).alias("line"))


@query("wn1_runs_by_identity", "SELECT file_id, count(*) AS blocks FROM (SELECT file_id, idx, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER (PARTITION BY file_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM (SELECT s.file_id, s.idx, coalesce(l.global_id::VARCHAR, s.local_label) AS k FROM seg s LEFT JOIN loc l ON l.file_id = s.file_id AND l.label = s.local_label)) WHERE new = 1 GROUP BY file_id", (fx.SEG, *LOC))
def _(s, d):
    refs = fx.loc(s, d).select("file_id", F.col("label").alias("local_label"), "global_id")
    rows = fx.seg(s, d).join(refs, ["file_id", "local_label"], "left").withColumn("k", F.coalesce(F.col("global_id").cast("string"), "local_label"))
    by = Window.partitionBy("file_id").orderBy("idx")
    return rows.withColumn("new", ~F.lag("k").over(by).eqNullSafe(F.col("k"))).groupBy("file_id").agg(F.count_if("new").alias("blocks"))
