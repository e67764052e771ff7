import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F
from voxframe.engine import Engine
from voxframe.operators import store
from voxframe.operators.inference import VECTOR, infer
from voxframe.sources import config

A, B, C = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def voices(spark, rows):
    return spark.createDataFrame(rows, "file_id long, label string, centroid array<double>, total_dur double, n_segments long")


def segments(spark, rows):
    return spark.createDataFrame(rows, "file_id long, idx long, text string, seg_start double, seg_end double, local_label string")


def test_a_corpus_from_files_to_transcripts(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", config.Settings(out_dir=f"file://{tmp_path}/out"))
    seen = spark.createDataFrame([("/in/x.wav", 0, 1, 10, 5.0, 60.0, "en"), ("/in/y.wav", 0, 1, 10, 5.0, 60.0, "en")], "path string, track int, track_count int, size long, mtime double, duration double, language string")
    jobs = {r.path: r.id for r in e.enqueue(seen).collect()}
    assert sorted(jobs.values()) == [1, 2]
    x, y = jobs["/in/x.wav"], jobs["/in/y.wav"]
    e.add(segments(spark, [(x, 0, "hello", 0.0, 1.0, "speaker_00"), (x, 1, "hi", 1.0, 2.0, "speaker_01")]), voices(spark, [(x, "speaker_00", A, 20.0, 2), (x, "speaker_01", B, 3.0, 1)]))
    assert [(r.id, r.n_locals) for r in e.speakers().collect()] == [(1, 1)]  # the other is under the speech floor
    e.name(1, "Ann")
    near = [0.9, 0.3, 0.0]
    e.add(segments(spark, [(y, 0, "again", 0.0, 1.0, "speaker_00"), (y, 1, "new", 1.0, 2.0, "speaker_01")]), voices(spark, [(y, "speaker_00", near, 20.0, 2), (y, "speaker_01", C, 30.0, 1)]))
    got = {r.id: r for r in e.tables()["identities"].collect()}
    assert len(got) == 2 and got[1].centroid[1] == pytest.approx(0.156, abs=0.02) and got[2].centroid == C
    assert [r.action for r in e.enqueue(seen).collect()] == []
    assert {r.file_id: r.body for r in e.render("TXT").collect()} == {x: "Ann: hello\nspeaker_01: hi\n", y: "Ann: again\nSPEAKER_0002: new\n"}
    assert [r.text for r in e.search("ANN: ").collect()] == [] and sorted(r.text for r in e.search("ann").collect()) == ["again", "hello"]
    paths = e.tables()["files"].select(F.col("id").alias("file_id"), F.concat(F.col("id").cast("string"), F.lit(".md")).alias("path"))
    for _ in range(2):
        assert e.render("md", paths).count() == 2
    assert e.tables()["outputs"].count() == 2 and "**Ann** `00:00:00.000`" in (tmp_path / "out" / f"{x}.md").read_text()
    assert '"speaker": "Ann"' in e.render("json").where(F.col("file_id") == x).head().body
    e.enroll("Zoe", "clip.wav", C, 9.0)
    assert {r.display: (r.enrolled, r.n_clips) for r in e.speakers().collect()}["Zoe"] == (True, 1)
    e.merge(2, 3)
    assert {r.id: (r.display, r.n_locals) for r in e.speakers().collect()} == {1: ("Ann", 2), 3: ("Zoe", 1)}
    e.recluster()
    assert {r.id for r in e.speakers().collect()} == {1, 3}
    centre = e.tables()["identities"].where("id = 1").head().centroid
    sims = {tuple(r.centroid): r.similarity for r in e.tables()["locals"].where("global_id = 1").collect()}
    assert len(sims) == 2 and all(0.9 < s < 1 and s == pytest.approx(sum(a * b for a, b in zip(v, centre)) / sum(a * a for a in v) ** 0.5) for v, s in sims.items())
    local = e.tables()["locals"].where("label = 'speaker_00'").agg(F.max("id")).head()[0]
    e.split(local)
    assert e.speakers().count() == 3 and e.tables()["segments"].where("global_id = 4").count() == 1
    e.dismiss(4, 1)
    assert [(r.low, r.high) for r in e.tables()["dismissed"].collect()] == [(1, 4)] and e.dupes(0.1, 0.99).count() == 0
    e.undismiss(1, 4)
    assert [(r.left_id, r.right_id) for r in e.dupes(0.1, 0.99).collect()] == [(1, 4)]
    e.unenroll(3)
    assert e.enrollments().count() == 0 and not e.tables()["identities"].where("id = 3").head().enrolled
    with pytest.raises(ValueError):
        e.enroll("99", "c", C, 1.0)
    e.clear()
    assert all(v.count() == 0 for v in e.tables().values()) and e.tables(1)["files"].count() == 0


def test_arrival_order_and_the_end_of_a_batch(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", config.Settings(out_dir=f"file://{tmp_path}/out"))
    seen = spark.createDataFrame([(f"/in/a/{k}.wav", 0, 1, 10, 5.0, 60.0, "en") for k in range(3)], "path string, track int, track_count int, size long, mtime double, duration double, language string")
    e.enqueue(seen)
    said = segments(spark, [(k, 0, f"t{k}", 0.0, 1.0, "speaker_00") for k in (1, 2)])
    who = voices(spark, [(k, "speaker_00", A, 20.0, 1) for k in (1, 2)])
    e.add(said, who)
    assert e.speakers().count() == 2  # one batch sees a frozen store
    assert e.finish() == {"moved": 1, "rendered": 0} and e.speakers().count() == 1
    e.rollback(2)
    e.add_in_order(said, who)
    assert e.speakers().count() == 1 and [r.n_locals for r in e.speakers().collect()] == [2]
    paths = e.paths("TXT", ["/in"])
    assert {r.path for r in paths.collect()} == {f"a/{k}.txt" for k in range(3)}
    assert {r.path for r in Engine(spark, e.root, config.Settings(mirror_tree=False)).paths("txt", ["/in"]).collect()} == {f"{k}.txt" for k in range(3)}
    e.render("txt", paths)
    local = e.tables()["locals"].agg(F.max("id")).head()[0]
    e.split(local)
    assert e.finish() == {"moved": 1, "rendered": 2}
    files = e.tables()["files"]
    e._commit(files=files.withColumn("status", F.when(F.col("id") == 3, "transcribing").otherwise(F.col("status"))))
    assert e.requeue() == 1 and e.requeue() == 0 and e.tables()["files"].where("status = 'pending'").count() == 1
    for bad in (lambda: e.name(77, "x"), lambda: e.merge(77, 1), lambda: e.merge(1, 77), lambda: Engine(spark, e.root).render("txt", paths)):
        with pytest.raises(ValueError):
            bad()
    e.enroll("Zoe", "clip.wav", C, 9.0)
    assert [tuple(r) for r in e.table_of("speakers").collect()][0][1:4] == ("Zoe", "1 clip", 0)
    assert [(r.display, r.seconds) for r in e.table_of("enrollments").collect()] == [("Zoe", "9.0")]
    assert e.table_of("dupes").count() == 0 and e.table_of("models").where("kind = 'transcription'").count() == 8
    assert tuple(e.table_of("clear").head()) == (3, 2, 2, 1)


def test_a_run_is_cancelled(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    seen = spark.createDataFrame([(f"/in/{k}.wav", 0, 1, 10, 5.0, 60.0, "en") for k in range(3)], "path string, track int, track_count int, size long, mtime double, duration double, language string")
    e.enqueue(seen)
    e.add(segments(spark, [(1, 0, "first", 0.0, 1.0, "speaker_00")]), voices(spark, [(1, "speaker_00", A, 20.0, 1)]))
    e.begin(spark.createDataFrame([(2,), (3,)], "id long"))
    before, caught = store.last_version(spark, e.root), []

    def slow(batches):
        import time

        time.sleep(25)
        yield from batches

    def work():
        try:
            with e.run("night"):
                said = segments(spark, [(2, 0, "never", 0.0, 1.0, "speaker_00")])
                e.add(said.mapInArrow(slow, said.schema), voices(spark, [(2, "speaker_00", B, 20.0, 1)]))
        except Exception as x:
            caught.append(x)

    thread = InheritableThread(target=work)
    thread.start()
    time.sleep(4)
    assert e.cancel("night") == 2
    thread.join(60)
    assert not thread.is_alive() and len(caught) == 1
    assert store.last_version(spark, e.root) == before + 1  # the files in flight went back, nothing else
    assert [r.text for r in e.tables()["segments"].collect()] == ["first"] and {r.id: r.status for r in e.tables()["files"].collect()} == {1: "done", 2: "pending", 3: "pending"}
    assert e.cancel("night") == 0
    with pytest.raises(ValueError):
        e.split(99)


def test_a_change_writes_the_parts_it_touches(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    rows = spark.range(4000).select(F.col("id").alias("file_id"), F.lit("a").alias("x"))
    store.commit({"t": rows}, at, {"t": "file_id"})
    one = rows.where("file_id = 77")
    parts = store.buckets_of(one, "file_id")
    own = store.current(spark, at, only={"t": parts})["t"]
    assert len(parts) == 1 and 0 < own.count() < 120
    store.commit({"t": own.where("file_id <> 77").unionByName(one.withColumn("x", F.lit("b")))}, at, {"t": "file_id"}, {"t": parts})
    assert len([p for p in (tmp_path / "s").glob("v2-*/t/_bucket=*")]) == 1
    new = store.current(spark, at)["t"]
    assert new.count() == 4000 and [r.file_id for r in new.where("x = 'b'").collect()] == [77] and store.current(spark, at, 1)["t"].where("x = 'b'").count() == 0
    store.commit({"t": own.limit(0)}, at, {"t": "file_id"}, {"t": parts})  # a part may become empty
    assert store.current(spark, at)["t"].count() == 4000 - own.count()
    store.commit({"t": rows.limit(0)}, at, {"t": "file_id"})
    assert store.current(spark, at)["t"].columns == ["file_id", "x"] and store.current(spark, at)["t"].count() == 0


def test_settings_decide(spark, tmp_path):
    s = config.load('split_channels = true\nmax_split_channels = 2\nisolate = "always"\nembed_max_segments = 1\nhotwords = ["Ann", "Bo"]\ninitial_prompt = "Hi."\nbeam_size = 7\n')
    e = Engine(spark, f"file://{tmp_path}/s", s)
    media = spark.createDataFrame([("a", 2, "stereo", 0.1, 0.0, True), ("b", 4, "", 0.1, 0.9, False)], "path string, channels int, layout string, correlation double, noise_floor double, healthy boolean")
    assert e.tracks(media).count() == 3 and Engine(spark, e.root).tracks(media).count() == 2
    assert [r.isolate for r in e.isolation(media).orderBy("path").collect()] == [True, False]
    turns = spark.createDataFrame([(1, 0, 0.0, 5.0, A), (1, 0, 6.0, 10.0, B)], "file_id long, speaker int, t_start double, t_end double, vector array<double>")
    assert [(r.label, r.n_segments, r.total_dur, r.centroid) for r in e.voices(turns).collect()] == [("speaker_00", 1, 9.0, A)]
    told = s.model_options()
    assert told["prompt"] == "Hi. Ann, Bo." and told["beam_size"] == 7


def test_versions_are_claimed_once(spark, tmp_path):
    at, rows = f"file://{tmp_path}/s", spark.createDataFrame([(1,)], "x long")
    store.commit({"t": rows}, at)
    (tmp_path / "s" / "claims" / "v2").write_text("")  # another writer is about to put its mark
    with pytest.raises(RuntimeError):
        store.commit({"t": rows}, at)
    assert store.last_version(spark, at) == 1 and store.abandon(spark, at) == 1
    assert store.commit({"t": rows.union(rows)}, at) == 2 and store.rollback(spark, at, 1) == 3
    assert store.current(spark, at)["t"].count() == 1 and store.current(spark, at, 2)["t"].count() == 2
    assert store.backup(spark, at, f"{at}-copy") == 1 and store.current(spark, f"{at}-copy")["t"].count() == 1
    with pytest.raises(ValueError):
        store.backup(spark, at, f"{at}-copy")


def test_settings():
    s = config.load('match_threshold = 0.7\nmin_speaker_speech = 5\nformats = ["SRT", "tsv"]\n')
    assert s.min_speaker_speech == 5.0 and config.load(config.save(s)) == s and not config.Settings().problems()
    for bad in ("nonsense = 1", "beam_size = 0", "beam_size = 2.5", "review_threshold = 0.9", "formats = []", 'formats = ["doc"]', "overwrite = 1", "embed_min_segment = 0.2", 'isolate = "maybe"', "match_threshold = 1", 'model = ""'):
        with pytest.raises(ValueError):
            config.load(bad)


def test_models_fail_a_row_at_a_time(spark):
    def load():
        return lambda row: [{"vector": [float(row["id"]), 1.0 / row["x"]]}] * row["id"]

    rows = spark.createDataFrame([(1, 2), (2, 0), (0, 1), (3, 4)], "id long, x long")
    got = sorted((r.id, r.vector, r.error) for r in infer(rows, ["id"], load, VECTOR).collect())
    assert got == [(1, [1.0, 0.5], None), (2, None, "ZeroDivisionError: float division by zero")] + [(3, [3.0, 0.25], None)] * 3
