import pytest
from pyspark.sql import functions as F
from voxframe.functions import text as t
from voxframe.operators import identity, ingest, levels, progress, render, store, words


def test_probe_reports(spark):
    rows = [("a", "codec_name=aac\nchannels=0\nduration=N/A\nduration=7.5\nx=a=b"), ("b", ""), ("c", None), ("d", "codec_name=N/A\nduration=0\nduration=3\nduration=4"), ("e", "codec_name=x\nduration=2s\nduration=9\nsample_rate=junk")]
    got = {r.path: r for r in ingest.probe(spark.createDataFrame(rows, "path string, report string")).collect()}
    assert (got["a"].codec, got["a"].channels, got["a"].duration, got["a"].error) == ("aac", 1, 7.5, None)
    assert all(got[k].error == "no audio stream" and got[k].codec is None for k in "bcd") and got["d"].duration == 4 and got["b"].duration == 0
    assert (got["e"].duration, got["e"].sample_rate, got["e"].layout) == (2.0, 0, "")


def test_tracks_need_a_plain_layout(spark):
    rows = spark.createDataFrame([("a", 2, "", 0.1), ("b", 2, "5.1", 0.1), ("c", 9, "", 0.1), ("d", 2, None, None), ("e", 1, "", 0.0)], "path string, channels int, layout string, correlation double")
    assert {(r.path, r["count"]) for r in ingest.expand_tracks(rows).groupBy("path").count().collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1)}
    assert ingest.expand_tracks(rows, split=False).count() == 5


def test_words_from_tokens(spark):
    m = words.MARK
    toks = ["he", "llo", m, "!", m + "you", "", m + "two"]
    rows = spark.createDataFrame([(1, i, x, float(i), float(i), 1 - i / 10, 9.0) for i, x in enumerate(toks)], "seg long, pos long, token string, t_start double, t_end double, probability double, seg_end double")
    got = [(r.w_pos, r.text, r.w_start, r.w_end, round(r.probability, 1)) for r in words.from_tokens(rows, ["seg"]).orderBy("w_pos").collect()]
    assert got == [(0, "hello!", 0, 3, 0.7), (1, "you", 4, 6, 0.6), (2, "two", 6, 9, 0.4)]
    assert words.from_tokens(rows.limit(0), ["seg"]).count() == 0


def test_queue_keeps_failures_until_the_next_start(spark):
    ev = [(1, 1, "started", "probing", -1.0), (1, 2, "stage", "failed", 0.5), (1, 3, "stage", "writing", 0.1), (2, 1, "stage", "failed", 0.0), (2, 2, "started", "x", 0.0), (3, 1, "started", "x", 0.0), (4, 1, "finished", "done", 0.7)]
    rows = spark.createDataFrame(ev, "file long, n long, kind string, stage string, fraction double")
    assert {tuple(r) for r in progress.queue_states(rows, "file", "n").collect()} == {(1, "writing", 0.1, True), (2, "failed", 0.0, False), (3, "probing", -1.0, False), (4, "done", -1.0, False)}


def test_percent(spark):
    r = spark.range(12).select("id", progress.percent(F.col("id"), F.lit(0.5)).alias("p")).collect()
    assert [x.p for x in r] == [0, 6, 19, 31, 44, 56, 69, 81, 94, 100, 94, 100]


@pytest.mark.parametrize("x,shown", [(12345.678, "12345.7"), (3.0, "3"), (1234567.8, "1.23457e+06"), (0.00001234, "1.234e-05"), (999999.4, "999999"), (999999.6, "1e+06"), (0.0, "0"), (-0.5, "-0.5"), (0.0001, "0.0001"), (99999.96, "100000")])
def test_general_numbers(spark, x, shown):
    assert spark.range(1).select(t.general(F.lit(x))).head()[0] == shown


def test_paths(spark):
    def root(*p):
        return spark.range(1).select(t.common_root(F.array(*[F.lit(x) for x in p]).cast("array<string>"))).head()[0]

    assert root("/a/b/x.wav", "/a/b/c/y.wav", "/a/bb/z.wav") == "/a" and root("/a/b/x.wav") == "/a/b" and root("/x.wav", "/y/z.wav") == "/" and root("a/x", "b/y") == "" and root() == ""

    def out(source, mirror=None):
        return spark.range(1).select(t.output_path(F.lit("/o"), F.lit(source), F.lit(1), F.lit(2), F.lit("JSON"), mirror)).head()[0]

    assert out("/in/a/b:c.d.wav") == "/o/b_c.d.track2.json" and out("/in/a/b.wav", F.lit("/in")) == "/o/a/b.track2.json" and out("/else/b", F.lit("/in")) == "/o/b.track2.json"


def test_upsert_of_locals_and_versions(spark, tmp_path):
    schema = "id long, file_id long, label string, centroid array<double>, total_dur double, n_segments long, global_id long, similarity double"
    old = spark.createDataFrame([(5, 1, "a", [1.0], 2.0, 1, 9, 0.8), (7, 1, "b", [1.0], 2.0, 1, None, None)], schema)
    new = spark.createDataFrame([(None, 1, "a", [2.0], 3.0, 4, None, None), (None, 2, "b", [3.0], 1.0, 1, None, None), (None, 1, "c", [3.0], 1.0, 1, None, None)], schema).drop("id")
    got = store.put_locals(old, new).orderBy("id").collect()
    assert [(r.id, r.label, r.total_dur, r.global_id) for r in got] == [(5, "a", 3.0, 9), (7, "b", 2.0, None), (8, "c", 1.0, None), (9, "b", 1.0, None)]
    at = f"file://{tmp_path}/s"
    assert store.last_version(spark, at) is None
    store.commit({"l": old, "m": old}, at)
    store.commit({"l": new.drop("id")}, at)
    new.drop("id").limit(0).write.parquet(f"{at}/v3/l")  # a commit that stopped before its mark
    assert store.current(spark, at)["l"].count() == 3 and store.current(spark, at)["m"].count() == 2 and store.current(spark, at, 1)["l"].count() == 2


def test_alignment(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "a")], "file_id long, idx long, label string")
    new = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x"), (2, 1, "y"), (4, 0, "z")], old.schema)
    got = {tuple(r) for r in store.align_or_replace(old, new, ["label"]).collect()}
    assert got == {(1, 0, "x"), (1, 1, "y"), (2, 0, "x"), (2, 1, "y"), (3, 0, "a"), (4, 0, "z")}


def test_targets(spark):
    ids = spark.createDataFrame([(1, "Ann"), (2, "Bo"), (3, "BO"), (4, None)], "id long, name string")
    asked = spark.createDataFrame([(x,) for x in ("ann", "bo", "Cy", "2", "02", "77")], "who string")
    got = {r.who: (r.action, r.id) for r in identity.resolve_targets(asked, ids).collect()}
    assert got == {"ann": ("join", 1), "bo": ("error", None), "Cy": ("create", None), "2": ("join", 2), "02": ("join", 2), "77": ("error", None)}


def test_clips(spark):
    rows = [(1, 0.0, 4.0, 0.5, [1.0, 0.0]), (1, 2.0, 6.0, 0.5, [0.0, 1.0]), (1, 4.0, 8.0, 0.01, [0.0, 1.0]), (2, 0.0, 2.0, 0.5, [1.0, 0.0]), (3, 0.0, 4.0, 0.0, [1.0, 0.0]), (4, 0.0, 4.0, 0.5, None)]
    got = {r.clip: r for r in levels.analyse_clips(spark.createDataFrame(rows, "clip long, start double, end double, level double, vector array<double>")).collect()}
    assert (got[1].windows, got[1].duration, round(got[1].coherence, 4), got[1].usable) == (2, 4.0, 0.7071, True) and got[1].problem == "mixed"
    assert got[2].problem == "short" and got[2].coherence == 1 and not got[2].usable
    assert all((got[k].windows, got[k].problem) == (0, "silent") for k in (3, 4))


def test_files_written_whole(spark, tmp_path):
    bodies = spark.createDataFrame([(1, "one\n"), (2, ""), (3, "drei ä")], "file_id long, body string")
    paths = bodies.select("file_id", F.concat(F.lit("d/"), F.col("file_id").cast("string"), F.lit(".txt")).alias("path"))
    for _ in range(2):
        assert sorted(tuple(r) for r in render.write_files(bodies, paths, str(tmp_path)).collect()) == [(1, "d/1.txt", 4), (2, "d/2.txt", 0), (3, "d/3.txt", 7)]
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["1.txt", "2.txt", "3.txt"] and (tmp_path / "d/3.txt").read_text() == "drei ä"
