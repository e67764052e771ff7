import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from voxframe.engine import Engine
from voxframe.functions import packed
from voxframe.operators import render, store


def plain_unpack(blob):
    if blob is None or len(blob) < 4:
        return []
    (n,), at, out = struct.unpack_from("<I", blob), 4, []
    for _ in range(n):
        if at + 16 > len(blob):
            break
        a, b, p, k = struct.unpack_from("<fffI", blob, at)
        if at + 16 + k > len(blob):
            break
        out.append({"start": a, "end": b, "probability": p, "text": blob[at + 16 : at + 16 + k].decode()})
        at += 16 + k
    return out


def made(seed):
    rng = random.Random(seed)
    rows = [[{"start": float(k), "end": k + 0.5, "probability": 0.25, "text": rng.choice(["", "a", "été", "long " * 9])} for k in range(rng.randint(0, 6))] for _ in range(20)]
    return [None, [], *rows]


def test_round_trip_and_cut_blobs():
    rows = made(2)
    blobs = packed.blobs_of(pa.array(rows, pa.list_(packed._WORD)))
    assert packed.words_of(blobs).to_pylist() == [r or [] for r in rows]
    assert packed.words_of(blobs.slice(3, 5)).to_pylist() == rows[3:8]
    whole = blobs.to_pylist()
    cut = [b[:k] for b in whole for k in range(0, len(b), 3)]
    safe = [b for b in cut if _whole_text(b)]
    assert len(safe) > 50
    assert packed.words_of(pa.array([None, b"", b"\x01\x00", *safe], pa.binary())).to_pylist() == [[], [], [], *map(plain_unpack, safe)]
    huge = struct.pack("<IfffI", 1 << 31, 1, 2, 3, (1 << 32) - 1) + b"abc"
    assert packed.words_of(pa.array([huge], pa.binary())).to_pylist() == [[]]
    assert packed.words_of(pa.array([], pa.binary())).to_pylist() == [] and packed.blobs_of(pa.array([], pa.list_(packed._WORD))).to_pylist() == []


def _whole_text(blob):
    try:
        plain_unpack(blob)
    except UnicodeDecodeError:
        return False
    return True


def test_vectors():
    blobs = [struct.pack("<3f", 1, 2, 3), None, b"", b"\x00\x00", struct.pack("<2f", 4, 5) + b"xyz"]
    assert packed.vectors_of(pa.array(blobs, pa.binary())).to_pylist() == [[1.0, 2.0, 3.0], [], [], [], [4.0, 5.0]]


def test_columns(spark):
    rows = [(i, r) for i, r in enumerate(made(3))]
    df = spark.createDataFrame(rows, f"id long, words {packed.WORDS}")
    back = df.withColumn("back", packed.unpack_words(packed.pack_words("words"))).collect()
    assert all((r.words or []) == r.back for r in back) and len(back) == len(rows)


def test_the_store_keeps_words(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s")
    e.enqueue(spark.createDataFrame([("/in/x.wav", 0, 1, 10, 5.0, 60.0, "en")], "path string, track int, track_count int, size long, mtime double, duration double, language string"))
    said = [(1, 0, 'say "hi"', 0.0, 1.0, "speaker_00", -0.25, 0.125, [(0.1, 0.5, 0.9, 'say'), (0.5, 1.0, 0.5, '"hi"')]), (1, 1, "", 1.0, 2.0, "speaker_00", 0.0, 0.0, []), (1, 2, "end", 2.0, 3.0, "speaker_01", None, None, None)]
    segments = spark.createDataFrame(said, f"file_id long, idx long, text string, seg_start double, seg_end double, local_label string, avg_logprob float, no_speech float, words {packed.WORDS}")
    none = spark.createDataFrame([], "file_id long, label string, centroid array<double>, total_dur double, n_segments long")
    e.add(segments, none)
    body = e.render("json").head().body
    want = ',\n      "avg_logprob": -0.25,\n      "no_speech": 0.125,\n      "text": "say \\"hi\\"",\n      "words": [\n        {"start": 0.1, "end": 0.5, "probability": 0.9, "text": "say"},\n        {"start": 0.5, "end": 1, "probability": 0.5, "text": "\\"hi\\""}\n      ]\n    },\n'
    assert want in body and body.endswith('"avg_logprob": 0,\n      "no_speech": 0,\n      "text": "end"\n    }\n  ]\n}\n')
    e.fail(spark.createDataFrame([(1, "no sound")], "id long, error string"))
    assert [(r.status, r.error) for r in e.tables()["files"].collect()] == [("failed", "no sound")] and e.tables()["segments"].count() == 3
    again = spark.createDataFrame([("/in/x.wav", 0, 1, 10, 5.0, 60.0, "en")], "path string, track int, track_count int, size long, mtime double, duration double, language string")
    assert [(r.status, r.error) for r in e.enqueue(again).collect()] == [("pending", "")]


def test_a_store_of_an_older_form(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    Engine(spark, at)
    old = spark.createDataFrame([(1, 0, "old", 0.0, 1.0, "speaker_00", None)], "file_id long, idx long, text string, seg_start double, seg_end double, local_label string, global_id long")
    store.commit({"segments": old}, at, {"segments": "file_id"})
    rows = Engine(spark, at).tables()["segments"].collect()
    assert [(r.text, r.words, r.avg_logprob) for r in rows] == [("old", None, None)]
    assert '"no_speech": 0' in render.json(Engine(spark, at).tables()["segments"].withColumn("label", F.lit("x")), spark.createDataFrame([(1, "s", 0, 1, 1.0, "", "")], "file_id long, source string, track int, track_count int, duration double, language string, model string")).head().body
    with pytest.raises(ValueError):
        Engine(spark, at).name(5, "x")
