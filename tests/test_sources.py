import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxframe.operators import ingest
from voxframe.sources import models, wav


def raw(tag, channels, rate, bits, body, extra=b""):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + extra
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"odd " + struct.pack("<I", 3) + b"xyz\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body


def test_layouts():
    assert wav.parse(raw(1, 1, 8000, 8, bytes([0, 128, 255])))[0].tolist() == [[-1, 0, 127 / 128]]
    assert wav.parse(raw(1, 2, 8000, 16, struct.pack("<4h", -32768, 16384, 0, 1)))[0].tolist() == [[-1, 0], [0.5, 1 / 32768]]
    assert wav.parse(raw(1, 1, 8000, 24, b"\0\0\x80\0\0\x40"))[0].tolist() == [[-1, 0.5]]
    assert wav.parse(raw(1, 1, 8000, 32, struct.pack("<2i", -(2**31), 2**30)))[0].tolist() == [[-1, 0.5]]
    assert wav.parse(raw(3, 1, 8000, 32, struct.pack("<2f", 0.25, -2)))[0].tolist() == [[0.25, -2]]
    extra = struct.pack("<HHI", 22, 16, 4) + struct.pack("<H", 1) + bytes(14)
    assert wav.parse(raw(0xFFFE, 1, 8000, 16, struct.pack("<h", 16384), extra))[0].tolist() == [[0.5]]
    for bad in (b"", b"RIFF0000WAVE", raw(1, 1, 8000, 12, b"ab"), raw(2, 1, 8000, 16, b"ab")):
        with pytest.raises(ValueError):
            wav.parse(bad)


def test_round_trip_and_strict_reader():
    x = np.array([[-1.5, -0.5, 0, 0.25, 1.0]], np.float32)
    back, rate = wav.parse(wav.to_wav(x, 16_000))
    assert rate == 16_000 and np.abs(back - np.clip(x, -1, 1)).max() < 1e-4
    assert len(wav.parse_mono16k(wav.to_wav(x, 16_000))) == 5
    for bad in (wav.to_wav(x, 8000), wav.to_wav(np.concatenate([x, x]), 16_000)):
        with pytest.raises(ValueError):
            wav.parse_mono16k(bad)


def test_measures():
    rng = np.random.default_rng(0)
    tone = np.sin(np.arange(64_000) / 5)
    assert wav.noise_floor(tone[:100]) == 0 and wav.noise_floor(np.zeros(64_000)) == 1 and 0.9 < wav.noise_floor(tone) <= 1
    gate = np.repeat(rng.random(200) > 0.5, 320)
    assert wav.channel_correlation(np.stack([tone * gate, tone * gate]), 16_000) > 0.99
    assert wav.channel_correlation(np.stack([tone * gate, tone * np.repeat(rng.random(200) > 0.5, 320)]), 16_000) < 0.3
    assert wav.channel_correlation(np.zeros((2, 64_000)), 16_000) == 1 and wav.channel_correlation(np.zeros((2, 100)), 16_000) == 0


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    rng = np.random.default_rng(1)
    two = rng.normal(size=(2, 64_000)) * 0.2 * np.repeat(rng.random((2, 200)) > 0.5, 320, axis=1)
    (tmp_path / "a" / "x.WAV").write_bytes(wav.to_wav(two, 16_000))
    (tmp_path / "y.wav").write_bytes(wav.to_wav(two[0], 16_000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "note.txt").write_text("no media")
    assert [r.path.rsplit("/", 1)[1] for r in wav.discover(spark, [str(tmp_path)]).collect()] == ["x.WAV", "bad.wav", "y.wav"]
    assert wav.discover(spark, [str(tmp_path)], recursive=False).count() == 2
    decoded = wav.decode(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r for r in decoded.collect()}
    assert got["bad.wav"].error and got["x.WAV"].channels == 2 and got["y.wav"].duration == 4.0
    tracks = ingest.expand_tracks(decoded.where("error is null").withColumn("layout", F.lit("stereo"))).select("path", "track", "track_count").collect()
    assert sorted((r.path[-5:], r.track, r.track_count) for r in tracks) == [("x.WAV", 0, 2), ("x.WAV", 1, 2), ("y.wav", 0, 1)]


def test_media_names(spark):
    assert len(wav.MEDIA) == 36
    names = ["a.WAV", "b/c.M2ts", "d.rm", "e.txt", "f", ".wav", "g.wav/h", "b/c.M2ts", None]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.path for r in wav.media_paths(rows).collect()] == [".wav", "a.WAV", "b/c.M2ts", "d.rm"]


def test_layouts_written_are_read(spark, tmp_path):
    x = np.array([[-1.0, -0.5, 0, 0.25, 0.99]], np.float32)
    for bits, tag, near in ((8, wav.PCM, 0.01), (16, wav.PCM, 1e-4), (24, wav.PCM, 1e-6), (32, wav.PCM, 1e-6), (32, wav.FLOAT, 0)):
        back, rate = wav.parse(wav.to_wav(np.concatenate([x, -x]), 8000, bits, tag))
        assert rate == 8000 and back.shape == (2, 5) and np.abs(back[0] - x[0]).max() <= near
    with pytest.raises(ValueError):
        wav.to_wav(x, 8000, 12)


def test_resampled_tone():
    t = np.arange(44_100) / 44_100
    y = wav.resample(np.sin(2 * np.pi * 440 * t), 44_100, 16_000)
    assert len(y) == 16_000 and np.abs(y[100:-100] - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)[100:-100]).max() < 0.01
    assert np.abs(wav.resample(np.sin(2 * np.pi * 15_000 * t), 44_100, 16_000)[100:-100]).max() < 0.05  # above what the lower rate holds
    up = wav.resample(np.sin(2 * np.pi * 440 * np.arange(8000) / 8000), 8000, 16_000)
    assert np.abs(up[100:-100] - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)[100:-100]).max() < 0.01


def test_ranges_and_channels(spark, tmp_path):
    left, right = np.linspace(-0.9, 0.9, 48_000), np.linspace(0.9, -0.9, 48_000)
    (tmp_path / "x.wav").write_bytes(wav.to_wav(np.stack([left, right]), 16_000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = wav.read_samples(files, channel=1, start=1.0, end=2.5, seconds=0.5).orderBy("path", "chunk").collect()
    bad, rows = got[0], got[1:]
    assert bad.error and bad.samples is None
    assert [(r.chunk, r.first, r.rate, len(r.samples)) for r in rows] == [(0, 0, 16_000, 8000), (1, 8000, 16_000, 8000), (2, 16_000, 16_000, 8000)]
    assert np.abs(np.concatenate([r.samples for r in rows]) - right[16_000:40_000]).max() < 1e-4
    mono = wav.read_samples(files.where("path like '%x.wav'"), rate=8000).collect()
    assert sum(len(r.samples) for r in mono) == 24_000 and np.abs(mono[0].samples).max() < 1e-3
    assert wav.read_samples(files.where("path like '%x.wav'"), channel=5).head().error == "no channel 5"
    chunks = wav.read_samples(files.where("path like '%x.wav'"), channel=0, seconds=0.7).withColumn("path", F.lit("d/y.wav"))
    assert [tuple(r) for r in wav.write_files(chunks, str(tmp_path / "out"), 32, wav.FLOAT).collect()] == [("d/y.wav", 44 + 4 * 48_000)]
    assert np.abs(wav.parse((tmp_path / "out/d/y.wav").read_bytes())[0][0] - left).max() < 1e-4


def test_outside_program(spark, tmp_path):
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\nif grep -q good; then echo \"$@\"; else echo 'no such codec' >&2; exit 3; fi\n")
    tool.chmod(0o755)
    files = spark.createDataFrame([("a", bytearray(b"good")), ("b", bytearray(b"bad")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in wav.transcode(files, str(tool), channel=1, start=2.0, end=5.0).collect()}
    assert b"-ss 2.0 -i pipe:0 -t 3.0" in got["a"].content and b"pan=mono|c0=c1,aresample=16000" in got["a"].content
    assert "no such codec" in got["b"].error and got["c"].error and got["b"].content is None
    assert all(r.error for r in wav.transcode(files, str(tmp_path / "nothing")).collect())


def test_models(spark, tmp_path):
    known = models.catalogue(spark)
    assert known.count() == 15 and models.find_model(known, "LARGE-v3", "whisper").head().n_bytes == 3_100_000_000
    assert models.find_model(known, "large-v3", "vad").count() == 0
    (tmp_path / "silero_vad.onnx").write_bytes(b"x")
    at = str(tmp_path / "silero_vad.onnx")
    assert models.resolve("Silero-VAD", "vad", str(tmp_path)) == models.resolve("silero_vad.onnx", "vad", str(tmp_path)) == models.resolve(at, "vad", "") == at
    with pytest.raises(ValueError):
        models.resolve("tiny", "whisper", str(tmp_path))
