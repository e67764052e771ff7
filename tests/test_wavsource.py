import numpy as np
import pytest
from pyspark.sql import functions as F
from voxframe import files
from voxframe.sources import wav, wavsource


def stored(tmp_path):
    rng = np.random.default_rng(7)
    long, two = rng.uniform(-1, 1, 50_000), rng.uniform(-1, 1, (2, 3001))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "long.wav").write_bytes(wav.to_wav(long, 8000))
    (tmp_path / "two.WAV").write_bytes(wav.to_wav(two, 44_100, 24))
    (tmp_path / "none.wav").write_bytes(wav.to_wav(np.zeros((1, 0)), 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEdata\0\0\0\0")
    (tmp_path / "odd.wav").write_bytes(wav.to_wav(np.zeros((1, 3)), 16_000)[:12] + b"junk\x03\0\0\0abc\0" + wav.to_wav(np.full((1, 5), 0.5), 16_000)[12:])
    return f"file://{tmp_path}", {"long.wav": wav.parse((tmp_path / "a" / "long.wav").read_bytes())[0], "two.WAV": wav.parse((tmp_path / "two.WAV").read_bytes())[0], "none.wav": np.zeros((1, 0)), "odd.wav": wav.parse((tmp_path / "odd.wav").read_bytes())[0]}


def joined(df):
    out, rows = {}, df.orderBy("path", "channel", "chunk").collect()
    for r in rows:
        if r.error is None:
            name = r.path.rsplit("/", 1)[1]
            assert r.first == len(out.get((name, r.channel), []))
            out.setdefault((name, r.channel), []).extend(r.samples)
    return out, rows


@pytest.mark.parametrize("size", [999, 20_000, 1 << 20])
def test_any_partition_gives_all_samples(spark, tmp_path, size):
    at, want = stored(tmp_path)
    df = wavsource.read(spark, at, seconds=0.05, partition_bytes=size)
    got, rows = joined(df)
    assert got.keys() == {(k, c) for k, x in want.items() for c in range(len(x))}
    assert all(np.array_equal(np.array(v, np.float32), want[k][c]) for (k, c), v in got.items())
    assert [r.error for r in rows if r.error] == ["data before format"]
    if size < 100_000:
        tasks = df.where("path like '%long.wav'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 5


def test_ranges_channels_and_rates(spark, tmp_path):
    at, want = stored(tmp_path)
    x, rate = want["long.wav"], 8000
    for start, end, to, channel in ((0.0, None, 16_000, "mean"), (1.25, 3.5, 5512, 0), (2.0, 1.0, None, "mean"), (6.0, 99.0, 16_000, 0), (70.0, 80.0, 16_000, 0)):
        for size in (7000, 1 << 20):
            got, _ = joined(wavsource.read(spark, at, start=start, end=end, rate=to, channel=channel, seconds=0.3, partition_bytes=size).where("path like '%long.wav'"))
            whole, _ = wav.picked(x, rate, 0, start, end, to)
            assert np.allclose(got["long.wav", None if channel == "mean" else 0], whole, atol=1e-6)
    heads = {r.path.rsplit("/", 1)[1]: (r.rate, r.channels, r.bits, r.frames, r.samples) for r in wavsource.read(spark, at, samples=False).where("error is null").collect()}
    assert heads == {"long.wav": (8000, 1, 16, 50_000, None), "two.WAV": (44_100, 2, 24, 3001, None), "none.wav": (8000, 1, 16, 0, None), "odd.wav": (16_000, 1, 16, 5, None)}
    strict = {r.path.rsplit("/", 1)[1]: r.error for r in wavsource.read(spark, at, strict=True, samples=False).collect()}
    assert strict["odd.wav"] is None and strict["long.wav"] == "not 16 kHz, mono, 16 bit"
    assert {r.error for r in wavsource.read(spark, at, channel=1).where("path not like '%two.WAV'").collect()} == {"no channel 1", "data before format"}
    assert [r.first for r in wavsource.read(spark, at, seconds=1).where("first >= 16000 and first < 32000 and channel = 0 and path like '%long.wav'").orderBy("first").collect()] == [16_000, 24_000]
    (tmp_path / "empty").mkdir()
    assert wavsource.read(spark, f"{at}/empty").count() == 0


def test_a_range_reads_its_bytes_only(tmp_path, monkeypatch):
    at, _ = stored(tmp_path)
    seen = []
    plain = files.Source.read_at
    monkeypatch.setattr(files.Source, "read_at", lambda self, p, n: seen.append(n) or plain(self, p, n))

    def read(*pushed, **options):
        seen.clear()
        reader = wavsource.WavReader({"path": at} | options)
        assert list(reader.pushFilters(list(pushed))) == list(pushed)
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p)), sum(seen)

    only = wavsource.StringStartsWith(("path",), f"{at}/a/")
    assert read(only, start="1", end="1.004")[1] < 64 + 100
    assert read(only, samples="false") == (1, 12 + 8 + 16 + 8)
    rows, size = read(only, wavsource.GreaterThanOrEqual(("first",), 40_000), wavsource.LessThan(("first",), 41_000), seconds="0.125")
    assert rows == 1 and size < 2000 + 100
    assert read(only, seconds="1")[1] < 100_000 + 200


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("d/x.wav", k, 8000, [0.25] * 10) for k in range(5)] + [("e.wav", 0, 8000, None)], "path string, chunk int, rate int, samples array<double>").repartition(4)
    with pytest.raises(Exception, match="unknown layout"):
        wav.write_files(rows, f"file://{tmp_path}/out", bits=12)
    assert not list((tmp_path / "out").rglob("*")) if (tmp_path / "out").exists() else True
    assert sorted(map(tuple, wav.write_files(rows, f"file://{tmp_path}/out").collect())) == [("d/x.wav", 144), ("e.wav", 44)]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["d", "e.wav", "x.wav"]
    assert wav.parse((tmp_path / "out/d/x.wav").read_bytes())[0].shape == (1, 50)
