"""Ties: printed numbers, equal seconds of two speakers, samples halfway between two codes, dismissed pairs."""

import numpy as np
from pyspark.sql import functions as F
from voxframe.functions import text as t
from voxframe.operators import attribution
from voxframe.plans import catalog
from voxframe.sources import wav


def test_general_numbers_tie_to_even(spark):
    rng = np.random.default_rng(2)
    x = [1234565.0, 1234575.0, 0.1234565, 0.1234575, 12345.65, 2.000005, 1.000015, 100000.5, 100001.5, -1234565.0, 1.234565e-5, 999999.5, 2097145.0, 0.15, 7 / 15]
    x += [(10 * k + 5) / 10.0**p for k, p in zip(rng.integers(100000, 1000000, 3000).tolist(), rng.integers(0, 11, 3000).tolist())]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", t.general(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in rows if r.s != "%g" % r.x] == []


def test_equal_seconds_are_a_tie(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 10.0)], "file_id long, idx long, seg_start double, seg_end double")
    turns = [(1, 1, 0.1, 0.1 + 0.2), (1, 1, 1.0, 1.1), (1, 0, 3.0, 3.3)]  # 0.3 s each, but for the last digits
    for k in (1, -1):
        trn = spark.createDataFrame([(f, s if k > 0 else 1 - s, a, b) for f, s, a, b in turns], "file_id long, speaker int, t_start double, t_end double")
        assert attribution.assign_speakers(seg, trn).head().label == "speaker_00"


def test_samples_near_half_a_code(spark, tmp_path):
    x = [(k + 0.5 + e) / 32767 for k in (20_001, 30_000) for e in (-1e-4, 1e-4)]
    rows = spark.createDataFrame([("a.wav", 0, 8000, x)], "path string, chunk long, rate long, samples array<double>")
    wav.write_files(rows, f"file://{tmp_path}/w").collect()
    assert np.frombuffer((tmp_path / "w" / "a.wav").read_bytes()[44:], "<i2").tolist() == [20_001, 20_002, 30_000, 30_001]


def test_every_seventh_sum_is_dismissed(spark, sf):
    rows = catalog.QUERIES["jn5_duplicate_candidates"](spark, sf).collect()
    assert rows and all((r.left_id + r.right_id) % 7 for r in rows) and any(abs(r.left_id - r.right_id) <= 12 for r in rows)
