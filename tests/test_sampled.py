import math
import random

import pytest
from voxframe.engine import Engine
from voxframe.operators import sampled


def plain(x, width, hop):
    begins = [0] if len(x) <= width else range(0, len(x) - width + 1, hop)
    return [(b, tuple(x[b : b + width])) for b in begins] if x else []


def cut(key, x, sizes):
    rows, at = [], 0
    while at < len(x):
        n = next(sizes)
        rows.append((key, at, x[at : at + n]))
        at += n
    return rows


SCHEMA = "k string, first long, samples array<double>"


@pytest.mark.parametrize("width,hop", [(16, 8), (10, 3), (5, 9), (40, 1), (1, 1)])
def test_the_windows_are_the_same_for_any_chunks(spark, width, hop):
    r = random.Random(width)
    recordings = {f"r{n}": [r.random() for _ in range(n)] for n in (1, width - 1, width, width + 1, 97, 400)}
    want = sorted((k, b, w) for k, x in recordings.items() for b, w in plain(x, width, hop))
    for sizes in (lambda: r.randint(1, 9), lambda: 500, lambda: 33):
        rows = [c for k, x in recordings.items() for c in cut(k, x, iter(sizes, None))]
        rows += [("none", 0, []), ("null", 0, None), ("r97", 97, [])]
        r.shuffle(rows)
        found = sampled.windows_of(spark.createDataFrame(rows, SCHEMA), "k", width, hop).collect()
        assert sorted((x.k, x.begin, tuple(x.samples)) for x in found) == want


def test_a_missing_or_repeated_chunk_is_an_error(spark):
    for rows in ([("a", 0, [1.0] * 5), ("a", 6, [1.0] * 5)], [("a", 3, [1.0] * 20)], [("a", 0, [1.0] * 9), ("a", 0, [1.0] * 9)]):
        with pytest.raises(Exception, match="missing or comes twice"):
            sampled.windows_of(spark.createDataFrame(rows, SCHEMA), "k", 4, 2).collect()


def test_only_loud_windows_come_to_the_model(spark, tmp_path):
    def load():
        def model(row):
            if row["samples"][0] == 0.5:
                raise ValueError("no voice")
            assert max(map(abs, row["samples"])) > 0.01, "a quiet window"
            return [{"vector": [1.0, 1.0 if row["samples"][0] > 0 else -3.0]}]

        return model

    loud, quiet, other = [0.25] * 32, [1e-4] * 32, [-0.25] * 32
    rows = [c for k, x in {"one": loud, "half": loud + quiet, "two": loud + other, "bad": [0.5] * 32, "still": quiet, "brief": [0.25] * 5}.items() for c in cut(k, x, iter(lambda: 7, None))]
    chunks = spark.createDataFrame([*rows, ("none", 0, None)], SCHEMA)
    got = {r.k: (r.windows, round(r.duration, 6), r.usable, r.problem) for r in sampled.analyse(chunks, "k", load, rate=8, window=2.0, hop=1.0).collect()}
    assert got == {"one": (3, 3.0, True, ""), "half": (4, 4.0, True, ""), "two": (7, 7.0, True, "mixed"), "bad": (0, 0.0, False, "silent"), "still": (0, 0.0, False, "silent"), "brief": (1, 0.625, False, "short"), "none": (0, 0.0, False, "empty")}
    assert math.isclose(spark.range(1).select(sampled.rms_of(sampled.F.array(sampled.F.lit(3.0), sampled.F.lit(4.0)))).head()[0], math.sqrt(12.5))


def test_the_engine_takes_its_windows_from_the_settings(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    chunks = spark.createDataFrame([("a", k * 16_000, [0.25] * 16_000) for k in range(9)], "clip string, first long, samples array<float>")
    found = engine.recorded_clips(chunks, lambda: lambda row: [{"vector": [1.0, float(len(row["samples"]) == 64_000)]}]).collect()
    assert [tuple(r) for r in found] == [("a", 3, 6.0, 1.0, True, "")]
