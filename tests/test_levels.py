import numpy as np
import pytest
from voxframe.operators import levels


@pytest.mark.parametrize(("limit", "buckets"), [(100_000, 1024), (40, 8), (0, 2)])
def test_places_of_hot_and_cool_keys(spark, monkeypatch, limit, buckets):
    monkeypatch.setattr(levels, "SORTED", limit)
    monkeypatch.setattr(levels, "BUCKETS", buckets)
    rng = np.random.default_rng(3)
    sets = {"hot": rng.normal(size=900), "ties": rng.integers(0, 3, 300) * 1.0, "same": np.full(200, -2.5), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, 5.0] * 30), "few": np.array([3.0, 1.0]), "one": np.array([7.0])}
    rows = [(k, float(x)) for k, v in sets.items() for x in v] + [("few", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "who string, x double").repartition(5)
    got = {r.who: r for r in levels.nth(df, "who", "x", {"p50": "n div 2", "top": "cast(floor((n - 1) * 0.9D) as int)", "least": "0"}).collect()}
    assert got.keys() == sets.keys()
    for k, v in sets.items():
        v = np.sort(v)
        assert (got[k].n, got[k].p50, got[k].top, got[k].least) == (len(v), v[len(v) // 2], v[int((len(v) - 1) * 0.9)], v[0])


def test_the_middle_of_a_key_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(levels, "SORTED", 500)
    df = spark.range(0, 40_000, 1, 8).selectExpr("if(id % 4 > 0, -1, id) as who", "cast(id * 7919 % 40009 as double) as x")
    found = levels.nth(df, "who", "x", {"p50": "n div 2"}).where("who = -1").head()
    want = sorted(i * 7919 % 40009 for i in range(40_000) if i % 4)
    assert (found.n, found.p50) == (30_000, want[15_000])
