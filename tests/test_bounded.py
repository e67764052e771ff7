"""What is near leaves a task a block at a time, and only as much of it as is asked for."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from voxframe.operators import identity, similarity


def made(n=60, files=20):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-1, 2, (n // 2, 4)), rng.normal(size=(n - n // 2, 4))]).astype(float) + [1.5, 0, 0, 0]
    return x / np.sqrt((x * x).sum(1))[:, None], rng.integers(0, files, n)


def table(spark, x, files):
    return spark.createDataFrame([(i, int(f), r.tolist()) for i, (f, r) in enumerate(zip(files, x))], "id long, file_id long, centroid array<double>")


def test_pairs_leave_a_block_at_a_time(monkeypatch):
    monkeypatch.setattr(similarity, "STEP", 16)
    rows = pa.table({"id": range(100), "v": [[1.0, 0.0]] * 100, "x": pa.array([[]] * 100, pa.list_(pa.int64()))})
    side = similarity._by_size(rows)
    sizes = [len(b) for b in similarity._pairs(0.5, 2.0, None)(side, side, True, False)]
    assert sum(sizes) == 4950 and max(sizes) <= 256
    assert sum(len(b) for b in similarity._forest(0.5)(side, side, True, False)) == 99
    side = similarity._by_size(rows.set_column(2, "x", pa.array([[3]] * 100, pa.list_(pa.int64()))))
    assert max(len(b) for b in similarity._nearest(0.5)(side, side, False, False)) <= 48


@pytest.fixture(params=[0, 1 << 22])
def tiles(request, monkeypatch):
    for k, v in (("STEP", 16), ("TILE", 100), ("SMALL", request.param)):
        monkeypatch.setattr(similarity, k, v)


def test_the_nearest_with_ties(spark, tiles):
    x, files = made()
    df = table(spark, x, files).withColumn("who", F.col("id") % 11)
    sim = np.round(x @ x.T, 9)
    got = {}
    for r in similarity.nearest(df, df, "who", 0.6, 1 + F.col("id") % 4).collect():
        got.setdefault(r.id, []).append((round(-r.sim, 9), r.who))
    for i in range(len(x)):
        best = sorted((-max(sim[i][w::11]), w) for w in range(11) if max(sim[i][w::11]) >= 0.6)
        assert sorted(got.get(i, [])) == best[: 1 + i % 4]
    near = similarity.near_identities(df, df.withColumnRenamed("who", "global_id"), 0.6).collect()
    assert len(near) == sum(max(sim[i][w::11]) >= 0.6 for i in range(len(x)) for w in range(11))
    pairs = similarity.pairs_above(df.withColumnRenamed("centroid", "v"), 0.6, None, F.array("file_id"), lambda a, b: a[..., 0] != b[..., 0]).collect()
    assert {(r.a, r.b) for r in pairs} == {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if sim[i, j] >= 0.6 and files[i] != files[j]}


def test_large_components_in_tiles(spark, tiles, monkeypatch):
    x, files = made()
    df = table(spark, x, files)
    want = identity.agglomerate(x, files.tolist(), 0.8)
    first = {c: i for i, c in reversed(list(enumerate(want)))}
    monkeypatch.setattr(identity, "LARGE", 5)
    assert {r.id: r.cluster for r in identity.cluster(df, 0.8).collect()} == {i: first[c] for i, c in enumerate(want)}


def test_a_matrix_of_equals_is_clustered_without_a_list_of_its_pairs():
    import tracemalloc

    tracemalloc.start()
    got = identity.agglomerate(np.ones((400, 1)), [i // 2 for i in range(400)], 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {0, 1} and peak < 8 * 400 * 400 * 5


def clusters(x, files, threshold):
    want = identity.agglomerate(x, files.tolist(), threshold)
    first = {c: i for i, c in reversed(list(enumerate(want)))}
    return {i: first[c] for i, c in enumerate(want)}


def test_a_component_too_large_for_a_matrix_stays_in_its_task(spark, monkeypatch):
    x, files = made()
    df, want = table(spark, x, files), clusters(x, files, 0.8)
    monkeypatch.setattr(identity, "LARGE", 5)
    with monkeypatch.context() as m:
        m.setattr(identity.linkage, "merge_rounds", None)
        assert {r.id: r.cluster for r in identity.cluster(df, 0.8).collect()} == want
    monkeypatch.setattr(identity, "HELD", 20)  # numbers; beyond, rounds of joins
    rounds = identity.linkage.merge_rounds
    asked = []
    monkeypatch.setattr(identity.linkage, "merge_rounds", lambda *a: asked.append(1) or rounds(*a))
    assert {r.id: r.cluster for r in identity.cluster(df, 0.8).collect()} == want and asked


@pytest.mark.parametrize("n, files", [(0, 1), (1, 1), (300, 20), (300, 400)])
def test_clusters_by_means_are_those_of_the_matrix(n, files):
    x, files = made(n, files)
    assert identity.linkage.by_means(x, files.tolist(), 0.8) == identity.agglomerate(x, files.tolist(), 0.8)


def test_clusters_by_means_need_no_matrix(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(identity.linkage, "SOUGHT", 1 << 14)
    tracemalloc.start()
    got = identity.linkage.by_means(np.ones((2000, 1)), [i // 2 for i in range(2000)], 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {0, 1} and peak < 8 * 2000 * 2000 / 4


def test_what_a_forest_has_linked_is_not_listed_again(monkeypatch):
    monkeypatch.setattr(similarity, "STEP", 16)
    seen, stars = [], similarity.stars
    monkeypatch.setattr(similarity, "stars", lambda u, v: seen.append(len(u)) or stars(u, v))
    rows = pa.table({"id": range(100), "v": [[1.0, 0.0]] * 100, "x": pa.array([[]] * 100, pa.list_(pa.int64()))})
    side = similarity._by_size(rows)
    assert sum(len(b) for b in similarity._forest(0.5)(side, side, True, False)) == 99
    assert sum(seen) < 2000  # of 4,950 pairs


def test_candidates_leave_the_tasks_that_compare_as_they_are(spark, monkeypatch):
    x, files = made()
    ids = spark.createDataFrame([(i + 5, i % 7 == 0, r.tolist()) for i, r in enumerate(x)], "id long, enrolled boolean, centroid array<double>")
    loc = spark.createDataFrame([(i + 5, int(f), float(i % 4)) for i, f in enumerate(files)], "global_id long, file_id long, total_dur double")
    gone = spark.createDataFrame([(5 + i, 6 + i) for i in range(0, 58)], "low long, high long")
    place = {i: (i % 7 != 0, -(i % 4), i) for i in range(60)}
    want = set()
    for i, j in itertools.combinations(range(60), 2):
        if 0.6 <= x[i] @ x[j] < 0.95 and files[i] != files[j] and (i % 7 or j % 7) and j != i + 1 and (i + j) % 3:
            want.add(tuple(k + 5 for k in sorted((i, j), key=place.get)))
    for tile in (1, 1 << 14):
        monkeypatch.setattr(similarity, "LEAST", tile)
        found = identity.duplicate_candidates(ids, loc, gone, 0.6, 0.95, lambda a, b: (a + b - 10) % 3 != 0)
        assert {(r.left_id, r.right_id) for r in found.collect()} == want and want
        above = found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroups")[0]
        assert "Join" not in above and "Exchange" not in above
