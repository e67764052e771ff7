from collections import Counter, defaultdict

import numpy as np
from voxframe.operators import identity, matching
from voxframe.plans import fixtures as fx
from voxframe.streaming import events


def unit(*x):
    return (np.array(x) / np.linalg.norm(x)).tolist()


def test_resolution_in_order_of_similarity(spark):
    a, b = unit(1, 0.0, 0), unit(0, 1.0, 0)
    ids = spark.createDataFrame([(1, "", False, a), (2, "Ann", True, b)], "id long, name string, enrolled boolean, centroid array<double>")
    clips = spark.createDataFrame([(7, 2, b)], "id long, global_id long, centroid array<double>")
    rows = [(10, 1, 9.0, unit(1, 0.9, 0)), (11, 1, 9.0, unit(1, 0.1, 0)), (12, 1, 9.0, unit(0, 1, 0.1)), (13, 1, 9.0, unit(0, 1, 0.9)), (14, 1, 7.9, unit(0, 0, 1)), (15, 1, 8.0, unit(0, 0, 1)), (20, 2, 1.0, a)]
    loc = spark.createDataFrame(rows, "id long, file_id long, total_dur double, centroid array<double>")
    got = {r.local_id: (r.outcome, r.global_id) for r in matching.resolve_batch(loc, ids, clips).collect()}
    assert got == {10: ("enrolled", 2), 11: ("inferred", 1), 12: ("enrolled", 2), 13: ("enrolled", 2), 14: ("below_floor", None), 15: ("mint", None), 20: ("inferred", 1)}
    one = {r.local_id: (r.outcome, r.global_id) for r in matching.resolve_batch(loc, ids, clips, collapse=False).collect()}
    assert one[12] == ("enrolled", 2) and one[13] == ("mint", None) and one[10] == ("mint", None)


def test_voices_without_a_vector_stay_local(spark):
    none = spark.createDataFrame([], "id long, enrolled boolean, centroid array<double>")
    loc = spark.createDataFrame([(1, 1, 60.0, None), (2, 1, 60.0, []), (3, 1, 60.0, unit(1, 0)), (4, 1, 1.0, None)], "id long, file_id long, total_dur double, centroid array<double>")
    got = {r.local_id: (r.outcome, r.global_id) for r in matching.resolve_batch(loc, none, none.selectExpr("id", "id as global_id", "centroid")).collect()}
    assert got == {1: ("no_vector", None), 2: ("no_vector", None), 3: ("mint", None), 4: ("no_vector", None)}


def test_batch_against_plain_matching(spark, sf):
    loc, ids, clips = (f(spark, sf).toPandas() for f in (fx.vp, fx.gs, fx.enr))
    got = {r.local_id: (r.outcome, r.global_id) for r in matching.resolve_batch(fx.vp(spark, sf), fx.gs(spark, sf), fx.enr(spark, sf)).collect()}
    dot = lambda x, y: float(np.dot(x, y))
    for _, rows in loc.groupby("file_id"):
        near = defaultdict(float)
        for l in rows.itertuples():
            for c in clips.itertuples():
                near[l.id, c.global_id] = max(near[l.id, c.global_id], dot(l.centroid, c.centroid))
        first = identity.greedy([(s, i, g) for (i, g), s in near.items() if s >= 0.55], True)
        second = identity.greedy([(s, l.id, g.id) for l in rows.itertuples() if l.id not in first for g in ids[~ids.enrolled].itertuples() if (s := dot(l.centroid, g.centroid)) >= 0.65])
        for l in rows.itertuples():
            want = ("enrolled", first[l.id][0]) if l.id in first else ("inferred", second[l.id][0]) if l.id in second else ("mint" if l.total_dur >= 8 else "below_floor", None)
            assert got[l.id] == want


def test_recluster_claims(spark):
    ids = spark.createDataFrame([(1, "", False), (2, "Bo", False), (3, "", True), (4, "", False)], "id long, name string, enrolled boolean")
    x, y, z = unit(1, 0.0, 0), unit(0, 1.0, 0), unit(0, 0, 1.0)
    rows = [(1, 1, 9.0, 1, x), (2, 2, 9.0, 1, x), (3, 3, 1.0, 2, x), (4, 4, 9.0, 1, y), (5, 5, 9.0, None, y), (6, 6, 9.0, 3, y), (7, 7, 2.0, None, y), (8, 8, 9.0, 1, z), (9, 9, 9.0, 4, z), (10, 10, 9.0, 4, z)]
    loc = spark.createDataFrame(rows, "id long, file_id long, total_dur double, global_id long, centroid array<double>")
    found = matching.recluster(ids, loc).collect()
    assert all(r.similarity == 1.0 for r in found)
    got = {r.id: (r.global_id, r.reassigned) for r in found}
    assert got == {1: (2, True), 2: (2, True), 3: (2, False), 4: (1, False), 5: (1, True), 8: (4, True), 9: (4, False), 10: (4, False)}


def test_recluster_gives_each_cluster_its_own_identity(spark, sf):
    rows = matching.recluster(fx.gs(spark, sf), fx.loc(spark, sf)).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.cluster].add(r.global_id)
    assert all(len(g) == 1 for g in by.values()) and max(Counter(next(iter(g)) for g in by.values()).values()) == 1


def test_stream_in_order_of_arrival(spark, tmp_path):
    import os

    schema = "user_id long, event_id long, stage string"
    for k in range(3):
        spark.createDataFrame([(1, k, f"s{k}"), (k + 5, k, "x")], schema).coalesce(1).write.parquet(str(tmp_path / "raw" / str(k)))
    (tmp_path / "log").mkdir()
    for k in range(3):
        (part,) = [p for p in os.listdir(tmp_path / "raw" / str(k)) if p.endswith(".parquet")]
        os.rename(tmp_path / "raw" / str(k) / part, tmp_path / "log" / f"{k}.parquet")
        os.utime(tmp_path / "log" / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    kind = spark.createDataFrame([], schema).schema
    seen = []
    events.drain(events.read_log(spark, str(tmp_path / "log"), kind), lambda batch, n: seen.append(sorted(r.event_id for r in batch.collect())))
    assert seen == [[0, 0], [1, 1], [2, 2]]
    last = events.latest_snapshot(spark, str(tmp_path / "log"), kind, "user_id", "event_id", ["stage"])
    assert {r.user_id: r.stage for r in last.collect()} == {1: "s2", 5: "x", 6: "x", 7: "x"}


def test_lines_from_pieces(spark):
    rows = [("a", 1, "one\ntw"), ("a", 2, "o"), ("a", 3, ""), ("a", 4, " \n\n  three \nfo"), ("b", 1, "x\n"), ("b", 2, None)]
    got = events.joined_lines(spark.createDataFrame(rows, "source string, n long, text string"), "source", "n").orderBy("source", "line").collect()
    assert [(r.source, r.text, r.open) for r in got] == [("a", "one", False), ("a", "two", False), ("a", "three", False), ("a", "fo", True), ("b", "x", False)]
    log = spark.createDataFrame([], events.SCHEMA)
    assert len(log.columns) == 31 and events.latest(log, "file_id", "event_id", ["kind", "stage"]).count() == 0


def test_recluster_clusters_once(spark, sf, monkeypatch):
    rows_out, cluster = spark.sparkContext.accumulator(0), matching.cluster

    def counted(rows, threshold):
        def tell(batches):
            for b in batches:
                rows_out.add(len(b))
                yield b

        found = cluster(rows, threshold)
        return found.mapInArrow(tell, found.schema)

    monkeypatch.setattr(matching, "cluster", counted)
    assert len(matching.recluster(fx.gs(spark, sf), fx.loc(spark, sf)).collect()) == rows_out.value
