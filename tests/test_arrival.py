import numpy as np
import pytest
from pyspark.sql import functions as F
from voxframe.engine import Engine
from voxframe.operators import arrival, identity

MATCH, FLOOR = 0.65, 8.0


def one_by_one(locals_, ids, earlier):
    """Files one after another against a store of plain lists. No clips."""
    at, n = {i: np.array(v) for i, v, enrolled in ids if not enrolled and v}, {}
    stored = list(earlier)
    out = {}
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    for file_id in sorted({r[1] for r in locals_}):
        stored = [r for r in stored if r[0] != file_id]
        n = {i: max(1, sum(1 for r in stored if r[1] == i)) for i in at}
        rows = [r for r in locals_ if r[1] == file_id]
        sims = [(float(unit(r[2]) @ unit(at[i])), r[0], i) for r in rows if r[2] for i in at]
        taken = identity.greedy([x for x in sims if x[0] >= MATCH])
        for i, _, v, dur in rows:
            if i in taken:
                who, sim = taken[i]
                at[who] = unit((at[who] * n[who] + np.array(v)) / (n[who] + 1))
                out[i] = ("inferred", who, sim)
            elif not v:
                out[i] = ("no_vector", None, None)
                continue
            elif dur >= FLOOR:
                who = arrival._NEW + i
                at[who], out[i] = np.array(v), ("mint", who, 1.0)
            else:
                out[i] = ("below_floor", None, None)
                continue
            stored.append((file_id, who))
    return out, at


def drifting(seed, n_files):
    """Voices that wander, so identities move along and reach voices that none of their first voices was near."""
    rng = np.random.default_rng(seed)
    rows, turn = [], rng.uniform(0, 6, 8)
    for f in range(n_files):
        for k in rng.choice(8, 3, replace=False).tolist():
            turn[k] += rng.uniform(0, 0.6)
            v = [np.cos(turn[k]), np.sin(turn[k]), 0.3 * (k % 3), 0.2 * (k % 2)]
            rows.append((len(rows) + 50, f, [float(x) for x in v] if rng.random() > 0.05 else None, float(rng.choice([3.0, 9.0, 30.0]))))
    ids = [(i, [float(x) for x in rng.normal(size=4)], i % 4 == 3) for i in range(1, 9)] + [(9, None, False)]
    earlier = [(int(rng.integers(0, 2 * n_files)), int(rng.integers(1, 10))) for _ in range(60)]
    return rows, ids, earlier


@pytest.mark.parametrize("seed", [1, 2])
def test_as_files_one_by_one(spark, seed):
    rows, ids, earlier = drifting(seed, 60)
    want, centres = one_by_one(rows, ids, earlier)
    loc = spark.createDataFrame(rows, "id long, file_id long, centroid array<double>, total_dur double")
    known = identity.with_vectors(spark.createDataFrame(ids, "id long, centroid array<double>, enrolled boolean"))
    clips = spark.createDataFrame([], "id long, global_id long, centroid array<double>")
    found, moved = arrival.resolve_in_order(loc, known, clips, spark.createDataFrame(earlier, "file_id long, global_id long"), match=MATCH, floor=FLOOR)
    got = {r.local_id: (r.outcome, arrival._NEW + r.minted_by if r.minted_by is not None else r.global_id, r.similarity) for r in found.collect()}
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(x[2] == pytest.approx(want[i][2]) for i, x in got.items() if want[i][2] is not None)
    assert {"inferred", "mint", "no_vector"} <= {x[0] for x in want.values()}
    last = {arrival._NEW + r.minted_by if r.minted_by is not None else r.global_id: r.centroid for r in moved.collect()}
    assert set(last) == {x[1] for x in want.values() if x[0] == "inferred"}
    assert all(v == pytest.approx(centres[i].tolist()) for i, v in last.items())


def test_a_centroid_that_drifts_joins_components(spark):
    """The second voice moves the identity to where the third is near it, though no two vectors of the graph link them."""
    turn = lambda a: [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]
    limit = 0.66
    rows = [(1, 1, turn(0) + [0.0], 9.0), (2, 2, turn(48) + [0.0], 9.0), (3, 3, [*(0.7 * x for x in turn(24)), 0.51**0.5], 9.0)]
    first, second, third = (np.array(r[2]) for r in rows)
    assert first @ second >= limit and max(first @ third, second @ third) < limit < third @ (first + second) / np.linalg.norm(first + second)
    loc = spark.createDataFrame(rows, "id long, file_id long, centroid array<double>, total_dur double")
    none = spark.createDataFrame([], "id long, global_id long, centroid array<double>, enrolled boolean")
    found, _ = arrival.resolve_in_order(loc, none, none, none.selectExpr("id as file_id", "global_id"), match=limit, floor=FLOOR)
    assert {r.local_id: (r.outcome, r.minted_by) for r in found.collect()} == {1: ("mint", 1), 2: ("inferred", 1), 3: ("inferred", 1)}


def test_one_commit_for_all_files(spark, tmp_path):
    rows, *_ = drifting(3, 6)
    said = spark.createDataFrame([(f, 0, "x", 0.0, 1.0, f"speaker_{i}") for i, f, _, _ in rows], "file_id long, idx long, text string, seg_start double, seg_end double, local_label string")
    who = spark.createDataFrame([(f, f"speaker_{i}", v, d, 1) for i, f, v, d in rows], "file_id long, label string, centroid array<double>, total_dur double, n_segments long")
    one, many = (Engine(spark, f"file://{tmp_path}/{k}") for k in "ab")
    one.add_in_order(said, who)
    for f in range(6):
        many.add(said.where(F.col("file_id") == f), who.where(F.col("file_id") == f))
    tables = [{k: sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.drop("centroid").collect()))) for k, t in e.tables().items()} for e in (one, many)]
    assert tables[0] == tables[1]
    centres = [{r.id: r.centroid for r in e.tables()["identities"].collect()} for e in (one, many)]
    assert all(v == pytest.approx(centres[1][i]) for i, v in centres[0].items())
    assert (tmp_path / "a" / "marks").is_dir() and len([p for p in (tmp_path / "a" / "marks").iterdir() if p.name.startswith("v")]) == 2
