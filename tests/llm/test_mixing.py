import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from voxframe.llm import mixing


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _size string").withColumn("_vx_size", mixing.word_count())
    out = mixing.mix(df, **kw).withColumn("taken", F.col("_vx_size") * F.col("_vx_copies")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    return out, by


def test_targets_and_sample(spark):
    rows = [(i, f"s{i % 4}", "w " * (1 + i * 7919 % 50), None) for i in range(4000)]
    rows += [(10_000 + i, "tiny", "a b", None) for i in range(5)] + [(20_000, None, "a b c", None), (20_001, "s0", None, None), (20_002, "s0", " \n", None)]
    out, by = run(spark, rows)
    again, _ = run(spark, rows[::-1])
    assert sorted((r.doc_id, r._vx_copies) for r in out) == sorted((r.doc_id, r._vx_copies) for r in again)
    assert len(out) == len(rows) and all(0 <= r._vx_copies <= 3 for r in out)
    size = {s: sum(r._vx_size for r in rs) for s, rs in by.items()}
    target = {s: rs[0]._vx_target for s, rs in by.items()}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    w = dict(zip(sorted(s for s in size if s), [5, 2, 1, 5, 2])) | {None: 1}
    free = {s for s in size if target[s] < 3 * size[s]}
    assert {"tiny", None}.isdisjoint(free) and len({round(target[s] / w[s], 6) for s in free}) == 1
    factor = next(target[s] / w[s] for s in free)
    assert all(target[s] == 3 * size[s] and factor * w[s] >= 3 * size[s] for s in size if s not in free)
    for s, rs in by.items():
        assert abs(sum(r.taken for r in rs) - target[s]) <= max(r._vx_size for r in rs)


def plain(rows, weights=(5, 2, 1)):
    """Copies by document, with loops and exact fractions where the operator has sums; rows: id, source, size."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted((x for x in by if x is not None)) + [x for x in by if x is None]
    size = {x: sum(r[2] for r in by[x]) for x in by}
    w = {x: weights[k % len(weights)] for k, x in enumerate(order)}
    free, left, target = set(order), sum(size.values()), {}
    while over := [x for x in free if left * w[x] > 3 * size[x] * sum(w[y] for y in free)]:
        for x in over:
            target[x] = 3 * size[x]
        free -= set(over)
        left = sum(size.values()) - sum(target.values())
    target |= {x: left * w[x] / sum(w[y] for y in free) for x in free}
    copies = {}
    for x in order:
        whole = math.floor(target[x] / size[x]) if size[x] else 0
        rest = target[x] - whole * size[x]
        sure, others = [], sorted(by[x], key=lambda r: -r[2])
        while others and rest > 0:  # the longest is certain while its p would reach 1
            squares = sum(r[2] ** 2 for r in others)
            remains = rest - sum(r[2] for r in sure)
            if others[0][2] and remains * others[0][2] >= squares:
                sure.append(others.pop(0))
            else:
                break
        remains, squares = rest - sum(r[2] for r in sure), sum(r[2] ** 2 for r in others)

        def rank(r):
            u = (int(hashlib.md5(f"{'null' if r[0] is None else r[0]}|11".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = remains / squares * max(1, r[2])
            return u / (1 - u) * ((1 - p) / p)

        copies |= {r[0]: whole + (r in sure) for r in by[x]}
        cum = 0
        for r in sorted(others, key=rank) if squares and remains > 0 else []:
            cum += r[2]
            if cum <= remains or cum - remains < remains - (cum - r[2]):
                copies[r[0]] += 1
    return copies


@pytest.mark.parametrize("few", [0, 50_000])
def test_against_a_plain_version(spark, monkeypatch, few):
    """Also with edges of many buckets, and with sources dealt by join."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "d", None]), int(r.paretovariate(0.7)) % 4000) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _vx_size long")
    got = {x.doc_id: x._vx_copies for x in mixing.mix(df).collect()}
    assert got == plain(rows)
    assert len({got[i] for i, s, _ in rows if s == "a"}) > 1


def test_longer_documents_are_likelier(spark):
    rows = [(i, "a", 10 if i % 2 else 40) for i in range(4000)] + [(5000 + i, "b", 30) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _vx_size long")
    got = {x.doc_id: x._vx_copies for x in mixing.mix(df, weights=(1, 3)).collect()}
    short, long = (sum(got[i] for i in range(4000) if i % 2 == k) / 2000 for k in (1, 0))
    assert abs(long / short - 4) < 0.6


def test_odd_tables(spark):
    assert run(spark, [(1, "a", "x", None)])[0][0]._vx_copies == 1
    assert run(spark, [(1, None, None, None), (None, "b", "", None)])[1][None][0]._vx_target == 0
    df = spark.createDataFrame([], "doc_id long, source string, _vx_size long")
    assert mixing.mix(df).count() == 0
    twice = [(1, "a", "x y", None), (1, "a", "x y", None), (2, "b", "x", None)]
    assert len(run(spark, twice)[0]) == 3


def test_repeated_rows_go_together(spark):
    rows = [(i // 5, "a", "w " * (1 + i // 5 % 7), None) for i in range(1000)] + [(5000 + i, "b", "w w w", None) for i in range(300)]
    out, by = run(spark, rows, weights=(1, 3))
    assert len(out) == len(rows) and all(len({r._vx_copies for r in by["a"] if r.doc_id == i}) == 1 for i in range(200))
    assert abs(sum(r.taken for r in by["a"]) - by["a"][0]._vx_target) <= 5 * 7
