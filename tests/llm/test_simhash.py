import numpy as np
import xxhash
from voxframe.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node long"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def components(fps):
    """fps: (id, fingerprint); all pairs, the slow way."""
    best = {i: i for i, _ in fps}
    moved = True
    while moved:
        moved = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 3 and best[j] < best[i]:
                    best[i], moved = best[j], True
    return best


def test_fingerprint_is_the_plain_one(monkeypatch):
    texts = [None, "", "  \n", "One", "one TWO", "a b c d a b c", "É é \x0b x\x1cy z", "w " * 5000]
    want = [plain(t) for t in texts]
    assert [simhash.simhash(t) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.simhash(t) for t in ["a b c d a b c" * 9, *texts]] == [plain("a b c d a b c" * 9), *want]


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = components(fps)
    assert {i: (r.fp % 2**64, r.component_id) for i, r in got.items()} == {i: (f, want[i]) for i, f in fps}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "same words here again", "x", 1), (3, "same words here again", "x", 1), (None, "same words here again", "y", 2), (9, "Q " * 40_000, "z", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (1, 1), (2, 1), (3, 3), (3, 3), (9, 9)]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))} | {int(x) for x in rng.integers(-(2**63), 2**63, 50)}
    nodes = [(f if f < 2**63 else f - 2**64, i) for i, f in enumerate(sorted(fps))]
    monkeypatch.setattr(simhash, "FEW", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    df = spark.createDataFrame(nodes, "fp long, node long")
    found = [(r.a, r.b) for r in simhash.links(df).collect()]
    of = dict((n, f % 2**64) for f, n in nodes)
    want = components([(n, of[n]) for n in of])
    best = {n: n for n in of}
    for _ in of:
        for a, b in found:
            best[a] = best[b] = min(best[a], best[b])
    assert best == want


def test_null_and_repeated_ids_link_by_fingerprint(spark, monkeypatch):
    chain, twin, nulls = 0, 0x5A5A << 40, 0x33CC << 20
    rows = [(1, chain), (None, chain | 0b111), (2, chain | 0b111111), (7, twin), (7, twin ^ 1), (8, twin ^ 0b1111), (None, nulls), (None, nulls ^ 1), (9, -1)]
    docs = spark.createDataFrame([(i, "x", f) for i, f in rows], "doc_id long, text string, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda d, *_: d.select("doc_id", "fp"))
    monkeypatch.setattr(simhash, "fingerprint_column", lambda d, *_: d.withColumn("_vx_fp", d.fp))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == dict(zip(rows, [1, 1, 1, 7, 7, 7, None, None, 9]))
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 7, 9]


def test_of_rows_with_one_id_and_one_fingerprint_the_same_stays(spark):
    rows = [(1, "Alpha beta gamma delta", 1), (1, "alpha  beta gamma delta", 2), (1, "alpha beta\tgamma delta", 3), (1, "alpha beta\tgamma delta", 4), (2, None, 5), (None, "", 6)]
    kept = set()
    for k in range(4):
        df = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, `a.b` int").repartition(1 + k)
        kept.add(tuple(sorted(tuple(r) for r in simhash.keep_one(df).collect())))
    assert len(kept) == 1 and [r[0] for r in kept.pop()] == [1, 2]


def broadcast(df):
    """The lines of df's plan that stand below a broadcast."""
    lines, depth, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), None, []
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return out


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    nodes = simhash.write_table(spark.range(3000).selectExpr("xxhash64(id div 100) ^ (id % 100) fp", "id node"), "nodes")
    few = simhash.links(nodes)
    assert "Generate explode([0,1,2" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "FEW", 8)
    many = simhash.links(nodes)  # with keys that blocks compare
    assert broadcast(many)
    assert not [x for d in (few, many) for x in broadcast(d) if "explode([0,1,2" in x]
