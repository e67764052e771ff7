import math
import random
import zlib

from voxframe.llm import toxicity as t


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    held = {r.doc_id for r in labels.where(t.held_out()).collect()}
    assert held == {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    flipped = labels.selectExpr("doc_id", f"CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    model, other = t.fit(docs, labels), t.fit(docs, flipped)
    assert (model.weight == other.weight).all() and model.bias == other.bias
    s = {r.doc_id: r._vx_score for r in t.score(docs, model, keep=["doc_id"]).collect()}
    assert len(s) == docs.count() and all(0 <= x <= 1 for x in s.values())
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in held}
    assert auc([(s[i], y[i]) for i in y]) > 0.85


def test_odd_rows(spark):
    rows = [(1, "you idiot scum", 1), (2, "nice day", 1), (3, None, 1), (None, "", 1), (4, "x" * 600_000, 1), (4, "x" * 600_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 1), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    s = sorted((r.doc_id or 0, r._vx_score) for r in t.score(docs, model).collect())
    assert len(s) == 6 and s[-1] == s[-2] and all(0 <= x <= 1 for _, x in s)
    alone = t.fit(docs, labels.where("toxic = 1"))
    assert len({r._vx_score for r in t.score(docs, alone).collect()}) == 1
    assert t.score(docs.limit(0), model).count() == 0


def plain_scores(docs, labels, features, steps=200, l2=0.3):
    """The same in loops: n-grams as strings, counts in dicts, gradients a row at a time."""

    def grams(text):
        text = f" {(text or '').lower()} " if text else "  "
        out = set()
        for n in (3, 4, 5, 6):
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                out.add(((h + n) * 0x9E3779B97F4A7C15) % 2**64 >> 64 - 19)
        return out

    known = {}
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            known[i] = max(y, known.get(i, 0))
    share = (sum(known.values()) + 1) / (len(known) + 2)
    own = sorted((known[i], i, grams(t)) for i, t in docs if i in known)
    n = {k: sum(y == k for y, _, _ in own) for k in (0, 1)}
    p, q = ({g: sum(g in x for y, _, x in own if y == k) for g in set().union(*(x for _, _, x in own))} for k in (1, 0))

    def differs(g):
        pooled = (p[g] + q[g]) / (n[0] + n[1])
        return abs(p[g] / n[1] - q[g] / n[0]) / math.sqrt(pooled * (1 - pooled) + 1e-9)

    best = sorted((g for g in p if p[g] + q[g] >= 4), key=lambda g: (-differs(g), g))[:features]
    ratio = {g: math.log((p[g] + 1) / (n[1] + 2)) - math.log((q[g] + 1) / (n[0] + 2)) for g in best}
    w, m1, m2 = {g: 0.0 for g in [*best, None]}, {g: 0.0 for g in [*best, None]}, {g: 0.0 for g in [*best, None]}  # None: the intercept
    for t_ in range(1, steps + 1):
        grad = {g: l2 * w[g] / len(own) if g is not None else 0.0 for g in w}
        for y, _, x in own:
            z = w[None] + sum(ratio[g] * w[g] for g in best if g in x)
            e = (1 / (1 + math.exp(-z)) - y) / len(own)
            grad[None] += e
            for g in best:
                if g in x:
                    grad[g] += ratio[g] * e
        for g in w:
            m1[g], m2[g] = 0.9 * m1[g] + 0.1 * grad[g], 0.999 * m2[g] + 0.001 * grad[g] ** 2
            w[g] -= 0.05 * (m1[g] / (1 - 0.9**t_)) / (math.sqrt(m2[g] / (1 - 0.999**t_)) + 1e-9)
    bias = w[None] + math.log(share / (1 - share)) - math.log(n[1] / n[0])
    return {i: 1 / (1 + math.exp(-(bias + sum(ratio[g] * w[g] for g in best if g in grams(t))))) for i, t in docs}


def test_scores_against_a_plain_version(spark):
    r = random.Random(6)
    mild, rude = "walk tree lamp sun garden bread".split(), "scum idiot trash".split()
    docs = [(i, " ".join(r.choice(mild + (rude if i % 3 == 0 else [])) for _ in range(r.randint(0, 9)))) for i in range(60)] + [(200, None), (201, "É scum ÉÉ")]
    labels = [(i, int(i % 3 == 0)) for i in range(50)] + [(3, 0)]
    want = plain_scores(docs, labels, 60)
    model = t.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), features=60)
    got = {x.doc_id: x._vx_score for x in t.score(spark.createDataFrame(docs, "doc_id long, text string"), model, keep=["doc_id"]).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert len({round(s, 3) for s in want.values()}) > 10
