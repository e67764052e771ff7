import hashlib
import random

import numpy as np
from voxframe.llm import suffixes as s


def plain(docs, length):
    """docs: (id, text) in order; every string looked up in a set."""
    seen, out = set(), {}
    for i, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            k = data[p : p + length]
            if k in seen:
                gone[p : p + length] = True
            seen.add(k)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.digest(df).collect()}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain(sorted((r.doc_id, r.text) for r in docs.collect()), 100)
    assert sum(w[1] for w in want.values()) > 0
    assert got(s.dedup(docs)) == want


def test_shuffled_fragments_in_small_pieces(spark, monkeypatch):
    r = random.Random(4)
    bits = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 160))) for _ in range(12)] + ["a" * 300, "ab" * 90]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200 + i, rows[i][1][:80] + "#" + rows[i][1][80:]) for i in range(0, 60, 5)]
    monkeypatch.setattr(s, "SCAN", 13)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for length, piece in ((100, s.PIECE), (40, 37), (64, 500)):
        assert got(s.dedup(df, length=length, piece=piece)) == plain(rows, length)


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i // 7) % 26) for i in range(400_000))
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, long, 0), (5, "x" + long, 0), (6, "y" * 100, 0), (7, "y" * 101, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    want = plain([r[:2] for r in rows], 100)
    assert got(s.dedup(df)) == want
    twice = spark.createDataFrame([*rows, *rows], "doc_id long, text string, at int")
    found = s.dedup(twice)
    assert found.count() == 14 and got(found) == want
    none = spark.createDataFrame([(None, "z" * 150, 0), (1, "z" * 120, 0), (1, "other " * 30, 0)], "doc_id long, text string, at int")
    by = {(r.doc_id, r.n_bytes): r.n_removed for r in s.digest(s.dedup(none)).collect()}
    assert by == {(None, 150): 149, (1, 120): 120, (1, 180): 174}
    assert s.dedup(df.limit(0)).count() == 0


def thue_morse(n, swap=False):
    return "".join("AB"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_structured_strings_are_told_apart(spark):
    """Strings on which polynomial hashes modulo 2**64 collide."""
    r = random.Random(8)
    edge = lambda: "".join(r.choice("cdefgh") for _ in range(r.randint(300, 900)))
    rows = [(i, edge() + thue_morse(r.choice([256, 1024, 2048]), bool(i % 2)) + edge()) for i in range(40)]
    rows += [(100 + i, rows[i][1][: 700 + 90 * i]) for i in range(0, 40, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for length in (100, 128, 300, 500, 2036):
        assert got(s.dedup(df, length=length)) == plain(rows, length), length


def test_growth_ends_at_the_length_and_at_most_doubles():
    for length in range(s.GRAM + 2, s.GRAM + 2001):
        steps = s.growth(length)
        assert steps[0][0] == s.GRAM and steps[-1][1] == length and all(a < b <= 2 * a for a, b in steps)
        assert all(x[1] == y[0] for x, y in zip(steps, steps[1:])) and len(steps) <= 12


def test_a_rank_names_the_pair_of_former_ranks():
    r = random.Random(6)
    raw = bytes(r.choice(b"ab") for _ in range(30)) * 40 + bytes(r.randrange(256) for _ in range(3000))
    for length in (100, 300):
        steps = []
        for core, longer in [(0, s.GRAM), *s.growth(length)]:
            steps += [longer - core] if core else []
            at = np.arange(len(raw) - longer + 1)
            names = list(zip(*(x.tolist() for x in s.ranks(raw, at, steps))))
            strings = [raw[p : p + longer] for p in at]
            assert len(set(names)) == len(set(strings)) == len(set(zip(names, strings)))
            if core:
                first, last = s.ranks(raw, at, steps[:-1]), s.ranks(raw, at + steps[-1], steps[:-1])
                pairs = list(zip(*(x.tolist() for x in (*first, *last))))
                assert len(set(pairs)) == len(set(names)) == len(set(zip(pairs, names)))


def test_a_passage_in_every_document_is_spread(spark):
    """One passage in all documents: few of its rows reach the task of its rank."""
    r = random.Random(3)
    passage = "".join(r.choice("abcdefghij ") for _ in range(700))
    rows = [(i, "".join(r.choice("klmnopqrst ") for _ in range(150)) + passage) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        units = df.select("doc_id", df.text.cast("binary").alias("text")).mapInArrow(s._anchors(100, s.PIECE), s._ROWS)
        sizes = [x["count"] for x in units.groupBy("a").count().collect()]
        assert max(sizes) < 100 and sum(sizes) > 9000
        assert got(s.dedup(df)) == plain(rows, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
