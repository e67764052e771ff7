import hashlib
import re

from pyspark.sql import functions as F
from voxframe.llm import decontaminate as d


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item) if item is not None else "null")
    sizes, out = {len(k) for k in windows}, {}
    for i, text in docs:
        w, hit, got = words(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    got |= windows[k]
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.digest(df).collect()}


def test_whole_tables_against_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sum(w[4] for w in want.values()) > 0
    assert result(d.locate(docs, bench, keep=["doc_id"])) == want
    assert result(d.locate(docs, bench, block_bytes=500)) == want
    kept = d.remove(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}


ITEMS = [(1, "one two three"), (2, "Solo"), (3, None), (4, "..."), (None, "a b a b a b a b a b a b a"), (5, "one two three"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (5, "w1 w2"), (1, "one two three")]
DOCS = [(1, None), (2, ""), (3, "x ONE, two-three solo"), (4, "a b " * 40), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (6, "w1 w2 w3"), (7, "Übung solo; üsolo"), (8, "pad " * 60_000 + "solo")]


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, 7) for i, t in DOCS], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")
    want = plain(DOCS, ITEMS)
    for block in (1 << 20, 10):
        for shard in (1, 1 << 23):
            monkeypatch.setattr(d, "SHARD", shard)
            assert result(d.locate(docs, bench, block_bytes=block)) == want
    assert d.locate(docs.limit(0), bench).count() == 0
    assert not any(w[4] for w in result(d.locate(docs, bench.limit(0))).values())


def test_longest_matches():
    block, known = d.Block.of([("i", " ".join(f"w{k}" for k in range(30)))], 10), d.vocabulary()
    docs = [d.numbers(t, known) for t in ("none of it", "x " + " ".join(f"w{k}" for k in range(5, 25)) + " y", "")]
    found = d.SuffixArray(docs, known, [10]).search(block)
    assert [x.tolist() for x in found] == [[1], [0], [5], [1], [20]]


def test_the_array_is_sorted():
    known = d.vocabulary()
    docs = [d.numbers(t, known) for t in ("a b a b a b c a b", "b a b c", "", "c")]
    array = d.SuffixArray(docs, known, [1, 3, 5])
    for n, (_, _, places) in array.sorted.items():
        strings = [tuple(array.numbers[p : p + n]) for p in places]
        assert strings == sorted(strings) and all(0 not in x for x in strings)
        assert sorted(places) == [p for p in range(len(array.numbers) - n + 1) if 0 not in array.numbers[p : p + n]]


def test_words_come_in_pieces(monkeypatch):
    text = "Ab c" * 50 + " " + "x" * 30 + " y z"
    whole = [w for part in d.words_of(text) for w in part]
    monkeypatch.setattr(d, "PIECE", 7)
    assert [w for part in d.words_of(text) for w in part] == whole and len(list(d.words_of(text))) > 5


def test_many_blocks_are_files_of_tasks(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = result(d.locate(docs, bench, keep=["doc_id"]))
    made = d.blocks_of(bench, "item_id", "text", 10, 600)
    items = [i for r in made.collect() for i in d.Block.unpacked(d.files.read_whole(r.path), 10).ids]
    assert made.count() > 6 and sorted(items) == sorted(str(r.item_id) for r in bench.collect())
    monkeypatch.setattr(d, "SHARD", 1 << 18)
    assert result(d.locate(docs, bench, block_bytes=600)) == want


def test_a_block_comes_back_whole():
    for items in (ITEMS, [], [("x", None)], [("y", "wort " * 30 + "Ärger")]):
        block = d.Block.of([(str(i), t) for i, t in items], 10)
        again = d.Block.unpacked(block.packed(), 10)
        for name in ("ids", "words", "lengths"):
            assert getattr(block, name) == getattr(again, name)
        for name in ("numbers", "size", "item", "place", "window"):
            assert getattr(block, name).tolist() == getattr(again, name).tolist()


def test_a_test_set_larger_than_a_block(spark):
    """Some 40 MB of items in blocks of 4 MB: repeated items, and each item's text in one document."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(120)), lambda k: F.substring(F.sha1(F.concat(F.col("id").cast("string"), F.lit(":"), k.cast("string"))), 1, 8)))
    bench = spark.range(40_000).select(F.col("id").alias("item_id"), text.alias("text"))
    docs = bench.where("item_id % 997 = 0").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), "text", F.lit(" after it")).alias("text"))
    found = {r.doc_id: r._vx_matches for r in d.locate(docs, bench.unionByName(bench.where("item_id % 3 = 0")), block_bytes=4 << 20).collect()}
    assert len(found) == 41 and all([tuple(x) for x in m] == [(str(i), 0, 2, 120)] for i, m in found.items())
