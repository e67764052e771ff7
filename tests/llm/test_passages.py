import random
import re

import pytest
from voxframe.llm import passages

SCHEMA = "doc_id long, text string, `_0.x` string, word long"
LAST = 1 << 70


def plain(docs, window=13):
    """(id, words, spans, kept, longest) of each document, window by window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    ids = [LAST if i is None else i for i, _ in docs]

    def hits(n):
        first = {}
        for i, w in zip(ids, words):
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                first[k] = min(i, first.get(k, i))
        return [[p for p in range(len(w) - n + 1) if first[tuple(w[p : p + n])] < i] for i, w in zip(ids, words)]

    longest, n = [0] * len(docs), window
    while any(h := hits(n)):
        longest = [n if x else y for x, y in zip(h, longest)]
        n *= 2
    out = []
    for (i, _), w, h, most in zip(docs, words, hits(window), longest):
        gone = {q for p in h for q in range(p, p + window)}
        spans = [(p, next(q for q in range(p, len(w) + 1) if q not in gone)) for p in sorted(gone) if p - 1 not in gone]
        out.append((i, len(w), tuple(spans), " ".join(x for p, x in enumerate(w) if p not in gone), most))
    return sorted(out, key=repr)


def collected(df, longest=True):
    rows = [(r.doc_id, r._vx_n_words, tuple(map(tuple, r._vx_spans)), r._vx_kept, r._vx_longest) for r in df.collect()]
    return sorted(rows if longest else [r[:-1] for r in rows], key=repr)


def test_lengths():
    assert passages.lengths(13, 7) == [7, 13]
    assert passages.lengths(13, 1) == [1, 2, 4, 7, 13]
    assert passages.lengths(50, 8) == [7, 13, 25, 50]
    assert passages.lengths(5, 9) == [5]


def test_whole_table_against_plain_version(spark, sf, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 1 << 14)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert any(r[4] > 13 for r in want)
    got = passages.dedup(docs)
    assert got.columns == [*docs.columns, "_vx_n_words", "_vx_spans", "_vx_kept", "_vx_longest"]
    assert collected(got) == want
    assert collected(passages.dedup(docs, longest=False), False) == [r[:-1] for r in want]


@pytest.mark.parametrize(("window", "start"), [(5, 5), (5, 1), (6, 3), (13, 7), (8, 2)])
def test_strings_with_structure(spark, monkeypatch, window, start):
    monkeypatch.setattr(passages, "CHUNK", 300)
    rng = random.Random(window)
    docs = [(i // 2, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(30)]
    thue = "".join(bin(i).count("1") % 2 and "ab" or "ba" for i in range(64))
    docs += [(40, " ".join(thue)), (41, " ".join(thue[::-1])), (42, "a " * 70), (43, "a " * 50), (43, "a " * 50), (44, " ".join("abc" * 20)), (45, "x " + " ".join("abc" * 20) + " y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain(docs, window)
    assert collected(passages.dedup(df, window=window, start=start)) == want
    assert collected(passages.dedup(df, window=window, start=start, longest=False), False) == [r[:-1] for r in want]


def test_odd_rows(spark):
    line = "One two\tthree\nfour é  \x0b five\x0csix seven\r\neight nine ten eleven twelve 13\xa0x fourteen fifteen"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, line, "x", 1), (3, line, "x", 1), (None, line, "y", 2), (None, line + " end", "y", 2), (9, "Q " * 40_000, "z", 3), (10, "begin " + line.replace("\t", " "), "z", 3), (11, "Q " * 12, "z", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain([r[:2] for r in rows[:6] + rows[7:]]) + [(9, 40_000, (), ("Q " * 40_000)[:-1], 0)]
    got = passages.dedup(docs)
    assert got.columns[:4] == ["doc_id", "text", "_0.x", "word"]
    assert collected(got) == sorted(want, key=repr)
    assert passages.dedup(docs.limit(0)).count() == 0
    assert passages.dedup(docs.limit(0), longest=False).count() == 0
