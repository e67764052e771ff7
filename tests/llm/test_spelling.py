import random
import zlib
from collections import Counter

import numpy as np
import pytest
from voxframe.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def runs(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif now:
            out.append(now)
            now = ""
    return out


def plain_words(docs, typo=97):
    found = Counter()
    for i, text in docs:
        for w in runs(text):
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % typo == 0 else w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    out = {}
    for w, n in words.items():
        close = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        top = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(close), top if top and words[top] >= 2 * n else None)
    roots = {}
    for w in out:
        r = w
        while out[r][2]:
            r = out[r][2]
        roots[w] = r
    return {(w, n, k, f, f and words[f], roots[w]) for w, (n, k, f) in out.items()}


def as_set(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_vocabulary_of_the_table(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.word: r.n for r in spelling.vocabulary(docs, typo=97).collect()} == want


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([3, 4, 6, 8, 16, 40, 100]) for _ in range(500)}
    words |= {"aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 15, "aaaaaaaa": 31, "ÿÿÿÿÿ": 3, "x" * 3000: 4, "x" * 1500 + "y" + "x" * 1499: 9, "x" * 2999: 30}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert as_set(spelling.group(df)) == plain_groups(words)


def test_clashing_hashes_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HASHES", ((7, 3), (5, 2)))
    words = [(i, w) for i, w in enumerate(["house", "mouse", "hose", "horse", "hours", "other", "xxxxx", "xxxxy", "hhouse"])]
    rows = spark.createDataFrame(words, "id long, word string")
    keys = list(spelling.emitted(np.arange(len(words)), [w for _, w in words]))
    assert len(np.unique(np.concatenate([k[1] for k in keys]))) < 36
    want = {(a, b) for a, x in words for b, y in words if a < b and near(x, y)}
    assert {(r.a, r.b) for r in spelling.near_pairs(rows).collect()} == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 11)
    monkeypatch.setattr(spelling, "HELD", 2)
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "Colour COLOUR  colour×colour" * 3, "y", 2), (4, "color color colér", "z", 3), (4, "color color colér", "z", 3), (4, "color color colér", "z", 3), (5, "abc " * 9 + "Größe GRÖSSE größe Größe\x00größe", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for typo in (0, 2, 97):
        want = plain_words([(r[0], r[1]) for r in rows], typo or 1 << 40)
        words = spelling.vocabulary(docs, typo=typo)
        assert {r.word: r.n for r in words.collect()} == want
        assert as_set(spelling.group(words)) == plain_groups(want)
    assert spelling.group(spelling.vocabulary(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.group(docs, times=1)
