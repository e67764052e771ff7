from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from voxframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, `_vx_chunk.x` string, a long"


@pytest.fixture(scope="module")
def plain():
    """Tokens of a text as (id, first byte, end) of both sides, by the libraries on whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    hidden = [x for x in range(256) if x not in alignment.VISIBLE]
    byte = {chr(x): x for x in alignment.VISIBLE} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def ranged(pairs):
        at, out = 0, []
        for i, data in pairs:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        same = all(b"".join(d for _, d in side) == b" " + text.encode() for side in (left, right))
        return (ranged(left), ranged(right)) if same else ([], [])

    return tokens


def expected(rows, tokens):
    """The result, pair by pair."""
    found = [(i, *tokens(text)) for i, text in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in found]
    count = Counter(p for ls in links for p in ls)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for (i, a, b), ls in zip(found, links):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if start <= x[1] < e) for side in (a, b)))
            start = e
        out.append((i, len(a), len(b), len(ends), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), ";".join(groups)))
    return out


def collected(df):
    return [tuple(r) for r in df.select("doc_id", *[f"_vx_{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")]).collect()]


def order(rows):
    return sorted(rows, key=repr)


TEXTS = [None, "", " ", "  two  spaces ", "The quick <|endoftext|> brown </s> fox's <0x41>", "für été ß × ÷", "日本語 の text", "á ﬁ ­ x y", "tab\tnew\nline\r\n\r\nx", "▁ low ▁line", "nul \x00 byte \x1f", "\U0001f600 \U0001f468‍\U0001f469 ok", "word " * 300, "x" * 3000, "1234567890 3.14159 $%^ ''' \"q\" 'll we'll"]


def test_units_give_the_ids_of_whole_texts(spark, sf, plain):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    pair = alignment.Pair(A, B)
    assert pair.cuts
    for text, *both in zip(texts, *(x.to_pylist() for x in pair.encode(texts))):
        assert [np.frombuffer(x, pair.kind).tolist() for x in both] == [[t[0] for t in side] for side in plain(text)], text


def test_small_cache_gives_the_same(monkeypatch):
    texts = TEXTS * 2
    want = alignment.Pair(A, B).encode(texts)
    monkeypatch.setattr(alignment, "CACHE", 6)
    small = alignment.Pair(A, B)
    assert [[x[0].as_py() for x in small.encode([t])] for t in texts] == [list(x) for x in zip(*(w.to_pylist() for w in want))]
    whole = alignment.Pair(A, B)
    whole.cuts = False
    assert whole.encode(texts) == want


def test_links_by_bisection_are_all_overlaps():
    rng = np.random.default_rng(5)
    for n in [1, 2, 40]:
        total = int(rng.integers(n, 4 * n + 1))
        cuts = [np.append(np.sort(rng.choice(np.arange(1, total), rng.integers(0, min(n, total)), replace=False)), total) for _ in range(2)]
        a, b = (np.diff(c, prepend=0) for c in cuts)
        of_a, of_b, cut_a, cut_b = alignment.linked(a, b)
        spans = [[(e - s, e) for s, e in zip(x, np.cumsum(x))] for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e]
        assert list(zip(of_a.tolist(), of_b.tolist())) == want
        assert np.cumsum(a)[cut_a].tolist() == np.cumsum(b)[cut_b].tolist() == sorted(set(cuts[0].tolist()) & set(cuts[1].tolist()))


def test_whole_table_against_brute_force(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").repartition(3)
    want = expected([(r.doc_id, r.text) for r in docs.collect()], plain)
    assert order(collected(alignment.align(docs, A, B))) == order(want)


def test_odd_rows_and_many_chunks(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 400)
    rows = [(i if i % 5 else None, t, "kept", i) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    tokens = alignment.tokenized(docs, A, B, keep=["doc_id"])
    assert tokens.select("_vx_chunk").distinct().count() > 4
    want = expected([(r[0], r[1]) for r in rows], plain)
    found = alignment.align(docs, A, B)
    assert found.columns[:4] == ["doc_id", "text", "_vx_chunk.x", "a"]
    assert order(collected(found)) == order(want)
    short = alignment.align(docs, A, B, keep=["doc_id"], digest=True)
    assert order(collected(short)) == order([(*r[:-1], sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want])
    assert alignment.align(docs.limit(0), A, B).count() == 0
