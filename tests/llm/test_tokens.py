import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from voxframe.llm import rans, tokens
from voxframe.workspace import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("n", [0, 1, 31, 33, rans.BLOCK, 3 * rans.BLOCK + 77])
@pytest.mark.parametrize("kinds", [1, 3, 40_000])
def test_codec_round_trip(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.uint32) * (2**32 // (kinds + 1))
    data = rans.encode(ids, [5, None], np.array([n // 2, n - n // 2]))
    r = rans.Reader(data)
    assert np.array_equal(r.decode(), ids) and r.doc_ids == [5, None] and r.lengths.tolist() == [n // 2, n - n // 2]
    assert np.array_equal(r.decode(n // 3, n // 2), ids[n // 3 : n // 2])


def test_table_adds_up():
    for n in (1, 2, 5000, 60_000):
        s, f, bits = rans.table(np.repeat(np.arange(n), np.minimum(50, 1 + np.arange(n) % 97)))
        assert f.sum() == 1 << bits and f.min() >= 1 and len(s) == n


def test_damage_is_found():
    data = bytearray(rans.encode(np.arange(40_000) % 700, [1], np.array([40_000])))
    for at in (3, 70, len(data) - 9):
        bad = bytearray(data)
        bad[at] ^= 64
        with pytest.raises(rans.CorruptFile):
            rans.Reader(bytes(bad)).decode()
    with pytest.raises(rans.CorruptFile):
        rans.Reader(bytes(data[:-4]))


def test_chunks_give_the_ids_of_the_whole_text(spark, sf, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", None, " ", "it's <|endoftext|>x 12 ab é ́  İ ΣΑΣ", "a\x1cb\x85c d", "x" * 3000]
    monkeypatch.setattr(tokens, "CACHE", 500)
    e = tokens.Encoder(PATH)
    ids, counts = e.encode(pa.array([t or "" for t in texts]), 2)
    want = plain(texts)
    assert e.encode(pa.array([t or "" for t in texts]), 2)[0].tolist() == ids.tolist()
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


def test_corpus_round_trip(spark, sf, monkeypatch):
    monkeypatch.setattr(tokens, "STEP", 9000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "z", "x"), (10**9, None, "x"), (3, "twice", "x"), (3, "twice", "x")], "doc_id long, text string, start string")
    docs = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    written = tokens.write(docs, new_path(spark, "t"), PATH, file_ids=5000)
    got = sorted(tuple(r) for r in tokens.read(spark, written).select("start", "n_tokens", "ids_crc32", "doc_id").collect())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r, ids in zip(rows, plain([r.text for r in rows])):
        want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), r.doc_id))
        start += len(ids)
    assert got == want and written.count() > 4
    at = want[50]
    assert zlib.crc32(tokens.document_ids(written, at[0], at[1]).tobytes()) == at[2]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read(spark, tokens.write(docs, new_path(spark, "t"), PATH)).count() == 0


def test_capitals_with_combining_marks():
    texts = ["H\u0331a b", "T\u0308.x", "W\u030aY\u030aJ\u030c", "H\u1dc4\u0331", "Hello E\u0301t."]
    ids, counts = tokens.Encoder(PATH).encode(pa.array(texts), 2)
    assert ids.tolist() == [x for w in plain(texts) for x in w]
    assert counts.tolist() == [len(w) for w in plain(texts)]


def test_a_range_reads_its_blocks_only():
    ids = np.random.default_rng(2).integers(0, 9000, 40 * rans.BLOCK).astype("<u4")
    data = rans.encode(ids, [1], np.array([len(ids)]))
    read = []

    class Counted(rans.Held):
        def read_at(self, at, n):
            read.append(n)
            return super().read_at(at, n)

    r = rans.Reader(Counted(data))
    opened = sum(read)
    assert np.array_equal(r.decode(5 * rans.BLOCK + 3, 5 * rans.BLOCK + 90), ids[5 * rans.BLOCK + 3 : 5 * rans.BLOCK + 90])
    assert sum(read) - opened < (len(data) - opened) / 30


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  spaces, ÀB\n\nand Ḥ́ lines", "", "x " * 50]
    e = tokens.Encoder(path)
    ids, counts = e.encode(pa.array(texts), 2)
    want = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert not e.chunked and tokens.Encoder(PATH).chunked
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
